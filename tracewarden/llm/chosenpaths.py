"""Near-duplicates by a chosen-path set similarity join.

A tree branches on minwise tokens: at every level a document goes to ``CHOICES`` children, each named by the token of its
set that is least under that child's hash. Two sets of likeness s choose alike with a probability of s, so with two
choices a level they stay together somewhere down to any depth with a probability of 0.968 at least (the fixed point of
p = 1 - (1 - s p)^2 at s = 0.85). ``TREES`` independent trees miss one pair in a million at the threshold. Nodes of few
documents are compared exhaustively, on whole sets; larger ones are branched further.

Three rules keep the work in proportion to the documents, without losing a link between components:

- A node whose documents are all connected already, or were all compared in one earlier node, is done. Later trees
  therefore only see what earlier ones left.
- Before sets travel, sketches (the least token of each of 128 ranges) drop documents that have no likely partner.
- A node too large to be compared is dealt to parts, each with the same few pivots. Copies of one text connect through
  the pivots at once. Documents that are still apart from the node's main component are compared with every part, in
  blocks: as soon as they are few or less than half, which settles the node, and on the last level in any case.
  (Branching would not split such a node: its documents choose alike.)
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.shared import NO_ID, components, documents, looked_up, partitions, saved

WORDS, LIKENESS = 3, (85, 100)
#: Trees of the first and the second pass.
PASSES = ((0,), (1, 2, 3))
TREES, LEVELS, CHOICES = 4, 3, 2
#: Sets that are compared in one node; pivots in each part of a larger one.
LEAF, PIVOTS = 128, 4
#: Blocks of LEAF documents apart from the main component up to which a large node is settled instead of branched.
BLOCKS = 4
#: Documents of a block and of a part that it meets: so many times LEAF, as far as their sets fit a task. Rows fall by it.
WIDER = 4
#: Ranges of a sketch. Pairs are dropped below a likeness of LIKELY or, if less, so many standard deviations under LIKENESS.
RANGES, LIKELY, DEVIATIONS = 128, 0.65, 6
SEED = 12
#: Tokens hashed at once, bytes of an output batch, of the sets that one task compares; rows of a task that reads sketches.
CHUNK, BATCH, TASK, ROWS = 1 << 12, 1 << 24, 1 << 25, 20_000
SPREAD = 0x9E3779B97F4A7C15

_random = np.random.default_rng(SEED)
FACTORS = _random.integers(0, 1 << 63, (TREES * LEVELS * CHOICES, 1), np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _random.integers(0, 1 << 63, (TREES * LEVELS * CHOICES, 1), np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(text: str | None, known: dict[bytes, int], words: int = WORDS) -> np.ndarray:
    """The different hashes of the word shingles in order; empty without a word. ``known`` remembers words' hashes."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lowers A-Z, splits at \x20 and \x09-\x0D
    if not found:
        return np.zeros(0, np.uint64)
    if len(known) > 1 << 20:
        known.clear()
    for word in set(found).difference(known):
        known[word] = xxhash.xxh64_intdigest(word, seed=SEED)
    each = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    width = min(words, len(found))
    count = len(found) - width + 1
    out = np.full(count, width, np.uint64)
    for k in range(width):
        out = _mixed(out * np.uint64(SPREAD) + each[k : k + count])
    return np.unique(out)


def picks(values: np.ndarray) -> np.ndarray:
    """The least value under each choice's hash, as longs."""
    parts = [_mixed(FACTORS * values[at : at + CHUNK] + TERMS).min(axis=1) for at in range(0, len(values), CHUNK)]
    return np.min(parts, axis=0).view(np.int64)


def sketch(values: np.ndarray) -> bytes:
    """A byte for each range of hashes: of the least value in it, zero if there is none."""
    edges = np.arange(RANGES, dtype=np.uint64) << np.uint64(64 - int(math.log2(RANGES)))
    at = np.searchsorted(values, edges)
    ends = np.r_[at[1:], len(values)]
    first = values[np.minimum(at, len(values) - 1)]
    return np.where(at < ends, first % np.uint64(255) + np.uint64(1), np.uint64(0)).astype(np.uint8).tobytes()


def described(df: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, a hash of its text, and of its set a print, the size, the choices and the sketch; a row for each of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            prints, sizes, chosen, sketches = [], [], [], []
            for text in batch.column("text").to_pylist():
                values = tokens(text, known, words)
                prints.append(xxhash.xxh128_digest(values.tobytes()))
                sizes.append(len(values))
                chosen.append(picks(values).tolist() if len(values) else None)
                sketches.append(sketch(values) if len(values) else None)
            columns = [batch.column("doc_id"), batch.column("row"), pa.array(prints, pa.binary()), pa.array(sizes, pa.int64())]
            columns += [pa.array(chosen, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "print", "size", "picks", "sketch"])

    hashed = documents(df).withColumn("row", F.xxhash64(F.coalesce("text", F.lit(""))))
    return hashed.mapInArrow(run, "doc_id long, row long, print binary, size long, picks array<long>, sketch binary")


def likely(sizes: np.ndarray, sketches: np.ndarray, parts: np.ndarray, known: np.ndarray) -> list[np.ndarray]:
    """Groups of positions that likely pairs connect: neither connected nor compared yet, of sizes and sketches near enough."""
    over, under = LIKENESS
    small, large = np.minimum.outer(sizes, sizes), np.maximum.outer(sizes, sizes)
    # The share of equal ranges among those held is a sample without replacement of the likeness, whatever the sets' size.
    held = np.arange(RANGES + 1)
    least = np.minimum(LIKELY * held, over / under * held - DEVIATIONS * np.sqrt(over / under * (1 - over / under) * held))
    may = (parts[:, None] != parts[None, :]) & (known[:, None] != known[None, :]) & (under * small >= over * large)
    for i in np.flatnonzero(may.any(axis=1)):
        js = i + 1 + np.flatnonzero(may[i, i + 1 :])
        if len(js):
            same = ((sketches[js] == sketches[i]) & (sketches[i] > 0)).sum(axis=1)
            off = js[same < least[((sketches[js] > 0) | (sketches[i] > 0)).sum(axis=1)]]
            may[i, off] = may[off, i] = False
    out, free = [], may.any(axis=1)
    while free.any():
        queue, group = [int(np.argmax(free))], []
        free[queue[0]] = False
        while queue:
            p = queue.pop()
            group.append(p)
            found = np.flatnonzero(may[p] & free)
            free[found] = False
            queue += found.tolist()
        out.append(np.array(group))
    return out


def connected(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of positions that connect all sets of a likeness of ``LIKENESS`` or more: breadth first, each is taken once."""
    over, under = LIKENESS
    counts = np.fromiter(map(len, sets), np.int64, len(sets))
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(flat, np.cumsum(counts)[:-1])
    mark = np.zeros(len(vocabulary), bool)
    rest, sizes, out = np.arange(len(sets)), counts, []
    while len(rest) > 1:
        queue, flat, rest, sizes = [int(rest[0])], flat[sizes[0] :], rest[1:], sizes[1:]
        while queue and len(rest):
            p = queue.pop()
            mark[own[p]] = True
            common = np.add.reduceat(mark[flat], np.cumsum(sizes) - sizes, dtype=np.int64)
            mark[own[p]] = False
            near = under * common >= over * (sizes + counts[p] - common)
            if near.any():
                found = rest[near].tolist()
                out += [(p, q) for q in found]
                queue += found
                flat, rest, sizes = flat[np.repeat(~near, sizes)], rest[~near], sizes[~near]
    return out


class Join:
    """The state of one run: the different sets, the links found so far and the components they make."""

    def __init__(self, df: DataFrame, words: int = WORDS):
        self.texts, self.words, self.spark = documents(df), words, df.sparkSession
        id_ = F.coalesce("doc_id", F.lit(NO_ID))
        self.rows = saved(described(df, words), "described")
        first = [F.first(c).alias(c) for c in ("size", "picks", "sketch")]
        of = self.rows.where("size > 0").groupBy("print").agg(F.min(F.struct(id_.alias("id"), "row")).alias("least"), *first)
        self.sets = saved(of, "sets")
        self.links: DataFrame | None = None
        self.component: DataFrame | None = None
        self.settled: DataFrame | None = None

    def labelled(self) -> DataFrame:
        """print, size, its component so far (``part``, a print that stands for it), and ``known``: the largest node that it
        was settled in, else the component. Documents of one part or one known node need no comparison."""
        found = self.sets.select("print", "size")
        if self.component is None:
            return found.select("print", "size", F.col("print").alias("part"), F.col("print").alias("known"))
        found = found.join(self.component, F.col("print") == F.col("node"), "left").select("print", "size", F.coalesce("component", "print").alias("part"))
        if self.settled is None:
            return found.withColumn("known", F.col("part"))
        done = self.settled.select(F.col("print").alias("of"), F.unhex(F.hex("in.node")).alias("done"))
        return found.join(done, F.col("print") == F.col("of"), "left").select("print", "size", "part", F.coalesce("done", "part").alias("known"))

    def settle(self, members: DataFrame) -> None:
        """Remember the members of large nodes all pairs of which have been compared."""
        new = members.select("print", F.struct("count", "node").alias("in"))
        every = new if self.settled is None else new.union(self.settled)
        self.settled = saved(every.groupBy("print").agg(F.max("in").alias("in")), "settled", tidy=False)

    def add(self, found: DataFrame) -> None:
        # Texts that are not wanted should not be shuffled: Spark may filter them by a Bloom filter of bounded size.
        key = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "0")
        try:
            found = saved(found, "links", tidy=False)
        finally:
            self.spark.conf.set(key, before)
        if not found.isEmpty():
            self.links = found if self.links is None else self.links.union(found)
            self.component = saved(components(self.links, tidy=False), "component", tidy=False)

    # --- nodes ---------------------------------------------------------------------------

    def children(self, members: DataFrame, level: int) -> DataFrame:
        """(tree, node, print) one level down; ``members`` has tree, node and print."""
        chosen = members if level == 0 else members.join(self.sets.select("print", "picks"), "print")
        at = (F.col("tree") * LEVELS + level) * CHOICES
        named = [F.xxhash64("node", F.lit(level), F.lit(c), F.get("picks", at + c)) for c in range(CHOICES)]
        return chosen.select("tree", "print", F.explode(F.array(*named)).alias("node")).select("tree", "node", "print")

    def counted(self, members: DataFrame) -> DataFrame:
        """Members of nodes that are not done, with what labelled() says, the node's ``count`` and main group, the most
        frequent ``known``, and how many members are ``off`` it."""
        total = members.count()
        shared = members.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select(F.col("node").alias("of"), "n", F.col("n").alias("count"))
        met = looked_up(members, "node", saved(shared, "shared", tidy=False), "of", "n", total).where("count is not null")
        labelled = saved(met.join(self.labelled(), "print"), "labelled", tidy=False)
        if self.component is None:
            return labelled.withColumns({"main": F.lit(None).cast("binary"), "off": F.col("count") - 1})
        groups = labelled.groupBy("node", "known").agg(F.count("*").alias("m"), F.min("part").alias("low"), F.max("part").alias("high"))
        nodes = groups.groupBy("node").agg(
            F.sum("m").alias("n"), F.count("*").alias("groups"), F.min("low").alias("low"), F.max("high").alias("high"), F.max(F.struct("m", "known")).alias("most"))
        open_ = nodes.where("groups > 1 and low < high").select(F.col("node").alias("of"), "n", F.col("most.known").alias("main"), (F.col("n") - F.col("most.m")).alias("off"))
        found = looked_up(labelled, "node", saved(open_, "nodes", tidy=False), "of", "n", total).where("off is not null")
        return saved(found, "counted", tidy=False)

    def small(self, members: DataFrame) -> DataFrame:
        """(grp, print) for nodes that are compared as they are."""
        return members.where(F.col("count") <= LEAF).select(F.col("node").alias("grp"), "print")

    def few(self, members: DataFrame) -> DataFrame:
        """Members of large nodes that are settled now."""
        return members.where((F.col("count") > LEAF) & F.col("main").isNotNull() & ((F.col("off") <= BLOCKS * LEAF) | (2 * F.col("off") <= F.col("count"))))

    def many(self, members: DataFrame) -> DataFrame:
        """Members of large nodes that are not."""
        return members.where((F.col("count") > LEAF) & (F.col("main").isNull() | (F.col("off") > BLOCKS * LEAF) & (2 * F.col("off") > F.col("count"))))

    def parts(self, large: DataFrame) -> DataFrame:
        """(grp, print): members of large nodes by parts, each with the node's pivots."""
        h = F.xxhash64("print", F.lit(SEED))
        large = large.withColumn("in_all", F.ceil(F.col("count") / LEAF))
        each = large.select(F.xxhash64("node", F.pmod(h, "in_all")).alias("grp"), "print")
        lowest = large.groupBy("node").agg(F.max("in_all").alias("in_all"), *(
            F.min(F.when(F.pmod(h, F.lit(PIVOTS)) == k, F.struct(h.alias("h"), F.col("print").alias("print")))).alias(f"p{k}") for k in range(PIVOTS)))
        pivots = lowest.select("node", "in_all", F.explode(F.array(*(F.col(f"p{k}.print") for k in range(PIVOTS)))).alias("print")).where("print is not null")
        everywhere = pivots.select("print", F.explode(F.sequence(F.lit(0).cast("long"), F.col("in_all") - 1)).alias("at"), "node")
        return each.union(everywhere.select(F.xxhash64("node", "at").alias("grp"), "print"))

    def apart(self, large: DataFrame) -> DataFrame:
        """(grp, print): what is not in its node's main group meets every part of the node, in blocks; without a main
        group all do. Each document comes once for every block or part that it meets, so these are as large as sets allow."""
        # Two sides of mean sets fill a task; the mean is the same for both kinds of members.
        mean = large.groupBy("node").agg((F.sum("size") / F.count("*")).alias("mean"))
        large = large.join(mean, "node")
        side = F.greatest(F.lit(LEAF), F.least(F.lit(WIDER * LEAF), F.floor(F.lit(TASK // 16) / F.col("mean"))))
        placed = large.select(
            "node", "print", F.coalesce(F.col("known") != F.col("main"), F.lit(True)).alias("is_off"), F.ceil(F.col("count") / side).alias("in_all"), F.ceil(F.col("off") / side).alias("blocks"))
        others = placed.select("node", "print", F.pmod(F.xxhash64("print", F.lit(SEED + 1)), "in_all").alias("at"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        off = placed.where("is_off").withColumn("block", F.pmod(F.xxhash64("print", F.lit(SEED + 2)), "blocks"))
        those = off.select("node", "print", F.explode(F.sequence(F.lit(0).cast("long"), F.col("in_all") - 1)).alias("at"), "block")
        return others.union(those).select(F.xxhash64("node", "at", "block").alias("grp"), "print")

    # --- comparison ------------------------------------------------------------------------

    def pruned(self, groups: DataFrame) -> DataFrame:
        """(grp, print) of groups that likely pairs connect; of groups with equal members one."""
        groups = saved(groups.distinct(), "groups", tidy=False)
        count = max(partitions(self.spark), groups.count() // ROWS)
        rows = groups.join(self.sets.select("print", "sketch"), "print").join(self.labelled(), "print")

        def run(table: pa.Table) -> pa.Table:
            grp = table.column("grp").to_numpy()
            order = np.argsort(grp, kind="stable")
            table, grp = table.take(order), grp[order]
            sizes = table.column("size").to_numpy()
            prints = table.column("print").to_pylist()
            numbers: dict[bytes, int] = {}
            parts, known = (np.array([numbers.setdefault(p, len(numbers)) for p in table.column(c).to_pylist()]) for c in ("part", "known"))
            sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, RANGES)
            cuts = np.flatnonzero(np.diff(grp)) + 1
            names, found = [], []
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(grp)]):
                for n, group in enumerate(likely(sizes[a:b], sketches[a:b], parts[a:b], known[a:b])):
                    name = xxhash.xxh64_intdigest(int(grp[a]).to_bytes(8, "little", signed=True), seed=n) >> 1
                    names += [name] * len(group)
                    found += [prints[a + i] for i in group]
            return pa.table({"grp": pa.array(names, pa.int64()), "print": pa.array(found, pa.binary())})

        dest = rows.withColumn("dest", F.pmod("grp", F.lit(count)))
        likely_ones = saved(dest.groupBy("dest").applyInArrow(run, "grp long, print binary"), "likely", tidy=False)
        members = likely_ones.groupBy("grp").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("print")).alias("mixed"), F.min("print").alias("low"), F.max("print").alias("high"))
        one = members.groupBy("n", "mixed", "low", "high").agg(F.min("grp").alias("grp"))
        return likely_ones.join(one.select("grp"), "grp", "left_semi")

    def compared(self, groups: DataFrame) -> DataFrame:
        """(a, b): links that connect all sets which are alike and share a group, confirmed on the whole sets."""
        groups, words = saved(self.pruned(groups), "pruned", tidy=False), self.words
        wanted = groups.groupBy("print").agg(F.collect_list("grp").alias("groups")).join(self.sets.select("print", "size", "least"), "print")
        wanted = saved(wanted.select("least.id", "least.row", "print", "groups", "size"), "wanted", tidy=False)
        total = wanted.agg(F.sum(F.size("groups") * F.col("size"))).first()[0] or 0
        count = max(partitions(self.spark), 8 * total // TASK)

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[bytes, int] = {}
            for batch in batches:
                out, held = [], 0
                for text, key, names in zip(*(batch.column(c).to_pylist() for c in ("text", "print", "groups"))):
                    blob = tokens(text, known, words).tobytes()
                    for name in names:
                        out.append((name % count, name, key, blob))
                        held += len(blob)
                        if held >= BATCH:
                            yield _batch(out)
                            out, held = [], 0
                yield _batch(out)

        def verify(table: pa.Table) -> pa.Table:
            groups, a, b = {}, [], []
            for name, key, blob in zip(*(table.column(c) for c in ("grp", "print", "blob"))):
                groups.setdefault(name.as_py(), {})[key.as_py()] = np.frombuffer(blob.as_buffer(), np.uint64)
            for group in groups.values():
                names = list(group)
                for p, q in connected(list(group.values())):
                    a.append(min(names[p], names[q]))
                    b.append(max(names[p], names[q]))
            return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

        texts = self.texts.select("text", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"))
        sent = texts.join(wanted.where("size > 0").drop("size"), ["id", "row"]).dropDuplicates(["id", "row"]).select("text", "print", "groups")
        sent = sent.mapInArrow(spread, "dest long, grp long, print binary, blob binary")
        return sent.groupBy("dest").applyInArrow(verify, "a binary, b binary").distinct()

    # --- passes ------------------------------------------------------------------------------

    def run(self, trees: tuple[int, ...]) -> None:
        """One pass: the top nodes of ``trees``, then what is left of the large ones, level by level."""
        roots = self.sets.select(F.explode(F.array(*(F.lit(t) for t in trees))).alias("tree"), F.col("tree").cast("long").alias("node"), "print", "picks")
        top = self.counted(saved(self.children(roots, 0), "members"))
        self.add(self.compared(self.small(top).union(self.apart(self.few(top))).union(self.parts(self.many(top)))))
        self.settle(self.few(top))
        groups, large, now_settled = None, self.many(top).select("tree", "node", "print"), []
        for level in range(1, LEVELS + 1):
            if large.isEmpty():
                break
            now = self.counted(large)
            done = self.few(now) if level < LEVELS else now.where(F.col("count") > LEAF)
            now_settled.append(done)
            new = self.apart(done) if level == 1 else self.apart(done).union(self.small(now))
            groups = new if groups is None else groups.union(new)
            if level < LEVELS:
                large = saved(self.children(self.many(now).select("tree", "node", "print"), level), "members", tidy=False)
        if groups is not None:
            self.add(self.compared(groups))
            for done in now_settled:
                self.settle(done)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"dest": pa.int64(), "grp": pa.int64(), "print": pa.binary(), "blob": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))


def near_duplicates(df: DataFrame, words: int = WORDS) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept.

    Documents link if the Jaccard likeness of their sets of word shingles is ``LIKENESS`` or more, and component_id is
    the smallest doc_id reachable. A text of fewer words is one shingle; null texts and those without a word have an
    empty set and link with nothing, so their component is their own. Equal sets are one set, however many texts have
    it. Repeated rows stay. A missing doc_id stays missing and names no component unless all ids of it are missing.
    Other columns are left aside. An empty table gives no rows.
    """
    join = Join(df, words)
    for trees in PASSES:
        join.run(trees)
    lowest = join.rows.where("size > 0").groupBy("print").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    named = saved(lowest.join(join.labelled(), "print"), "named")
    least = named.groupBy("part").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    prints = looked_up(named.select("print", "part", F.col("n").alias("times")), "part", least.withColumnRenamed("part", "of"), "of", "n", named.count())
    table = saved(prints.select(F.col("print").alias("of"), "component_id", "times"), "classes")
    found = looked_up(join.rows.select("doc_id", "size", "print"), "print", table, "of", "times", join.rows.count())
    id_ = F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("size").alias("n_shingles"), id_.alias("component_id"), F.col("doc_id").eqNullSafe(id_).alias("kept"))


ORACLE = r"""
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS k, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
    FROM documents
), s AS (
    SELECT k, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS held
    FROM d
), each AS MATERIALIZED (SELECT k, len(held) AS n, unnest(held) AS t FROM s),
links AS MATERIALIZED (
    SELECT a.k AS a, b.k AS b FROM each a JOIN each b ON a.t = b.t AND a.k <> b.k AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (SELECT k AS a, k AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_id AS (SELECT r.a AS k, min(s.doc_id) AS component_id FROM reach r JOIN s ON s.k = r.b GROUP BY r.a)
SELECT doc_id, len(held)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM s JOIN least_id USING (k)
"""
