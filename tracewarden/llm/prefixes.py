"""Prefix trie of conversations by truncation peeling.

Every conversation is reduced to its path: a key for each depth that stands for all turns up to it. From the greatest
depth downwards, conversations that end there are merged with the nodes that survive from below; then the last turn is
stripped and what is left is grouped again. A node is complete when its depth is reached, so its counts, leaves and
savings are added up while it is discovered.

A round strips several turns at once, half of those left, if the paths that share the round's lowest node are few enough
for one task; else fewer, down to a single turn, for which grouping with partial sums does all. So a frequent opening
makes more rounds, never a large task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.shared import WHITE, looked_up, saved

GROUP = 20
SHARED = 4
#: Paths under one lowest node that a task may peel at once; conv_ids in one piece of a list to be hashed.
TOGETHER, PIECE = 10_000, 4096
KEY = 16
ROOT = b"\0" * KEY
EMPTY = hashlib.sha256(b"").hexdigest()
RECORD = "length long, path binary, words array<long>, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
COLUMNS = [c.split()[0] for c in RECORD.split(", ")]
SIZED = pa.list_(pa.int64())


def turns(df: DataFrame) -> DataFrame:
    """conv_id and its turns in order, an array of (turn, role, digest, words). Rows without conv_id belong nowhere."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    words = F.size(F.regexp_extract_all(text, F.lit(WHITE.replace("[", "[^") + "+"), F.lit(0))).cast("long")
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    one = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), words.alias("words"))
    each = df.select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("one")).where("conv_id is not null")
    return each.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("own"))


def rebuilt(df: DataFrame, group: int = GROUP, shared: int = SHARED) -> DataFrame:
    """Each conversation with its group's opening in place of its own: the first crc32(conv_id) % ``shared`` turns are
    those of the group's first conversation."""
    own = turns(df)
    base = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("of"), F.slice("own", 1, shared - 1).alias("opening"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    joined = own.join(base, F.col("conv_id") - F.col("conv_id") % group == F.col("of"), "left")
    opening = F.slice(F.coalesce("opening", F.slice("own", 1, 0)), F.lit(1), h)
    rest = F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))
    return joined.select("conv_id", F.concat(opening, rest).alias("turns"))


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, length, path and words: KEY bytes of the path for each depth, a chained digest of the turns so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, lengths = [], []
            for digests in batch.column("digests").to_pylist():
                key, path = ROOT, bytearray()
                for digest in digests:
                    key = hashlib.md5(key + digest, usedforsecurity=False).digest()
                    path += key
                out.append(bytes(path))
                lengths.append(len(digests))
            columns = [batch.column("conv_id"), pa.array(lengths, pa.int64()), pa.array(out, pa.binary()), batch.column("words")]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "length", "path", "words"])

    plain = conversations.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.words").alias("words"))
    return plain.mapInArrow(run, "conv_id long, length long, path binary, words array<long>")


def key_at(depth: int | Column) -> Column:
    """The path's key at a depth of 1 or more."""
    start = (depth - 1) * KEY + 1
    return F.substring("path", F.lit(start) if isinstance(start, int) else start.cast("int"), F.lit(KEY))


def merged(records: DataFrame) -> DataFrame:
    """One record for each path. Map tasks add up first, so a frequent path is a row from each."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    return records.groupBy("length", "path").agg(F.first("words").alias("words"), F.min("conv_id").alias("conv_id"), *sums).select(*COLUMNS)


def lowest(records: DataFrame, high: int) -> int:
    """The depth to which a round from ``high`` strips: half, or as far as no node just above has too many paths."""
    low = high // 2
    while low < high - 1:
        most = records.where(F.col("length") > low).groupBy(key_at(low + 1).alias("k")).count().agg(F.max("count")).first()[0]
        if most is None or most <= TOGETHER:
            return low
        low = (low + high + 1) // 2
    return high - 1


def peeled(records: list[tuple], high: int, low: int) -> tuple[list[tuple], list[tuple]]:
    """The nodes of depth ``low`` + 1 to ``high``, and the records of depth ``low`` that survive."""
    levels: list[dict] = [{} for _ in range(high - low + 1)]

    def put(depth: int, path: bytes, words: list[int], conv: int, n: int, children: int, leaves: int, tokens: int) -> None:
        level, key = levels[depth - low], path[-KEY:]
        node = level.get(key)
        if node is None:
            level[key] = [path, words, conv, n, children, leaves, tokens]
        else:
            node[2] = min(node[2], conv)
            for i, more in enumerate((n, children, leaves, tokens)):
                node[3 + i] += more

    for record in records:
        put(*record)
    nodes = []
    for depth in range(high, low, -1):
        for key, (path, words, conv, n, children, leaves, tokens) in levels[depth - low].items():
            leaves = leaves if children else 1
            tokens += (n - 1) * words[depth - 1]
            above = path[:-KEY]
            nodes.append((key, above[-KEY:] or ROOT, depth, conv, n, children, leaves, tokens))
            put(depth - 1, above, words, conv, n, 1, leaves, tokens)
        levels[depth - low] = {}
    return nodes, [(low, path, words[:low], *rest) for path, words, *rest in levels[0].values()]


def round_of(records: DataFrame, high: int, low: int) -> DataFrame:
    """One round: rows are nodes (``key`` given) or surviving records (``path`` given)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for record in zip(*(batch.column(c).to_pylist() for c in COLUMNS)):
                lowest_key = record[1][low * KEY : (low + 1) * KEY]
                if lowest_key != last and len(held) >= TOGETHER:
                    yield rows(*peeled(held, high, low))
                    held = []
                held.append(record)
                last = lowest_key
        if held:
            yield rows(*peeled(held, high, low))

    def rows(nodes: list[tuple], alive: list[tuple]) -> pa.RecordBatch:
        key, parent, depth, *counts = zip(*nodes)
        length, path, words, *rest = zip(*alive)
        a, b = len(nodes), len(alive)
        binary = [key + (None,) * b, parent + (None,) * b, (None,) * a + path]
        longs = [depth + length] + [x + y for x, y in zip(counts, rest)]
        arrays = [pa.array(x, pa.binary()) for x in binary] + [pa.array([None] * a + list(words), SIZED)] + [pa.array(x, pa.int64()) for x in longs]
        return pa.RecordBatch.from_arrays(arrays, names=["key", "parent", "path", "words", "depth", *COLUMNS[3:]])

    dealt = records.withColumn("low_key", key_at(low + 1)).repartition("low_key").sortWithinPartitions("low_key").select(*COLUMNS)
    return dealt.mapInArrow(run, "key binary, parent binary, path binary, words array<long>, depth long, " + RECORD.split("array<long>, ")[1])


def joined_ids(ended: DataFrame) -> DataFrame:
    """key and ends_sha256: the hash of the conv_ids that end in each node, ascending. ``ended`` has key and conv_id.

    Ids are sorted over the whole table and joined piece by piece; a node's pieces then meet in order and are hashed one
    after the other, so a long list is never held.
    """

    def pieces(batches):
        key, ids = None, []

        def piece():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["key", "first", "ids"])

        for batch in batches:
            for k, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if ids and (k != key or len(ids) >= PIECE):
                    yield piece()
                    ids = []
                key = k
                ids.append(conv)
        if ids:
            yield piece()

    def hashes(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for k, text in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if k != key:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            yield _hashed(out)
        if state is not None:
            yield _hashed([(key, state.hexdigest())])

    sorted_ids = ended.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    cut = sorted_ids.mapInArrow(pieces, "key binary, first long, ids string")
    return cut.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashes, "key binary, ends_sha256 string")


def _hashed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["key", "ends_sha256"])


def with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with parent_conv_id."""
    parents = nodes.select(F.col("key").alias("of"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    return looked_up(nodes, "parent", parents, "of", "n", nodes.count())


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of ``conversations`` (conv_id, turns): key, parent, depth, conv_id,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ends = saved(paths(conversations), "paths")
    zero = F.lit(0).cast("long")
    records = ends.select("length", "path", "words", "conv_id", F.lit(1).cast("long").alias("n_convs"), zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"))
    ended = saved(merged(records), "ended", tidy=False)
    high = ended.agg(F.max("length")).first()[0] or 0
    alive, nodes = None, []
    while high:
        here = ended.where(F.col("length") <= high)
        now = here if alive is None else merged(alive.unionByName(here))
        low = lowest(now, high)
        out = saved(round_of(now.where(F.col("length") > low), high, low), "round", tidy=False)
        nodes.append(out.where("key is not null").drop("path", "words"))
        alive = out.where("path is not null").withColumnRenamed("depth", "length").select(*COLUMNS)
        high, ended = low, ended.where(F.col("length") <= low)
    top = ended.where("length = 0") if alive is None else alive.unionByName(ended.where("length = 0"))
    root = top.groupBy().agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in COLUMNS[4:])).where("conv_id is not null")
    root = root.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long"))
    found = root.select(F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), zero.alias("depth"), *COLUMNS[3:])
    for more in nodes:
        found = found.unionByName(more)
    found = with_parents(saved(found, "nodes", tidy=False))
    last = F.when(F.col("length") == 0, F.lit(ROOT)).otherwise(key_at(F.col("length")))
    hashed = joined_ids(ends.select(last.alias("key"), "conv_id")).withColumnRenamed("key", "at")
    return found.join(hashed, F.col("key") == F.col("at"), "left").drop("at").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))


def prefix_trie(df: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations, a row for each node: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Turns stand in the order of ``turn``, missing ones first; ties by role, then by a digest of role and text. Repeated
    rows are turns of their own. A missing role or text is empty, rows without conv_id are left out, other columns are
    ignored. An empty table gives no rows. A conversation's path (24 bytes for a turn) is held as one value.
    """
    return trie(rebuilt(df)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: CRC-32 of a decimal number: each byte is followed by eight steps (-1) of the reflected polynomial.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length({c}::VARCHAR) + 1),
    lambda i: list_concat([ascii(substr({c}::VARCHAR, i::BIGINT, 1))::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
    lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END), 4294967295::BIGINT)"""

ORACLE = f"""
WITH own AS (
    SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''),
        md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS ts
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (SELECT *, ({_CRC.format(c="conv_id")} % 4)::BIGINT AS h FROM own),
re AS (
    SELECT a.conv_id, list_concat(coalesce(b.ts, [])[1:a.h], a.ts[a.h + 1:]) AS ts
    FROM h a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20
), member AS (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS depth FROM re),
node AS (
    SELECT depth, ts[1:depth] AS p, min(conv_id) AS conv_id, count(*) AS n_convs,
        coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(ts) = depth), '') AS ends
    FROM member GROUP BY depth, ts[1:depth]
), kids AS (SELECT depth - 1 AS depth, p[1:depth - 1] AS p, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1, 2),
whole AS (
    SELECT node.*, coalesce(k.n, 0) AS n_children,
        CASE WHEN node.depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(node.p[node.depth].t, '[^\\x20\\x09-\\x0D]+')) END AS tokens
    FROM node LEFT JOIN kids k ON k.depth = node.depth AND k.p = node.p
), above AS (SELECT unnest(range(0, depth + 1)) AS d, p, n_children, tokens FROM whole),
tree AS (SELECT d AS depth, p[1:d] AS p, sum((n_children = 0)::INT) AS n_leaves, sum(tokens) AS saved FROM above GROUP BY 1, 2)
SELECT w.conv_id, w.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children,
    t.n_leaves::BIGINT AS n_leaves, t.saved::BIGINT AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM whole w JOIN tree t ON t.depth = w.depth AND t.p = w.p
LEFT JOIN node up ON up.depth = w.depth - 1 AND up.p = w.p[1:w.depth - 1]
"""
