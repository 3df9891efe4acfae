"""Mixing sources to target weights, by blocks of words; DataFrame operations only.

The words of each source are one stream, cut into blocks of fixed length. A source's target is turned into a number of
slots; slots are dealt to output shards at random and lead, through a pseudorandom permutation of the source's block
numbers, to the blocks to take. Blocks and slots meet by (source, block).

The draw is a multinomial one given its totals: a permutation of all slots gives each shard its counts per source
(drawn without replacement), so that every source meets its target exactly instead of within a few standard
deviations. Permutations are swap-or-not shuffles (Hoang, Morris and Rogaway 2012): bijections of any range, computed
row by row from hashes, the same in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.shared import NO_ID, keyed, let, partitions, saved, unkeyed

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
#: Words in a block, slots in an output shard, slots made from one row, rounds of a permutation.
BLOCK, SHARD, CHUNK, ROUNDS = 32, 65_536, 4096, 12
SEED = 7
#: Parts that a source's rows are summed in, one after the other: a hot source is many keys.
PARTS = 4096


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """The image of ``x`` under a pseudorandom permutation of 0 to n - 1 that ``key`` selects."""

    def step(value: Column, turn: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, turn), n) - value + n, n)
        swap = F.xxhash64(key, turn, F.greatest(value, partner)) % 2 == 0
        return F.when(swap, partner).otherwise(value)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x, step)


def rows_of(df: DataFrame) -> DataFrame:
    """doc_id, row (hash of the text), source, size (words) of every document; saved, so that texts are read once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return saved(
        df.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.xxhash64(text).alias("row"),
            F.col("source").cast("string").alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        ),
        "sizes",
    ).withColumn("part", F.pmod(F.xxhash64("doc_id", "row"), F.lit(PARTS)))


def sources(rows: DataFrame, block: int = BLOCK, share: float = SHARE) -> DataFrame:
    """One row for each source, in order of code points, null last: no, source_size, target, blocks, slots, first (its
    first slot in the whole), total (slots of all).

    A target is the source's weight times one factor, or ``MOST`` times its size if that is less: resharing the excess
    by weight until none is above ends there. The factor follows from one pass over the sources in order of how early
    they reach their limit.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("no"), F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = sizes.withColumn("no", F.row_number().over(everything) - 1).withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "no")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    factor = (F.lit(share) * F.sum("source_size").over(whole) - full) / left
    filled = ranked.withColumn("factor", factor)
    final = F.first(F.when(F.col("factor") * F.col("weight") <= F.col("cap"), F.col("factor")), ignorenulls=True).over(whole)
    aimed = filled.withColumn("target", F.round(F.least(F.col("cap").cast("double"), F.col("weight") * final), 6))
    blocks = F.ceil(F.col("source_size") / block)
    slots = F.when(F.col("source_size") > 0, F.round(F.col("target") * blocks / F.col("source_size"))).otherwise(0).cast("long")
    counted = aimed.withColumn("blocks", blocks).withColumn("slots", F.least(slots, MOST * blocks))
    before = F.coalesce(F.sum("slots").over(Window.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.select("source", "no", "source_size", "target", "blocks", "slots", before.alias("first"), F.sum("slots").over(whole).alias("total"))


def slots(table: DataFrame, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """One row for each slot of the mix: no, block, pass (0, 1), position in the whole output and its shard."""
    chunks = table.where("slots > 0").select("no", "blocks", "slots", "first", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / CHUNK))).alias("chunk"))
    last = F.least(F.col("slots"), (F.col("chunk") + 1) * CHUNK) - 1
    each = chunks.repartition(partitions(table.sparkSession), "no", "chunk").select("no", "blocks", "first", "total", F.explode(F.sequence(F.col("chunk") * CHUNK, last)).alias("slot"))
    turn = F.floor(F.col("slot") / F.col("blocks"))
    key = F.xxhash64(F.lit(seed), F.col("no"), turn)
    position = permuted(F.col("first") + F.col("slot"), F.col("total"), F.lit(seed))
    dealt = each.select("no", permuted(F.pmod("slot", "blocks"), F.col("blocks"), key).alias("block"), turn.alias("pass"), position.alias("position"))
    return dealt.withColumn("shard", F.floor(F.col("position") / shard))


def placed(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Each document's place in its source's stream: rows with no, start, source_size, target."""
    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("sum"))
    base = F.coalesce(F.sum("sum").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sums.select("source", "part", base.alias("base"))
    named = table.select(F.col("source").alias("named"), "no", "source_size", "target")
    bases = bases.join(named, F.col("source").eqNullSafe(F.col("named"))).select(F.col("source").alias("of"), F.col("part").alias("at"), "base", "no", "source_size", "target")
    inside = F.sum("size").over(Window.partitionBy("source", "part").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, -1))
    laid = rows.withColumn("inside", F.coalesce(inside, F.lit(0)))
    joined = laid.join(bases, laid.source.eqNullSafe(F.col("of")) & (laid.part == F.col("at")))
    return joined.select("doc_id", "row", "size", "no", (F.col("base") + F.col("inside")).alias("start"), "source_size", "target")


def pieces(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each block that a document reaches into: block, words (of the document in it). Empty ones have none."""
    end = F.col("start") + F.col("size")
    each = docs.where("size > 0").select("*", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("block"))
    low, high = F.greatest("start", F.col("block") * block), F.least(end, (F.col("block") + 1) * block)
    return each.select("*", (low - F.col("start")).alias("from"), (high - low).alias("words"))


def taken(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target (its source's), taken (words the mix takes, repeats
    counted).

    Null and empty texts have size 0 and are never taken; a null source is a source of its own, the last. Repeated rows
    count as often as they occur. Sources without words have target 0. An empty table gives no rows.
    """
    rows = rows_of(df)
    table = saved(sources(rows, block), "sources")
    docs = saved(placed(rows, table), "placed")
    counts = slots(table).groupBy("no", "block").agg(F.count("*").alias("times"))
    columns = ["doc_id", "row", "no", "start", "size", "source_size", "target"]
    # The planner takes the slots for as few as the sources they come from: no broadcast.
    met = pieces(docs, block).join(counts.hint("merge"), ["no", "block"], "left")
    some = met.groupBy(*columns).agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    none = docs.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"))
    return some.union(none).select("doc_id", "size", "source_size", "target", "taken")


def _more_than(n: int):
    return lambda part: part["times"] > n


def mixed(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix as documents: for each pass the parts of a document that are taken, with its other columns; n_chars, if
    there is one, follows the text. Documents of which nothing is taken are gone, parts taken twice stand in two rows."""
    rows = rows_of(df)
    table = saved(sources(rows, block), "sources")
    docs = placed(rows, table)
    counts = slots(table).groupBy("no", "block").agg(F.count("*").alias("times"))
    met = pieces(docs, block).join(counts.hint("merge"), ["no", "block"])
    # A document's parts are bounded by its text; equal rows have their starts apart.
    each = met.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "row", "start").agg(F.sort_array(F.collect_list(F.struct("from", "words", "times"))).alias("parts"))
    plans = saved(each.groupBy("id", "row").agg(F.sort_array(F.collect_list(F.struct("start", "parts"))).alias("plans")), "plans")
    nth = F.row_number().over(Window.partitionBy("id", "row").orderBy("id"))
    joined = keyed(df).join(plans, ["id", "row"]).withColumn("plan", F.get(F.col("plans")["parts"], nth - 1))
    # Words with the white space after them; a leading run of it goes.
    white = r"\x20\x09-\x0D"
    text = F.regexp_replace(F.col("doc.text").cast("string"), f"^[{white}]+", "")

    def chosen(words: Column) -> Column:
        passes = []
        for n in range(MOST):
            parts = F.filter("plan", _more_than(n))
            passes.append(F.array_join(F.flatten(F.transform(parts, lambda p: F.slice(words, (p["from"] + 1).cast("int"), p["words"].cast("int")))), ""))
        return F.array(*passes)

    # The text is split once, however many parts are taken from it.
    texts = let(F.split(text, f"(?<=[{white}])(?=[^{white}])"), chosen)
    out = joined.select("doc", F.explode(texts).alias("mixed")).where("mixed != ''")
    changed = {"text": F.col("mixed")}
    if "n_chars" in df.columns:
        changed["n_chars"] = F.length("mixed").cast(df.schema["n_chars"].dataType)
    return unkeyed(out, df.columns, **changed)
