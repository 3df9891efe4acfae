"""SpotSigs document fingerprints (Theobald, Siddharth and Paepcke 2008); DataFrame operations only.

An anchor is a common word; its signature is the anchor with the chain of the next content words, anchors skipped.
Prose is full of anchors, lists and menus hold few, so a fingerprint follows a document's prose. Fingerprints are the
sets of a document's hashed signatures. Sets whose sizes lie too many length partitions apart cannot be alike and are
not compared; the rest are compared by Jaccard's measure.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.shared import documents, let

#: Anchors, our own choice of very common words: English, German, French, Spanish.
ANCHORS = (
    "the a an of and to in is that it was for on are with as at be by from this have or not "
    "der die das und ist von zu mit den ein eine nicht sich auch auf für im dem des als "
    "le la les un une et est en du que qui dans pour par sur pas au plus ce il "
    "el los las y es por con para se lo su como más del una no al"
).split()
CHAIN = 2
#: Ratio between neighbouring length partitions; likeness below LEAST may be given as 0.
RATIO, LEAST = 0.8, 0.05
#: Documents in one bucket of neighbours, and buckets at most.
BUCKET, BUCKETS = 2000, 65_536


def signatures(text: Column, anchors: list[str] = ANCHORS, chain: int = CHAIN) -> Column:
    """The sorted set of a text's signatures as 32-bit numbers. A text without any (null and empty ones too) has its
    whole hash as its only signature, so that only equal texts share it."""

    def of(words: Column) -> Column:
        stops = F.filter(F.transform(words, lambda w, i: F.when(w.isin(anchors), i)), lambda i: i.isNotNull())
        content = F.filter(words, lambda w: ~w.isin(anchors))

        # Before the k-th anchor, at word p, stand p - k content words.
        def sign(p: Column, k: Column, c: Column) -> Column:
            return F.hash(F.get(words, p), *(F.get(c, p - k + n) for n in range(chain)))

        def chained(c: Column) -> Column:
            signs = F.transform(stops, lambda p, k: F.when(p - k + chain <= F.size(c), sign(p, k, c)))
            return F.filter(signs, lambda s: s.isNotNull())

        return let(content, chained)

    whole = F.array(F.hash(F.coalesce(text, F.lit(""))))
    found = let(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0), of)
    return let(found, lambda s: F.when(F.size(s) > 0, F.sort_array(F.array_distinct(s))).otherwise(whole))


def printed(found: Column) -> Column:
    """A set of signatures as text: eight hex digits each."""
    return F.array_join(F.transform(found, lambda s: F.lpad(F.right(F.lower(F.hex(s.cast("long"))), F.lit(8)), 8, "0")), "")


def length_partition(found: Column) -> Column:
    return F.floor(F.log(F.size(found)) / math.log(1 / RATIO))


def likeness(a: Column, b: Column, least: float = LEAST) -> Column:
    """Jaccard's measure of two sets; 0 without comparing where their length partitions rule ``least`` out."""
    apart = F.abs(length_partition(a) - length_partition(b)) - 1
    common = F.size(F.array_intersect(a, b))
    measure = let(common, lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when(apart * math.log(1 / RATIO) > math.log(1 / least), F.lit(0.0)).otherwise(measure)


def following(df: DataFrame, order: str, bucket: int = BUCKET) -> DataFrame:
    """``df`` with the struct ``next``: the row after each in descending ``order`` (a long that is not null), ties by
    the column ``row``; after the last the first.

    No window spans the table: rows are dealt to buckets by bounds between which about as many rows lie, and the first
    row of each bucket also visits the bucket before.
    """
    count = df.count()
    wanted = min(BUCKETS, max(1, count // bucket))
    bounds = []
    if wanted > 1:
        shares = [k / wanted for k in range(1, wanted)]
        bounds = sorted(set(df.select(F.percentile_approx(order, shares, max(10_000, 4 * wanted))).first()[0]))
    # The number of bounds at or below the value, by bisection.
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)] if bounds else []
    place = F.lit(0)
    if bounds:
        table = F.array(*map(F.lit, bounds))
        place = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(table, at + step - 1) <= F.col(order)), at + step).otherwise(at))
    placed = df.withColumn("_bucket", place)
    tops = sorted((r._bucket, r.top) for r in placed.groupBy("_bucket").agg(F.max(order).alias("top")).collect())
    # In descending order the bucket before is the one above; the first row of all comes after the last.
    visits = {b: (top, tops[(n + 1) % len(tops)][0]) for n, (b, top) in enumerate(tops)}
    size = len(bounds) + 1
    top = F.get(F.array(*(F.lit(visits.get(b, (None, None))[0]).cast("long") for b in range(size))), F.col("_bucket"))
    to = F.get(F.array(*(F.lit(visits.get(b, (None, None))[1]).cast("int") for b in range(size))), F.col("_bucket"))
    stays = F.struct(F.col("_bucket").alias("at"), F.lit(False).alias("visitor"))
    visit = F.struct(to.alias("at"), F.lit(True).alias("visitor"))
    dealt = placed.select(*df.columns, F.explode(F.when(F.col(order) == top, F.array(stays, visit)).otherwise(F.array(stays))).alias("_to"))
    after = Window.partitionBy("_at").orderBy("_visitor", F.col(order).desc(), "row")
    flat = dealt.select(*df.columns, F.col("_to.at").alias("_at"), F.col("_to.visitor").alias("_visitor"))
    return flat.withColumn("next", F.lead(F.struct(*df.columns)).over(after)).where("not _visitor").drop("_at", "_visitor")


def compared(df: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third replaced by the start of the next document in descending doc_id (after the last
    the first; missing ids last; rows of one id in order of their texts' hash). Null texts are empty. The next of a
    single document is itself; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = documents(df).select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))
    signed = following(keyed.withColumn("found", signatures(F.col("text"))), "id")
    cut = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    rows = signed.select("doc_id", F.length("text").cast("long").alias("n_chars"), "found", F.col("next.found").alias("of_next"), edited.alias("edited"))

    def finish(s: Column) -> Column:
        return F.struct(printed(s).alias("edited_fingerprint"), likeness(F.col("found"), s).alias("near_edited"))

    parts = rows.select("*", let(signatures(F.col("edited")), finish).alias("_edited"))
    return parts.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("found")).alias("fingerprint"),
        F.col("_edited.edited_fingerprint").alias("edited_fingerprint"),
        F.col("_edited.near_edited").alias("near_edited"),
        likeness(F.col("found"), F.col("of_next")).alias("near_next"),
    )
