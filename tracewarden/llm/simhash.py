"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint of 64 bits is cut into ``ceil((distance + 1) / 2)`` segments: of at most ``distance`` differing bits one
segment then holds one at most. Each segment is indexed once per bit with that bit deleted, so two segments that
differ in at most one bit meet under at least one key. Rows that meet are verified on all 64 bits. Fewer, longer
segments make the keys more selective than plain pigeonhole pieces (21 bits instead of 12 for a distance of 4).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.shared import NO_ID, components, documents, keyed, partitions, saved, unkeyed

BITS = 64
WORDS = 4
DISTANCE = 4
SEED = 42
#: Shingles whose hashes are held at once, and the longest run of equal keys that is searched without cutting further.
CHUNK, RUN = 1 << 16, 2048


def hashes(text: str | None, words: int = WORDS) -> Iterator[np.ndarray]:
    """The hashes of the word shingles in order, repeats included, in pieces; none without a word."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lowers A-Z, splits at \x20 and \x09-\x0D
    if not found:
        return
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(found) > words:
        starts, ends = starts[: len(found) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    for at in range(0, len(starts), CHUNK):
        pairs = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist())
        yield np.fromiter((digest(joined[a:b]) for a, b in pairs), "<u8")


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of the word shingles, repeats included; 0 without a word."""
    ones, count = np.zeros(BITS, np.int64), 0
    for part in hashes(text, words):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        count += len(part)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, a hash of its text (null: of the empty text) and its fingerprint as a long; a row for each row of ``df``."""

    def run(batches):
        for batch in batches:
            values = [fingerprint(t, words) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), batch.column("row"), pa.array(np.array(values, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "fingerprint"])

    hashed = documents(df).withColumn("row", F.xxhash64(F.coalesce("text", F.lit(""))))
    return hashed.mapInArrow(run, "doc_id long, row long, fingerprint long")


def variants(distance: int = DISTANCE, bits: int = BITS) -> list[tuple[int, int]]:
    """(mask, deleted bit) of every variant: the mask has a segment's bits without the deleted one."""
    count = (distance + 2) // 2
    edges = [bits * k // count for k in range(count + 1)]
    return [(((1 << b) - (1 << a)) & ~(1 << bit), bit) for a, b in zip(edges, edges[1:]) for bit in range(a, b)]


def _mixed(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return keys ^ (keys >> np.uint64(29))


def _forest(values: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what the links of ``values`` connect: breadth first, each value is taken once."""
    out, rest = [], values
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            p = queue.pop()
            near = np.bitwise_count(rest ^ p) <= distance
            if near.any():
                found = rest[near]
                out.append((np.full(len(found), p), found))
                queue.extend(found)
                rest = rest[~near]
    return out


def links(values: np.ndarray, distance: int, top: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """As _forest(); a long run is cut by distance + 1 exact pieces of the bits first, one of which two linked values share."""
    if len(values) <= RUN or not top:
        return _forest(values, distance)
    out = []
    edges = [BITS * k // (distance + 1) for k in range(distance + 2)]
    for a, b in zip(edges, edges[1:]):
        piece = values & np.uint64((1 << b) - (1 << a))
        order = np.argsort(piece, kind="stable")
        cuts = np.flatnonzero(np.diff(piece[order])) + 1
        for part in np.split(values[order], cuts):
            if len(part) > 1:
                out += _forest(part, distance)
    return out


def linked(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links between different values of the long column ``fingerprint`` that connect all values at most
    ``distance`` bits apart. Each bucket emits links that connect its members, not all its pairs."""
    spark = prints.sparkSession
    masks = variants(distance)
    split = max(2, partitions(spark) // 4)

    def index(batches):
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            dest, blobs = [], []
            for n, (mask, _) in enumerate(masks):
                part = (_mixed(values & np.uint64(mask)) % np.uint64(split)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                for p in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                    if len(p):
                        dest.append(n * split + int(part[p[0]]))
                        blobs.append(values[p].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(dest, pa.int64()), pa.array(blobs, pa.binary())], names=["dest", "blob"])

    def verify(group: pa.Table) -> pa.Table:
        mask = np.uint64(masks[group.column("dest")[0].as_py() // split][0])
        values = np.frombuffer(b"".join(group.column("blob").to_pylist()), np.uint64)
        key = values & mask
        order = np.argsort(key, kind="stable")
        values, key = values[order], key[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        out = []
        for a, n in zip(starts[sizes > 8], sizes[sizes > 8]):
            out += links(values[a : a + n], distance)
        short = np.repeat(sizes <= 8, sizes)
        for step in range(1, 8):
            near = short[:-step] & (key[:-step] == key[step:]) & (np.bitwise_count(values[:-step] ^ values[step:]) <= distance)
            out.append((values[:-step][near], values[step:][near]))
        a, b = (np.concatenate([x[i] for x in out] or [values[:0]]) for i in (0, 1))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
        return pa.table({"a": pa.array(pairs[:, 0].copy().view(np.int64)), "b": pa.array(pairs[:, 1].copy().view(np.int64))})

    distinct = prints.select("fingerprint").where("fingerprint is not null").distinct()
    return distinct.mapInArrow(index, "dest long, blob binary").groupBy("dest").applyInArrow(verify, "a long, b long").distinct()


def _classes(df: DataFrame, distance: int, words: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and for each different one its class: any value that names the component."""
    prints = saved(fingerprints(df, words), "fingerprints")
    found = components(saved(linked(prints, distance), "links"))
    distinct = prints.select("fingerprint").distinct()
    return prints, distinct.join(found, distinct.fingerprint == found.node, "left").select("fingerprint", F.coalesce("component", "fingerprint").alias("class"))


def near_duplicates(df: DataFrame, distance: int = DISTANCE, words: int = WORDS) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits), component_id.

    Documents link if their fingerprints differ in at most ``distance`` bits; component_id is the smallest doc_id
    reachable. Null and empty texts have fingerprint zero and link like any other. Repeated rows stay. A missing
    doc_id stays missing and names no component unless all ids of it are missing. An empty table gives no rows.
    """
    prints, classes = _classes(df, distance, words)
    lowest = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("low"))
    lowest = classes.join(lowest, "fingerprint")
    smallest = lowest.groupBy("class").agg(F.min("low").alias("component_id"))
    table = saved(lowest.join(smallest, "class").select(F.col("fingerprint").alias("print"), "component_id"), "classes")
    hexed = F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint")
    return prints.join(table, prints.fingerprint == table.print, "left").select("doc_id", hexed, "component_id")


def deduplicated(df: DataFrame, distance: int = DISTANCE, words: int = WORDS) -> DataFrame:
    """The rows of ``df`` that stay, with all columns: of each component the one with the smallest doc_id (missing ids
    last; among rows of one id the text with the smallest hash; of equal rows one)."""
    prints, classes = _classes(df, distance, words)
    id_ = F.coalesce("doc_id", F.lit(NO_ID))
    # Partial: a row for each fingerprint before the classes meet.
    least = prints.groupBy("fingerprint").agg(F.min(F.struct(id_.alias("id"), "row")).alias("least"))
    stay = classes.join(least, "fingerprint").groupBy("class").agg(F.min("least").alias("least")).select("least.id", "least.row")
    return staying(df, stay)


def staying(df: DataFrame, stay: DataFrame) -> DataFrame:
    """The rows of ``df`` whose id and row are in ``stay``, of equal rows one."""
    kept = keyed(df).join(saved(stay, "stay"), ["id", "row"], "left_semi")
    first = Window.partitionBy("id", "row").orderBy("id")
    return unkeyed(kept.withColumn("nth", F.row_number().over(first)).where("nth = 1"), df.columns)
