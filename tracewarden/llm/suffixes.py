"""Removal of repeated passages by suffix sorting.

Work is dealt out by content. The hash of every k-gram is taken, and each window of ``LENGTH`` bytes belongs to the
first of its k-grams with the least hash. Equal windows thus belong to equal k-grams at equal offsets and meet in one
task, however far apart their texts lie. K-grams of one text alone need no further look; around the others, the bytes
of their windows (the k-gram's context) are sent to the task of the k-gram.

A task sorts the suffixes of its contexts by the difference-cover method of Kaerkkaeinen and Sanders: triples at
positions 1 and 2 modulo 3 are sorted and named, the names are sorted by recursion, the remaining suffixes are merged
in, and adjacent suffixes are compared in their first ``LENGTH`` bytes. As no comparison looks further, recursion ends
once names cover as many bytes.
"""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.shared import NO_ID, documents, partitions, saved

LENGTH, GRAM = 50, 24
#: Bytes that are hashed at once.
CHUNK = 1 << 18
#: Six bytes of a hash are kept.
LOW = np.uint64(2**48 - 1)
#: Positions that the other two bytes can tell apart.
PLACES = np.arange(1 << 16, dtype=np.uint64)


def _words(buffer: np.ndarray, count: int) -> np.ndarray:
    """The eight bytes from each position on as a number."""
    return np.lib.stride_tricks.as_strided(buffer[:8].view(np.uint64), shape=(count,), strides=(1,))


def gram_hashes(buffer: np.ndarray, count: int, gram: int) -> np.ndarray:
    """Hashes of the ``gram`` bytes (8 at least) from each of the first ``count`` positions on."""
    words = _words(buffer, len(buffer) - 7)
    h = words[:count] * np.uint64(0x9E3779B97F4A7C15)
    for at in [*range(8, gram - 8, 8), gram - 8]:
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h += words[at : at + count]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    h &= LOW
    return h


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each position on, of fewer at the end."""
    h, span = h.copy(), 1
    while span < width:
        step = min(span, width - span)
        np.minimum(h[:-step], h[step:], out=h[:-step])
        span += step
    return h


def windows(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Of every window of a text: position and hash of the k-gram it belongs to."""
    count = len(text) - length + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owners, hashes, width = [], [], length - gram + 1
    step = len(PLACES) - width + 1
    for a in range(0, count, step):
        n = min(step, count - a)
        part = np.frombuffer(text[a : a + n + length] + bytes(16), np.uint8)
        # Six bytes of hash, then two of place: the least is the first of those with the least hash.
        h = gram_hashes(part, n + width - 1, gram)
        h <<= np.uint64(16)
        h |= PLACES[: len(h)]
        least = _least(h, width)[:n]
        owners.append((least & PLACES[-1]).astype(np.int64) + a)
        hashes.append(least >> np.uint64(16))
    return np.concatenate(owners), np.concatenate(hashes)


def seen(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """Per text the different hashes of k-grams that windows belong to. Texts are hashed together, a chunk at a time."""
    out, group, size = [], [], 0
    width = length - gram + 1

    def flush() -> None:
        if not group:
            return
        lengths = np.array([len(t) for t in group])
        total = int(lengths.sum())
        starts = np.cumsum(lengths) - lengths
        if not total:
            out.extend(np.zeros(0, np.uint64) for _ in group)
            group.clear()
            return
        h = gram_hashes(np.frombuffer(b"".join(group) + bytes(gram + 16), np.uint8), total, gram)
        least = _least(h, width)
        # Where a window starts, and where the least hash is another than before.
        edge = np.zeros(total + 1, np.int8)
        some = lengths >= length
        edge[starts[some]] = 1
        edge[(starts + lengths - length + 1)[some]] = -1
        new = np.r_[True, least[1:] != least[:-1]]
        new[starts[some]] = True
        at = np.flatnonzero(new & np.cumsum(edge[:-1], dtype=np.int8).view(bool))
        # Two bytes of text, then six of hash.
        key = np.sort((np.searchsorted(starts, at, "right") - 1).astype(np.uint64) << np.uint64(48) | least[at])
        key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
        cuts = np.searchsorted(key, np.arange(1, len(group), dtype=np.uint64) << np.uint64(48))
        out.extend(np.split(key & LOW, cuts))
        group.clear()

    for text in texts:
        if len(text) > CHUNK:
            flush()
            size = 0
            out.append(np.unique(windows(text, length, gram)[1]))
            continue
        group.append(text)
        size += len(text)
        if size > CHUNK or len(group) == len(PLACES):
            flush()
            size = 0
    flush()
    return out


def _named(triple: np.ndarray, limit: int) -> tuple[np.ndarray, int]:
    """The rank of each triple (from 1) among the different ones, all below ``limit``, and how many these are."""
    if limit <= max(1 << 20, 2 * len(triple)):
        there = np.zeros(limit, bool)
        there[triple] = True
        number = np.cumsum(there, dtype=np.int32)
        return number[triple].astype(np.int64), int(number[-1])
    by = np.argsort(triple)
    sorted_ = triple[by]
    name = np.empty(len(triple), np.int64)
    name[by] = np.cumsum(np.r_[True, sorted_[1:] != sorted_[:-1]])
    return name, int(name[by[-1]])


def suffix_order(s: np.ndarray, names: int, need: int) -> np.ndarray:
    """Positions of ``s`` (numbers from 1 to ``names``, 0 between texts) sorted by at least the first ``need`` numbers
    of their suffixes."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = np.concatenate([s, np.zeros(3, s.dtype)])
    # Positions of remainder 0, 1 and 2 modulo 3; those of 1, then those of 2 are sampled.
    zeros, ones, twos = ((n - k + 2) // 3 for k in range(3))
    wide = names + 1

    def pairs(at: int, count: int) -> np.ndarray:
        return s[at::3][:count] * wide + s[at + 1 :: 3][:count]

    pair = np.concatenate([pairs(1, ones), pairs(2, twos)])
    limit = wide**3
    if names >= 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
        limit = (len(pair) + 1) * wide
    triple = pair * wide
    triple[:ones] += s[3::3][:ones]
    triple[ones:] += s[4::3][:twos]
    name, found = _named(triple, limit)
    del pair, triple
    rank = np.zeros(n + 3, np.int64)
    if found < len(name) and need > 3:
        deeper = suffix_order(np.concatenate([name[:ones], [0], name[ones:]]), found, (need + 2) // 3)
        deeper = deeper[deeper != ones]
        ordered = deeper - (deeper > ones)
        name[ordered] = np.arange(1, len(ordered) + 1)
    else:
        ordered = np.argsort(name)
    rank[1:n:3], rank[2:n:3] = name[:ones], name[ones:]
    top = n + 1
    key = s[::3][:zeros] * top + rank[1::3][:zeros]
    by = np.argsort(key)
    # How many of the rest stand before each sampled suffix.
    before = np.zeros(len(ordered), np.int64)
    first = ordered < ones
    before[first] = np.searchsorted(key[by], (s[1::3][:ones] * top + rank[2::3][:ones])[ordered[first]])
    head = np.concatenate([pairs(0, zeros), pairs(2, twos)])
    if names * names * top > 2**62:
        head = np.unique(head, return_inverse=True)[1]
    head *= top
    head[:zeros] += rank[2::3][:zeros]
    head[zeros:] += rank[4::3][:twos]
    before[~first] = np.searchsorted(head[:zeros][by], head[zeros:][ordered[~first] - ones])
    before = np.maximum.accumulate(before)
    out = np.empty(n, np.int64)
    place = before + np.arange(len(ordered))
    free = np.ones(n, bool)
    free[place] = False
    out[place] = np.where(first, 3 * ordered + 1, 3 * (ordered - ones) + 2)
    out[free] = 3 * by
    return out


def earlier(contexts: list[bytes], first: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each context a bit for each of its windows (the first is bit 0): whether an equal window stands in a context
    with a smaller number in ``first``."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    data = np.frombuffer(b"\0".join(contexts) + bytes(length + 16), np.uint8)
    n = int(sizes.sum()) + len(contexts) - 1
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    # Bytes that occur are numbered in order: few numbers have few triples.
    there = np.bincount(data[:n], minlength=256) > 0
    s = np.cumsum(there)[data[:n]]
    s[starts[1:] - 1] = 0
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)[:n]
    valid = np.arange(n) - starts[owner] <= sizes[owner] - length
    order = suffix_order(s, int(there.sum()), length)
    order = order[valid[order]]
    words = _words(data, len(data) - 7)
    same = np.ones(len(order) - 1, bool)
    for at in [*range(0, length - 8, 8), length - 8]:
        w = words[order + at]
        same &= w[1:] == w[:-1]
    cuts = np.flatnonzero(np.r_[True, ~same])
    doc = first[owner[order]]
    least = np.repeat(np.minimum.reduceat(doc, cuts), np.diff(np.r_[cuts, len(order)]))
    hit = order[least < doc]
    bits = np.zeros(len(contexts), np.uint64)
    np.bitwise_or.at(bits, owner[hit], np.uint64(1) << (hit - starts[owner[hit]]).astype(np.uint64))
    return bits


def _dest(hashes: np.ndarray, count: int) -> np.ndarray:
    return ((hashes >> np.uint64(3)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % count


def _grouped(dest: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(dest, kind="stable")
    return [p for p in np.split(order, np.flatnonzero(np.diff(dest[order])) + 1) if len(p)]


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.to_pylist()]


def _packed(hashes: np.ndarray) -> bytes:
    """The low six bytes of each; a chance meeting of two costs a look at both, no more."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    parts = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return np.ascontiguousarray(np.pad(parts, ((0, 0), (0, 2)))).view("<u8").reshape(-1)


def _packed_texts(texts: np.ndarray) -> bytes:
    """Each different text once, then the texts' numbers among them, in two bytes: a batch has fewer texts than that."""
    some, number = np.unique(texts, return_inverse=True)
    return len(some).to_bytes(4, "little") + some.tobytes() + number.astype("<u2").tobytes()


def _unpacked_texts(data: bytes, count: int) -> np.ndarray:
    size = int.from_bytes(data[:4], "little")
    return np.frombuffer(data, np.int64, size, 4)[np.frombuffer(data, "<u2", count, 4 + 8 * size)]


def shared_grams(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(row, hashes): of each text the k-grams' hashes that another text has as well. ``texts``: row (its hash), bytes.

    Each task sends a k-gram once for each batch of texts, however many of them hold it.
    """
    count = 8 * partitions(texts.sparkSession)

    def send(batches):
        for batch in batches:
            rows = batch.column("row").to_numpy()
            _, some = np.unique(rows, return_index=True)
            data = _texts(batch.column("bytes").take(pa.array(some)))
            rows, per = rows[some], seen(data, length, gram)
            hashes = np.concatenate(per) if per else np.zeros(0, np.uint64)
            text = np.repeat(rows, [len(p) for p in per])
            # Hashes that several texts of this batch hold need no answer: these texts take them as shared at once.
            by = np.argsort(hashes, kind="stable")
            hashes, text = hashes[by], text[by]
            start = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
            many = np.diff(np.r_[start, len(hashes)]) > 1
            within = np.repeat(many, np.diff(np.r_[start, len(hashes)]))
            out_dest, out_h, out_t, out_own = [], [], [], []
            for p in _grouped(_dest(hashes[start], count)):
                at = start[p]
                out_dest.append(int(_dest(hashes[at[:1]], count)[0]))
                out_h.append(_packed(hashes[at]))
                out_t.append(_packed_texts(text[at]))
                out_own.append(np.packbits(many[p]).tobytes())
            for p in _grouped(text[within]):
                at = np.flatnonzero(within)[p]
                out_dest.append(-1 - int(text[at[0]]) % count)
                out_h.append(_packed(hashes[at]))
                out_t.append(text[at[:1]].tobytes())
                out_own.append(b"")
            yield pa.RecordBatch.from_arrays([pa.array(out_dest, pa.int64()), *(pa.array(x, pa.binary()) for x in (out_h, out_t, out_own))], names=["dest", "hashes", "texts", "many"])

    def answer(group: pa.Table) -> pa.Table:
        if group.column("dest")[0].as_py() < 0:
            rows = [np.frombuffer(x, np.int64)[0] for x in group.column("texts").to_pylist()]
            lists = [_unpacked(x).view(np.int64) for x in group.column("hashes").to_pylist()]
            return pa.table({"row": pa.array(rows, pa.int64()), "hashes": pa.array(lists, pa.list_(pa.int64()))})
        per = [_unpacked(x) for x in group.column("hashes").to_pylist()]
        hashes = np.concatenate(per)
        text = np.concatenate([_unpacked_texts(x, len(p)) for x, p in zip(group.column("texts").to_pylist(), per)])
        many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)).astype(bool) for x, p in zip(group.column("many").to_pylist(), per)])
        by = np.argsort(hashes, kind="stable")
        hashes, text, many = hashes[by], text[by], many[by]
        start = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        size = np.diff(np.r_[start, len(hashes)])
        shared = np.minimum.reduceat(text, start) != np.maximum.reduceat(text, start)
        keep = np.repeat(shared & (size > 1), size) & ~many
        parts = _grouped(text[keep])
        hashes, text = hashes[keep], text[keep]
        return pa.table({"row": pa.array([text[p[0]] for p in parts], pa.int64()), "hashes": pa.array([hashes[p].view(np.int64) for p in parts], pa.list_(pa.int64()))})

    answers = texts.mapInArrow(send, "dest long, hashes binary, texts binary, many binary").groupBy("dest").applyInArrow(answer, "row long, hashes array<long>")
    return answers.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("hashes"))).alias("hashes"))


def contexts(candidates: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Contexts of shared k-grams by batch of texts and destination. ``candidates``: id, row, bytes, hashes.

    Of equal contexts in a batch one is sent, with the smallest id. Where they stand stays with the batch.
    """
    count = 8 * partitions(candidates.sparkSession)

    def run(batches):
        for batch in batches:
            ids, rows = batch.column("id").to_numpy(), batch.column("row").to_numpy()
            lists = batch.column("hashes")
            place: dict[bytes, int] = {}
            dest, first, which, doc, start = [], [], [], [], []
            for n, text in enumerate(_texts(batch.column("bytes"))):
                owner, hashes = windows(text, length, gram)
                if not len(owner):
                    continue
                # The windows of a k-gram stand in a run.
                last = np.append(np.flatnonzero(owner[1:] != owner[:-1]), len(owner) - 1)
                kept = np.isin(hashes[last], np.asarray(lists[n].values).view(np.uint64))
                if not kept.any():
                    continue
                a, b = np.append(0, last[:-1] + 1)[kept], last[kept]
                goes = _dest(hashes[a], count).tolist()
                for p, q, to in zip(a.tolist(), b.tolist(), goes):
                    context = text[p : q + length]
                    at = place.setdefault(context, len(place))
                    if at == len(first):
                        first.append(ids[n])
                        dest.append(to)
                    elif ids[n] < first[at]:
                        first[at] = ids[n]
                    which.append(at)
                    doc.append(n)
                    start.append(p)
            if not place:
                continue
            data, dest, first = list(place), np.array(dest), np.array(first, np.int64)
            which, doc, start = np.array(which), np.array(doc), np.array(start, np.uint32)
            number, out = np.zeros(len(data), np.int64), []
            groups = _grouped(dest)
            for p in groups:
                number[p] = np.arange(len(p))
            by = {int(dest[which[p[0]]]): p for p in _grouped(dest[which])}
            name = random.getrandbits(62)
            for p in groups:
                to = int(dest[p[0]])
                here = by[to]
                docs, local = np.unique(doc[here], return_inverse=True)
                sizes = np.array([len(data[k]) for k in p], np.uint32)
                out.append((name, to, sizes.tobytes(), b"".join([data[k] for k in p]), first[p].tobytes(), number[which[here]].astype(np.uint32).tobytes(), local.astype(np.uint32).tobytes(), start[here].tobytes(), ids[docs].tobytes(), rows[docs].tobytes()))
            columns = list(zip(*out))
            names = ["batch", "dest", "sizes", "data", "first", "which", "doc", "start", "ids", "rows"]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[2:])], names=names)

    schema = "batch long, dest long, sizes binary, data binary, first binary, which binary, doc binary, start binary, ids binary, rows binary"
    return candidates.mapInArrow(run, schema)


def repeated(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """(batch, dest, bits): per context of ``found`` its windows that stand in a text with a smaller id."""

    def run(group: pa.Table) -> pa.Table:
        place: dict[bytes, int] = {}
        least: list[int] = []
        per = []
        for sizes, data, first in zip(*(group.column(c).to_pylist() for c in ("sizes", "data", "first"))):
            ends = np.cumsum(np.frombuffer(sizes, np.uint32).astype(np.int64))
            first = np.frombuffer(first, np.int64)
            which = []
            for a, b, doc in zip([0, *ends[:-1].tolist()], ends.tolist(), first.tolist()):
                at = place.setdefault(data[a:b], len(place))
                if at == len(least):
                    least.append(doc)
                elif doc < least[at]:
                    least[at] = doc
                which.append(at)
            per.append((np.array(which), first))
        least = np.array(least, np.int64)
        bits = earlier(list(place), least, length)
        sizes = np.array([len(c) for c in place], np.int64)
        full = (np.uint64(1) << (sizes - length + 1).astype(np.uint64)) - np.uint64(1)
        # An equal context with a smaller id has all windows.
        out = [np.where(least[which] < first, full[which], bits[which]).tobytes() for which, first in per]
        return pa.table({"batch": group.column("batch"), "dest": group.column("dest"), "bits": pa.array(out, pa.binary())})

    return found.select("batch", "dest", "sizes", "data", "first").groupBy("dest").applyInArrow(run, "batch long, dest long, bits binary")


def removals(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, row, spans): per text the bytes to remove as pairs of start and end, in any order and overlapping."""

    def run(batches):
        for batch in batches:
            ids, rows, spans = [], [], []
            for sizes, first, which, doc, start, idx, rws, bits in zip(*(batch.column(c).to_pylist() for c in ("sizes", "first", "which", "doc", "start", "ids", "rows", "bits"))):
                size, first, which, doc, start = np.frombuffer(sizes, np.uint32), np.frombuffer(first, np.int64), np.frombuffer(which, np.uint32), np.frombuffer(doc, np.uint32), np.frombuffer(start, np.uint32).astype(np.int64)
                idx, rws, bits = np.frombuffer(idx, np.int64), np.frombuffer(rws, np.int64), np.frombuffer(bits, np.uint64)
                full = (np.uint64(1) << (size.astype(np.int64) - length + 1).astype(np.uint64)) - np.uint64(1)
                mine = np.where(idx[doc] > first[which], full[which], bits[which])
                hit = np.flatnonzero(mine)
                mine, doc, start = mine[hit], doc[hit], start[hit]
                docs, a, b = [], [], []
                while len(mine):
                    low = np.bitwise_count((mine & (~mine + np.uint64(1))) - np.uint64(1)).astype(np.int64)
                    rest = mine >> low.astype(np.uint64)
                    ones = np.bitwise_count(rest ^ (rest + np.uint64(1))).astype(np.int64) - 1
                    docs.append(doc)
                    a.append(start + low)
                    b.append(start + low + ones - 1 + length)
                    more = (rest >> ones.astype(np.uint64)) << (low + ones).astype(np.uint64)
                    left = np.flatnonzero(more)
                    mine, doc, start = more[left], doc[left], start[left]
                if docs:
                    docs, pairs = np.concatenate(docs), np.stack([np.concatenate(a), np.concatenate(b)], axis=1).astype(np.uint32)
                    for p in _grouped(docs.astype(np.int64)):
                        ids.append(idx[docs[p[0]]])
                        rows.append(rws[docs[p[0]]])
                        spans.append(pairs[p].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(spans, pa.binary())], names=["id", "row", "spans"])

    each = found.mapInArrow(run, "id long, row long, spans binary")
    return each.groupBy("id", "row").agg(F.collect_list("spans").alias("spans"))


def cut(candidates: DataFrame) -> DataFrame:
    """Removes the spans from the texts: id, row, n_removed, n_spans, kept (bytes)."""

    def run(batches):
        for batch in batches:
            removed, count, kept, sums = [], [], [], []
            for text, spans in zip(batch.column("bytes").to_pylist(), batch.column("spans").to_pylist()):
                pairs = np.frombuffer(b"".join(spans), np.uint32).reshape(-1, 2).astype(np.int64)
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, pairs[:, 0], 1)
                np.add.at(edge, pairs[:, 1], -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                count.append(int((gone & ~np.r_[False, gone[:-1]]).sum()))
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
                sums.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary()), pa.array(sums, pa.string())], names=["id", "row", "n_removed", "n_spans", "kept", "kept_sha256"])

    return candidates.mapInArrow(run, "id long, row long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def deduplicated(df: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte goes that is covered by a string of ``length`` bytes which also starts in a document with a smaller
    doc_id. Missing ids count as larger than all others and as equal among themselves; null texts are empty, texts
    shorter than ``length`` lose nothing, rows of one id do not count against one another. An empty table gives no rows.
    """
    data = F.coalesce("text", F.lit("")).cast("binary")
    keyed = documents(df).select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), data.alias("bytes"))
    base = saved(keyed.select("doc_id", "id", "row", F.octet_length("bytes").cast("long").alias("n_bytes"), F.sha2("bytes", 256).alias("sha")), "texts")
    # Copies of a whole text lose all of it; only the first one is looked at.
    least = saved(base.groupBy("sha").agg(F.min("id").alias("least")), "least")
    marked = base.join(least, "sha").withColumn("copy", (F.col("id") > F.col("least")) & (F.col("n_bytes") >= length))
    grams = saved(shared_grams(keyed.select("row", "bytes"), length, gram), "grams")
    open_ = marked.where(~F.col("copy") & (F.col("n_bytes") >= length)).select("id", "row").distinct().join(grams, "row")
    candidates = saved(keyed.select("id", "row", "bytes").join(open_, ["id", "row"]), "candidates")
    found = saved(contexts(candidates, length, gram), "contexts")
    bits = saved(repeated(found, length), "bits")
    spans = saved(removals(found.drop("data").join(bits, ["batch", "dest"]), length), "spans")
    done = cut(candidates.select("id", "row", "bytes").join(spans, ["id", "row"])).select("id", "row", "n_removed", "n_spans", "kept_sha256").dropDuplicates(["id", "row"])
    done = saved(done, "cut")
    nothing = hashlib.sha256(b"").hexdigest()
    joined = marked.join(done, ["id", "row"], "left")
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copy"), F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
