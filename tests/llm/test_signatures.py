"""SimHash and SpotSigs against brute force."""

import hashlib
import re

import xxhash

from tracewarden.llm import simhash, spotsigs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    group = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return prints, group


def brute_components(rows):
    prints, group = brute_groups(rows)
    out = []
    for (i, p), g in zip(prints, group):
        ids = [j for (j, _), h in zip(prints, group) if h == g and j is not None]
        out.append((i, f"{p:016x}", min(ids, default=None)))
    return out


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def test_simhash_equals_brute_force(odd, small):
    for df in (odd, small):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        assert in_order(simhash.near_duplicates(df).collect()) == in_order(brute_components(rows))


def test_any_two_prints_within_the_distance_meet(spark):
    import random

    r = random.Random(3)
    values = [r.getrandbits(64) for _ in range(300)]
    values += [v ^ sum(1 << b for b in r.sample(range(64), k)) for v in values[:200] for k in (1, 4, 5)]
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    prints = spark.createDataFrame(signed, "fingerprint long")
    from tracewarden.llm.shared import components

    found = {r.node: r.component for r in components(simhash.linked(prints)).collect()}
    for v in values[:200]:
        for w in values:
            if v != w and (v ^ w).bit_count() <= 4:
                a, b = (x - (1 << 64) if x >> 63 else x for x in (v, w))
                assert found[a] == found[b]


def test_long_runs_are_searched_whole():
    import numpy as np

    r = np.random.default_rng(1)
    center = r.integers(0, 2**63, 4, dtype=np.uint64)
    flips = np.uint64(1) << r.integers(0, 64, (3000, 4), dtype=np.uint64)
    values = np.unique(center[r.integers(0, 4, 3000)] ^ flips[:, 0] ^ flips[:, 1])
    pairs = simhash.links(values, 4)
    parent = {int(v): int(v) for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        for x, y in zip(a.tolist(), b.tolist()):
            assert (x ^ y).bit_count() <= 4
            parent[find(x)] = find(y)
    roots = {int(c): {find(int(v)) for v in values if (int(v) ^ int(c)).bit_count() <= 2} for c in center}
    assert all(len(s) == 1 for s in roots.values())


def test_simhash_keeps_one_row_of_each_group(odd, none):
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    all_rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert len(rows) == len(set(brute_groups(all_rows)[1]))
    assert {r.doc_id for r in rows} == {c for _, _, c in brute_components(all_rows)}
    assert all(r["bucket.at"] == "p" and r.doc == "d" for r in rows)
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicated(none).count() == 0


def brute_spots(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    content = [(n, w) for n, w in enumerate(words) if w not in spotsigs.ANCHORS]
    out = set()
    for n, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            chain = [c for m, c in content if m > n][: spotsigs.CHAIN]
            if len(chain) == spotsigs.CHAIN:
                out.add((w, *chain))
    return out


def test_spotsigs_equal_brute_force(small):
    rows = sorted(((r.doc_id, r.text or "") for r in small.collect()), reverse=True)
    found = {r.doc_id: r for r in spotsigs.compared(small).collect()}
    assert len(found) == len(rows)
    for n, (i, text) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for near, other, print_ in ((r.near_edited, edited, r.edited_fingerprint), (r.near_next, after, None)):
            a, b = brute_spots(text), brute_spots(other)
            if a and b:
                exact = len(a & b) / len(a | b)
                assert abs(near - exact) < 0.02 or near == 0 and exact <= spotsigs.LEAST
            if print_ is not None and b:
                assert abs(len(print_) // 8 - len(b)) <= 1
        assert len(r.fingerprint) % 8 == 0 and r.fingerprint


def test_spotsigs_of_odd_rows(odd, none, spark):
    rows = spotsigs.compared(odd).collect()
    assert len(rows) == odd.count()
    prints = {}
    texts = {r.doc_id: r.text or "" for r in odd.collect() if r.doc_id not in (8, None)}
    for r in rows:
        if r.doc_id in texts:
            assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert spotsigs.compared(none).count() == 0
    one = spotsigs.compared(spark.createDataFrame([(1, "the red house on a hill")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def test_neighbours_over_many_buckets(spark):
    import random

    ids = random.Random(2).sample(range(10**9), 500)
    df = spark.createDataFrame([(i, i * 3) for i in ids], "id long, row long")
    found = {r.id: r.next.id for r in spotsigs.following(df, "id", bucket=7).collect()}
    ids.sort(reverse=True)
    assert found == dict(zip(ids, ids[1:] + ids[:1]))
