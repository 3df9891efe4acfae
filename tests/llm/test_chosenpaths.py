"""Chosen-path near-duplicates against all pairs, and against their SQL."""

import random

import duckdb
import numpy as np
import pytest

from tracewarden.llm import chosenpaths

WORDS = "the of and river stone winter garden silver morning letter window bridge captain market shadow forest copper".split()


def sets_of(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2)))


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= 85 * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= 85 * (len(a) + len(b) - common):
                    up[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    least = {g: min((rows[i][0] for i in m if rows[i][0] is not None), default=None) for g, m in groups.items()}
    return sorted(((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in chosenpaths.near_duplicates(df).collect()), key=str)


def near_copies(seed, groups, copies, words, edits):
    """Copies of texts with a few changed words each: likenesses on both sides of the threshold."""
    r = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [w + str(r.randrange(50)) for w in r.choices(WORDS, k=words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(r.randrange(edits + 1)):
                text[r.randrange(len(text))] = "new" + str(r.randrange(10**6))
            out.append(" ".join(text))
    r.shuffle(out)
    return list(enumerate(out))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "f") for i, t in rows], "doc_id long, text string, print string, grp string").repartition(4)


def test_odd_documents(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert result(odd) == brute(rows)


def test_empty_table(spark, none):
    got = chosenpaths.near_duplicates(none)
    assert got.collect() == [] and got.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_small_groups(spark):
    rows = near_copies(1, 40, 8, 90, 6)
    assert result(frame(spark, rows)) == brute(rows)


@pytest.mark.parametrize("edits", [4, 12])
def test_groups_beyond_a_leaf(spark, monkeypatch, edits):
    """Nodes are branched on every level; what stays too large goes through pivots, parts and blocks."""
    monkeypatch.setattr(chosenpaths, "LEAF", 8)
    rows = near_copies(2, 3, 150, 100, edits) + [(900 + i, "same words here " * 30) for i in range(20)]
    assert result(frame(spark, rows)) == brute(rows)


def test_chains_in_a_large_node(spark, monkeypatch):
    """Each text is like the next one only: no pivot is near to most of them."""
    monkeypatch.setattr(chosenpaths, "LEAF", 4)
    words = [f"w{i}" for i in range(700)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(140)]
    assert result(frame(spark, rows)) == brute(rows)


def test_recall_of_every_pair(spark):
    """At the threshold itself: four trees, no link missing among thousands."""
    rows = near_copies(3, 300, 3, 130, 5)
    assert result(frame(spark, rows)) == brute(rows)


def test_sketches_keep_pairs_at_the_threshold():
    r = np.random.default_rng(5)
    for size in (256, 700, 3000):
        for _ in range(200):
            both = int(round(size * 0.92))
            values = np.unique(r.integers(0, 1 << 63, 2 * size, np.uint64) * np.uint64(2))[: 2 * size]
            r.shuffle(values)
            a = np.sort(values[:size])
            b = np.sort(np.r_[values[:both], values[size : 2 * size - both]])
            sketches = np.frombuffer(chosenpaths.sketch(a) + chosenpaths.sketch(b), np.uint8).reshape(2, -1)
            assert len(chosenpaths.likely(np.array([size, size]), sketches, np.array([0, 1]), np.array([0, 1]))) == 1


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_sql(spark, size):
    path = f"/root/testdata/{size}/documents.parquet"
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{path}'")
    expected = connection.execute(f"select doc_id, n_shingles, component_id, kept from ({chosenpaths.ORACLE})").fetchall()
    assert result(spark.read.parquet(path)) == sorted(expected, key=str)
