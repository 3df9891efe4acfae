"""Dense nodes of the chosen-path join: who meets whom, in how many rows, and which pairs sketches drop."""

import numpy as np
import pytest

from tracewarden.llm import chosenpaths


def pair(r, size, common):
    """Two sets of ``size`` tokens, so many of them in common."""
    values = np.unique(r.integers(0, 1 << 63, 3 * size, np.uint64) * np.uint64(2))
    r.shuffle(values)
    a, b = np.sort(values[:size]), np.sort(np.r_[values[:common], values[size : 2 * size - common]])
    return np.frombuffer(chosenpaths.sketch(a) + chosenpaths.sketch(b), np.uint8).reshape(2, -1)


def kept(size, sketches):
    return len(chosenpaths.likely(np.array([size, size]), sketches, np.array([0, 1]), np.array([0, 1])))


@pytest.mark.parametrize("size", [3, 7, 13, 20, 40, 60, 90, 150, 200, 255])
def test_sketches_keep_pairs_of_small_sets_at_the_threshold(size):
    r = np.random.default_rng(size)
    common = -(-170 * size // 185)  # the least that reaches 85 of 100
    assert 100 * common >= 85 * (2 * size - common) and 100 * (common - 1) < 85 * (2 * size - common + 1)
    assert all(kept(size, pair(r, size, common)) for _ in range(400))


def test_sketches_drop_small_sets_that_share_a_passage():
    r = np.random.default_rng(9)
    assert sum(kept(150, pair(r, 150, 70)) for _ in range(200)) <= 2


def members(spark, apart, together, size=100):
    """A large node: ``apart`` documents with no link, the others in its main group."""
    rows = [(1, f"p{i}".encode(), f"p{i}".encode() if i < apart else b"main", size) for i in range(apart + together)]
    df = spark.createDataFrame(rows, "node long, print binary, known binary, size long")
    return df.selectExpr("*", f"{apart + together}L as `count`", f"{apart}L as off", "cast('main' as binary) as main")


def meetings(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.grp, set()).add(bytes(r.print))
    return groups.values()


def all_meet(groups, some, every):
    met = {}
    for g in groups:
        for p in g:
            met.setdefault(p, set()).update(g)
    return all(met[p] == every for p in some)


def test_documents_apart_meet_all_in_fewer_rows(spark, monkeypatch):
    monkeypatch.setattr(chosenpaths, "LEAF", 8)
    df = members(spark, 150, 150)
    found = chosenpaths.Join.apart(None, df)
    every = {f"p{i}".encode() for i in range(300)}
    assert all_meet(meetings(found), {f"p{i}".encode() for i in range(150)}, every)
    assert found.count() < 5000  # 300 documents in 19 blocks and 150 in 38 parts made 11,400


def test_long_sets_keep_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(chosenpaths, "LEAF", 8)
    groups = meetings(chosenpaths.Join.apart(None, members(spark, 100, 100, size=chosenpaths.TASK)))
    assert max(map(len, groups)) <= 40


def test_node_without_a_main_group(spark, monkeypatch):
    """No link is known yet: all documents of the node meet all."""
    monkeypatch.setattr(chosenpaths, "LEAF", 8)
    df = members(spark, 90, 0).selectExpr("node", "print", "known", "size", "`count`", "off - 1 as off", "cast(null as binary) as main")
    every = {f"p{i}".encode() for i in range(90)}
    assert all_meet(meetings(chosenpaths.Join.apart(None, df)), every, every)
