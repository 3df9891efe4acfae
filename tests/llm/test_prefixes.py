"""The conversation trie against one built turn by turn, and against its SQL."""

import random
import re
import zlib
from hashlib import md5, sha256

import duckdb
import pytest
from pyspark.sql import types as T

from tracewarden.llm import prefixes

SCHEMA = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("conv_id", "turn")]
    + [T.StructField(n, T.StringType()) for n in ("role", "text", "key", "path", "one", "n.convs")]
)
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role or "", text or ""))

    def order(t):
        return t[0] is not None, t[0] or 0, t[1], md5(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest()

    own = {c: [t[1:] for t in sorted(ts, key=order)] for c, ts in own.items()}
    members = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - int(c - 20 * int(c / 20)), [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, len(path)))
    out = []
    for node, who in members.items():
        under = [k for k in members if k[: len(node)] == node]
        children = [k for k in under if len(k) == len(node) + 1]
        leaves = [k for k in under if not any(m[: len(k)] == k and len(m) == len(k) + 1 for m in under)]
        saved = sum((len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) for k in under if k)
        ends = ",".join(map(str, sorted(c for c, n in who if n == len(node))))
        parent = min(members[node[:-1]])[0] if node else None
        out.append((min(who)[0], len(node), parent, len(who), len(children), len(leaves), saved, sha256(ends.encode()).hexdigest()))
    return out


def odd_conversations():
    r = random.Random(3)
    rows = []
    for c in list(range(-25, 130, 1)) + [1000, 2021]:
        if c % 13 == 5:
            continue
        for t in range(r.choice([0, 1, 2, 3, 4, 4, 5, 9])):
            rows.append((c, t if r.random() < 0.9 else None, r.choice(["user", "user", None]), r.choice(["hi there", "hi", "", None, "a  b\tc", "é\x0bü   x"]), "k", "p", "o", "n"))
    rows += [(None, 0, "user", "lost", "k", "p", "o", "n"), (7, 3, "user", "same", *"kpon"), (7, 3, "user", "same", *"kpon"), (40, 0, "user", "word " * 20_000, *"kpon")]
    rows += [(60, t, "user", "turn", *"kpon") for t in range(70)] + [(61, t, "user", "turn", *"kpon") for t in range(40)]
    return rows


def rows_of(df):
    return sorted(([r[c] for c in COLUMNS] for r in df.collect()), key=str)


def test_trie_equals_brute_force(spark):
    rows = odd_conversations()
    got = rows_of(prefixes.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert got == sorted(map(list, brute(rows)), key=str)


def test_rounds_of_single_turns_give_the_same(spark, monkeypatch):
    """Where paths under one node are too many for a task, rounds get shorter."""
    rows = odd_conversations()
    monkeypatch.setattr(prefixes, "TOGETHER", 2)
    monkeypatch.setattr(prefixes, "PIECE", 3)
    got = rows_of(prefixes.prefix_trie(spark.createDataFrame([r for r in rows if r[0] not in (60, 61)], SCHEMA)))
    assert got == sorted(map(list, brute([r for r in rows if r[0] not in (60, 61)])), key=str)


def test_empty_conversations(spark):
    assert prefixes.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    lost = spark.createDataFrame([(None, 1, "user", "x", *"kpon")], SCHEMA)
    assert prefixes.prefix_trie(lost).collect() == []


def test_many_copies_are_hashed_in_order(spark):
    rows = [(20 * c, 0, "user", "same", *"kpon") for c in range(9000, 0, -1)]
    got = rows_of(prefixes.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    ids = ",".join(str(20 * c) for c in range(1, 9001))
    assert [r[7] for r in got if r[1] == 1 and r[3] == 9000 or r[1] == 1] == [sha256(ids.encode()).hexdigest()]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_trie_equals_its_sql(spark, size):
    path = f"/root/testdata/{size}/conversations.parquet"
    connection = duckdb.connect()
    connection.execute(f"create view conversations as select * from '{path}'")
    result = connection.execute(prefixes.ORACLE)
    at = [[d[0] for d in result.description].index(c) for c in COLUMNS]
    assert rows_of(prefixes.prefix_trie(spark.read.parquet(path))) == sorted(([r[i] for i in at] for r in result.fetchall()), key=str)
