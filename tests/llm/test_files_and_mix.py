"""Token files and the source mix."""

import re
import zlib

import numpy as np
import pytest

from tracewarden.llm import mixing, tokens


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_file())


def test_encoder_equals_the_library(tokenizer, small):
    encoder = tokens.Encoder(tokens.tokenizer_file())
    texts = [r.text or "" for r in small.limit(60).collect()]
    texts += ["", " ", "  a", "a  b", "a \n b", "a\n\nb c", "trailing ", "\n", "it's we'll I'D don't 's", "a b  c", "<|endoftext|> and <|endoftext|>x", "x <|endo", "12 345.6 é漢字 \U0001f600", "a\tb c\td", "foo. bar, baz.", ". , .", "ſ 's'"]
    for _ in range(2):  # with words remembered, too
        for text, ids in zip(texts, encoder.encode(texts)):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text[:50])


def test_files_give_back_every_document(odd, none, small, tokenizer, spark):
    for df in (odd, small):
        index = tokens.write(df, length=16, shards=3).cache()
        rows = sorted(index.collect(), key=lambda r: r.start)
        ids = [r.doc_id if r.doc_id is not None else 2**63 for r in rows]
        assert ids == sorted(ids) and len(rows) == df.count()
        whole, expected = 0, {}
        for r in df.collect():
            e = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
            expected.setdefault(r.doc_id, []).append((len(e), zlib.crc32(np.array(e, "<u4").tobytes())))
        for r in rows:
            assert r.start == whole
            whole += r.n_tokens
        found = {}
        for r in tokens.read(index).collect():
            found.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
        assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
        for path in {r.path for r in rows}:
            shard, inside = tokens.Shard(path), [r for r in rows if r.path == path]
            size = max(r.at + r.n_tokens for r in inside)
            ids, mask = zip(*(shard.sequence(n) for n in range(-(-size // 16))))
            assert all(len(x) == 16 for x in ids) and np.concatenate(mask).sum() == size
            assert np.concatenate(ids)[np.concatenate(mask)].tolist() == shard.ids(0, size).tolist()
    assert tokens.read(tokens.write(none)).count() == 0


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_targets(rows):
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        aimed = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if aimed[s] > 2 * sizes[s]]
        if not above:
            return sizes, fixed | aimed
        fixed |= {s: 2 * sizes[s] for s in above}


def test_mix_meets_its_targets(odd, small, none):
    for df in (small, odd):
        rows = df.collect()
        sizes, targets = brute_targets(rows)
        source = {(r.doc_id, len(words(r.text))): r.source for r in rows}
        found = mixing.taken(df).collect()
        assert len(found) == len(rows)
        taken = dict.fromkeys(sizes, 0)
        for r in found:
            s = source[r.doc_id, r.size]
            assert r.source_size == sizes[s] and abs(r.target - targets[s]) < 1e-3 and 0 <= r.taken <= 2 * r.size
            taken[s] += r.taken
        for s in sizes:
            assert abs(taken[s] - targets[s]) <= 3 * mixing.BLOCK
        key = lambda rs: sorted((str(r.doc_id), r.size, r.taken) for r in rs)
        assert key(mixing.taken(df.repartition(5)).collect()) == key(found)
    assert mixing.taken(none).count() == 0


def test_permutation_is_one_and_stirs(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 1000):
        got = [r.y for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3).cast("long")).alias("y")).collect()]
        assert sorted(got) == list(range(n))
    assert sum(abs(a - b) == 1 for a, b in zip(got, got[1:])) < 20


def test_slots_lead_to_blocks_evenly(spark):
    table = spark.createDataFrame([("a", 0, 3200, 0.0, 100, 150, 0, 170), ("b", 1, 320, 0.0, 10, 20, 150, 170)], "source string, no int, source_size long, target double, blocks long, slots long, first long, total long")
    rows = mixing.slots(table, shard=50).collect()
    assert sorted(r.position for r in rows) == list(range(170)) and {r.shard for r in rows} == {0, 1, 2, 3}
    times = {}
    for r in rows:
        times[r.no, r.block] = times.get((r.no, r.block), 0) + 1
    assert sorted(times[0, b] for b in range(100)) == [1] * 50 + [2] * 50 and all(times[1, b] == 2 for b in range(10))


def test_mixed_documents_hold_the_words_taken(odd, none, small):
    for df in (small, odd):
        wanted, got = {}, {}
        for r in mixing.taken(df).collect():
            wanted[r.doc_id] = wanted.get(r.doc_id, 0) + r.taken
        out = mixing.mixed(df)
        assert out.columns == df.columns
        texts = {}
        for r in df.collect():
            texts.setdefault(r.doc_id, []).append(" ".join(words(r.text)))
        for r in out.collect():
            got[r.doc_id] = got.get(r.doc_id, 0) + len(words(r.text))
            assert r.n_chars == len(r.text)
            assert any(set(words(r.text)) <= set(t.split()) for t in texts[r.doc_id])
        assert got == {k: v for k, v in wanted.items() if v}
    assert mixing.mixed(none).count() == 0
