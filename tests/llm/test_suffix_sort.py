"""The steps of the suffix search that take most of its time, against plain ones."""

import random

import numpy as np

from tracewarden.llm import suffixes


def test_triples_of_bytes_are_counted_not_sorted(monkeypatch):
    """Texts of a few letters: only the shorter strings of names are sorted, and every window is judged as by hand."""
    r = random.Random(4)
    base = "".join(r.choices("abcdefgh ", k=3000)).encode()
    contexts = list({base[a : a + r.randrange(50, 77)] for a in (r.randrange(2900) for _ in range(400))})
    first = np.array([r.randrange(50) for _ in contexts])
    total = sum(map(len, contexts))
    sizes = []
    for name in ("argsort", "unique"):
        monkeypatch.setattr(np, name, lambda x, *a, f=getattr(np, name), **b: sizes.append(len(x)) or f(x, *a, **b))
    got = suffixes.earlier(contexts, first)
    assert max(sizes) < 0.5 * total
    least: dict[bytes, int] = {}
    for c, d in zip(contexts, first.tolist()):
        for i in range(len(c) - 49):
            least[c[i : i + 50]] = min(d, least.get(c[i : i + 50], d))
    assert got.tolist() == [sum((least[c[i : i + 50]] < d) << i for i in range(len(c) - 49)) for c, d in zip(contexts, first.tolist())]


def test_names_of_triples():
    r = np.random.default_rng(1)
    for limit in (10, 5000, 1 << 40):
        triple = r.integers(0, limit, 3000)
        expected = np.unique(triple, return_inverse=True)
        name, found = suffixes._named(triple, limit)
        assert found == len(expected[0]) and (name == expected[1] + 1).all()


def test_hashes_of_texts_that_share_a_chunk():
    r = random.Random(2)
    texts = [bytes(r.choices(b"ab c", k=r.choice([0, 0, 1, 49, 50, 51, 200]))) for _ in range(300)] + [b"", b"x" * 60, b""]
    for some in (texts, texts[:1] * 3, [b""] * 3, []):
        assert [p.tolist() for p in suffixes.seen(some)] == [sorted(set(suffixes.windows(t)[1].tolist())) for t in some]
