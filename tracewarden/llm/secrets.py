"""Secret scans: rules, and a character convolutional network over every other candidate.

The rules (assignments, access keys, hex runs) find their spans exactly. A candidate is a run of 16 key characters or
more, with a digit among them; each that no rule covers is read, whole and with its surroundings, by a small
convolutional network in numpy. Labelled findings are of three kinds: those of the rules as they stand, the same without
the words around them (so that the network cannot live on them), and generated ones: keys of many makes against
identifiers, paths, dates, numbers and uuids. Uncovered candidates of the corpus have no label and teach nothing. The
outputs are calibrated on makes that the network was not fitted on, and the threshold is the most precise that still
finds the wanted share of the secrets among them.

All different findings of the rules take part, whole: two thirds are dealt to parts, each of which is fitted beside the
generated ones in a task of its own, and the weights are averaged after every round; the outputs for the others are
counted in fine steps, so that the driver sees counts alone.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from copy import deepcopy
from itertools import accumulate
from random import Random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.shared import documents, saved

#: The given rules.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "network")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
DIGIT = re.compile("[0-9]")
#: Code points that the network reads before and after a candidate, which it reads whole.
BEFORE, AFTER = 24, 8
CLASSES = {c: n for n, c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-\"':, \n", 1)}
OTHER = len(CLASSES) + 1
FILTERS, SPAN = 24, 5
#: Positions read at once: longer candidates are read in stretches, with the same result.
STRETCH = 65_536
#: The rules' findings, and their characters, that one part of the fit has about; generated ones of each make; rounds;
#: share of the secrets that the threshold must keep.
PART, PART_BYTES, GENERATED, ROUNDS, RECALL = 2000, 1 << 22, 150, 12, 0.99
#: Findings that the calibration weighs in full: more of them share this weight, and generated ones keep theirs.
WEIGHED = 1000
#: Outputs are counted in steps of 1 / STEPS, at most MOST steps up and down. Averages of parts that meet in one task.
STEPS, MOST, MEETING = 512, 1 << 16, 16

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
LETTERS = LOWER + UPPER + DIGITS


def _run(r: Random, letters: str, least: int, most: int | None = None) -> str:
    return "".join(r.choice(letters) for _ in range(r.randint(least, most or least)))


def _word(r: Random) -> str:
    """Something that can be spoken."""
    return "".join(r.choice("bcdfghklmnprstvw") + r.choice(("a", "e", "i", "o", "u", "er", "an", "in", "ou")) for _ in range(r.randint(1, 4)))


def _words(r: Random, by: str, shape=str) -> str:
    """Spoken parts and a number among them, long enough for a candidate."""
    parts = [shape(_word(r)) for _ in range(r.randint(2, 5))]
    parts.insert(r.randint(1, len(parts)), _run(r, DIGITS, 1, 4))
    text = by.join(parts)
    return text if len(text) >= 16 else text + by + _words(r, by, shape)


def _grouped(r: Random) -> str:
    by = r.choice("-/_")
    return by.join(_run(r, DIGITS, 2, 6) for _ in range(r.randint(7, 10)))


def _date(r: Random) -> str:
    day = f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"
    return r.choice((f"{day}T{_run(r, DIGITS, 6)}Z", f"{day}_{_word(r)}_{_run(r, DIGITS, 1, 4)}", f"{day}/{day}"))


def _uuid(r: Random) -> str:
    text = "-".join(_run(r, DIGITS + "abcdef", n) for n in (8, 4, 4, 4, 12))
    return r.choice((text, text.upper()))


def _ruled(r: Random) -> str:
    line = r.choice("-=_") * r.randint(8, 30)
    return line + _run(r, DIGITS, 1, 3) + line


def _parts(r: Random) -> str:
    """A few short names or numbers, then a key."""
    by = r.choice("-_")
    heads = [r.choice((_run(r, LOWER, 2, 5), _run(r, DIGITS, 4, 12))) for _ in range(r.randint(1, 3))]
    return by.join([*heads, _run(r, LETTERS, 20, 40)])


def _alphabet(r: Random) -> str:
    """A key over letters and digits that are few, or of one case."""
    letters = r.choice((LOWER, UPPER, LETTERS))
    return _run(r, "".join(r.sample(letters, r.randint(10, 26))) + _run(r, DIGITS, 5, 10), 24, 48)


#: Makes of secrets and of ordinary candidates.
SECRETS = {
    "forge": lambda r: r.choice(("ghp_", "gho_", "ghu_", "ghs_", "ghr_")) + _run(r, LETTERS, 36),
    "plain": lambda r: _run(r, LETTERS, 20, 48),
    "payment": lambda r: r.choice(("sk", "pk", "rk")) + r.choice(("_live_", "_test_", "-live-", "-test-")) + _run(r, LETTERS, 24, 34),
    "chat": lambda r: "xox" + r.choice("bpars") + "-" + _run(r, DIGITS, 10, 12) + "-" + _run(r, DIGITS, 10, 12) + "-" + _run(r, LETTERS, 24),
    "base64": lambda r: _run(r, LETTERS + "+/", 32, 88) + r.choice(("", "=", "==")),
    "signed": lambda r: "eyJ" + _run(r, LETTERS + "-_", 20, 120),
    "cloud": lambda r: "AIza" + _run(r, LETTERS + "-_", 35),
    "upper": lambda r: _run(r, UPPER + DIGITS, 20, 40),
    "armour": lambda r: "MII" + _run(r, LETTERS + "+/", 61),
    "package": lambda r: r.choice(("npm_", "glpat-", "hf_", "pypi-")) + _run(r, LETTERS, 20, 36),
    "upper_hex": lambda r: _run(r, DIGITS + "ABCDEF", 32, 64),
    "lower": lambda r: _run(r, LOWER + DIGITS, 24, 40),
    "parts": _parts,
    "sealed": lambda r: _run(r, LETTERS + "+/=", 64, 100),
    "alphabet": _alphabet,
}
ORDINARY = {
    "digits": lambda r: _run(r, DIGITS, 16, 60),
    "slug": lambda r: _words(r, "-"),
    "uuid": _uuid,
    "grouped": _grouped,
    "path": lambda r: _words(r, "/"),
    "snake": lambda r: _words(r, "_", r.choice((str, str.upper))),
    "date": _date,
    "camel": lambda r: _words(r, "", str.capitalize),
    "joined": lambda r: _words(r, ""),
    "ruled": _ruled,
}
#: What stands around generated candidates.
NAMED = ('token = "', "api_key: ", 'password: "', "Authorization: Bearer ", "export ACCESS_KEY=", "secret ", '"credential": "')
NEUTRAL = ("see ", "the file ", "https://example.org/", "order ", "number ", "id: ", "in ", "(", '"', "\n", "", "version ")
BEHIND = ('"', " ", "\n", ")", ", and ", ".", "", "' on")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the rules' findings, in order."""
    out = []
    lowered = text.lower()
    if any(w in lowered for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, whether a rule's span covers some of it) of every candidate."""
    if not DIGIT.search(text):
        return []
    ends = list(accumulate((e for _, _, e in base), max))
    starts = [s for s, _, _ in base]

    def covered(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return before > 0 and ends[before - 1] > start

    return [(m.start(), m.end(), covered(m.start(), m.end())) for m in CANDIDATE.finditer(text) if DIGIT.search(m[0])]


def window(text: str, start: int, end: int) -> bytes:
    """The classes of the characters that the network reads; 0 is nothing."""
    parts = (text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0"), text[start:end], text[end : end + AFTER].ljust(AFTER, "\0"))
    return bytes([0 if c == "\0" else CLASSES.get(c, OTHER) for c in "".join(parts)])


class Network:
    """Embedding and convolution in one table, largest value of each filter by region (before, inside, after), one layer
    on top. Windows may have any length: they stand in a row with nothing between them."""

    def __init__(self, seed: int = 7):
        random = np.random.default_rng(seed)
        self.table = random.normal(0, 0.2, (SPAN, OTHER + 1, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.top = random.normal(0, 0.2, 3 * FILTERS + 1).astype(np.float32)
        self.slope, self.shift, self.threshold = 1.0, 0.0, 1.1
        #: Running means of the gradients and of their squares, steps so far.
        self.first, self.second, self.turn = [np.zeros_like(w) for w in self.weights()], [np.zeros_like(w) for w in self.weights()], 0

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.bias, self.top]

    def state(self) -> np.ndarray:
        """Weights and running means in a row."""
        return np.concatenate([w.ravel() for w in self.weights() + self.first + self.second]).astype(np.float64)

    def restore(self, state: np.ndarray, turn: int) -> None:
        at, self.turn = 0, turn
        for w in self.weights() + self.first + self.second:
            w[...] = state[at : at + w.size].reshape(w.shape)
            at += w.size

    def _filtered(self, x: np.ndarray) -> np.ndarray:
        steps = len(x) - SPAN + 1
        return self.bias + sum(self.table[k][x[k : k + steps]] for k in range(SPAN))

    def _row(self, windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Codes in a row, and where the regions of each window start (a fourth one is the gap)."""
        gap = bytes(SPAN - 1)
        x = np.frombuffer(gap.join(windows) + gap + b"\0", np.uint8)
        sizes = np.array([len(w) for w in windows])
        first = np.cumsum(sizes + SPAN - 1) - sizes - SPAN + 1
        return x, np.stack([first, first + BEFORE, first + sizes - AFTER, first + sizes], axis=1).ravel()

    def _forward(self, windows: list[bytes]):
        """Codes in a row, filter values, where regions start, their largest values, outputs."""
        x, cuts = self._row(windows)
        h = self._filtered(x)
        best = np.maximum.reduceat(h, cuts, axis=0).reshape(len(windows), 4, FILTERS)
        return x, h, cuts, best, self._out(best[:, :3])

    def _peaks(self, windows: list[bytes], stretch: int = STRETCH):
        """Codes in a row, the regions' largest values and where they stand, outputs. Long rows are read in stretches."""
        if sum(map(len, windows)) <= stretch:
            x, h, cuts, best, out = self._forward(windows)
            region = np.repeat(np.arange(len(cuts)), np.diff(np.append(cuts, len(h))))
            place, filters = np.nonzero(h == best.reshape(-1, FILTERS)[region])
            at = np.zeros((len(cuts), FILTERS), np.int64)
            at[region[place], filters] = place
            return x, best[:, :3], at.reshape(best.shape)[:, :3], out
        x, cuts = self._row(windows)
        best, at = np.full((len(windows), 3, FILTERS), -np.inf, np.float32), np.zeros((len(windows), 3, FILTERS), np.int64)
        for n, edges in enumerate(cuts.reshape(-1, 4)):
            for k in range(3):
                for a in range(edges[k], edges[k + 1], stretch):
                    h = self._filtered(x[a : min(a + stretch, edges[k + 1]) + SPAN - 1])
                    place = h.argmax(axis=0)
                    value = h[place, np.arange(FILTERS)]
                    at[n, k] = np.where(value > best[n, k], place + a, at[n, k])
                    best[n, k] = np.maximum(value, best[n, k])
        return x, best, at, self._out(best)

    def _out(self, best: np.ndarray) -> np.ndarray:
        return np.maximum(best, 0).reshape(len(best), -1) @ self.top[:-1] + self.top[-1]

    def _long(self, one: bytes, stretch: int = STRETCH) -> float:
        """As _forward() for a single window, in stretches."""
        x = np.frombuffer(one + bytes(SPAN - 1), np.uint8)
        best = np.full((1, 3, FILTERS), -np.inf, np.float32)
        regions = ((0, BEFORE), (BEFORE, len(one) - AFTER), (len(one) - AFTER, len(one)))
        for at in range(0, len(one), stretch):
            h = self._filtered(x[at : at + stretch + SPAN - 1])
            for n, (low, high) in enumerate(regions):
                part = h[max(0, low - at) : max(0, high - at)]
                best[0, n] = np.maximum(best[0, n], part.max(axis=0, initial=-np.inf))
        return float(self._out(best)[0])

    def raw(self, windows: list[bytes]) -> np.ndarray:
        out, part, size = [], [], 0
        for w in [*windows, None]:
            if part and (w is None or size + len(w) > STRETCH):
                out += self._forward(part)[4].tolist() if size <= STRETCH else [self._long(part[0])]
                part, size = [], 0
            if w is not None:
                part.append(w)
                size += len(w)
        return np.array(out, np.float32)

    def probability(self, windows: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(windows) + self.shift, -30, 30)))

    def fit(self, windows: list[bytes], y: np.ndarray, rounds: int = ROUNDS, seed: int = 11) -> None:
        """Rounds of Adam, from where the last ones ended."""
        random, rate = np.random.default_rng(seed), 0.01
        for _ in range(rounds):
            for part in np.array_split(random.permutation(len(y)), max(1, len(y) // 64)):
                x, best, at, out = self._peaks([windows[n] for n in part])
                error = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[part]) / len(part)
                top = np.append(np.maximum(best, 0).reshape(len(part), -1).T @ error, error.sum())
                down = (error[:, None] * self.top[:-1]).reshape(best.shape) * (best > 0)
                table = np.zeros_like(self.table)
                columns = np.broadcast_to(np.arange(FILTERS), at.shape)
                for k in range(SPAN):
                    np.add.at(table[k], (x[at + k], columns), down)
                self.turn += 1
                for w, g, m, v in zip(self.weights(), [table, down.sum(axis=(0, 1)), top], self.first, self.second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**self.turn)) / (np.sqrt(v / (1 - 0.999**self.turn)) + 1e-8)

    def steps(self, windows: list[bytes]) -> np.ndarray:
        """Outputs as numbers of steps."""
        return np.clip(np.rint(self.raw(windows).astype(float) * STEPS), -MOST, MOST).astype(np.int64)

    def calibrate(self, raw: np.ndarray, y: np.ndarray, weight: np.ndarray, recall: float = RECALL) -> None:
        """Platt's scaling of weighted outputs, then a threshold that keeps the share of positives at the best precision."""
        positive, negative = (weight * y).sum(), (weight * (1 - y)).sum()
        goal = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
        z = np.column_stack([raw, np.ones(len(raw))])
        prior = np.array([1.0, 0.0])

        def loss(w: np.ndarray) -> float:
            return float((weight * (np.logaddexp(0, z @ w) - goal * (z @ w))).sum() + 5e-4 * ((w - prior) ** 2).sum())

        w = prior
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + 1e-3 * np.eye(2), z.T @ (weight * (goal - p)) - 1e-3 * (w - prior))
            # Outputs far out make whole steps overshoot.
            part = next((f for f in 0.5 ** np.arange(30) if loss(w + f * step) < loss(w)), 0.0)
            w = w + part * step
            if not part:
                break
        self.slope, self.shift = w.tolist()
        good, bad = np.flatnonzero(y > 0), raw[y == 0]
        good = good[np.argsort(raw[good], kind="stable")]
        sums = np.cumsum(weight[good])
        most = raw[good[min(np.searchsorted(sums, (1 - recall) * sums[-1], side="right"), len(good) - 1)]]
        # Any lower threshold above the next finding that is no secret is as precise: the middle is the safest.
        least = max(bad[bad < most].max(initial=most - 2.0), -self.shift / self.slope if self.slope > 0 else most)
        middle = (most + min(least, most)) / 2
        self.threshold = float(1 / (1 + np.exp(-np.clip(self.slope * middle + self.shift, -30, 30))))


def surrounded(r: Random, run: str, named: float) -> bytes:
    """The window of a run in generated surroundings, with this chance of words that name a secret."""
    before = _word(r) + " " + _word(r) + r.choice((" ", "\n", ": ")) + r.choice(NAMED if r.random() < named else NEUTRAL)
    return window(before + run + r.choice(BEHIND) + _word(r), len(before), len(before) + len(run))


def generated(makes: dict, secret: bool, each: int, seed: int) -> list[bytes]:
    """``each`` windows of every make; those without a digit are no candidates and left out."""
    r = Random(seed)
    runs = [make(r) for make in makes.values() for _ in range(each)]
    return [surrounded(r, run, 0.4 if secret else 0.15) for run in runs if DIGIT.search(run)]


def moved(r: Random, found: bytes) -> bytes:
    """A finding of the rules in neutral surroundings."""
    other = surrounded(r, "0", 0.0)
    return other[:BEFORE] + found[BEFORE : len(found) - AFTER] + other[len(other) - AFTER :]


def _only_numbers(found: bytes) -> bool:
    return set(found[BEFORE : len(found) - AFTER]) <= {CLASSES[c] for c in DIGITS + "+/_=-"}


def _hash(found: bytes) -> int:
    return xxhash.xxh64_intdigest(found, seed=3)


def own(findings: list[bytes]) -> list[bytes]:
    """Findings as they stand, then moved. Findings of digits alone are secrets only where they stand."""
    return findings + [moved(Random(_hash(w)), w) for w in findings if not _only_numbers(w)]


def made(late: bool, secrets: dict, ordinary: dict) -> tuple[list[bytes], list[bytes]]:
    """Generated secrets, of three quarters of the makes or (``late``) the others, and ordinary candidates."""
    makes = {k: m for n, (k, m) in enumerate(secrets.items()) if (n % 4 == 1) == late}
    return generated(makes, True, 2 * GENERATED, 1 + late), generated(ordinary, False, (3 - late) * GENERATED, 5 + late)


def _averages(rows: list[tuple[int, bytes]]) -> bytes:
    """The average of states, each as often as it says."""
    total = sum(n for n, _ in rows)
    return (sum(n * np.frombuffer(state) for n, state in rows) / total).tobytes()


def _fitted(network: Network, early: DataFrame, parts: int, secrets: dict, ordinary: dict) -> None:
    """Fit on ``early`` (part, window): a task for every part, weights averaged after every round."""
    each = ROUNDS if parts == 1 else 1

    def fit(seed: int):
        def run(group: pa.Table) -> pa.Table:
            # A task may hold several parts: each starts from the same weights.
            one, found = deepcopy(network), sorted(group.column("window").to_pylist())
            yes, no = made(False, secrets, ordinary)
            yes += own(found)
            one.fit(yes + no, np.array([1.0] * len(yes) + [0.0] * len(no)), each, seed)
            part = group.column("part")[0].as_py()
            return pa.table({"part": [part], "n": [len(found)], "turn": [one.turn], "state": [one.state().tobytes()]})

        def meet(group: pa.Table) -> pa.Table:
            rows = sorted(zip(*(group.column(c).to_pylist() for c in ("part", "n", "turn", "state"))))
            state = _averages([(n, s) for _, n, _, s in rows])
            return pa.table({"part": [rows[0][0]], "n": [sum(r[1] for r in rows)], "turn": [max(r[2] for r in rows)], "state": [state]})

        schema = "part long, n long, turn long, state binary"
        # The number of partitions is given, so that Spark does not join the tasks.
        fitted = early.repartition(parts, "part").groupBy("part").applyInArrow(run, schema)
        return fitted if parts <= MEETING else fitted.groupBy(F.pmod("part", F.lit(MEETING)).alias("meeting")).applyInArrow(meet, schema)

    for n in range(0, ROUNDS, each):
        rows = sorted(fit(11 + n).collect(), key=lambda r: r.part)
        network.restore(np.frombuffer(_averages([(r.n, r.state) for r in rows])), max(r.turn for r in rows))


def _outputs(network: Network, late: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the outputs for ``late`` (window), as they stand and moved, and how many of each there are."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(network.steps(own(batch.column("window").to_pylist())))], names=["step"])

    rows = late.select("window").mapInArrow(run, "step long").groupBy("step").count().collect()
    rows = np.array(sorted((r["step"], r["count"]) for r in rows), np.int64).reshape(-1, 2)
    return rows[:, 0], rows[:, 1]


def trained(findings: DataFrame | list[bytes], secrets: dict = SECRETS, ordinary: dict = ORDINARY) -> Network:
    """A network fitted on three quarters of the makes of secrets and two thirds of the rules' findings, and calibrated on
    the rest: those makes are new to it there. ``findings`` has all different windows (``window``), or is an empty list."""
    network, steps, counts, n_early, n_late, size = Network(), np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0, 0
    if not isinstance(findings, list):
        of = findings.agg(*(F.count(F.when(F.col("late") == late, 1)) for late in (False, True)), F.sum(F.when(~F.col("late"), F.length("window"))))
        n_early, n_late, size = of.first()
    if n_early:
        parts = max(-(-n_early // PART), -(-size // PART_BYTES))
        _fitted(network, findings.where("not late").select(F.pmod(F.xxhash64("window"), F.lit(parts)).alias("part"), "window"), parts, secrets, ordinary)
    else:
        yes, no = made(False, secrets, ordinary)
        network.fit(yes + no, np.array([1.0] * len(yes) + [0.0] * len(no)))
    if n_late:
        steps, counts = _outputs(network, findings.where("late"))
    yes, no = (network.steps(w) for w in made(True, secrets, ordinary))
    y = np.repeat([1.0, 1.0, 0.0], [len(yes), len(steps), len(no)])
    weight = np.concatenate([np.ones(len(yes)), counts * min(1.0, WEIGHED / max(1, n_late)), np.ones(len(no))])
    network.calibrate(np.concatenate([yes, steps, no]) / STEPS, y, weight)
    return network


def _found(df: DataFrame) -> DataFrame:
    """The one pass over the texts: per document the rules' spans and every candidate with its window."""

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("covered", pa.bool_()), ("window", pa.binary())]))
        for batch in batches:
            spans, found = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                spans.append([v for s, k, e in base for v in (s, k, e)])
                found.append([{"start": a, "end": b, "covered": c, "window": window(text, a, b)} for a, b, c in candidates(text, base)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(pa.int64())), pa.array(found, kind)], names=["doc_id", "spans", "found"])

    return saved(documents(df).mapInArrow(run, "doc_id long, spans array<long>, found array<struct<start:long,end:long,covered:boolean,window:binary>>"), "found")


def findings(found: DataFrame) -> DataFrame:
    """All different windows of candidates that a rule covers, a third of them ``late``."""

    def run(batches):
        for batch in batches:
            late = [_hash(w) % 3 == 0 for w in batch.column("window").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("window"), pa.array(late, pa.bool_())], names=["window", "late"])

    each = found.select(F.explode("found").alias("x")).where("x.covered").select("x.window").distinct()
    return saved(each.mapInArrow(run, "window binary, late boolean"), "findings", tidy=False)


def scanned(df: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end, joined by commas, in order of start, then kind, then end; code points, end exclusive. Null
    and empty texts have none. Texts and candidates are read whole, whatever their length; shorter runs, and runs without
    a digit, are found by the rules alone. Repeated rows stay; other columns are left aside; an empty table gives no rows.
    """
    found = _found(df)
    uncovered = F.exists("found", lambda x: ~x["covered"])
    network = None if found.where(uncovered).isEmpty() else trained(findings(found))

    def run(batches):
        for batch in batches:
            counts, sums, texts = [[], [], []], [], []
            spans, lists = batch.column("spans").to_pylist(), batch.column("found").to_pylist()
            open_ = [(n, x) for n, found in enumerate(lists) for x in found if not x["covered"]]
            more: dict[int, list] = {}
            if open_ and network:
                for (n, x), p in zip(open_, network.probability([x["window"] for _, x in open_])):
                    if p >= network.threshold:
                        more.setdefault(n, []).append((x["start"], 3, x["end"]))
            for n, flat in enumerate(spans):
                base = list(zip(flat[::3], flat[1::3], flat[2::3]))
                for k in range(3):
                    counts[k].append(sum(b[1] == k for b in base))
                shown = [",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in s) for s in (base, sorted(base + more.get(n, [])))]
                sums.append(hashlib.sha256(shown[0].encode()).hexdigest())
                texts.append(shown[1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(sums, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return found.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
