"""Rot metrics on the recipes of FIXTURES.md."""

import math
import random

import pytest
from pyspark.sql import functions as F

from helpers import act, edit, fail, ok, read, say, sessions
from tracewarden.functions import classify as c
from tracewarden.operators import buffer as b, rot, turns as t

SENTENCE = "This is a fairly long sentence that is going to be repeated every turn"
RULES = rot.Constraints(no_new_deps=True, forbidden_prefixes=["/secret/"], must_touch_paths=["README.md"])

CASES = {
    "turns": [say("one"), read("a"), say("two"), edit("b")],
    "inflation": [say(" ".join(["word"] * (10 * 2**i))) for i in range(6)],
    "hedging": [say("plain text here"), say(" ".join(["maybe perhaps"] * 80))],
    "sentence": [say(SENTENCE + ".") for _ in range(5)],
    "ngrams": [say("foo bar baz " * 30)],
    "distinct": [read("f%d" % i) for i in range(10)],
    "same_command": [fail("npm test", "error %s" % "abcdefghij"[i]) for i in range(10)],
    "same_error": [fail("cmd %s" % "abcdefgh"[i], "TypeError: x is not a function at line %d" % i) for i in range(8)],
    "reading": [x for i in range(20) for x in (say("turn"), read("f%d" % i))],
    "healthy": [x for i in range(8) for x in (say("did step %s" % "abcdefgh"[i]), edit("f%d" % i), ok("pytest %d" % i))],
    "no_edits": [x for i in range(10) for x in (say("t"), read("f%d" % i))],
    "churn": [x for i in range(8) for x in (say("t"), edit("same.py"), fail("pytest", "E"))],
    "deps": [say("x"), edit("app/package.json"), read("/secret/key")],
    "touched": [say("t%d" % i) for i in range(7)] + [read("docs/README.md")],
    "chat": [say("hi"), say("hello")],
    "empty_output": [read("a"), edit("b")],
}


@pytest.fixture(scope="module")
def modules(spark):
    return {r.session_id: r for r in rot.rot_modules(b.buffer(sessions(spark, CASES)), rules=RULES).collect()}


def part(row, module, name):
    return next(p.value for p in row[module].contributors if p.name == name)


def test_behavioral(modules):
    assert part(modules["inflation"], "behavioral", "length_inflation") > 0.2
    assert part(modules["hedging"], "behavioral", "hedge_density") > 0.5
    assert modules["empty_output"].behavioral.value == 0


def test_repetition(modules):
    assert modules["sentence"].repetition.value > 0.3
    assert part(modules["sentence"], "repetition", "repeated_sentences") == 1.0
    assert part(modules["ngrams"], "repetition", "ngram_self_repeat") > 0.3


def test_thrash(modules):
    assert modules["distinct"].thrash.value < 0.1
    assert part(modules["same_command"], "thrash", "repeated_tool_calls") > 0.5
    assert part(modules["same_error"], "thrash", "repeated_errors") > 0.5
    assert part(modules["reading"], "thrash", "turns_since_progress") > 0.3
    assert modules["same_command"].thrash.evidence[0] == "'Bash: npm test' repeated 10x in last 20 actions"


def test_progress(modules):
    assert modules["healthy"].progress.value < 0.2
    assert modules["no_edits"].progress.value > 0.5
    assert part(modules["churn"], "progress", "file_churn") == 0.35
    # Two turns of plain talk: a fifth of the full penalty.
    assert modules["chat"].progress.value == round(0.55 * 0.2, 4)


def test_constraints(modules):
    deps = modules["deps"]
    assert part(deps, "constraint", "no_new_deps") == 0.5
    assert part(deps, "constraint", "forbidden_paths") == 0.3
    assert part(deps, "constraint", "must_touch") == 0
    assert part(modules["touched"], "constraint", "must_touch") == 0
    assert part(modules["no_edits"], "constraint", "must_touch") == 1.0
    assert modules["no_edits"].constraint.evidence == ["required path not yet touched after 6 turns: README.md"]


def test_turns(spark):
    rows = t.turns(b.buffer(sessions(spark, {"s": CASES["turns"]}))).orderBy("turn_idx").collect()
    assert [(r.action_count, r.has_edit, r.model_output) for r in rows] == [(2, False, "one"), (2, True, "two")]


def ema(scores, alpha=0.4):
    s, out = None, []
    for r in scores:
        s = r if s is None else alpha * r + (1 - alpha) * s
        out.append(s)
    return out


def states(smoothed):
    runs, out = [0, 0, 0], []
    for s in smoothed:
        runs = [n + 1 if s >= limit else 0 for n, limit in zip(runs, (0.6, 0.4, 0.2))]
        out.append(3 if runs[0] >= 2 else 2 if runs[1] >= 3 else 1 if runs[2] >= 2 else 0)
    return out


def test_smoothing_of_a_long_session_matches_the_plain_loop(spark):
    random.seed(3)
    scores = [random.random() * (1.2 if i % 700 < 350 else 0.5) for i in range(5000)]
    ticks = spark.createDataFrame(
        [("s", i + 1, float(r), 0.0, 0.0) for i, r in enumerate(scores)],
        "session_id string, snapshot_id bigint, raw_score double, constraint double, thrash double",
    )
    rows = rot.smooth(ticks).orderBy("snapshot_id").collect()
    expected = ema(scores)
    assert len(rows) == len(scores)
    assert max(abs(r.smoothed_score - e) for r, e in zip(rows, expected)) < 1e-12
    assert [r.state for r in rows] == states(expected)


def test_alarm_goes_straight_to_the_worst_state(spark):
    ticks = spark.createDataFrame(
        [("s", 1, 0.1, 0.7, 0.7), ("s", 2, 0.1, 0.7, 0.69)],
        "session_id string, snapshot_id bigint, raw_score double, constraint double, thrash double",
    )
    assert [r.state for r in rot.smooth(ticks).orderBy("snapshot_id").collect()] == [3, 0]


@pytest.mark.parametrize("every", [1, 7, 8, 100])
def test_last_snapshot_equals_the_final_state(spark, every):
    case = {"s": CASES["churn"]}
    actions = sessions(spark, case)
    final = rot.rot_modules(b.buffer(actions, 20)).first()
    replayed = rot.rot_modules(b.replay(actions, every=every, max_size=20), ["session_id", "snapshot_id"])
    last = replayed.orderBy(F.desc("snapshot_id")).first()
    assert last.snapshot_id == -(-len(CASES["churn"]) // every)
    assert last.raw_score == final.raw_score and last.thrash == final.thrash and last.progress == final.progress


@pytest.mark.parametrize("alpha", [0.02, 0.4, 0.97, 1.0])
def test_smoothing_forgets_nothing(spark, alpha):
    random.seed(4)
    scores = {"a": [random.random() for _ in range(3000)], "b": [1.0] + [0.0] * 900, None: [0.5, 0.9]}
    ticks = spark.createDataFrame(
        [(k, i + 5, float(r), 0.0, 0.0) for k, values in scores.items() for i, r in enumerate(values)],
        "session_id string, snapshot_id bigint, raw_score double, constraint double, thrash double",
    )
    got = {(r.session_id, r.snapshot_id): r.smoothed_score for r in rot.smooth(ticks, alpha).collect()}
    assert len(got) == sum(map(len, scores.values()))
    for k, values in scores.items():
        s = None
        for i, r in enumerate(values):
            s = r if s is None else alpha * r + (1 - alpha) * s
            assert abs(got[k, i + 5] - s) <= 1e-12 * max(s, 1e-200) + 1e-300


def test_scores_are_blended_with_four_digits(spark):
    df = spark.createDataFrame([(0.29001,)], "raw_score double").select(rot.shown("raw_score"))
    from tracewarden.operators import score

    mixed = df.select(score.blend(F.lit(0), None, F.col("raw_score"), score.BlendWeights(0.0, 0.0, 1.0)).alias("v")).first().v
    assert df.first().raw_score == 0.29 and mixed == int((1 - 0.29) * 100)


def test_rounding_is_that_of_python(spark):
    random.seed(1)
    values = [random.randrange(0, 200001) / 100000 * random.choice([1, 0.35, 0.55, 0.45]) for _ in range(3000)]
    values += [k / 32 for k in range(64)] + [0.55 * 0.375, 2.675, 0.00005, 1234.56785]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", c.round_half_even(F.col("v"), 4).alias("r4"), c.round_half_even(F.col("v"), 1).alias("r1")
    )
    for r in df.collect():
        assert r.r4 == round(r.v, 4) and r.r1 == round(r.v, 1), r


def plain_fold(scores, alpha):
    out = []
    for raw in scores:
        out.append(raw if not out else alpha * raw + (1.0 - alpha) * out[-1])
    return out


@pytest.mark.parametrize("alpha", [rot.ALPHA, 0.05, 0.9, 1.0])
def test_smoothing_has_the_bits_of_the_fold(spark, alpha):
    """Long sessions in hundredths, where the last bit decides thresholds; a null session; ids that start late."""
    r = random.Random(8)
    cases = {"long": (0, [r.randrange(101) / 100 for _ in range(100_000)]), "steps": (0, [0.2] * 700 + [0.6] * 5000 + [0.0] * 4000 + [1.0] * 900), "zeros": (0, [0.0] * 3000),
             None: (690, [r.random() for _ in range(3000)]), "one": (5, [0.7]), "wide": (3, [r.choice([-1e8, 1e8, 0.1]) for _ in range(4000)])}
    rows = [(s, first + i, x, 0.0, 0.0) for s, (first, xs) in cases.items() for i, x in enumerate(xs)]
    ticks = spark.createDataFrame(rows, "session_id string, snapshot_id long, raw_score double, constraint double, thrash double").repartition(5)
    got = rot.smooth(ticks, alpha)
    assert sorted(got.columns) == sorted([*ticks.columns, "smoothed_score", "state"])
    found = {}
    for x in got.collect():
        found.setdefault(x.session_id, []).append((x.snapshot_id, x.raw_score, x.smoothed_score))
    assert found.keys() == cases.keys()
    for s, (_, xs) in cases.items():
        assert [x[1:] for x in sorted(found[s])] == list(zip(xs, plain_fold(xs, alpha)))
