"""Toxicity from a lexicon, tolerant of spelling, with context windows.

The lexicon is a trie. A Levenshtein automaton over it is determinised step by step while words are read: a state is
the set of trie nodes with the fewest edits that reach each. Almost every word leaves it after two or three letters,
so misspelled terms cost no more than a search for exact ones. Each hit is weighed by its window: hits inside
quotation marks or beside a word of reporting count apart from direct ones, and close hits strengthen one another. A
logistic regression, fitted on labelled rows, turns a document's counts into a score.

The lexicon has two parts: a list of our own, and terms learned from the labelled rows that are not held out, in whatever
language: words that toxic texts hold much more often than others. Weights of learned terms are fitted on rows that had
no part in learning them: FOLDS parts, each described by terms of the others.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.shared import saved, smallest

#: Our own list of terms of abuse, English, a few German, French and Spanish ones.
LEXICON = (
    "idiot moron stupid loser trash scum clown worthless pathetic disgusting imbecile garbage filthy dumbass "
    "bastard asshole cretin halfwit idiotin abschaum connard abruti imbécile estúpido asqueroso"
).split()
REPORTING = "said says called calls wrote writes quoted quote word term sagte schrieb nannte dit écrit dijo escribió".split()
LOOKALIKE = str.maketrans("01345789@$!*", "oieastbgasi*")
WORD = re.compile(r"[^\W_]+(?:[*@$!][^\W_]+)*")
#: Code points around a hit that are read for quotation; words within which hits strengthen one another.
AROUND, NEAR = 60, 20
FEATURES = ["direct", "any", "misspelled", "loose", "quoted", "dense", "close", "learned", "learned_direct"]
#: Texts that must hold a learned term at least, and how much likelier than others a toxic text is to hold it.
LEAST, LIKELIER, FOLDS = 4, 20.0, 5
#: Labelled rows the model is fitted on, at most; of more, those whose hash is smallest.
FITTED = 20_000
THRESHOLD = 0.7
#: Used where the labels do not hold both classes, and what weights are drawn to where labels say little: abuse once,
#: in whatever spelling, is likely toxic.
PRIOR = [-3.0, 1.0, 4.5, 4.5, 0.0, 0.0, 0.0, 0.0, 4.0, 0.5]


def edits(term: str) -> int:
    """Edits a term of this length may have."""
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class Automaton:
    """Deterministic states of the Levenshtein automaton over the lexicon's trie, made when first met."""

    def __init__(self, lexicon: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.terms: list[str | None] = [None]
        self.most: list[int] = [0]
        for term in lexicon:
            node = 0
            for n, letter in enumerate(term):
                if letter not in self.children[node]:
                    self.children.append({})
                    self.terms.append(None)
                    self.most.append(0)
                    self.children[node][letter] = len(self.children) - 1
                self.most[node] = max(self.most[node], edits(term))
                node = self.children[node][letter]
            self.terms[node], self.most[node] = term, max(self.most[node], edits(term))
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state({0: 0})

    def _state(self, found: dict[int, int]) -> int:
        # A letter of a term left out: go down without reading.
        todo = list(found.items())
        while todo:
            node, cost = todo.pop()
            if cost < self.most[node] and found.get(node) == cost:
                for child in self.children[node].values():
                    if cost + 1 < found.get(child, 9) and cost + 1 <= self.most[child]:
                        found[child] = cost + 1
                        todo.append((child, cost + 1))
        key = frozenset(found.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
        return self.states[key]

    def _step(self, state: int, letter: str) -> int:
        found: dict[int, int] = {}
        for node, cost in self.sets[state]:
            child = self.children[node].get(letter)
            if child is not None and cost < found.get(child, 9) and cost <= self.most[child]:
                found[child] = cost
            for other, price in [(node, cost + 1), *((c, cost + 1) for c in self.children[node].values())]:
                if price <= self.most[other] and price < found.get(other, 9):
                    found[other] = price
        return self._state(found) if found else -1

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its edits, and how many it took; of equally near ones the first in order."""
        state, steps = self.start, self.steps
        for letter in word:
            to = steps[state].get(letter)
            if to is None:
                to = steps[state][letter] = self._step(state, letter)
            if to < 0:
                return None
            state = to
        ends = [(cost, self.terms[node]) for node, cost in self.sets[state] if self.terms[node] and cost <= edits(self.terms[node])]
        cost, term = min(ends, default=(0, None))
        return (term, cost) if term else None


class Scorer:
    """Features of texts; remembers words of either kind."""

    def __init__(self, lexicon: list[str] = LEXICON, learned: list[str] = ()):
        self.automaton, self.learned = Automaton(lexicon), frozenset(learned)
        self.known: dict[str, tuple] = {}

    def _match(self, word: str) -> tuple[str, int, int] | None:
        """The nearest term, its edits, and which list it is from."""
        plain = word.translate(LOOKALIKE)
        if hit := self.automaton.match(word) or plain != word and self.automaton.match(plain):
            return *hit, 0
        # Near misses of learned terms tell nothing (the fit gave them a negative weight): only whole words count.
        return next(((w, 0, 1) for w in (word, plain) if w in self.learned), None)

    def features(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * len(FEATURES)
        lowered = text.lower()
        words = WORD.findall(lowered)
        known, hits = self.known, {}
        for word in set(words):
            if (hit := known.get(word, 0)) == 0:
                hit = known[word] = self._match(word)
            if hit:
                hits[word] = hit
        if len(known) > 500_000:
            known.clear()
        if not hits:
            return [0.0] * len(FEATURES)
        exact = misspelled = loose = quoted = close = learned = 0
        last = None
        for n, found in enumerate(WORD.finditer(lowered)):
            hit = hits.get(found[0])
            if not hit:
                continue
            if is_quoted(lowered, found.start(), found.end()):
                quoted += not hit[2]
                continue
            if hit[2]:
                learned += 1
                continue
            if hit[1] and found[0][0] != hit[0][0]:
                loose += 1
                continue
            exact, misspelled = exact + (not hit[1]), misspelled + bool(hit[1])
            close += last is not None and n - last <= NEAR
            last = n
        direct = exact + misspelled
        counts = [np.log1p(exact), exact > 0, misspelled > 0, np.log1p(loose), np.log1p(quoted), min(1.0, 20.0 * direct / len(words)), np.log1p(close)]
        return [float(x) for x in (*counts, learned > 0, np.log1p(learned))]


def is_quoted(text: str, start: int, end: int) -> bool:
    """Whether quotation marks stand on both sides in the same line, near by, or a word of reporting just before."""
    before, after = text[max(0, start - AROUND) : start].rpartition("\n")[2], text[end : end + AROUND].partition("\n")[0]
    for left, right in (('"', '"'), ("“", "”"), ("«", "»"), ("„", "“")):
        if left in before and right in after and (left != right or before.count(left) % 2):
            return True
    return any(w in REPORTING for w in WORD.findall(before)[-2:])


def features(text: Column, learned: list[str] = ()) -> Column:
    """The counts of FEATURES as an array of doubles; null and empty texts have zeros."""
    return features_by_list(text, F.lit(0), [learned])


def features_by_list(text: Column, number: Column, lists: list[list[str]]) -> Column:
    """As features(), the learned terms of each row being the list of that number."""
    terms = [list(x) for x in lists]

    @F.pandas_udf("array<double>")
    def run(parts: "pd.Series", numbers: "pd.Series") -> "pd.Series":
        scorers = run.scorers = getattr(run, "scorers", None) or [Scorer(LEXICON, x) for x in terms]
        return pd.Series([scorers[n].features(t) for t, n in zip(parts, numbers)])

    return run(text.cast("string"), number.cast("int"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(df: DataFrame, labels: DataFrame, rows: int = FITTED) -> DataFrame:
    """doc_id, text, toxic of at most ``rows`` documents that have a label and are not held out: those whose hashed doc_id
    is smallest. Missing labels are left out; of several labels of one document the largest counts, of several texts the
    least."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null")
    marks = marks.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chosen = smallest(texts.select("doc_id").distinct().join(marks, "doc_id"), F.xxhash64("doc_id"), rows).select("doc_id", "toxic")
    # At most ``rows`` pairs of numbers are broadcast.
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    # Equal texts share a fold: none is described by terms that its copy taught.
    return saved(sample.withColumn("fold", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(FOLDS)).cast("int")), "labelled")


def learned(sample: DataFrame, least: int = LEAST) -> tuple[list[str], list[list[str]]]:
    """Words that at least ``least`` different toxic texts hold, and toxic texts LIKELIER times as often as others; and for
    each fold those that its complement teaches, where one toxic text less is enough. One pass counts for all of them."""
    texts = sample.groupBy("fold", "text").agg(F.max("toxic").alias("toxic"))
    sizes = {r.fold: (r.t, r.n) for r in texts.groupBy("fold").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).collect()}
    toxic, total = (sum(x[k] for x in sizes.values()) for k in (0, 1))
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)[^\W_]+(?:[*@$!][^\W_]+)*"), F.lit(0)))).alias("word")
    inside = [F.col("fold") == fold for fold in range(FOLDS)]
    apart = [f(F.when(x, F.col("toxic"))).alias(f"{c}{n}") for n, x in enumerate(inside) for f, c in ((F.sum, "t"), (F.count, "n"))]
    each = texts.select("fold", "toxic", word).where(F.length("word") > 2).groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"), *apart)

    def taught(t: Column, n: Column, most: int, rows: int, least: int) -> Column:
        return (t >= least) & ((t + 0.5) / (most + 1) >= LIKELIER * (n - t + 0.5) / (rows - most + 1))

    chosen = [taught(F.col("t"), F.col("n"), toxic, total, least)]
    for fold in range(FOLDS):
        t, n = sizes.get(fold, (0, 0))
        chosen.append(taught(F.col("t") - F.coalesce(f"t{fold}", F.lit(0)), F.col("n") - F.col(f"n{fold}"), toxic - t, total - n, least - 1))
    found = each.select("word", F.array(*chosen).alias("chosen")).where(F.exists("chosen", lambda x: x)).orderBy("word").collect()
    lists = [[r.word for r in found if r.chosen[n]] for n in range(FOLDS + 1)]
    return lists[0], lists[1:]


def fit(sample: DataFrame) -> tuple[list[str], list[float]]:
    """Learned terms and weights, the constant first, from labelled()."""
    terms, without = learned(sample)
    counts = features_by_list(F.col("text"), F.col("fold"), without)
    found = sample.select("doc_id", counts.alias("features"), "toxic").orderBy("doc_id").collect()
    y = np.array([float(r.toxic) for r in found])
    if len(set(y.tolist())) < 2:
        return terms, PRIOR
    x = np.column_stack([np.ones(len(y)), np.array([r.features for r in found])])
    prior, ridge = np.array(PRIOR), np.diag([1e-6] + [1.0] * len(FEATURES))
    w = np.zeros(len(prior))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ (w - prior))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return terms, w.tolist()


def score(counts: Column, weights: list[float]) -> Column:
    total = F.lit(weights[0])
    for n, w in enumerate(weights[1:]):
        total = total + counts[n] * F.lit(w)
    return 1 / (1 + F.exp(-total))


def scored(df: DataFrame, labels: DataFrame, rows: int = FITTED, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted.

    The text alone makes the score; null and empty texts get that of no hit. Repeated rows stay. A missing doc_id has no
    label and is not held out. An empty table gives no rows; without labels of both classes fixed prior weights are used.
    """
    terms, weights = fit(labelled(df, labels, rows))
    counts = df.select(F.col("doc_id").cast("long").alias("doc_id"), features(F.col("text"), terms).alias("features"))
    value = score(F.col("features"), weights)
    return counts.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), value.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(df: DataFrame, labels: DataFrame, rows: int = FITTED, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that are not predicted toxic, with all columns. Null and empty texts, repeated rows and those
    without doc_id are judged as scored() does; an empty table gives no rows."""
    terms, weights = fit(labelled(df, labels, rows))
    return df.where(score(features(F.col("text"), terms), weights) < threshold)
