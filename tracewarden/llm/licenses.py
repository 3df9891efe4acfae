"""License scans: an exact set-similarity join of text blocks with license templates; DataFrame operations only.

A block is a line. It meets a template if it holds a share of the template's different words of ``SHARE`` or more
(containment), and the template's mark where it has one: of five words four would do without the one that matters. Words are ordered by how many documents hold them, rarest first; a block that meets a template must
hold one of the template's ``size - need + 1`` rarest words (prefix filter), must have ``need`` template words at all
(length filter), and the first common word must leave enough words behind it on both sides (positional filter). Pairs
that pass are verified on the whole sets.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.shared import NO_ID, ascii_lower, let, saved

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHARE = 0.8
#: Phrases whose words stand consecutively, and their labels (given).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Our own templates: label, wording and the word that tells the license from others, where one does. Order and repeats
#: of words do not matter.
TEMPLATES = [
    ("gpl", "licensed under the gnu general public license", None),
    ("gpl", "under the terms of the gnu general public license", None),
    ("lgpl", "gnu lesser general public license", "lesser"),
    ("agpl", "gnu affero general public license", "affero"),
    ("apache", "licensed under the apache license", "apache"),
    ("mit", "released under the mit license", "mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", None),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", None),
    ("mpl", "subject to the terms of the mozilla public license", "mozilla"),
    ("cc-by", "creative commons attribution license", None),
    ("cc-by-nc", "licensed under cc by nc", "nc"),
    ("cc-by-sa", "licensed under cc by sa", "sa"),
    ("cc0", "to the extent possible under law waived all copyright and related rights", None),
    ("reserved", "all rights reserved", None),
]


def _sets(label: str, text: str, mark: str | None) -> list[tuple[str, list[str], int]]:
    """(label, words, words needed) of a template. One with a mark stands for its wordings with the mark that hold the
    share, each needed whole: a line that meets one of them holds the mark and the share, and the other way round."""
    words = sorted(set(text.split()))
    need = math.ceil(SHARE * len(words))
    if mark is None:
        return [(label, words, need)]
    others = [w for w in words if w != mark]
    return [(label, sorted((mark, *some)), need) for some in combinations(others, need - 1)]


SETS = [x for template in TEMPLATES for x in _sets(*template)]
VOCABULARY = sorted({w for _, words, _ in SETS for w in words})


def _places(words: Column, phrase: str) -> Column:
    """Positions at which the phrase starts."""
    parts = phrase.split()
    at = F.transform(words, lambda w, i: F.when(w == parts[0], i))
    rest = F.filter(at, lambda i: i.isNotNull())
    follows = [lambda i, n=n, part=part: F.coalesce(F.get(words, i + n) == part, F.lit(False)) for n, part in enumerate(parts[1:], 1)]
    return F.filter(rest, lambda i: reduce(and_, (f(i) for f in follows)))


def _base(lowered: Column) -> Column:
    """Struct of n_base, first_word, last_word and labels of the phrases; only texts that hold a phrase's words in a
    row are taken apart."""
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    seen = F.lit(False)
    for phrase in PHRASES:
        parts = phrase.split()
        inside = F.lit(True)
        for part in parts:
            inside = inside & lowered.contains(part)
        seen = seen | (inside & lowered.rlike(gap.join(parts)))

    def of(words: Column) -> Column:
        places = F.array(*(F.struct(F.lit(label).alias("label"), _places(words, phrase).alias("at")) for phrase, label in PHRASES.items()))
        some = F.filter(places, lambda p: F.size(p["at"]) > 0)
        starts = F.flatten(F.transform(some, lambda p: p["at"]))
        return F.struct(starts.alias("starts"), F.sort_array(F.array_distinct(F.transform(some, lambda p: p["label"]))).alias("labels"))

    nothing = F.struct(F.array().cast("array<int>").alias("starts"), F.array().cast("array<string>").alias("labels"))
    return F.when(seen, let(F.regexp_extract_all(lowered, F.lit(WORD), 0), of)).otherwise(nothing)


def _held(text: Column) -> Column:
    """The different template words of a text."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(WORD), 0), lambda w: w.isin(VOCABULARY)))


def _enough(held: Column) -> Column:
    """Whether the words are enough for some template."""
    out = F.lit(False)
    for _, words, need in SETS:
        out = out | (F.size(F.array_intersect(held, F.array(*map(F.lit, words)))) >= need)
    return out


def scan(df: DataFrame) -> DataFrame:
    """What one pass over the texts leaves: per document its key, the base columns, its template words, and of
    documents that hold enough words for a template the lines that do. Saved."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lowered = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), ascii_lower(text).alias("lowered"))
    held = lowered.select("*", let(F.col("lowered"), lambda t: F.struct(_base(t).alias("base"), _held(t).alias("held"))).alias("found"))
    most = min(need for _, _, need in SETS)

    def lines(t: Column) -> Column:
        each = F.transform(F.split(t, "\n"), lambda line, n: F.struct(n.alias("line"), _held(line).alias("held")))
        return F.filter(each, lambda x: F.size(x["held"]) >= most)

    kept = F.when(_enough(F.col("found.held")), lines(F.col("lowered"))).otherwise(F.array().cast("array<struct<line:int,held:array<string>>>"))
    starts = F.col("found.base.starts")
    return saved(
        held.select(
            "doc_id",
            "row",
            F.regexp_count("lowered", F.lit(WORD)).cast("long").alias("n_words"),
            F.size(starts).cast("long").alias("n_base"),
            F.array_min(starts).cast("long").alias("first_word"),
            F.array_max(starts).cast("long").alias("last_word"),
            F.col("found.base.labels").alias("base"),
            F.col("found.held").alias("held"),
            kept.alias("lines"),
        ),
        "scan",
    )


def order(scanned: DataFrame) -> dict[str, int]:
    """Template words by the number of documents that hold them, rarest first; as many as the templates have words."""
    counts = {r.word: r["count"] for r in scanned.select(F.explode("held").alias("word")).groupBy("word").count().collect()}
    return {w: n for n, w in enumerate(sorted(VOCABULARY, key=lambda w: (counts.get(w, 0), w)))}


def matches(scanned: DataFrame) -> DataFrame:
    """(doc_id, row, line, template, label, containment): every line that meets a template."""
    spark = scanned.sparkSession
    ranks = order(scanned)
    rows, prefixes = [], []
    for n, (label, words, need) in enumerate(SETS):
        ordered = sorted(words, key=ranks.get)
        rows.append((n, label, ordered, len(words), need))
        prefixes += [(w, n, at, len(words), need) for at, w in enumerate(ordered[: len(words) - need + 1])]
    templates = spark.createDataFrame(rows, "template int, label string, words array<string>, size int, need int")
    index = spark.createDataFrame(prefixes, "word string, template int, at int, size int, need int")
    rank = F.create_map(*(F.lit(x) for pair in ranks.items() for x in pair))
    lines = scanned.select("doc_id", "row", F.explode("lines").alias("found")).select("doc_id", "row", "found.line", F.array_sort(F.transform("found.held", lambda w: F.struct(rank[w].alias("rank"), w.alias("word")))).alias("words"))
    each = lines.select("*", F.posexplode("words").alias("place", "one")).withColumn("word", F.col("one.word"))
    # Both tables have as many rows as the fixed list of templates has words.
    met = each.join(F.broadcast(index), "word").where(F.size("words") >= F.col("need"))
    left = 1 + F.least(F.col("size") - F.col("at") - 1, F.size("words") - F.col("place") - 1)
    keys = ["doc_id", "row", "line", "template"]
    first = met.groupBy(*keys).agg(F.min_by(F.struct("words", left.alias("left"), "need"), "at").alias("c"))
    candidates = first.where("c.left >= c.need").select(*keys, F.transform("c.words", lambda w: w["word"]).alias("held"))
    verified = candidates.join(F.broadcast(templates), "template").withColumn("common", F.size(F.array_intersect("held", "words")))
    return verified.where("common >= need").select(*keys, "label", (F.col("common") / F.col("size")).alias("containment"))


def scanned_licenses(df: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is the largest containment of a template met, 1 where a base phrase stands, else 0. Null and empty texts
    have no words, labels or score. Repeated rows stay; an empty table gives no rows.
    """
    scanned = scan(df)
    key = [F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.col("row").alias("_row")]
    found = matches(scanned).groupBy(*key).agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    joined = scanned.select("*", *key).drop("lines", "held").join(found, ["_id", "_row"], "left")
    labels = F.sort_array(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
