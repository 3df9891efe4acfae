"""Text measures on model output, all built-in regex and array functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tracewarden.functions import fixed_values as fv
from tracewarden.functions.classify import let, strip

# A hedge word counts when it is a whole run of letters.
_HEDGES = "(?<![a-z])(?:" + "|".join(fv.HEDGE_WORDS) + ")(?![a-z])"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit("[a-z]+"))


def hedge_count(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(_HEDGES))


def hedge_density(text: Column) -> Column:
    words = word_count(text)
    return F.when(words == 0, F.lit(0.0)).otherwise(hedge_count(text) / words)


def apology_count(text: Column) -> Column:
    lowered = F.lower(text)
    return reduce(lambda a, b: a + b, [lowered.contains(p).cast("int") for p in fv.APOLOGY_PHRASES])


def apology_density(text: Column) -> Column:
    words = word_count(text)
    per_hundred = apology_count(text) / F.greatest(words / F.lit(100.0), F.lit(1.0))
    return F.when(words == 0, F.lit(0.0)).otherwise(F.least(per_hundred, F.lit(1.0)))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def content_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{2,}"), F.lit(0))


def trigrams(word_list: Column) -> Column:
    def grams(ws: Column) -> Column:
        starts = F.slice(ws, 1, F.greatest(F.size(ws) - 2, F.lit(0)))
        return F.transform(starts, lambda w, i: F.concat_ws(" ", w, F.get(ws, i + 1), F.get(ws, i + 2)))

    return let(word_list, grams)


def repeated_share(items: Column) -> Column:
    """Share of array elements that repeat an earlier one."""

    def share(xs: Column) -> Column:
        total = F.size(xs)
        return F.when(total == 0, F.lit(0.0)).otherwise((total - F.size(F.array_distinct(xs))) / total)

    return let(items, share)


def sentences(text: Column) -> Column:
    """Sentences of more than 20 characters, trimmed and lower-cased."""
    parts = F.regexp_extract_all(text, F.lit(r"[^.!?\n]+[.!?]?"), F.lit(0))
    trimmed = F.transform(parts, strip)
    return F.transform(F.filter(trimmed, lambda s: F.length(s) > 20), F.lower)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
