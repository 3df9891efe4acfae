"""Score levels, themed labels and text bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewarden.functions import fixed_values as fv


def level(score: Column) -> Column:
    """0 (best) to 3 (worst)."""
    first, second, third = fv.LEVEL_THRESHOLDS
    return F.when(score >= first, 0).when(score >= second, 1).when(score >= third, 2).otherwise(3)


def _pick(level_column: Column, values: tuple) -> Column:
    expr = F.when(level_column == 0, values[0])
    for i, value in enumerate(values[1:], 1):
        expr = expr.when(level_column == i, value)
    return expr


def theme_values(theme: str) -> tuple:
    if theme not in fv.THEMES:
        raise ValueError(f"Unknown theme: {theme}. Available: {list(fv.THEMES)}")
    return fv.THEMES[theme]


def status_label(score: Column, theme: str = fv.DEFAULT_THEME) -> Column:
    return _pick(level(score), theme_values(theme)[0])


def status_emoji(score: Column, theme: str = fv.DEFAULT_THEME) -> Column:
    return _pick(level(score), theme_values(theme)[1])


def status_color(score: Column, theme: str = fv.DEFAULT_THEME) -> Column:
    return _pick(level(score), theme_values(theme)[2])


def level_label(level_column: Column, theme: str = fv.DEFAULT_THEME) -> Column:
    return _pick(level_column, theme_values(theme)[0])


def dim_theme(spark: SparkSession) -> DataFrame:
    """One row per theme and level (44 rows)."""
    rows = [
        (theme, i, labels[i], emojis[i], colours[i])
        for theme, (labels, emojis, colours) in fv.THEMES.items()
        for i in range(4)
    ]
    return spark.createDataFrame(rows, "theme string, level int, label string, emoji string, color string")


def with_all_themes(df: DataFrame, score: str = "overall_score") -> DataFrame:
    """Every row once per theme, with that theme's label, emoji and colour."""
    themes = dim_theme(df.sparkSession)
    return df.withColumn("level", level(F.col(score))).join(F.broadcast(themes), "level")


def bar(filled: Column, width: int) -> Column:
    k = filled.cast("int")
    return F.concat(F.repeat(F.lit("█"), k), F.repeat(F.lit("░"), F.lit(width) - k))


def score_bar(score: Column, width: int = 20) -> Column:
    """Bar of a 0-100 score."""
    return bar(F.floor(score / F.lit(100 // width)), width)


def mini_bar(value: Column, width: int = 10) -> Column:
    """Bar of a 0..1 value, rounded half to even."""
    return bar(F.rint(value * F.lit(width)), width)
