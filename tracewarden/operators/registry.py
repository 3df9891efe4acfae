"""Detector catalogue: modes, custom detectors and the combined check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tracewarden.model import is_security_category, severity_impact, severity_rank
from tracewarden.operators.buffer import SESSION
from tracewarden.operators.detector import Detector, evaluate, explode_warnings
from tracewarden.operators.health import all_health
from tracewarden.operators.security import all_security

WARNING_FIELDS = ["category", "severity", "signal", "message", "suggestion", "details"]


@dataclass(frozen=True)
class FrameDetector:
    """A custom detector given as a function from the buffer to warnings.

    ``check(buffered, keys)`` returns the keys and WARNING_FIELDS, at most one
    row per key. It may use ``applyInPandas``: a buffer is bounded.
    """

    name: str
    category: str
    description: str
    check: Callable[[DataFrame, list[str]], DataFrame]
    is_security: bool = False


class Registry:
    def __init__(self, detectors: list[Detector | FrameDetector]):
        self.detectors = list(detectors)

    def add(self, detector: Detector | FrameDetector) -> None:
        if self.get(detector.name):
            raise ValueError(f"Detector exists: {detector.name}")
        self.detectors.append(detector)

    def remove(self, name: str) -> bool:
        kept = [d for d in self.detectors if d.name != name]
        removed = len(kept) < len(self.detectors)
        self.detectors = kept
        return removed

    def get(self, name: str) -> Detector | FrameDetector | None:
        return next((d for d in self.detectors if d.name == name), None)

    def position(self, name: str) -> int | None:
        """Place of a built-in detector in ``results``."""
        return next((i for i, d in enumerate(self._built_in()) if d.name == name), None)

    def subset(self, security: bool) -> Registry:
        return Registry([d for d in self.detectors if d.is_security == security])

    def by_category(self) -> dict[str, list[str]]:
        listed: dict[str, list[str]] = {}
        for d in self.detectors:
            listed.setdefault(d.category, []).append(f"{d.name}: {d.description}")
        return listed

    def catalog(self, spark: SparkSession) -> DataFrame:
        rows = [(i, d.name, d.category, d.is_security, d.description) for i, d in enumerate(self.detectors)]
        return spark.createDataFrame(
            rows, "detector_ord int, detector string, category string, is_security boolean, description string"
        )

    def _built_in(self) -> list[Detector]:
        return [d for d in self.detectors if isinstance(d, Detector)]

    def _custom(self) -> list[FrameDetector]:
        return [d for d in self.detectors if isinstance(d, FrameDetector)]

    def evaluate(self, buffered: DataFrame, keys: list[str] = SESSION) -> DataFrame:
        """One row per session with ``results`` of the built-in detectors."""
        return evaluate(buffered, self._built_in(), keys)

    def check(self, buffered: DataFrame, keys: list[str] = SESSION) -> DataFrame:
        """All warnings, one row each; a failing detector fails the query."""
        built_in = self._built_in()
        order = {d.name: i for i, d in enumerate(self.detectors)}
        parts = []
        if built_in:
            position = F.create_map(*[F.lit(x) for d in built_in for x in (d.name, order[d.name])])
            parts.append(
                explode_warnings(evaluate(buffered, built_in, keys), built_in, keys).withColumn(
                    "detector_ord", position[F.col("detector")]
                )
            )
        for d in self._custom():
            parts.append(
                d.check(buffered, keys).select(
                    *keys,
                    F.lit(order[d.name]).alias("detector_ord"),
                    F.lit(d.name).alias("detector"),
                    *WARNING_FIELDS,
                    is_security_category(F.col("category")).alias("is_security"),
                    severity_impact(F.col("severity")).alias("impact"),
                    severity_rank(F.col("severity")).alias("severity_ord"),
                )
            )
        result = parts[0]
        for part in parts[1:]:
            result = result.unionByName(part)
        return result

    def check_all(self, buffered: DataFrame, keys: list[str] = SESSION) -> DataFrame:
        """Warnings per session ranked worst first, ties in detector order."""
        worst_first = Window.partitionBy(*keys).orderBy("severity_ord", "detector_ord")
        return self.check(buffered, keys).withColumn("rank", F.row_number().over(worst_first))

    def audit(self, buffered: DataFrame, keys: list[str] = SESSION) -> DataFrame:
        """One record per session and security detector, triggered or not."""
        detectors = [d for d in self._built_in() if d.is_security]
        names = F.array(*[F.lit(d.name) for d in detectors])
        categories = F.array(*[F.lit(d.category) for d in detectors])
        rows = evaluate(buffered, detectors, keys).select(
            *keys, F.col("n").alias("action_count"), F.posexplode("results").alias("i", "warning")
        )
        return rows.select(
            *keys,
            F.get(names, F.col("i")).alias("detector"),
            F.get(categories, F.col("i")).alias("category"),
            F.col("warning").isNotNull().alias("triggered"),
            "action_count",
            "warning",
        )


def create_registry(mode: str = "health", custom: list[Detector | FrameDetector] | None = None) -> Registry:
    if mode == "health":
        detectors = all_health()
    elif mode == "security":
        detectors = all_security()
    elif mode == "all":
        detectors = all_health() + all_security()
    else:
        raise ValueError(f"Unknown mode: {mode}")
    registry = Registry(detectors)
    for d in custom or []:
        registry.add(d)
    return registry
