"""The operators' registered queries, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewarden.llm import boilerplate, chosenpaths, decontaminate, licenses, mixing, prefixes, secrets, simhash, spotsigs, suffixes, tokens, toxicity, whitening
from tracewarden.llm.oracles import ORACLES  # noqa: F401


def prepared(spark: SparkSession) -> SparkSession:
    """Smaller Arrow batches: texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.read(tokens.write(table(spark, folder, "documents")))


def op2_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    return spotsigs.compared(table(spark, folder, "documents"))


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(table(spark, folder, "documents"))


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "distance", "start", "end")


def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scanned_licenses(table(spark, folder, "documents"))


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scanned(table(spark, folder, "documents"))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op8_lines(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.report(table(spark, folder, "pages"))


def op9_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.deduplicated(table(spark, folder, "documents"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


def op12_chosenpaths(spark: SparkSession, folder: str) -> DataFrame:
    return chosenpaths.near_duplicates(table(spark, folder, "documents"))


def op13_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    return prefixes.prefix_trie(table(spark, folder, "conversations"))


QUERIES = {
    "op1_tokens": op1_tokens,
    "op2_spotsigs": op2_spotsigs,
    "op3_mixing": op3_mixing,
    "op4_decontaminate": op4_decontaminate,
    "op5_licenses": op5_licenses,
    "op6_secrets": op6_secrets,
    "op7_simhash": op7_simhash,
    "op8_lines": op8_lines,
    "op9_suffixes": op9_suffixes,
    "op10_toxicity": op10_toxicity,
    "op11_whitening": op11_whitening,
    "op12_chosenpaths": op12_chosenpaths,
    "op13_prefixes": op13_prefixes,
}
