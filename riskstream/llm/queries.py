"""The queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskstream.llm import bpe, centroids, decontaminate, html, language_model, languages, licenses, near_dedup, neighbours, resample, secrets, substring_dedup, toxicity
from riskstream.llm.common import crc_remainder, documents
from riskstream.llm.sql import SQL

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, documents(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    held = F.coalesce(crc_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(documents(spark, sf_dir), digest=True).withColumnRenamed("kept", "kept_sha256")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.duplicates(documents(spark, sf_dir), k=3, similar=85)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.found(documents(spark, sf_dir), licenses.notices(spark))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(documents(spark, sf_dir, "embeddings"), every=50, k=5)


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(documents(spark, sf_dir))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(documents(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(documents(spark, sf_dir, "embeddings"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(crc_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    found = languages.predict(docs, languages.learn(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_near_dedup": op3_near_dedup,
        "op4_secrets": op4_secrets,
        "op5_bpe": op5_bpe,
        "op6_licenses": op6_licenses,
        "op7_neighbours": op7_neighbours,
        "op8_language_model": op8_language_model,
        "op9_html": op9_html,
        "op10_decontaminate": op10_decontaminate,
        "op11_centroids": op11_centroids,
        "op12_language": op12_language,
        "op13_resample": op13_resample,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
