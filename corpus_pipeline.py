"""From raw documents to token ids: each stage's result is written and is the next one's input.

Every stage keeps the columns of its input, whatever their names, but the last, which gives ids.
Stages decide on whole texts; a document that nothing speaks against stays, repeated rows and ids
included unless they are copies.  An empty table goes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskstream.llm import bpe, decontaminate, near_dedup, secrets, toxicity
from riskstream.llm.common import documents, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects at their language's threshold go; without labels of both classes none does."""
    return toxicity.clean(docs, toxicity.fit(docs, documents(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document of the smallest id stays.

    Rows are judged by their texts: of rows with one id and different texts none goes for the id, copies without id are
    copies too, and documents without words stay.
    """
    return near_dedup.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; ones without words or id, and items without words, are no reason to."""
    return decontaminate.clean(docs, documents(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; n_chars counts the new text. Null and empty texts stay as they are."""
    return secrets.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of what the ids decode to, for each row; null and empty texts have no tokens."""
    return bpe.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", tokenize),
]

#: No stage but the third and fourth could be said in SQL; tests compare run() with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
