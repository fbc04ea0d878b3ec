"""Evaluation of scores against 0/1 labels, as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskstream.functions import count_where
from riskstream.operators.ordered import SEGMENT, scan


def confusion(scored: DataFrame, threshold: float = 0.5, score: str = "score", label: str = "label") -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1; a ratio without cases is 0."""
    yes, true = F.col(score) >= threshold, F.col(label) == 1
    n = scored.agg(count_where(yes & true).alias("tp"), count_where(yes & ~true).alias("fp"), count_where(~yes & true).alias("fn"), count_where(~yes & ~true).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select("tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def _by_score(scored: DataFrame, score: str, label: str, segment: int) -> DataFrame:
    """Each distinct score, highest first, with its positives and negatives and those at higher scores."""
    own = scored.where(F.col(score).isNotNull()).groupBy((-F.col(score)).alias("down")).agg(count_where(F.col(label) == 1).alias("pos"), count_where(F.col(label) != 1).alias("neg"))
    return scan(own, [], ["down"], {"before_pos": "pos", "before_neg": "neg"}, segment=segment)


def roc_auc(scored: DataFrame, score: str = "score", label: str = "label", segment: int = SEGMENT) -> DataFrame:
    """The chance that a positive scores above a negative, ties counting half; null without both classes."""
    own = _by_score(scored, score, label, segment)
    pos, neg = F.sum(F.col("pos").cast("double")), F.sum(F.col("neg").cast("double"))
    above = F.sum(F.col("neg") * (F.col("before_pos") + F.col("pos") / 2))
    return own.agg(F.when((pos > 0) & (neg > 0), above / (pos * neg)).alias("roc_auc"))


def average_precision(scored: DataFrame, score: str = "score", label: str = "label", segment: int = SEGMENT) -> DataFrame:
    """The step-wise area under precision over recall, one step for each distinct score; null without positives."""
    own = _by_score(scored, score, label, segment)
    hit = F.col("before_pos") + F.col("pos")
    step = F.sum(F.col("pos") * hit / (hit + F.col("before_neg") + F.col("neg")))
    pos = F.sum("pos")
    return own.agg(F.when(pos > 0, step / pos).alias("average_precision"))
