"""Splitting, training, scoring and evaluating the fraud model."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskstream.operators.features import FEATURES
from riskstream.operators.metrics import average_precision, confusion, roc_auc
from riskstream.operators.ordered import scan

#: Features that may be null: each gets an indicator and a stand-in outside its range, since trees here do not route missing values.
MAY_MISS = ("amount_vs_customer_avg", "dist_km_from_home", "seconds_since_prev_event", "is_new_device")
MISSING = -1.0


@dataclass(frozen=True)
class Params:
    # The settings that published figures come from.
    trees: int = 400
    depth: int = 6
    rate: float = 0.05
    rows: float = 0.9
    columns: float = 0.9
    seed: int = 42


def split(df: DataFrame, id_col: str = "event_id", label: str = "label", fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """df with is_test: of each class the given fraction, to the row, by a hash order of ids; no class goes through one task."""
    order = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 15), 16, 10).cast("long")
    placed = scan(df.withColumn("_h", order), [label], ["_h", id_col], {"_before": F.lit(1)})
    size = df.groupBy(label).agg(F.round(F.count("*") * fraction).alias("_test"))
    return placed.join(F.broadcast(size), label).withColumn("is_test", F.col("_before") < F.col("_test")).drop("_h", "_before", "_test")


def balance(df: DataFrame, label: str = "label") -> DataFrame:
    """positives, negatives and the weight of positives that evens them out."""
    n = df.agg(F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) != 1).alias("negatives"))
    return n.withColumn("positive_weight", F.when(F.col("positives") > 0, F.col("negatives") / F.col("positives")).otherwise(F.lit(1.0)))


def prepared(df: DataFrame) -> DataFrame:
    """Features as doubles without nulls, with an indicator for each that may be missing."""
    columns = {f: F.coalesce(F.col(f).cast("double"), F.lit(MISSING)) for f in FEATURES}
    return df.withColumns(columns | {f"{f}_missing": F.col(f).isNull().cast("double") for f in MAY_MISS})


def train(df: DataFrame, p: Params = Params(), label: str = "label") -> PipelineModel:
    weight = balance(df, label).first()["positive_weight"]
    own = prepared(df).withColumn("_weight", F.when(F.col(label) == 1, F.lit(float(weight))).otherwise(F.lit(1.0))).withColumn(label, F.col(label).cast("double"))
    assembler = VectorAssembler(inputCols=[*FEATURES, *(f"{f}_missing" for f in MAY_MISS)], outputCol="_features")
    trees = GBTClassifier(featuresCol="_features", labelCol=label, weightCol="_weight", maxIter=p.trees, maxDepth=p.depth, stepSize=p.rate, subsamplingRate=p.rows, featureSubsetStrategy=str(p.columns), seed=p.seed)
    return Pipeline(stages=[assembler, trees]).fit(own)


def score(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """df with fraud_probability and fraud_prediction; works on static tables and on streams."""
    out = model.transform(prepared(df)).withColumn("fraud_probability", vector_to_array("probability")[1])
    keep = [c for c in df.columns if c not in ("fraud_probability", "fraud_prediction")]
    return out.select(*keep, "fraud_probability", (F.col("fraud_probability") >= threshold).cast("int").alias("fraud_prediction"))


def evaluate(scored: DataFrame, threshold: float = 0.5, label: str = "label") -> dict:
    own = scored.withColumn("score", F.col("fraud_probability"))
    out = confusion(own, threshold, "score", label).first().asDict()
    return out | roc_auc(own, "score", label).first().asDict() | average_precision(own, "score", label).first().asDict()


def passes(metrics: dict, least_auc: float = 0.9, least_f1: float = 0.8) -> bool:
    """The release gate; both strictly above."""
    return (metrics["roc_auc"] or 0) > least_auc and metrics["f1"] > least_f1


def save(model: PipelineModel, store, name: str, test: DataFrame, metrics: dict, p: Params = Params()) -> None:
    """The model, its test rows and its metadata, next to each other."""
    model.write().overwrite().save(f"{store.root}/{name}/model")
    store.write(f"{name}/test", test)
    store.write_json(f"{name}/metadata.json", {"features": list(FEATURES), "params": asdict(p), "metrics": metrics})


def load(store, name: str) -> PipelineModel:
    return PipelineModel.load(f"{store.root}/{name}/model")
