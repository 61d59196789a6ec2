"""Self-training of participant types: confident rule labels train a logistic model.

Gates are checked on counts before anything is trained; where one fails the rules' result is
returned with the reason. Medians and scaling are taken over the batch of the call.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.vocabulary import MODEL_FEATURES, TYPES
from marlstone.operators.features import robust_scaled
from marlstone.operators.participants import classify_type


def confident(df: DataFrame, batch: str, confidence: str = "type_confidence") -> DataFrame:
    """Rows whose confidence is at least their batch's median (linear interpolation, inclusive)."""
    middle = df.groupBy(batch).agg(F.percentile(confidence, F.lit(0.5)).alias("median_confidence"))
    return df.join(middle, batch).where(F.col(confidence) >= F.col("median_confidence")).drop("median_confidence")


def _gate(rows: int, by_class: dict[str, int], has_features: bool) -> str:
    if rows < 30:
        return "fewer than 30 rows"
    if sum(by_class.values()) < 15:
        return "fewer than 15 pseudo labels"
    if len(by_class) < 2:
        return "one class only"
    if min(by_class.values()) < 5:
        return "a class with fewer than 5 pseudo labels"
    return "" if has_features else "no model features"


def gated(df: DataFrame, batch: str) -> tuple[DataFrame, dict[str, int], str]:
    """(df with the rules' types, pseudo labels by class, reason): reason is empty if the gates let a model be trained."""
    ruled = classify_type(df, batch)
    pseudo = confident(ruled, batch)
    by_class = {r["capital_type"]: r["n"] for r in pseudo.groupBy("capital_type").agg(F.count("*").alias("n")).collect()}
    return ruled, by_class, _gate(ruled.count(), by_class, any(c in df.columns for c in MODEL_FEATURES))


def self_trained(df: DataFrame, batch: str, least_sure: float = 0.5, iterations: int = 1000) -> tuple[DataFrame, str]:
    """(df with type columns, reason): reason is empty if the model was used."""
    ruled, by_class, reason = gated(df, batch)
    if reason:
        return ruled.withColumn("trained", F.lit(False)), reason
    names = [c for c in MODEL_FEATURES if c in df.columns]
    classes = [t for t in TYPES if t in by_class]
    label = F.array_position(F.array(*[F.lit(t) for t in classes]), F.col("capital_type")) - 1
    total = sum(by_class.values())
    weight = F.create_map(*[F.lit(x) for t in classes for x in (t, total / (len(classes) * by_class[t]))])[F.col("capital_type")]
    scaled = robust_scaled(ruled, batch, names).withColumn("features", array_to_vector("scaled")).drop("scaled")
    train = confident(scaled, batch).select("features", label.cast("double").alias("label"), weight.alias("weight"))
    model = LogisticRegression(weightCol="weight", maxIter=iterations, regParam=1.0 / total, elasticNetParam=0.0, standardization=False, family="multinomial").fit(train)
    said = model.transform(scaled).withColumn("p", vector_to_array("probability"))
    sure = F.array_max("p")
    named = F.element_at(F.array(*[F.lit(t) for t in classes]), F.col("prediction").cast("int") + 1)
    out = said.withColumns(
        {
            "trained": sure >= least_sure,
            "capital_type": F.when(sure >= least_sure, named).otherwise(F.col("capital_type")),
            "type_confidence": F.when(sure >= least_sure, F.bround(sure, 4)).otherwise(F.col("type_confidence")),
        }
    )
    return out.drop("features", "rawPrediction", "probability", "prediction", "p"), ""
