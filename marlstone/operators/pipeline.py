"""The whole market run: daily rows to patterns, predictions and phases, all batches in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators import clusters, features, participants, selftrain


@dataclass(frozen=True)
class Result:
    features: DataFrame
    patterns: DataFrame
    predictions: DataFrame
    reason: str


def run(days: DataFrame, batch: str | None = None, alpha: float = 0.5, self_train: bool = False) -> Result:
    """Results for daily rows (symbol, date, ...). ``batch`` names the scope of normalising and
    clustering: a column such as date, or None for all rows together."""
    rows = features.derive(days)
    scope = batch or "all_rows"
    if batch is None:
        rows = rows.withColumn(scope, F.lit("all"))
    rows = rows.withColumn("row_key", F.concat_ws("|", "symbol", "date"))
    labelled = rows.join(clusters.cluster_labels(rows, scope, "row_key", alpha), [scope, "row_key"])
    patterns = clusters.name_clusters(labelled, scope).select("symbol", "date", "cluster", "pattern_type", "pattern_explanation")
    typed, reason = selftrain.self_trained(rows, scope) if self_train else (participants.classify_type(rows, scope), "")
    judged = participants.market_phase(participants.classify_intent(typed))
    predicted = judged.select("symbol", "date", "quant_score", "hot_money_score", "retail_score", "capital_type", "type_confidence", "capital_intention", "intention_confidence")
    phases = judged.select("symbol", "date", "market_phase", "phase_confidence")
    return Result(rows, patterns, participants.reconcile(predicted, patterns, phases), reason)
