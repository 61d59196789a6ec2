"""Result sinks: submission CSVs with a byte-order mark, their zip, batch output, answer files.

The CSV sinks here serve one day's result tables, which have a row a symbol: they are bounded by
the universe and written by the driver row by row. ``write_batches`` is the distributed sink.
"""

from __future__ import annotations

import csv
import json
import os
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.numeric import plain_date
from marlstone.functions.vocabulary import PATTERN_COLUMNS, PREDICT_COLUMNS
from marlstone.operators.submission import issues
from marlstone.sources.ticks import GENERATED


def submission_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """df in a submission table's columns; symbol and date go by their other names too."""
    names = {"stock_code": "stock_code" if "stock_code" in df.columns else "symbol", "transaction_date": "transaction_date" if "transaction_date" in df.columns else "date"}
    return df.select(*[plain_date(F.col(names[c])).alias(c) if c == "transaction_date" else F.col(names.get(c, c)).alias(c) for c in columns])


def _write_csv(df: DataFrame, path: str, order: list[str]) -> str:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for row in df.orderBy(*order).toLocalIterator():
            out.writerow(["" if x is None else x for x in row])
    return path


def write_patterns(df: DataFrame, path: str) -> str:
    return _write_csv(submission_table(df, PATTERN_COLUMNS), path, PATTERN_COLUMNS[:2])


def write_predictions(df: DataFrame, path: str) -> str:
    return _write_csv(submission_table(df, PREDICT_COLUMNS), path, PREDICT_COLUMNS[:2])


def pack(patterns: str, predictions: str, path: str) -> str:
    """Both files in one zip, by their base names."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in (patterns, predictions):
            z.write(f, os.path.basename(f))
    return path


def write_batches(df: DataFrame, path: str, batch: str = "date") -> None:
    """One folder a batch, written by all executors."""
    df.write.partitionBy(batch).mode("overwrite").parquet(path)


def write_days(patterns: DataFrame, predictions: DataFrame, path: str, provenance: str, most_days: int = 400) -> dict[str, dict]:
    """A folder for each date with both tables, their zip and a report of all dates beside them.

    Results of made-up ticks get a file that says so. A date with issues has no zip and its issues in the
    report. Days are few and a day's table has a row a symbol; more than ``most_days`` are refused.
    """
    names = lambda df: df.withColumnsRenamed({"symbol": "stock_code", "date": "transaction_date"})
    patterns, predictions = names(patterns), names(predictions)
    days = [r["day"] for r in patterns.select(plain_date(F.col("transaction_date")).alias("day")).distinct().orderBy("day").limit(most_days + 1).collect()]
    if len(days) > most_days:
        raise ValueError(f"more than {most_days} days; use write_batches")
    report: dict[str, dict] = {}
    for day in days:
        a, b = (df.where(plain_date(F.col("transaction_date")) == day) for df in (patterns, predictions))
        folder = os.path.join(path, day)
        files = write_patterns(a, f"{folder}/pattern_reco.csv"), write_predictions(b, f"{folder}/predict_result.csv")
        wrong = [r["issue"] for r in issues(a, b).limit(100).collect()]
        if wrong:
            report[day] = {"error": "validation", "issues": wrong}
            continue
        if provenance in (GENERATED, "synthetic"):
            with open(f"{folder}/SYNTHETIC_DO_NOT_SUBMIT.txt", "w", encoding="utf-8") as f:
                f.write("Made from generated ticks, to check the pipeline only.\n")
        report[day] = {"rows": b.count(), "zip": pack(*files, f"{folder}/submit.zip"), "data_provenance": provenance}
    write_report(f"{path}/batch_report.json", **report)
    return report


def write_report(path: str, **facts) -> str:
    """Facts of a run, where its rows came from among them."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(facts, f, ensure_ascii=False, indent=2, sort_keys=True)
    return path


def answer_table(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers in question order (column ``ordinal``) after a summary row with the token sums."""
    counts = ["prompt_tokens", "completion_tokens", "total_tokens"]
    rows = questions.select("qid", "ordinal").join(answers, "qid").select("ordinal", "qid", "answer", *counts)
    summary = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts]).select(F.lit(-1).alias("ordinal"), F.lit("summary").alias("qid"), F.lit("").alias("answer"), *counts)
    return summary.unionByName(rows).orderBy("ordinal").drop("ordinal")
