"""Scores of predictions: F1, accuracy, distributions, drift, cluster quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.vocabulary import PATTERNS
from marlstone.operators.clusters import silhouettes
from marlstone.operators.participants import prior_intent
from marlstone.operators.settling import written
from marlstone.operators.submission import normal_answer


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of a column."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def confidence_stats(df: DataFrame, column: str = "type_confidence", low: float = 0.5) -> DataFrame:
    """One row: mean confidence and the share under ``low``."""
    c = F.col(column).cast("double")
    return df.agg(F.bround(F.avg(c), 4).alias("type_conf_mean"), F.bround(F.avg((c < low).cast("double")), 4).alias("type_conf_low_frac"))


def drift(predicted: DataFrame, value: str = "capital_type") -> DataFrame:
    """One row: mean over adjacent dates of the share of common symbols whose value changes."""
    rows = predicted.select("symbol", "date", F.col(value).alias("v"))
    days = rows.select("date").distinct().withColumn("next_date", F.lead("date").over(_by_date()))
    later = rows.select("symbol", F.col("date").alias("next_date"), F.col("v").alias("later"))
    both = rows.join(days, "date").join(later, ["symbol", "next_date"])
    changes = both.groupBy("date").agg(F.avg((F.col("v") != F.col("later")).cast("double")).alias("rate"))
    return changes.agg(F.bround(F.avg("rate"), 4).alias("type_drift_mean"), F.count("*").alias("n_transitions"))


def _by_date():
    from pyspark.sql import Window

    return Window.orderBy("date")  # distinct dates only


def weighted_f1(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: F1 of each class, weighted by how often the class is true."""
    pairs = df.select(F.col(truth).alias("t"), F.col(predicted).alias("p")).groupBy("t", "p").agg(F.count("*").alias("n"))
    each = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("t").alias("c"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("true_n"), F.lit(0).cast("long").alias("said_n")),
                F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("true_n"), F.col("n").alias("said_n")),
            )
        ).alias("x")
    ).select("x.*")
    by_class = each.groupBy("c").agg(*[F.sum(x).alias(x) for x in ("tp", "true_n", "said_n")])
    f1 = 2 * F.col("tp") / (F.col("true_n") + F.col("said_n"))
    return by_class.agg((F.sum(F.col("true_n") * f1) / F.sum("true_n")).alias("weighted_f1"))


def consistency(df: DataFrame, pattern: str = "pattern_type", intent: str = "capital_intention") -> DataFrame:
    """One row: the share of rows with a prior whose intent agrees with it; null without any."""
    prior = prior_intent(F.col(pattern))
    known = F.col(pattern).isin(*PATTERNS)
    return df.agg(F.avg(F.when(known, (prior == F.col(intent)).cast("double"))).alias("consistency_rate"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the share of rows where two labels are equal."""
    return df.agg(F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"))


def grouped_accuracy(df: DataFrame, correct: Column, *dims: str) -> DataFrame:
    """Accuracy overall and by each dimension, from one pass of grouping sets."""
    named = df.select(*dims, correct.cast("long").alias("ok"))
    sets = [[], *[[d] for d in dims]]
    return named.groupingSets(sets, *dims).agg(F.count("*").alias("n"), F.sum("ok").alias("n_correct"), F.round(F.avg("ok"), 6).alias("accuracy"))


def answer_scores(truth: DataFrame, predicted: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, domain, answer_format, predicted, expected, correct) of every true answer (qid, answer).

    A question without an answer counts as an empty one, and one that isn't described has the domain
    ``?`` and the format ``multi``. Answers are compared in their normal form.
    """
    rows = truth.select("qid", F.col("answer").alias("expected"))
    rows = rows.join(predicted.select("qid", F.col("answer").alias("predicted")), "qid", "left")
    rows = rows.join(questions.select("qid", "domain", "answer_format"), "qid", "left")
    rows = rows.select("qid", F.coalesce("domain", F.lit("?")).alias("domain"), F.coalesce("answer_format", F.lit("multi")).alias("answer_format"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("predicted", "expected")])
    kind = F.col("answer_format")
    return rows.withColumn("correct", normal_answer(F.col("predicted"), kind) == normal_answer(F.col("expected"), kind))


def calinski_harabasz(df: DataFrame, batch: str, vector: str, label: str) -> DataFrame:
    """(batch, k, n, calinski_harabasz): spread between cluster means over spread inside clusters."""
    points = df.select(F.col(batch).alias("batch"), F.col(label).alias("label"), F.posexplode(vector).alias("at", "x"))
    cells = points.groupBy("batch", "label", "at").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("spread"))
    whole = points.groupBy("batch", "at").agg(F.avg("x").alias("mean"))
    met = cells.join(whole, ["batch", "at"])
    sums = met.groupBy("batch").agg(
        F.sum(F.col("n") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))).alias("between"),
        F.sum(F.col("n") * F.col("spread")).alias("within"),
        F.countDistinct("label").alias("k"),
        F.sum(F.when(F.col("at") == 0, F.col("n"))).alias("n"),
    )
    value = (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    usable = (F.col("k") >= 2) & (F.col("n") > F.col("k")) & (F.col("within") > 0)
    return sums.select(F.col("batch").alias(batch), "k", "n", F.when(usable, F.round(value, 2)).alias("calinski_harabasz"))


#: Rows of a block of vectors, and rows of it that are compared with another block at once.
_BLOCK, _STRIPE = 2000, 250


def _distance_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks (a, b) as the sums of distances from each row of a to each label of b, by block a."""
    sums: dict[tuple, list] = {}
    for found in batches:
        for r in (x for i in range(found.num_rows) for x in found.slice(i, 1).to_pylist()):
            codes = np.frombuffer(r["codes_b"], np.int64)
            x, y = (np.frombuffer(r[f"packed_{side}"], float).reshape(n, -1) for side, n in (("a", len(r["codes_a"]) // 8), ("b", len(codes))))
            _, total = sums.setdefault((r["batch"], r["a"]), (r, np.zeros((len(x), len(r["sizes"])))))
            member = np.zeros((len(y), total.shape[1]))
            member[np.arange(len(y)), codes] = 1
            square = (y * y).sum(axis=1)
            for at in range(0, len(x), _STRIPE):
                part = x[at : at + _STRIPE]
                d = np.sqrt(np.maximum((part * part).sum(axis=1)[:, None] + square[None, :] - 2 * part @ y.T, 0))
                if r["a"] == r["b"]:
                    d[np.arange(len(part)), np.arange(at, at + len(part))] = 0
                total[at : at + _STRIPE] += d @ member
    for (batch, block), (r, total) in sums.items():
        yield pa.RecordBatch.from_pydict({"batch": [batch], "block": pa.array([block], pa.int64()), "codes": [r["codes_a"]], "sizes": pa.array([r["sizes"]], pa.list_(pa.int64())), "sums": [total.tobytes()]})


def mean_silhouette(df: DataFrame, batch: str, vector: str, label: str) -> DataFrame:
    """(batch, silhouette): Euclidean silhouette of each batch, null under two labels.

    It needs all distances of a batch, n^2 of them. Batches are cut into blocks of packed vectors, and each
    pair of blocks is a row of a nested loop over the stored table, so only a block's sums by label are shuffled.
    """
    kind = dict(df.dtypes)[batch]
    slim = written(df.select(F.col(batch).alias("batch"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("l")))
    sizes = slim.groupBy("batch", "l").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("code", F.row_number().over(Window.partitionBy("batch").orderBy("l")) - 1)
    whole = sizes.groupBy("batch").agg(F.sum("size").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("code", "size"))), lambda x: x["size"]).alias("sizes"))
    rows = slim.withColumn("id", F.monotonically_increasing_id()).join(whole.select("batch", "n"), "batch")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / _BLOCK))).join(sizes.drop("size"), ["batch", "l"]).select("batch", "block", "code", "v")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"batch": [pdf["batch"].iloc[0]], "block": [pdf["block"].iloc[0]], "codes": [pdf["code"].to_numpy(np.int64).tobytes()], "packed": [np.stack(pdf["v"].to_numpy()).astype(float).tobytes()]})

    packed = written(rows.groupBy("batch", "block").applyInPandas(pack, f"batch {kind}, block long, codes binary, packed binary").join(whole.select("batch", "sizes"), "batch"))
    side = lambda name: packed.select(F.col("batch").alias(f"batch_{name}"), F.col("block").alias(name), F.col("codes").alias(f"codes_{name}"), F.col("packed").alias(f"packed_{name}"), *["sizes"] * (name == "a"))
    pairs = side("a").join(side("b").hint("shuffle_replicate_nl"), F.col("batch_a") == F.col("batch_b")).withColumnRenamed("batch_a", "batch").drop("batch_b")
    sums = pairs.mapInArrow(_distance_sums, f"batch {kind}, block long, codes binary, sizes array<long>, sums binary")

    def of_block(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, size = np.frombuffer(pdf["codes"].iloc[0], np.int64), np.asarray(pdf["sizes"].iloc[0])
        total = sum(np.frombuffer(x, float) for x in pdf["sums"]).reshape(len(codes), len(size))
        return pd.DataFrame({"batch": [pdf["batch"].iloc[0]], "total": [silhouettes(total, codes, size).sum()], "rows": [len(codes)], "k": [len(size)]})

    each = sums.groupBy("batch", "block").applyInPandas(of_block, f"batch {kind}, total double, rows long, k long").groupBy("batch").agg(F.sum("total").alias("total"), F.sum("rows").alias("n"), F.max("k").alias("k"))
    return each.select(F.col("batch").alias(batch), F.when((F.col("k") >= 2) & (F.col("k") < F.col("n")), F.round(F.col("total") / F.col("n"), 4)).alias("silhouette"))


def token_score(total: Column, budget: int = 5_000_000) -> Column:
    """Share of a token budget left, 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (budget - total) / budget))
