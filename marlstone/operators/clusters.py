"""Distances between daily rows and average-linkage clusters of a batch.

Pairs are made inside a batch only, by an equi-join on the batch, and the distance folds run in
the JVM. The dendrogram needs all distances of a batch, so a batch is one grouped-map group of at
most ``most`` rows; a larger batch is refused, as it would need n^2 memory by definition.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.numeric import number
from marlstone.functions.sequences import dtw, parse_sequence, wasserstein
from marlstone.functions.vocabulary import DISTRIBUTION
from marlstone.operators.participants import explanation, pattern_of


def shapes(df: DataFrame) -> DataFrame:
    """df with ``mix`` (the distribution vector) and ``seq`` (the sequence, or the net activity)."""
    mix = F.array(*[number(df, c) for c in DISTRIBUTION if c in df.columns])
    if "net_active_seq" in df.columns:
        textual = dict(df.dtypes)["net_active_seq"] == "string"
        seq = parse_sequence(F.col("net_active_seq")) if textual else F.coalesce("net_active_seq", F.array(F.lit(0.0)))
    else:
        seq = F.array(number(df, "net_active"))
    return df.withColumns({"mix": mix, "seq": seq})


def pair_distances(df: DataFrame, batch: str, key: str, alpha: float = 0.5) -> DataFrame:
    """(batch, i, j, mix_distance, seq_distance, distance) for i < j of each batch.

    Each distance is divided by its batch's greatest (0: left as it is), then mixed by alpha.
    """
    rows = shapes(df).select(F.col(batch).alias("batch"), F.col(key).alias("k"), "mix", "seq")
    a = rows.select("batch", F.col("k").alias("i"), F.col("mix").alias("mix_i"), F.col("seq").alias("seq_i"))
    b = rows.select(F.col("batch").alias("batch_j"), F.col("k").alias("j"), F.col("mix").alias("mix_j"), F.col("seq").alias("seq_j"))
    pairs = a.join(b, (F.col("batch") == F.col("batch_j")) & (F.col("i") < F.col("j")))
    pairs = pairs.select("batch", "i", "j", wasserstein(F.col("mix_i"), F.col("mix_j")).alias("mix_distance"), dtw(F.col("seq_i"), F.col("seq_j")).alias("seq_distance"))
    most = pairs.groupBy("batch").agg(F.max("mix_distance").alias("mix_most"), F.max("seq_distance").alias("seq_most"))
    part = lambda x: F.col(f"{x}_distance") / F.when(F.col(f"{x}_most") > 0, F.col(f"{x}_most")).otherwise(1.0)
    return pairs.join(most, "batch").select("batch", "i", "j", "mix_distance", "seq_distance", (alpha * part("mix") + (1 - alpha) * part("seq")).alias("distance"))


def average_linkage(d: np.ndarray) -> list[tuple[int, int]]:
    """Merges of average linkage, as pairs of current cluster indices (the second joins the first)."""
    d, size = d.astype(float).copy(), np.ones(len(d))
    np.fill_diagonal(d, np.inf)
    merges = []
    for _ in range(len(d) - 1):
        i, j = sorted(divmod(int(np.argmin(d)), len(d)))
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i], d[j], d[:, j] = np.inf, np.inf, np.inf
        size[i] += size[j]
        merges.append((i, j))
    return merges


def cut(n: int, merges: list[tuple[int, int]], k: int) -> np.ndarray:
    """Labels of k clusters, numbered by their first member."""
    label = np.arange(n)
    for i, j in merges[: n - k]:
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def silhouettes(to: np.ndarray, labels: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The silhouette of each row from its sums of distances to each label, of ``size`` members; single members count 0."""
    own, at = size[labels] - 1, np.arange(len(to))
    a = to[at, labels] / np.maximum(own, 1)
    away = to / size
    away[at, labels] = np.inf
    b = away.min(axis=1)
    top = np.maximum(a, b)
    return np.where((own > 0) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)


def silhouette(d: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette on a distance matrix; single members count 0."""
    groups = [labels == g for g in np.unique(labels)]
    to = np.stack([d[:, g].sum(axis=1) for g in groups], axis=1)
    return float(silhouettes(to, labels, np.array([g.sum() for g in groups])).mean())


def best_cut(d: np.ndarray, least: int = 3, most: int = 8) -> np.ndarray:
    """Labels of the k in [least, min(most, n - 1)] with the highest silhouette; ties: the smallest k."""
    n = len(d)
    if n < 3:
        return np.zeros(n, int)
    merges = average_linkage(d)
    if n == 3:
        return cut(n, merges, 3)
    best, labels = -np.inf, cut(n, merges, least)
    for k in range(least, min(most, n - 1) + 1):
        tried = cut(n, merges, k)
        if len(np.unique(tried)) >= 2 and (value := silhouette(d, tried)) > best:
            best, labels = value, tried
    return labels


def cluster_labels(df: DataFrame, batch: str, key: str, alpha: float = 0.5, most: int = 4000) -> DataFrame:
    """(batch, key, cluster): clusters are numbered by their least key."""
    pairs = pair_distances(df, batch, key, alpha).select("batch", "i", "j", "distance")
    alone = df.select(F.col(batch).alias("batch"), F.col(key).alias("i"), F.col(key).alias("j"), F.lit(0.0).alias("distance"))
    kind = dict(df.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.sort(pdf.loc[pdf["i"] == pdf["j"], "i"].unique())
        if len(keys) > most:
            raise ValueError(f"a batch has {len(keys)} rows; clustering takes {most} at most")
        d = np.zeros((len(keys), len(keys)))
        i, j = np.searchsorted(keys, pdf["i"]), np.searchsorted(keys, pdf["j"])
        d[i, j] = d[j, i] = pdf["distance"]
        return pd.DataFrame({"batch": pdf["batch"].iloc[0], "k": keys, "cluster": best_cut(d).astype("int32")})

    named = pairs.unionByName(alone).groupBy("batch").applyInPandas(run, f"batch {dict(df.dtypes)[batch]}, k {kind}, cluster int")
    return named.select(F.col("batch").alias(batch), F.col("k").alias(key), "cluster")


def name_clusters(df: DataFrame, batch: str, cluster: str = "cluster") -> DataFrame:
    """df with ``pattern_type`` and ``pattern_explanation`` of its cluster's mean features."""
    numeric = [c for c, t in df.dtypes if c not in (batch, cluster) and t in ("double", "float", "int", "bigint")]
    means = df.groupBy(batch, cluster).agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in numeric])
    named = means.select(batch, cluster, pattern_of(means).alias("pattern_type"))
    return df.join(named, [batch, cluster]).withColumn("pattern_explanation", explanation(F.col("pattern_type")))
