"""Arrays of numbers: parsing, distances, order statistics, book depth. All folds stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.numeric import EPS


def parse_sequence(text: Column) -> Column:
    """``a;b;c`` as array<double>, empty parts dropped; null or empty gives [0.0]."""
    parts = F.transform(F.filter(F.split(text, ";"), lambda s: F.trim(s) != ""), lambda s: s.try_cast("double"))
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(0.0)))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def wasserstein(u: Column, v: Column) -> Column:
    """1-Wasserstein distance on index support of two arrays of one length.

    Negative mass counts as none. Where either side has no mass: the sum of absolute differences.
    """
    pairs = F.zip_with(u, v, lambda a, b: F.struct(F.greatest(a, F.lit(0.0)).alias("a"), F.greatest(b, F.lit(0.0)).alias("b")))
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    # One fold finds the masses, a second one walks both cumulated shares.
    return F.transform(
        F.array(F.struct(pairs.alias("ps"), F.aggregate(pairs, start, lambda s, p: F.struct((s["a"] + p["a"]).alias("a"), (s["b"] + p["b"]).alias("b"))).alias("m"))),
        lambda z: F.when(
            (z["m"]["a"] > 0) & (z["m"]["b"] > 0),
            F.aggregate(
                z["ps"],
                F.struct(F.lit(0.0).alias("gap"), F.lit(0.0).alias("sum")),
                lambda s, p: F.struct(
                    (s["gap"] + p["a"] / z["m"]["a"] - p["b"] / z["m"]["b"]).alias("gap"),
                    (s["sum"] + F.abs(s["gap"] + p["a"] / z["m"]["a"] - p["b"] / z["m"]["b"])).alias("sum"),
                ),
                lambda s: s["sum"],
            ),
        ).otherwise(F.aggregate(z["ps"], F.lit(0.0), lambda s, p: s + F.abs(p["a"] - p["b"]))),
    )[0]


def dtw(a: Column, b: Column) -> Column:
    """Dynamic time warping with absolute cost, divided by the two lengths' sum; empty gives 0.

    The outer fold carries one row of the table; the inner fold builds the next row.
    """
    far = F.lit(float("inf"))
    first = F.concat(F.array(F.lit(0.0)), F.array_repeat(far, F.size(b)))

    def next_row(row: Column, x: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(b)),
            F.array(far),
            lambda made, j: F.concat(made, F.array(F.abs(x - F.get(b, j - 1)) + F.least(F.get(row, j), F.get(row, j - 1), F.get(made, j - 1)))),
        )

    full = F.aggregate(a, first, next_row, lambda row: F.get(row, F.size(b)) / (F.size(a) + F.size(b)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), full).otherwise(F.lit(0.0))


def order_stats(sizes: Column) -> Column:
    """struct(n, repeat, max_share, entropy) of the positive sizes of an order list.

    repeat: the largest share of orders in one bucket of 100, rounded half to even. entropy: of
    the size shares, normalised by its greatest value; 0 for a single order. Empty: all 0.
    """
    return F.transform(F.array(F.filter(F.coalesce(sizes, F.array().cast("array<double>")), lambda x: x > 0)), _stats_of)[0]


def _stats_of(xs: Column) -> Column:
    n = F.size(xs)
    buckets = F.transform(xs, lambda x: F.rint(x / 100) * 100)
    repeat = F.array_max(F.transform(F.array_distinct(buckets), lambda b: F.size(F.filter(buckets, lambda c: c == b)))) / n
    mass = total(xs)
    entropy = F.aggregate(xs, F.lit(0.0), lambda s, x: s - x / (mass + EPS) * F.log(x / (mass + EPS) + EPS)) / (F.log(n.cast("double")) + EPS)
    some = n > 0
    return F.struct(
        n.alias("n"),
        F.when(some, repeat).otherwise(0.0).alias("repeat"),
        F.when(some, F.array_max(xs) / (mass + EPS)).otherwise(0.0).alias("max_share"),
        F.when(n > 1, entropy).otherwise(0.0).alias("entropy"),
    )


def weighted_imbalance(bids: Column, asks: Column) -> Column:
    """(B - A) / (B + A) over volumes of the levels both sides have, level i weighing 1 / (i + 1)."""
    depth = F.least(F.size(bids), F.size(asks))
    sums = F.aggregate(
        F.zip_with(F.slice(bids, F.lit(1), depth), F.slice(asks, F.lit(1), depth), lambda b, a: F.struct(b.alias("b"), a.alias("a"))),
        F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("b"), F.lit(0.0).alias("a")),
        lambda s, p: F.struct((s["i"] + 1).alias("i"), (s["b"] + p["b"] / (s["i"] + 1)).alias("b"), (s["a"] + p["a"] / (s["i"] + 1)).alias("a")),
        lambda s: (s["b"] - s["a"]) / (s["b"] + s["a"] + EPS),
    )
    return F.when(depth > 0, sums).otherwise(F.lit(0.0))


def depth_slope(volumes: Column, depth: Column) -> Column:
    """Least-squares slope of the cumulated share of volume on the level index; 0 for one level."""
    used = F.slice(volumes, F.lit(1), depth)
    middle = (depth - 1) / 2
    # sum((i - mean) * y) / sum((i - mean) ** 2), with sum((i - mean) ** 2) = n (n^2 - 1) / 12
    top = F.aggregate(
        used,
        F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("c"), F.lit(0.0).alias("s")),
        lambda s, v: F.struct((s["i"] + 1).alias("i"), (s["c"] + v).alias("c"), (s["s"] + (s["i"] - middle) * (s["c"] + v)).alias("s")),
        lambda s: s["s"] / (s["c"] + EPS),
    )
    return F.when(depth > 1, top / (depth * (depth * depth - 1) / 12)).otherwise(F.lit(0.0))
