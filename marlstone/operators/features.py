"""Derived features of daily rows, batch-wide scaling and sequences.

Scaling has a scope, the batch: rows that are compared with each other. It is always an explicit
column. Batch statistics are one aggregate row a batch, joined back by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.numeric import EPS, clip, number
from marlstone.functions.vocabulary import MODEL_FEATURES
from marlstone.operators.settling import settled

#: A frame that has all of these carries finished features.
FINISHED = {"regularity", "iceberg", "net_active", "edge_concentration", "t0_balance"}


def derive(df: DataFrame) -> DataFrame:
    """Behaviour features from raw daily fields; a frame that has them already is returned as is."""
    if FINISHED <= set(df.columns):
        return df
    get = lambda name, default=0.0: number(df, name, default)
    cv = get("rs_interval_cv")
    if "ap_active_buy_pct" in df.columns:
        net = get("ap_active_buy_pct") - get("ap_active_sell_pct")
    else:
        net = get("oss_buy_amount_pct", 0.5) - get("oss_sell_amount_pct", 0.5)
    balance = 1 - F.abs(net)
    return df.withColumns(
        {
            "regularity": 1 / (1 + cv),
            "manual_irregularity": cv / (1 + cv),
            "iceberg": get("rs_split_similarity") * get("rs_split_run_ratio"),
            "spoof": get("cb_fast_cancel_ratio") * get("cb_cancel_order_ratio"),
            "aggression": get("obp_cross_spread_buy") + get("obp_cross_spread_sell"),
            "net_active": net,
            "balance": balance,
            "edge_concentration": get("pi_open_30min_amount_pct") + get("pi_close_10min_amount_pct"),
            "impact_per_amount": get("pi_max_price_impact_pct") / (get("deal_amount") / 1e8 + EPS),
            "t0_balance": balance * clip(get("deal_count") / (get("order_count") + EPS), 0, 2),
        }
    )


def _pairs(df: DataFrame, batch: str, names: list[str]) -> DataFrame:
    """(scope, feature, x): the features' values, one row each."""
    cells = F.array(*[F.struct(F.lit(i).alias("feature"), number(df, c).alias("x")) for i, c in enumerate(names)])
    return df.select(F.col(batch).alias("scope"), F.explode(cells).alias("c")).select("scope", "c.feature", "c.x")


def quantiles(df: DataFrame, batch: str, names: list[str], at: tuple[float, ...]) -> DataFrame:
    """(scope, feature, q): exact quantiles by linear interpolation, as an array, of each batch's features.

    Values are counted by value before they meet, and ranked by a sorted window a batch and
    feature, which spills; no task holds a batch's values in memory.
    """
    counts = _pairs(df, batch, names).groupBy("scope", "feature", "x").agg(F.count("*").alias("n"))
    one = Window.partitionBy("scope", "feature")
    ranked = counts.withColumn("upto", F.sum("n").over(one.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(one))

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("x")))

    place = lambda q: (F.col("total") - 1) * F.lit(q)
    ends = [x for i, q in enumerate(at) for x in (value_at(F.floor(place(q))).alias(f"low{i}"), value_at(F.ceil(place(q))).alias(f"high{i}"))]
    found = ranked.groupBy("scope", "feature", "total").agg(*ends)
    between = lambda i, q: F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * (place(q) - F.floor(place(q)))
    return found.select("scope", "feature", F.array(*[between(i, q) for i, q in enumerate(at)]).alias("q"))


def robust_scaled(df: DataFrame, batch: str, columns: list[str] | None = None) -> DataFrame:
    """df with ``scaled``: (x - median) / IQR of each feature over its batch; IQR 0 counts as 1.

    Quantiles are exact, by linear interpolation. Features that df lacks are left out.
    """
    names = [c for c in (columns or MODEL_FEATURES) if c in df.columns]
    df = settled(df)
    stats = quantiles(df, batch, names, (0.25, 0.5, 0.75)).groupBy("scope").agg(F.map_from_entries(F.collect_list(F.struct("feature", "q"))).alias("quartiles"))
    met = df.join(stats, F.col(batch).eqNullSafe(F.col("scope")))
    span = lambda q: F.when(q[2] == q[0], 1.0).otherwise(q[2] - q[0])
    scaled = F.array(*[(number(df, c) - F.col("quartiles")[i][1]) / span(F.col("quartiles")[i]) for i, c in enumerate(names)])
    return met.select(*[df[c] for c in df.columns], scaled.alias("scaled"))


def with_ranges(df: DataFrame, batch: str, names: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """df beside its batch's ranges, and each feature within its range: 0 to 1, one half where it is constant.

    Ranges are one aggregate row a batch, joined back by key; the added column is ``ranges``.
    """
    ends = [F.struct(F.min(number(df, c)).alias("low"), F.max(number(df, c)).alias("high")).alias(c) for c in names]
    ranges = df.groupBy(F.col(batch).alias("scope")).agg(F.struct(*ends).alias("ranges"))
    met = df.join(ranges, F.col(batch).eqNullSafe(F.col("scope"))).drop("scope")

    def within(c: str) -> Column:
        low, high = F.col("ranges")[c]["low"], F.col("ranges")[c]["high"]
        return F.when(high - low < 1e-9, 0.5).otherwise((number(df, c) - low) / (high - low))

    return met, {c: within(c) for c in names}
