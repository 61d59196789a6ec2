"""Daily tick features as a stream: running totals of each symbol and trading window.

Ticks arrive with an event time. A watermark bounds how late they may be; each (symbol, window)
is one aggregation state, which the state store spills and recovers from the checkpoint. What
depends on a tick's predecessor (increments of cumulative columns) is kept as greatest and least
values of the window, so the result doesn't depend on arrival order and equals the batch result
once the watermark has passed the window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.numeric import EPS


def windowed_features(ticks: DataFrame, window: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """(symbol, start, end, features) of each window. ticks: symbol, ts, price, volume, amount
    (cumulative inside the window), totalbidvolume, totalaskvolume."""
    lean = (F.col("totalbidvolume") - F.col("totalaskvolume")) / (F.col("totalbidvolume") + F.col("totalaskvolume") + EPS)
    rows = ticks.where("symbol is not null").withWatermark("ts", late)
    out = rows.groupBy("symbol", F.window("ts", window)).agg(
        F.count("*").alias("n_snapshots"),
        F.avg(lean).alias("imbalance"),
        F.stddev_samp(lean).alias("imbalance_vol"),
        ((F.max("price") - F.min("price")) / (F.avg("price") + EPS) * 100).alias("pi_max_price_impact_pct"),
        (F.max("volume") - F.min("volume")).alias("traded_volume"),
        (F.max("amount") - F.min("amount")).alias("traded_amount"),
    )
    return out.select("symbol", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n_snapshots", "imbalance", "imbalance_vol", "pi_max_price_impact_pct", "traded_volume", "traded_amount")
