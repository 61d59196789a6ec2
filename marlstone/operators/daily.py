"""Order-book ticks to one feature row for each symbol and day.

One projection computes the book figures of each tick; one shuffle by (symbol, day) serves the
window over time and the aggregation that follows it, so the whole block needs a single exchange.
Ticks without symbol or day are left out. NaN figures count as missing.

Figures for a symbol-day are independent of others, and a symbol-day has some thousand ticks, so
the key count grows with the data and no key does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.numeric import EPS, clip, minute_of_day, number
from marlstone.functions.sequences import depth_slope, order_stats, weighted_imbalance

LEVELS = "array<struct<price:double,volume:double,order:array<struct<volume:double>>,bigOrderPercent:double>>"
#: Bins of the intraday sequence, 30 minutes each of the two trading sessions.
BINS = 8


def parse_levels(raw: Column) -> Column:
    """Levels (price, volume, orders, big) of a JSON book side; anything malformed gives none."""
    levels = F.coalesce(F.from_json(raw, LEVELS), F.array().cast(LEVELS))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return F.transform(
        F.filter(levels, lambda x: x.isNotNull()),
        lambda x: F.struct(
            zero(x["price"]).alias("price"),
            zero(x["volume"]).alias("volume"),
            F.coalesce(F.transform(x["order"], lambda o: zero(o["volume"])), F.array().cast("array<double>")).alias("orders"),
            zero(x["bigOrderPercent"]).alias("big"),
        ),
    )


def wide_to_levels(df: DataFrame, price: str, volume: str, n: int = 10) -> Column:
    """A book side from one column a level; ``{i}`` stands for the level. Levels without a price go."""
    empty = F.array().cast("array<double>")
    made = [
        F.struct(number(df, price.format(i=i)).alias("price"), number(df, volume.format(i=i)).alias("volume"), empty.alias("orders"), F.lit(0.0).alias("big"))
        for i in range(1, n + 1)
        if price.format(i=i) in df.columns
    ]
    return F.filter(F.array(*made), lambda x: x["price"] > 0) if made else F.array().cast("array<struct<price:double,volume:double,orders:array<double>,big:double>>")


def book_figures(ticks: DataFrame) -> DataFrame:
    """ticks with imbalance, imbalance_10, slope, spread and the first level's order figures."""
    side = lambda name: F.transform(F.col(name), lambda x: x["volume"])
    first = lambda name, part: F.coalesce(F.get(F.col(name), 0)[part], F.lit(0.0))
    bid_total, ask_total = number(ticks, "totalbidvolume"), number(ticks, "totalaskvolume")
    rows = ticks.withColumns(
        {
            "bid_orders": order_stats(F.get("bids", 0)["orders"]),
            "ask_orders": order_stats(F.get("asks", 0)["orders"]),
            "bid_price": first("bids", "price"),
            "ask_price": first("asks", "price"),
            "depth": F.least(F.size("bids"), F.size("asks")),
        }
    )
    quoted = (F.col("bid_price") != 0) & (F.col("ask_price") != 0)
    return rows.withColumns(
        {
            "imbalance": (bid_total - ask_total) / (bid_total + ask_total + EPS),
            "imbalance_10": weighted_imbalance(side("bids"), side("asks")),
            "slope": depth_slope(side("bids"), F.col("depth")),
            "spread": F.when(quoted, (F.col("ask_price") - F.col("bid_price")) / ((F.col("ask_price") + F.col("bid_price")) / 2 + EPS)).otherwise(0.0),
            "split": (F.col("bid_orders.n") + F.col("ask_orders.n")).cast("double"),
            "repeat": F.greatest("bid_orders.repeat", "ask_orders.repeat"),
            "max_share": F.greatest("bid_orders.max_share", "ask_orders.max_share"),
            "entropy": (F.col("bid_orders.entropy") + F.col("ask_orders.entropy")) / 2,
            "big": first("bids", "big") + first("asks", "big"),
        }
    ).drop("bid_orders", "ask_orders", "bid_price", "ask_price", "depth")


def with_flows(ticks: DataFrame, tie: str | None = None) -> DataFrame:
    """ticks with increments (dvol, damt), returns, gaps in time and the session bin.

    Cumulative columns are carried forward over gaps, differenced and never negative; a day's
    first tick has no increment. ``tie`` orders ticks of one time.
    """
    by = Window.partitionBy("symbol", "dt").orderBy(*["date", *([tie] if tie else [])])
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ticks.withColumns(
        {
            "vol": F.coalesce(F.last(F.col("volume").try_cast("double"), ignorenulls=True).over(so_far), F.lit(0.0)),
            "amt": F.coalesce(F.last(F.col("amount").try_cast("double"), ignorenulls=True).over(so_far), F.lit(0.0)),
            "px": F.last(F.col("price").try_cast("double"), ignorenulls=True).over(so_far),
        }
    )
    step = lambda c: F.coalesce(F.greatest(F.col(c) - F.lag(c).over(by), F.lit(0.0)), F.lit(0.0))
    rows = rows.withColumns(
        {
            "dvol": step("vol"),
            "damt": step("amt"),
            "ret": F.coalesce(F.try_divide(F.col("px") - F.lag("px").over(by), F.lag("px").over(by)), F.lit(0.0)),
            "gap": (F.col("date") - F.lag("date").over(by)).cast("double"),
            "minute": minute_of_day(F.col("date")),
        }
    )
    whole = F.floor("minute")
    session = F.when((whole >= 570) & (whole < 690), whole - 570).when((whole >= 780) & (whole < 900), whole - 780 + 120)
    return rows.withColumn("session_bin", F.floor(session / 30).cast("int"))


def daily_features(ticks: DataFrame, tie: str | None = None) -> DataFrame:
    """One row for each (symbol, date). ticks: symbol, dt, date (epoch ms), price, volume, amount
    (cumulative), totalbidvolume, totalaskvolume, bigordervolume, bids and asks (parsed levels)."""
    rows = with_flows(book_figures(ticks.where("symbol is not null and dt is not null")), tie)
    minute, damt = F.col("minute"), F.col("damt")
    opening, closing = (minute >= 570) & (minute < 600), (minute >= 890) & (minute <= 900)
    day = rows.groupBy("symbol", F.col("dt").cast("string").alias("date_")).agg(
        F.count("*").alias("n"),
        F.sum("damt").alias("amount_sum"),
        F.coalesce(F.sum(F.when(opening, damt)), F.lit(0.0)).alias("open_amount"),
        F.coalesce(F.sum(F.when(closing, damt)), F.lit(0.0)).alias("close_amount"),
        *[F.sum(F.when(F.floor(minute / 30) == b, damt)).alias(f"half_hour_{b}") for b in range(48)],
        F.sum(F.when(minute.isNull(), damt)).alias("half_hour_none"),
        *[F.coalesce(F.avg(F.when(F.col("session_bin") == b, F.col("imbalance"))), F.lit(0.0)).alias(f"session_{b}") for b in range(BINS)],
        (F.stddev_samp("ret") * 100).alias("px_std_pct"),
        F.max("px").alias("px_max"),
        F.min("px").alias("px_min"),
        F.avg("px").alias("px_avg"),
        F.sum(F.col("px") * F.col("dvol")).alias("px_vol"),
        F.sum("dvol").alias("vol_sum"),
        F.avg("split").alias("split"),
        F.avg("big").alias("big"),
        F.avg("imbalance_10").alias("net"),
        F.avg("repeat").alias("repeat"),
        F.avg("max_share").alias("max_share"),
        F.avg("entropy").alias("entropy"),
        F.avg("slope").alias("slope"),
        F.avg("spread").alias("spread"),
        F.stddev_samp("imbalance").alias("noise"),
        F.stddev_samp("gap").alias("gap_std"),
        F.avg("gap").alias("gap_avg"),
        F.avg(F.coalesce(F.col("bigordervolume").try_cast("double"), F.lit(0.0))).alias("big_volume"),
        F.max_by("vol", F.struct("date", *([tie] if tie else []))).alias("last_vol"),
    )
    return _finished(day)


def _finished(day: DataFrame) -> DataFrame:
    """The day's named features from its aggregates."""
    halves = F.array(*[F.coalesce(f"half_hour_{b}", F.lit(0.0)) for b in range(48)], F.coalesce("half_hour_none", F.lit(0.0)))
    day = day.withColumns(
        {
            "all_amount": F.col("amount_sum") + EPS,
            "big_pct": F.when(F.col("big") > 1, F.col("big") / 100).otherwise(F.col("big")),
            "cv": F.when((F.col("n") > 2) & (F.col("gap_avg") > 0), F.col("gap_std") / (F.col("gap_avg") + EPS)).otherwise(0.0),
            "impact": (F.col("px_max") - F.col("px_min")) / (F.col("px_avg") + EPS) * 100,
            "vwap": F.col("px_vol") / (F.col("vol_sum") + EPS),
            "big_share": clip(F.col("big_volume") / (F.col("last_vol") / F.col("n") + EPS), 0, 1),
        }
    )
    day = day.withColumns(
        {
            "regular": 1 / (1 + F.col("cv")),
            "edge": F.col("open_amount") / F.col("all_amount") + F.col("close_amount") / F.col("all_amount"),
            "ice": clip(0.4 * clip(F.col("split") / 6, 0, 1) + 0.4 * F.col("repeat") + F.when(F.col("big_pct") > 0.3, 0.2).otherwise(0.0), 0, 1),
        }
    )
    net, big, regular, small = F.col("net"), F.col("big_pct"), F.col("regular"), clip(1 - F.col("big_pct"), 0, 1)
    features = {
        "regularity": regular,
        "manual_irregularity": F.col("cv") / (1 + F.col("cv")),
        "iceberg": F.col("ice"),
        "spoof": F.lit(0.0),
        "aggression": F.col("spread"),
        "net_active": net,
        "balance": 1 - F.abs(net),
        "edge_concentration": F.col("edge"),
        "impact_per_amount": F.col("impact") / (F.col("all_amount") / 1e8 + EPS),
        "t0_balance": (1 - F.abs(net)) * regular,
        "rs_interval_cv": F.col("cv"),
        "rs_split_similarity": F.col("ice"),
        "cb_fast_cancel_ratio": F.lit(0.0),
        "oss_hot_money_count_pct": F.col("big_share"),
        "oss_mega_amount_pct": big,
        "oss_small_amount_pct": clip(1 - big - F.col("big_share"), 0, 1),
        "pi_herfindahl_30min": F.aggregate(halves, F.lit(0.0), lambda s, x: s + x / F.col("all_amount") * (x / F.col("all_amount"))),
        "pi_max_price_impact_pct": F.col("impact"),
        "ap_unilateral_intensity": F.abs(net),
        "big_order_pct": big,
        "small_order_pct": small,
        "low_big_order": small,
        "low_concentration": clip(1 - F.col("edge"), 0, 1),
        "direction_noise": clip(F.col("noise") * 2, 0, 1) * F.when(regular > 0.8, 0.5).otherwise(1.0),
        "iceberg_repeat": F.col("repeat"),
        "l1_max_order_share": F.col("max_share"),
        "l1_order_entropy": F.col("entropy"),
        "ob_imbalance_10": net,
        "depth_slope_bid": F.col("slope"),
        "imbalance_vol": F.col("noise"),
        "oss_buy_amount_pct": clip(0.5 + net / 2, 0.02, 0.98),
        "oss_sell_amount_pct": clip(0.5 - net / 2, 0.02, 0.98),
        "oss_large_amount_pct": big * 0.6,
        "oss_medium_amount_pct": clip((1 - big) * 0.4, 0, 1),
        "px_std_pct": F.col("px_std_pct"),
        "vwap_dev": F.abs(F.col("px_avg") - F.col("vwap")) / (F.col("vwap") + EPS),
        "n_snapshots": F.col("n"),
        "net_active_seq": F.array(*[F.bround(f"session_{b}", 4) for b in range(BINS)]),
    }
    return day.select("symbol", F.col("date_").alias("date"), *[c.alias(k) for k, c in features.items()])


def sequence_text(values: Column) -> Column:
    """A sequence as ``a;b;c`` with four decimals, for text sinks."""
    return F.array_join(F.transform(values, lambda x: F.format_string("%.4f", x)), ";")
