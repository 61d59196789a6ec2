"""The driver's tables as stand-ins for order-book ticks, in Spark and as SQL prefixes.

A tick is an event: the type is the symbol, the value its price and amount, k of its props the
volume; five book levels and two lists of first-level orders are made from value and k by rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators.settling import settled as settled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks with cumulative volume and amount and parsed book sides."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", F.coalesce(F.from_json("props", "k double")["k"], F.lit(0.0)).alias("k"))
    so_far = Window.partitionBy("symbol", "dt").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumns({"symbol": F.col("event_type"), "dt": F.date_format("ts", "yyyyMMdd"), "date": F.unix_millis("ts")})
    side = lambda sign, per, more, orders, big: F.array(
        *[
            F.struct(
                (F.col("value") + sign * 0.01 * i).alias("price"),
                (per * i + more).cast("double").alias("volume"),
                (orders if i == 1 else F.array().cast("array<double>")).alias("orders"),
                (big if i == 1 else F.lit(0.0)).alias("big"),
            )
            for i in range(1, 6)
        ]
    )
    k, value = F.col("k"), F.col("value")
    return rows.select(
        "symbol",
        "dt",
        "date",
        "event_id",
        value.alias("price"),
        F.sum("k").over(so_far).alias("volume"),
        F.sum("value").over(so_far).alias("amount"),
        (k * 10 + 1000).alias("totalbidvolume"),
        (value * 20 + 800).alias("totalaskvolume"),
        (value / 50).alias("bigordervolume"),
        side(-1, 100, k, F.array(k * 10, k * 10, F.lit(150.0), F.lit(50.0)), k / 200).alias("bids"),
        side(1, 90, 100 - k, F.array(value, F.lit(100.0), F.lit(100.0)), (100 - k) / 300).alias("asks"),
    )


# The same in SQL: one CTE after another, ending in ``daily`` with unrounded features.
def _side_sql(name: str, per: int, more: str) -> str:
    return f"[{', '.join(f'{per * i} + {more}' for i in range(1, 6))}] as {name}"


_STATS = """
  len({x}) as {p}_n,
  case when len({x}) > 0 then list_max(list_transform(list_transform({x}, lambda v: round_even(v / 100, 0) * 100), lambda b: len(list_filter(list_transform({x}, lambda v: round_even(v / 100, 0) * 100), lambda c: c = b)))) / len({x})::double else 0.0 end as {p}_repeat,
  case when len({x}) > 0 then list_max({x}) / (list_sum({x}) + 1e-9) else 0.0 end as {p}_share,
  case when len({x}) > 1 then list_sum(list_transform({x}, lambda v: -(v / (list_sum({x}) + 1e-9)) * ln(v / (list_sum({x}) + 1e-9) + 1e-9))) / (ln(len({x})) + 1e-9) else 0.0 end as {p}_entropy"""

TICKS_SQL = f"""
ev as (select event_id, ts, event_type as symbol, strftime(ts, '%Y%m%d') as dt, epoch_us(ts) // 1000 as ms, value,
              coalesce(try_cast(regexp_extract(props, '([0-9]+)', 1) as double), 0.0) as k from events),
tk as (select *, sum(k) over w as volume, sum(value) over w as amount, k * 10 + 1000 as tb, value * 20 + 800 as ta, value / 50 as bov,
         {_side_sql('bv', 100, 'k')}, {_side_sql('av', 90, '100 - k')},
         list_filter([k * 10, k * 10, 150.0, 50.0], lambda v: v > 0) as bo, list_filter([value, 100.0, 100.0], lambda v: v > 0) as ao,
         k / 200 + (100 - k) / 300 as big
       from ev window w as (partition by symbol, dt order by ts, event_id rows unbounded preceding)),
bk as (select *, (tb - ta) / (tb + ta + 1e-9) as imb,
         (bv[1] - av[1] + (bv[2] - av[2]) / 2 + (bv[3] - av[3]) / 3 + (bv[4] - av[4]) / 4 + (bv[5] - av[5]) / 5)
           / (bv[1] + av[1] + (bv[2] + av[2]) / 2 + (bv[3] + av[3]) / 3 + (bv[4] + av[4]) / 4 + (bv[5] + av[5]) / 5 + 1e-9) as imb10,
         (-2 * bv[1] - (bv[1] + bv[2]) + (bv[1] + bv[2] + bv[3] + bv[4]) + 2 * list_sum(bv)) / (list_sum(bv) + 1e-9) / 10 as slope,
         case when value - 0.01 <> 0 then 0.02 / (value + 1e-9) else 0 end as spread, {_STATS.format(x='bo', p='b')}, {_STATS.format(x='ao', p='a')} from tk),
fl as (select *, coalesce(greatest(volume - lag(volume) over w, 0), 0) as dvol, coalesce(greatest(amount - lag(amount) over w, 0), 0) as damt,
         coalesce(case when lag(value) over w <> 0 then (value - lag(value) over w) / lag(value) over w end, 0) as ret,
         (ms - lag(ms) over w)::double as gap, ((ms / 1000.0 + 28800) % 86400) / 60 as minute
       from bk window w as (partition by symbol, dt order by ms, event_id)),
mi as (select *, case when floor(minute) >= 570 and floor(minute) < 690 then floor((floor(minute) - 570) / 30)
                      when floor(minute) >= 780 and floor(minute) < 900 then floor((floor(minute) - 660) / 30) end as bin,
         floor(minute / 30) as half from fl),
hh as (select symbol, dt, half, sum(damt) as a from mi group by all),
h2 as (select symbol, dt, sum(power(a / (t + 1e-9), 2)) as herf from (select *, sum(a) over (partition by symbol, dt) as t from hh) group by all),
ag as (select symbol, dt, count(*) as n, sum(damt) as asum, coalesce(sum(damt) filter (minute >= 570 and minute < 600), 0) as oa,
         coalesce(sum(damt) filter (minute >= 890 and minute <= 900), 0) as ca, stddev_samp(ret) * 100 as px_std,
         max(value) as pmax, min(value) as pmin, avg(value) as pavg, sum(value * dvol) as pv, sum(dvol) as vsum,
         avg(b_n + a_n) as split, avg(big) as bigm, avg(imb10) as net, avg(greatest(b_repeat, a_repeat)) as repeat,
         avg(greatest(b_share, a_share)) as share, avg((b_entropy + a_entropy) / 2) as entropy, avg(slope) as slope, avg(spread) as spread,
         stddev_samp(imb) as noise, stddev_samp(gap) as gstd, avg(gap) as gavg, avg(bov) as bova, arg_max(volume, (ms, event_id)) as lastv,
         {', '.join(f'coalesce(avg(imb) filter (bin = {b}), 0) as s{b}' for b in range(8))}
       from mi group by symbol, dt),
a2 as (select *, asum + 1e-9 as allamt, case when bigm > 1 then bigm / 100 else bigm end as bigp,
         case when n > 2 and gavg > 0 then gstd / (gavg + 1e-9) else 0 end as cv, (pmax - pmin) / (pavg + 1e-9) * 100 as impact,
         pv / (vsum + 1e-9) as vwap, least(greatest(bova / (lastv / n + 1e-9), 0), 1) as bshare from ag join h2 using (symbol, dt)),
a3 as (select *, 1 / (1 + cv) as regular, oa / allamt + ca / allamt as edge,
         least(greatest(0.4 * least(greatest(split / 6, 0), 1) + 0.4 * repeat + case when bigp > 0.3 then 0.2 else 0 end, 0), 1) as ice from a2),
daily as (select symbol, dt as date, regular as regularity, cv / (1 + cv) as manual_irregularity, ice as iceberg, 0.0::double as spoof, spread as aggression,
         net as net_active, 1 - abs(net) as balance, edge as edge_concentration, impact / (allamt / 1e8 + 1e-9) as impact_per_amount,
         (1 - abs(net)) * regular as t0_balance, cv as rs_interval_cv, ice as rs_split_similarity, 0.0::double as cb_fast_cancel_ratio,
         bshare as oss_hot_money_count_pct, bigp as oss_mega_amount_pct, least(greatest(1 - bigp - bshare, 0), 1) as oss_small_amount_pct,
         herf as pi_herfindahl_30min, impact as pi_max_price_impact_pct, abs(net) as ap_unilateral_intensity, bigp as big_order_pct,
         least(greatest(1 - bigp, 0), 1) as small_order_pct, least(greatest(1 - bigp, 0), 1) as low_big_order,
         least(greatest(1 - edge, 0), 1) as low_concentration, least(greatest(noise * 2, 0), 1) * case when regular > 0.8 then 0.5 else 1 end as direction_noise,
         repeat as iceberg_repeat, share as l1_max_order_share, entropy as l1_order_entropy, net as ob_imbalance_10, slope as depth_slope_bid, noise as imbalance_vol,
         least(greatest(0.5 + net / 2, 0.02), 0.98) as oss_buy_amount_pct, least(greatest(0.5 - net / 2, 0.02), 0.98) as oss_sell_amount_pct,
         bigp * 0.6 as oss_large_amount_pct, least(greatest((1 - bigp) * 0.4, 0), 1) as oss_medium_amount_pct, px_std as px_std_pct,
         abs(pavg - vwap) / (vwap + 1e-9) as vwap_dev, n::bigint as n_snapshots,
         [{', '.join(f'round_even(s{b}, 4)' for b in range(8))}] as net_active_seq from a3)"""
