"""Tick sources: exports, databases, injected functions, generators; one factory for all.

Every source gives a lazy frame in the internal column names, so symbol and date filters are
expressions that Spark pushes into the scan. Nothing falls back to made-up rows unless asked to.
"""

from __future__ import annotations

import hashlib
import importlib
import importlib.util
import os
import re
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from marlstone.functions.numeric import plain_date
from marlstone.operators.daily import parse_levels, wide_to_levels

TICK_COLUMNS = "symbol dt date hh price volume amount transactions totalbidvolume totalaskvolume bigordervolume bids asks".split()

# The vendor's column names and the internal ones.
VENDOR_NAMES = {
    "SecurityID": "symbol",
    "TradeDate": "dt",
    "DataTimeStamp": "date",
    "TradeTime": "hh",
    "LastPx": "price",
    "TotalVolumeTrade": "volume",
    "TotalValueTrade": "amount",
    "NumTrades": "transactions",
    "TotalBidQty": "totalbidvolume",
    "TotalOfferQty": "totalaskvolume",
    "BigOrderVolume": "bigordervolume",
}
# Aliases of the two keys, the first that is there counts.
SYMBOL_ALIASES = ("symbol", "stock_code", "code", "ts_code")
DATE_ALIASES = ("date", "transaction_date", "trade_date", "trading_date")
UNIVERSE_COLUMNS = ("股票代码", "stock_code", "symbol", "code")


#: The name of a source whose rows are made up; results from it are marked.
GENERATED = "generated"


@dataclass(frozen=True)
class Mapping:
    """How a vendor's wide rows become ticks."""

    names: dict[str, str] = field(default_factory=lambda: dict(VENDOR_NAMES))
    levels: int = 10
    bid_price: str = "BidPrice{i}"
    bid_volume: str = "BidOrderQty{i}"
    ask_price: str = "OfferPrice{i}"
    ask_volume: str = "OfferOrderQty{i}"

    @classmethod
    def from_dict(cls, spec: dict) -> Mapping:
        book = spec.get("book", {})
        return cls(spec.get("id_map", dict(VENDOR_NAMES)), book.get("n_levels", 10), book.get("bid_px", cls.bid_price), book.get("bid_vol", cls.bid_volume), book.get("ask_px", cls.ask_price), book.get("ask_vol", cls.ask_volume))


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """df with the columns that it has renamed; others are kept."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def normalised(df: DataFrame, mapping: Mapping = Mapping()) -> DataFrame:
    """Vendor rows as ticks: renamed, dates plain, book sides parsed or assembled from wide columns."""
    rows = renamed(df, mapping.names)
    for side, price, volume in (("bids", mapping.bid_price, mapping.bid_volume), ("asks", mapping.ask_price, mapping.ask_volume)):
        if side not in rows.columns:
            rows = rows.withColumn(side, wide_to_levels(rows, price, volume, mapping.levels))
        elif dict(rows.dtypes)[side] == "string":
            rows = rows.withColumn(side, parse_levels(F.col(side)))
    return rows.withColumn("dt", plain_date(F.col("dt"))) if "dt" in rows.columns else rows


def keyed(df: DataFrame) -> DataFrame:
    """df with ``symbol`` and ``date`` from the first alias that it has; dates without dashes."""
    out = df
    for name, aliases in (("symbol", SYMBOL_ALIASES), ("date", DATE_ALIASES)):
        if found := next((a for a in aliases if a in df.columns), None):
            out = out.withColumn(name, F.translate(F.col(found).cast("string"), "-", "") if name == "date" else F.col(found).cast("string"))
    return out


def _on_days(column: Column, kind: str, dates: list[str]) -> Column:
    """Whether a raw date column lies on one of the days; every part of it can be pushed into a scan."""
    days = sorted({d.replace("-", "")[:8] for d in dates})
    dashed = [f"{d[:4]}-{d[4:6]}-{d[6:]}" for d in days]
    if kind == "date":
        return column.isin([F.lit(d).cast("date") for d in dashed])
    if kind.startswith("timestamp"):
        ends = [(F.lit(d).cast(kind), F.date_add(F.lit(d).cast("date"), 1).cast(kind)) for d in dashed]
        return reduce(or_, [(column >= a) & (column < b) for a, b in ends], F.lit(False))
    return reduce(or_, [column.startswith(d) | column.startswith(e) for d, e in zip(days, dashed)], F.lit(False)) if kind == "string" else plain_date(column).isin(days)


def selected(df: DataFrame, symbols: list[str] | None = None, dates: list[str] | None = None, symbol: str = "symbol", date: str = "dt") -> DataFrame:
    """df cut to symbols and days (given with or without dashes), as filters that push down.

    Filters are on the raw columns: a text date matches by how it begins, in either spelling.
    """
    if symbols is not None:
        df = df.where(F.col(symbol).isin(list(symbols)))
    if dates is not None and date in df.columns:
        df = df.where(_on_days(F.col(date), dict(df.dtypes)[date], dates))
    return df


def _vendor_rows(df: DataFrame, mapping: Mapping, symbols: list[str] | None, dates: list[str] | None) -> DataFrame:
    """Vendor rows cut before they are normalised, so that the cut reaches the scan."""
    rows = renamed(df, mapping.names)
    return normalised(selected(rows, symbols, dates), mapping)


def _read_by(spark: SparkSession, files: list[str], reader: Callable[[bytes], pd.DataFrame]) -> DataFrame:
    """Files that Spark can't read, by a function from bytes to rows; all have the first one's columns, as text."""
    raw = spark.read.format("binaryFile").load(files).select("content")
    names = list(reader(bytes(raw.limit(1).first()["content"])).columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for content in pdf["content"]:
                got = reader(bytes(content)).reindex(columns=names)
                yield got.astype(object).where(got.notna(), None).map(lambda x: None if x is None else str(x))

    return raw.mapInPandas(run, StructType([StructField(c, StringType()) for c in names]))


def read_folder(spark: SparkSession, path: str, readers: dict[str, Callable[[bytes], pd.DataFrame]] | None = None) -> DataFrame:
    """CSV and Parquet files of a folder as one frame, columns matched by name.

    Files are read in one list for each format and set of columns, so the plan grows with the number
    of layouts and not with that of files. ``readers`` read files of other endings (``xlsx``).
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    listed = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    files = sorted(str(f.getPath()) for f in listed)
    parquet, tables = [f for f in files if f.endswith(".parquet")], [f for f in files if f.endswith(".csv")]
    frames = []
    if parquet:
        try:
            frames.append(spark.read.option("mergeSchema", True).parquet(*parquet))
            frames[-1].schema  # types of one column may differ between files
        except Exception:
            by_type: dict[str, list[str]] = {}
            for f in parquet:
                by_type.setdefault(spark.read.parquet(f).schema.simpleString(), []).append(f)
            frames = [spark.read.parquet(*some) for some in by_type.values()]
    by_header: dict[tuple[str, ...], list[str]] = {}
    for f in tables:
        by_header.setdefault(tuple(spark.read.csv(f, header=True).columns), []).append(f)
    frames += [spark.read.csv(some, header=True) for some in by_header.values()]
    for kind, reader in (readers or {}).items():
        if some := [f for f in files if f.endswith(f".{kind}")]:
            frames.append(_read_by(spark, some, reader))
    if not frames:
        raise FileNotFoundError(f"no CSV or Parquet file in {path}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def bound(template: str, symbols: list[str] | None = None, dates: list[str] | None = None) -> str:
    """An SQL template with ``:symbols`` and ``:dates`` written out as lists of quoted texts, dates without dashes."""
    given = {"symbols": symbols, "dates": None if dates is None else [d.replace("-", "") for d in dates]}

    def put(m: re.Match) -> str:
        values = given[m[1]]
        if not values:
            raise ValueError(f"the template needs {m[1]}")
        return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"

    return re.sub(r":(symbols|dates)\b", put, template)


def read_database(spark: SparkSession, url: str, table: str | None, symbols: list[str] | None, dates: list[str] | None, mapping: Mapping = Mapping(), template: str | None = None, **options: str) -> DataFrame:
    """A JDBC table or an SQL template with ``:symbols`` and ``:dates``.

    A table is read in one partition for each day asked for; its filters become the WHERE clause.
    """
    reader = spark.read.format("jdbc").options(url=url, **options)
    if template is not None:
        return _vendor_rows(reader.option("query", bound(template, symbols, dates)).load(), mapping, symbols, dates)
    whole = reader.option("dbtable", table).load()
    raw = next((a for a, b in mapping.names.items() if b == "dt" and a in whole.columns), "dt" if "dt" in whole.columns else None)
    if dates and raw and dict(whole.dtypes)[raw] == "string":
        days = sorted({d.replace("-", "") for d in dates})
        spelt = [(d, f"{d[:4]}-{d[4:6]}-{d[6:]}") for d in days]
        quote = '"' if any(c.islower() for c in raw) else ""
        parts = [" or ".join(f"{quote}{raw}{quote} like '{x}%'" for x in both) for both in spelt]
        whole = spark.read.jdbc(url, table, predicates=parts, properties=options)
    return _vendor_rows(whole, mapping, symbols, dates)


class Source:
    """Ticks by symbol and day; None leaves the choice to the source."""

    def __init__(self, load: Callable[[list[str] | None, list[str] | None], DataFrame], name: str):
        self._load, self.name = load, name

    def load(self, symbols: list[str] | None = None, dates: list[str] | None = None) -> DataFrame:
        return self._load(symbols, dates)


def source(spark: SparkSession, kind: str, *, path: str | None = None, fetch: Callable | None = None, url: str | None = None, table: str | None = None, template: str | None = None, mapping: Mapping = Mapping(), readers: dict[str, Callable] | None = None, seed: int = 42, n: int = 40) -> Source:
    """A source by kind: ``vendor`` (fetch function, database or exports), ``file``, ``synthetic``."""
    kind = kind.lower()
    if kind == "vendor":
        if fetch is not None:
            def load(symbols, dates):
                got = fetch(symbols, dates)
                return _vendor_rows(got if isinstance(got, DataFrame) else spark.createDataFrame(got), mapping, symbols, dates)
        elif url and (table or template):
            def load(symbols, dates):
                return read_database(spark, url, table, symbols, dates, mapping, template)
        elif path:
            def load(symbols, dates):
                return _vendor_rows(read_folder(spark, path, readers), mapping, symbols, dates)
        else:
            def load(symbols, dates):
                raise RuntimeError("the vendor source needs a fetch function, a database or an export folder")
        return Source(load, "vendor")
    if kind in ("file", "snapshot"):
        return Source(lambda symbols, dates: _vendor_rows(read_folder(spark, path, readers), mapping, symbols, dates), "file")
    if kind == "synthetic":
        return Source(lambda symbols, dates: synthetic_days(spark, n, seed), "synthetic")
    raise ValueError(f"no such source: {kind}")


def fetch_of(spec: str, name: str = "query_l2_snapshot") -> Callable | None:
    """The fetch function of a vendor's module, given by its name or file: the attribute ``name``, or that of
    the first attribute that has one; None, with a warning, where there is none."""
    try:
        if spec.endswith(".py"):
            made = importlib.util.spec_from_file_location(f"vendor_{hashlib.sha256(spec.encode()).hexdigest()[:8]}", spec)
            module = importlib.util.module_from_spec(made)
            made.loader.exec_module(module)
        else:
            module = importlib.import_module(spec)
    except Exception as e:
        warnings.warn(f"no vendor module at {spec}: {e}", stacklevel=2)
        return None
    holders = [module, *(v for k, v in sorted(vars(module).items()) if not k.startswith("_"))]
    found = next((f for h in holders if callable(f := getattr(h, name, None))), None)
    if found is None:
        warnings.warn(f"{spec} has no {name}", stacklevel=2)
    return found


#: Environment variables that configure a source, in the order in which they count.
ENVIRONMENT = {"module": "MARLSTONE_TICKS_MODULE", "url": "MARLSTONE_TICKS_URL", "table": "MARLSTONE_TICKS_TABLE", "template": "MARLSTONE_TICKS_SQL", "path": "MARLSTONE_TICKS_PATH"}


def detect(spark: SparkSession, *, fetch: Callable | None = None, url: str | None = None, table: str | None = None, template: str | None = None, path: str | None = None, allow_generated: bool = False, symbols: list[str] | None = None, dates: list[str] | None = None) -> Source:
    """The first source that is configured: fetch (a vendor's module), database, exports, by argument or else
    by environment; generated ticks only if allowed."""
    given = {"url": url, "table": table, "template": template, "path": path}
    if fetch is None and not any(given.values()):
        given = {k: os.environ.get(v) or None for k, v in ENVIRONMENT.items()}
        module = given.pop("module")
        fetch = fetch_of(module) if module else None
    if fetch is not None or (given["url"] and (given["table"] or given["template"])) or given["path"]:
        return source(spark, "vendor", fetch=fetch, **given)
    if not allow_generated:
        raise RuntimeError("no tick source is configured; pass allow_generated=True for generated ticks")
    return Source(lambda s, d: generated_ticks(spark, s or symbols or [], d or dates or []), GENERATED)


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """(symbol) from a CSV: the first known column, else the first column."""
    df = spark.read.csv(path, header=True)
    name = next((c for c in UNIVERSE_COLUMNS if c in df.columns), df.columns[0])
    return df.select(F.trim(F.col(f"`{name}`").cast("string")).alias("symbol")).where("symbol <> ''").distinct()


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Daily feature CSVs of a folder, united by name, with keys normalised."""
    return keyed(read_folder(spark, path))


_TICK_SCHEMA = (
    "symbol string, dt string, date bigint, hh int, price double, volume double, amount double, transactions double, totalbidvolume double, "
    "totalaskvolume double, bigordervolume double, bids array<struct<price:double,volume:double,orders:array<double>,big:double>>, "
    "asks array<struct<price:double,volume:double,orders:array<double>,big:double>>"
)


#: Ticks of a made-up symbol and day: at least, and fewer than.
TICKS = (3000, 6500)


def _tick_day(symbol: str, day: str, ticks: tuple[int, int] = TICKS) -> pd.DataFrame:
    """One symbol-day of made-up ticks; the seed is a hash of the key, so partitions don't matter."""
    rng = np.random.default_rng(int(hashlib.sha256(f"{symbol}|{day}".encode()).hexdigest()[:8], 16))
    n = int(rng.integers(*ticks))
    minutes = np.sort(np.concatenate([rng.uniform(570, 690, n // 2), rng.uniform(780, 900, n - n // 2)]))
    midnight = pd.Timestamp(day).value // 1_000_000 - 8 * 3_600_000
    price = np.maximum(rng.uniform(5, 80) * np.exp(np.cumsum(rng.normal(0, 4e-4, n))), 0.05)
    traded = rng.gamma(1.5, 900, n).round()
    lean = rng.normal(0, 0.3)

    def side(i: int, sign: int) -> list[dict]:
        volumes = rng.gamma(2, 400 * (1 - sign * lean / 3), 10).round()
        orders = (rng.gamma(1.2, 300, int(rng.integers(1, 7))).round()).tolist()
        return [{"price": round(price[i] + sign * 0.01 * (k + 1), 2), "volume": float(volumes[k]), "orders": orders if k == 0 else [], "big": float(rng.beta(2, 6)) if k == 0 else 0.0} for k in range(10)]

    bids, asks = [side(i, -1) for i in range(n)], [side(i, 1) for i in range(n)]
    return pd.DataFrame(
        {
            "symbol": symbol,
            "dt": day.replace("-", ""),
            "date": (midnight + minutes * 60_000).astype("int64"),
            "hh": (minutes // 60).astype("int32"),
            "price": price.round(2),
            "volume": traded.cumsum(),
            "amount": (traded * price).cumsum(),
            "transactions": np.arange(1, n + 1, dtype=float),
            "totalbidvolume": [sum(x["volume"] for x in b) for b in bids],
            "totalaskvolume": [sum(x["volume"] for x in a) for a in asks],
            "bigordervolume": rng.gamma(1, 300, n),
            "bids": bids,
            "asks": asks,
        }
    )


def generated_ticks(spark: SparkSession, symbols: list[str], dates: list[str], ticks: tuple[int, int] = TICKS) -> DataFrame:
    """Made-up ticks for every symbol and day, one task-sized group each. For tests and demos."""
    keys = spark.createDataFrame([(s, d) for s in symbols for d in dates], "symbol string, day string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for s, d in zip(pdf["symbol"], pdf["day"]):
                yield _tick_day(s, d, ticks)

    return keys.repartition("symbol", "day").mapInPandas(run, _TICK_SCHEMA)


def synthetic_days(spark: SparkSession, n: int = 40, seed: int = 42) -> DataFrame:
    """Made-up daily rows, quant and hot-money by turns, with the true type beside them."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        quant = i % 2 == 0
        pick = lambda q, h: float(rng.uniform(*(q if quant else h)))
        up = bool(rng.integers(0, 2))
        buy = float(np.clip(0.5 + (0.03 if quant else 0.25) * (1 if up else -1) + rng.normal(0, 0.02), 0.05, 0.95))
        rows.append(
            {
                "symbol": f"{600000 + i}.SH",
                "date": "20260507",
                "order_count": int(rng.integers(500, 5000)),
                "deal_count": int(rng.integers(200, 4000)),
                "deal_amount": float(rng.uniform(1e7, 1e9)),
                "rs_interval_cv": pick((0.1, 0.5), (0.8, 2.0)),
                "rs_split_similarity": pick((0.6, 0.95), (0.1, 0.4)),
                "rs_split_run_ratio": pick((0.5, 0.9), (0.1, 0.4)),
                "cb_fast_cancel_ratio": pick((0.3, 0.7), (0.02, 0.2)),
                "cb_cancel_order_ratio": pick((0.3, 0.6), (0.05, 0.3)),
                "oss_hot_money_count_pct": pick((0.0, 0.1), (0.3, 0.8)),
                "oss_mega_amount_pct": pick((0.0, 0.2), (0.3, 0.7)),
                "oss_large_amount_pct": pick((0.1, 0.3), (0.1, 0.3)),
                "oss_medium_amount_pct": pick((0.2, 0.4), (0.05, 0.2)),
                "oss_small_amount_pct": pick((0.3, 0.6), (0.05, 0.2)),
                "oss_buy_amount_pct": buy,
                "oss_sell_amount_pct": 1 - buy,
                "ap_active_buy_pct": buy,
                "ap_active_sell_pct": 1 - buy,
                "ap_unilateral_intensity": abs(2 * buy - 1),
                "obp_cross_spread_buy": pick((0.0, 0.1), (0.2, 0.5)),
                "obp_cross_spread_sell": pick((0.0, 0.1), (0.1, 0.4)),
                "pi_open_30min_amount_pct": pick((0.1, 0.2), (0.2, 0.5)),
                "pi_close_10min_amount_pct": pick((0.05, 0.1), (0.1, 0.4)),
                "pi_herfindahl_30min": pick((0.12, 0.2), (0.2, 0.5)),
                "pi_max_price_impact_pct": pick((0.3, 1.5), (1.5, 9.0)),
                "net_active_seq": ";".join(f"{x:.4f}" for x in rng.normal(2 * buy - 1, 0.2, 8)),
                "_true_type": "量化" if quant else "游资",
            }
        )
    return spark.createDataFrame(rows)
