"""Two-pass external shuffle into shards.

Pass 1 scatters whole records into buckets that fit in memory, by a seeded hash of the record, each
bucket to a partition of its own. Pass 2 gathers a bucket, puts it in a fixed order, runs Spark's
``shuffle`` (a Fisher-Yates shuffle) over it, seeded by seed and bucket, and writes it to the shared
folder with each record's place. Bucket sizes turn into global places by a prefix sum over one
row a bucket, and shard borders cut the global order so that shard counts differ by at most one
(law ``rows``): shard and slot follow from the place. The order depends on the seed, the rows and
``bucket_bytes`` alone, not on how the table is partitioned or on the session's settings.

Hot keys: the bucket is drawn from all columns of a record, so a key that holds a third of all rows
spreads over all buckets. Equal records can't be told apart, so those that occur more than
``REPEATS`` times collapse to one row and a count before any shuffle, and come back one by one with
their number in the hash. Only a few numbers reach the driver.

Null text or id: an ordinary record. Repeated rows: each gets its own slot. An empty table gives
an empty table. Input columns named like the output's (``shard``, ``slot``) are replaced. Columns
must be of types that can be compared (no maps).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.shared import quoted, settle, without

#: Equal records beyond so many are numbered, and least number of buckets.
REPEATS, LEAST_BUCKETS = 1000, 64
#: Tables of up to so many rows of a few numbers are broadcast; larger ones are joined by a shuffle.
_BROADCAST_ROWS = 200_000


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= _BROADCAST_ROWS else df.hint("merge")


def shuffle_shards(docs: DataFrame, shards: int = 8, seed: int = 2029, bucket_bytes: int = 32 << 20) -> DataFrame:
    """docs in a seeded random order, with ``shard`` (int) and ``slot`` (long, gapless from 0).

    A task of pass 2 holds one bucket, of about ``bucket_bytes`` before overheads.
    """
    docs = without(docs, "shard", "slot")
    columns = [quoted(c) for c in docs.columns]
    mix = F.xxhash64(F.lit(seed), *columns)
    wide = [F.coalesce(F.octet_length(quoted(f.name)), F.lit(0)) for f in docs.schema if f.dataType.simpleString() in ("string", "binary")]
    size = sum(wide, F.lit(16 * len(columns))).cast("long")
    kinds = settle(docs.groupBy(mix.alias("mix")).agg(F.count("*").alias("n"), F.sum(size).alias("size")), "shard-kinds")
    often = kinds.where(F.col("n") > REPEATS).select(F.col("mix").alias("often"))
    total, repeats = kinds.agg(F.sum("size"), F.sum((F.col("n") > REPEATS).cast("int"))).first()
    n = max(LEAST_BUCKETS, math.ceil((total or 0) / bucket_bytes))

    record = F.struct(*columns)
    rows = docs.select(mix.alias("mix"), F.lit(0).cast("long").alias("number"), record.alias("row"))
    if repeats:
        often = _sized(often, repeats)
        met = rows["mix"] == F.col("often")
        hot = rows.join(often, met, "left_semi").groupBy("mix", "row").agg(F.count("*").alias("n"))
        hot = hot.select("mix", F.explode(F.expr("sequence(1L, n)")).alias("number"), "row")
        rows = rows.join(often, met, "left_anti").unionAll(hot)
    key = F.xxhash64(F.lit(seed), "mix", "number")
    scattered = rows.select(F.pmod(key, F.lit(n)).cast("int").alias("bucket"), F.struct(key.alias("key"), "row").alias("record"))
    gathered = scattered.repartitionById(n, "bucket").groupBy("bucket").agg(F.collect_list("record").alias("records"))
    mixed = gathered.select("bucket", F.posexplode(F.shuffle(F.array_sort("records"), seed)).alias("at", "record"))
    table = settle(mixed.select("bucket", F.col("at").cast("long").alias("at"), F.col("record.row").alias("row")), "shards")

    counts = settle(table.groupBy("bucket").agg(F.count("*").alias("n")), "shard-buckets")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = counts.select(F.col("bucket").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(whole).alias("total"))
    placed = table.join(_sized(bases, n), table["bucket"] == bases["of"]).select("row", "total", (F.col("base") + F.col("at")).alias("place"))
    placed = placed.select("row", "place", F.expr(f"greatest(total div {shards}, 1L)").alias("even"), F.expr(f"total % {shards}").alias("more"))
    return placed.select(
        "row.*",
        F.expr("if(place < more * (even + 1), place div (even + 1), more + (place - more * (even + 1)) div even)").cast("int").alias("shard"),
        F.expr("if(place < more * (even + 1), place % (even + 1), (place - more * (even + 1)) % even)").alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write shards as folders ``shard=k``; rows keep their slot, by which a reader orders them."""
    sharded.write.partitionBy("shard").mode("overwrite").parquet(path)
