"""SimHash near-duplicates by multi-index hashing.

Fingerprints: A-Z are lower-cased, words are runs of anything but ASCII white space, shingles are
runs of words joined by one space, repeats included; a text of fewer words than a shingle is one
shingle. A shingle votes with its XXH64 (seed 42); a bit is 1 if it is set in over half the votes.

Search: a pair within ``distance`` 3 has a 32-bit half that differs in at most one bit. So each
distinct fingerprint is filed under both halves, probes the 33 keys of the Hamming ball of radius
1 around each half, and matches are verified on all 64 bits. Copies collapse into one fingerprint
before the search, and only verified links leave the join. Links are merged into components by
alternating large-star and small-star steps, each written to the shared folder.

Nulls: a null or blank text has fingerprint zero, which links like any other. Rows without an id
take part, but never name a component unless all its ids are null (then the name is null).
Repeated rows are each returned. An empty table gives an empty table. Input columns that clash
with the output's names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import discard, quoted, release, settle, slices, with_fields, without

_LOWER = bytes(range(256)).lower()
_SEED = 42


def fingerprint_text(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of one text as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        votes = [xxhash.xxh64_intdigest(joined, _SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        digest = xxhash.xxh64_intdigest
        last = len(words) - shingle + 1
        votes = [digest(joined[a:b], _SEED) for a, b in zip(starts[:last].tolist(), ends[shingle - 1 :].tolist())]
    rows = np.array(votes, np.uint64).view(np.uint8).reshape(-1, 8)
    set_in = np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > len(votes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint", shingle: int = 3) -> DataFrame:
    """docs with the signed 64-bit fingerprint of each text."""
    slim = without(docs, out_col) if out_col != text_col else docs
    slim = slim.withColumn(text_col, quoted(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index(text_col))
            prints = np.fromiter((fingerprint_text(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], [*batch.schema.names, out_col])

    return slim.mapInArrow(run, with_fields(slim, (out_col, "long")))


def links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (column ``fp``) at most ``distance`` bits apart.

    Multi-index hashing over two 32-bit halves. A half must be within distance // 2 of its
    counterpart; radius 1 covers distances up to 3.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two halves with balls of radius 1 cover distances 0 to 3")
    # Each fingerprint becomes 66 probes, so they are dealt out evenly before, whatever shuffle made them.
    prints = prints.select("fp").repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    halves = prints.select(
        "fp",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("half"), F.shiftrightunsigned("fp", 32).alias("key")),
                F.struct(F.lit(1).alias("half"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias("key")),
            )
        ).alias("at"),
    ).select("fp", "at.half", "at.key")
    ball = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])
    probes = halves.select(F.col("fp").alias("a"), "half", F.explode(ball).alias("flip"), "key")
    probes = probes.select("a", "half", F.col("key").bitwiseXOR(F.col("flip")).alias("key"))
    filed = halves.select(F.col("fp").alias("b"), "half", "key")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    # Sizes of exploded sides are underestimated, so a broadcast is ruled out by hint.
    met = probes.join(filed.hint("merge"), (probes["half"] == filed["half"]) & (probes["key"] == filed["key"]) & (F.col("a") < F.col("b")) & near)
    return met.select("a", "b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge list (a, b); the root is the component's least node.

    Alternates large-star and small-star until the edges are stars; every step is settled in the
    shared folder. Only two numbers a round reach the driver.
    """
    now, seen = settle(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("a <> b"), "cc"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or mark[0] == 0:
            release(edges.sparkSession)
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, seen = now, tuple(mark)
        now = settle(_small_star(_large_star(before)), "cc")
        discard(before)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 lower-case hex digits) and ``component_id``."""
    rows = fingerprints(docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")), "text", "fp", shingle)
    rows = settle(rows.select("id", "fp"), "simhash")
    classes = rows.groupBy("fp").agg(F.min("id").alias("first_id"))
    members = components(links(classes.select("fp"), distance))
    rooted = classes.join(members, classes["fp"] == members["node"], "left").select(classes["fp"], "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = settle(rooted, "simhash-classes")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp", "left").select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """docs with one row of each component left: the row of its least id, nulls last.

    Of repeated rows of that id one stays. Rows are numbered in the written table, so the
    choice is fixed before it is used. All columns of docs are kept as they are.
    """
    inside = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text"))
    table = settle(fingerprints(inside, "text", "fp", shingle).select("row", "id", "fp", F.monotonically_increasing_id().alias("uid")), "simhash-rows")
    key = F.struct(F.col("id").isNull().alias("lost"), "id", "uid")
    classes = settle(table.groupBy("fp").agg(F.min(key).alias("best")), "simhash-classes")
    members = components(links(classes.select("fp"), distance))
    kept = classes.join(members, classes["fp"] == members["node"], "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("best").alias("best"))
    return table.join(kept.select(F.col("best.uid").alias("uid")), "uid", "left_semi").select("row.*")
