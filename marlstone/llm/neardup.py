"""Near-dedup of whole texts: SimHash, then Jaccard similarity of five-word shingle sets.

First every text goes through ``simhash.near_duplicates``, on five-word shingles, and the members of a
component are compared with one of them. Three bits of 64 find the closest copies only, so minimum hashes
gather the other candidates; open pairs are those that neither has linked.

Shingles: words as in ``simhash`` (A-Z lower-cased, ASCII white space), five to a shingle, hashed by
XXH64; a text of fewer words is one shingle, a blank or null one has none. Texts of one set collapse
first.

Candidates: 64 minimum hashes of the set in 16 bands of four. A pair of likeness 0.8 shares no band
with probability (1 - 0.8**4)**16 = 0.0002, a closer one with less. Every link is verified on
the two whole sets.

Dense groups: every member of a bucket is compared with two heads of it, its most central text (the
one whose buckets hold the most members, summed) and one drawn by a hash. After that only pairs of
different components are open. Small buckets' open pairs are compared at once. The members of
larger buckets meet through an exact prefix filter: shingles are ordered from rare to common, two
alike sets of n and m shingles share one among the first n - ceil(0.8 n) + 1 of the longer and the
first n - ceil(1.6 / 1.8 n) + 1 of the shorter, and what follows their first shared shingle must
suffice for the overlap that 0.8 asks. So a copy whose own edits fill its prefix meets nobody,
and no pair that is alike is lost.

Rows without an id come last where one is kept; of repeated rows one stays. All columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.shared import Scratch, quoted, settle, slices, with_fields
from marlstone.llm.simhash import components, near_duplicates

_LOWER = bytes(range(256)).lower()
_SEED = 42
SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 16, 4
#: Open pairs of buckets of at most so many members are compared without the prefix filter.
SMALL = 32
_RNG = np.random.default_rng(20)
_FLIPS, _FACTORS = (_RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(1, len(words) - SHINGLE + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], _SEED) for a, b in zip(starts[:last].tolist(), ends[min(SHINGLE, len(words)) - 1 :].tolist())], np.uint64))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets; empty ones are alike."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) or len(b) else 1.0


def bands(found: np.ndarray) -> list[int]:
    """The signed 64-bit bucket of each band; none for an empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 2048):
        part = found[at : at + 2048]
        np.minimum(least, ((part[None, :] ^ _FLIPS[:, None]) * _FACTORS[:, None]).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _sketched(rows: DataFrame) -> DataFrame:
    """rows (uid, id, text) with ``mark`` (a hash of the set), ``n`` (its size) and ``bands``, without text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            marks, sizes, keys = [], [], []
            for t in batch.column(2):
                found = shingles(t.as_py())
                marks.append(xxhash.xxh64_intdigest(found.tobytes(), _SEED))
                sizes.append(len(found))
                keys.append(bands(found))
            added = [pa.array(np.array(marks, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *added], ["uid", "id", "mark", "n", "bands"])

    return rows.mapInArrow(run, with_fields(rows.select("uid", "id"), ("mark", "long"), ("n", "long"), ("bands", "array<long>")))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of marks whose whole sets are alike."""
    met = pairs.join(texts.select(F.col("mark").alias("b"), F.col("text").alias("tb")), "b")
    met = met.join(texts.select(F.col("mark").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lru_cache(64)(shingles)
        for batch in slices(batches):
            alike = [likeness(of(x.as_py()), of(y.as_py())) >= LEAST - 1e-12 for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return met.mapInArrow(run, "a long, b long")


def _long_enough(m: str, n: str):
    return F.least(m, n) >= LEAST * F.greatest(m, n) - 1e-9


def _ordered(open_: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(mark, root, n, order) of texts: (position, shingle) of the shared ones in a prefix, rare ones first.

    Positions count all shingles of a text; those that no other text here has stand before the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t.as_py()).view(np.int64) for t in batch.column(3)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], ["mark", "root", "n", "shingles"])

    sets = open_.join(texts, "mark").select("mark", "root", "n", "text").mapInArrow(run, "mark long, root long, n long, shingles array<long>")
    told = scratch.settle(sets, "near-sets").select("mark", "root", "n", F.explode("shingles").alias("shingle"))
    shared = scratch.settle(told.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "near-shared")
    rare = told.join(shared.hint("merge"), "shingle").groupBy("mark", "root", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("order"))
    return rare.select("mark", "root", "n", F.expr("transform(order, (x, i) -> named_struct('at', n - size(order) + i, 'shingle', x.shingle))").alias("order"))


def _open_pairs(ordered: DataFrame) -> DataFrame:
    """Pairs (a, b) of different roots that the prefix filter can't rule out."""
    prefix = lambda share: F.filter("order", lambda x: x["at"] < F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1)
    side = lambda name, share: ordered.select(F.col("mark").alias(name), F.col("root").alias(f"r{name}"), F.col("n").alias(f"n{name}"), F.explode(prefix(share)).alias("x")).select(name, f"r{name}", f"n{name}", F.col("x.at").alias(f"at{name}"), F.col("x.shingle").alias("shingle"))
    both = 2 * LEAST / (1 + LEAST)
    longer, shorter = side("a", LEAST), side("b", both)
    sized = (F.col("nb") >= LEAST * F.col("na") - 1e-9) & ((F.col("nb") < F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a"))))
    left = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb"))
    met = longer.join(shorter.hint("merge"), (longer["shingle"] == shorter["shingle"]) & (F.col("ra") != F.col("rb")) & sized & (left >= both / 2 * (F.col("na") + F.col("nb")) - 1e-9))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _printed(rows: DataFrame, marks: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b), a < b, of marks by SimHash: the marks of each of its components, with the least one.

    rows: uid, text. marks: uid, mark.
    """
    found = near_duplicates(rows, "uid", "text", SHINGLE).select("uid", "component_id")
    met = scratch.settle(found.join(marks.hint("merge"), "uid").select("component_id", "mark").distinct(), "near-prints")
    least = met.groupBy("component_id").agg(F.min("mark").alias("a"))
    tied = met.join(least.hint("merge"), "component_id").where("a <> mark").select("a", F.col("mark").alias("b"))
    return scratch.settle(tied, "near-printed")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies left: the row of its least id, nulls last."""
    inside = docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*[quoted(c) for c in docs.columns]).alias("row"))
    # Numbered rows are written first, so only ids and texts pass through Python.
    rows, scratch = settle(inside, "near-rows"), Scratch()
    text = F.col("row").getField(text_col).cast("string").alias("text")
    table = scratch.settle(_sketched(rows.select("uid", F.col("row").getField(id_col).alias("id"), text)), "near-sketches")
    best = F.min(F.struct(F.col("id").isNull().alias("lost"), "id", "uid")).alias("best")
    printed = _printed(rows.select("uid", text), table.select("uid", "mark"), scratch)
    classes = settle(table.groupBy("mark").agg(best, F.min("n").alias("n"), F.first("bands").alias("bands")), "near-classes")

    filed = classes.select("mark", "n", F.explode("bands").alias("bucket"))
    sizes = scratch.settle(filed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "near-sizes")
    filed = scratch.settle(filed.join(sizes.hint("merge"), "bucket"), "near-buckets")
    central = scratch.settle(filed.groupBy("mark").agg(F.sum("size").alias("central")), "near-central")
    filed = scratch.settle(filed.join(central.hint("merge"), "mark"), "near-filed")
    compared = central.select("mark").unionAll(printed.select(F.explode(F.array("a", "b")))).distinct()
    texts = scratch.settle(rows.select("uid", text).join(compared.join(classes, "mark").select("mark", F.col("best.uid").alias("uid")), "uid").select("mark", "text"), "near-texts")

    head = F.struct("mark", "n")
    heads = scratch.settle(filed.groupBy("bucket").agg(F.array_distinct(F.array(F.max_by(head, F.struct("central", "mark")), F.min_by(head, F.xxhash64(F.lit(0), "mark")))).alias("heads")), "near-heads")
    stars = filed.join(heads.hint("merge"), "bucket").select("mark", "n", F.explode("heads").alias("head")).where((F.col("mark") != F.col("head.mark")) & _long_enough("n", "head.n"))
    stars = scratch.settle(stars.select(F.least("mark", "head.mark").alias("a"), F.greatest("mark", "head.mark").alias("b")).unionAll(printed).distinct(), "near-pairs")
    links = scratch.settle(_verified(stars, texts), "near-links")

    # What is left open: pairs of different components in one bucket.
    roots = components(links)
    placed = scratch.settle(filed.join(roots, filed["mark"] == roots["node"], "left").select("bucket", "size", "mark", "n", F.coalesce("root", "mark").alias("root")), "near-placed")
    mixed = scratch.settle(placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket"), "near-mixed")
    placed = scratch.settle(placed.join(mixed.hint("merge"), "bucket"), "near-open")
    few = placed.where(F.col("size") <= SMALL)
    other = few.select("bucket", F.col("mark").alias("m"), F.col("n").alias("k"), F.col("root").alias("r"))
    near = few.join(other.hint("merge"), "bucket").where((F.col("mark") < F.col("m")) & (F.col("root") != F.col("r")) & _long_enough("n", "k"))
    many = placed.where(F.col("size") > SMALL).select("mark", "root", "n").distinct()
    rest = near.select(F.col("mark").alias("a"), F.col("m").alias("b")).unionAll(_open_pairs(_ordered(many, texts, scratch)))
    rest = scratch.settle(rest.distinct().join(stars, ["a", "b"], "left_anti"), "near-rest")
    more = scratch.settle(_verified(rest, texts), "near-links")

    members = components(links.unionAll(more))
    scratch.clear()  # the result reads rows, classes and members
    kept = classes.join(members, classes["mark"] == members["node"], "left").groupBy(F.coalesce("root", "mark").alias("root")).agg(F.min("best").alias("best"))
    return rows.join(kept.select(F.col("best.uid").alias("uid")), "uid", "left_semi").select("row.*")
