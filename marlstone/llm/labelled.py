"""Bounded samples of labelled documents, and folds, for the operators that learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import quoted, release


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; null ids count as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text", chars: int | None = None) -> list[tuple[str, int]]:
    """The examples of ``weighted``."""
    return weighted(docs, labels, label, usable, per_class, id_col, text_col, chars)[0]


def weighted(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text", chars: int | None = None) -> tuple[list[tuple[str, int]], dict[int, float]]:
    """(text, label) of at most about ``per_class`` documents a class, as chosen by a hash of the id,
    and how many documents of its class each of them stands for (the inverse of its share), so the
    weighted mix of classes is that of docs at every size.

    The bound is on what reaches the driver: labelled ids are counted, a hash threshold is set for
    each class, and only the rows under it are fetched. Texts over ``chars`` code points aren't
    chosen. Ids labelled twice with different values are left out; of
    repeated documents the least text counts.
    """
    marks = labels.select(quoted(id_col).alias("id"), quoted(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(usable)
    marks = marks.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").select("id", "y")
    sizes = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    space = 1 << 20
    under, weights = F.lit(-1), {}
    for y in (0, 1):
        bound = max(1, int(space * min(1.0, per_class / max(1, sizes.get(y, 0)))))
        under, weights[y] = F.when(F.col("y") == y, F.lit(bound)).otherwise(under), space / bound
    chosen = marks.where(F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(space)) < under)
    texts = docs.select(quoted(id_col).alias("doc"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    if chars is not None:
        texts = texts.where(F.length("text") <= chars)
    if chosen.count() <= 100_000:
        chosen = F.broadcast(chosen)
    met = texts.join(chosen, texts["doc"] == chosen["id"]).groupBy("id", "y").agg(F.min("text").alias("text"))
    examples = [(r["text"], r["y"]) for r in met.orderBy("id").toLocalIterator()]
    release(docs.sparkSession)
    return examples, weights
