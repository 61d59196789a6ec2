"""Concatenate and cut: every document's tokens in one stream, cut into windows of equal size.

Pass 1 tokenises each text once, ends it with an end token and writes ids with the document's
start inside its input partition. Partition totals (one number a partition) turn into global
offsets by a prefix sum. Pass 2 adds the partition's offset to each start and cuts at fixed
window borders; a document that crosses borders gives one boundary record for each window that it
touches, so every id lies in exactly one piece and only the last window is short.

Null text: the empty text, so one end token. Repeated rows are packed each. An empty table gives
an empty table. Columns of the input other than id and text are not carried. The order of the
stream is that of the input's partitions, fixed by the table that pass 1 writes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.bpe import load
from marlstone.llm.shared import quoted, settle, slices

#: Up to so many partition totals (about 20 bytes each) are broadcast; more are joined by shuffle.
_BROADCAST_PARTS = 200_000


def tokenised(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, start_in_part, doc_tokens, ids) with ids as little-endian unsigned 32-bit bytes."""
    slim = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, total = load(path), TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            raw = [ids + end for ids in bpe.encode(batch.column(1).to_pylist())]
            counts = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
            ends = total + np.cumsum(counts)
            columns = [batch.column(0), pa.array(np.full(len(raw), part, np.int32)), pa.array(ends - counts), pa.array(counts), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "part", "start_in_part", "doc_tokens", "ids"])
            total = int(ends[-1]) if len(ends) else total

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, part int, start_in_part long, doc_tokens long, ids binary")


def pack(docs: DataFrame, path: str, length: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: id, start, length, ids (binary), doc_tokens, sequence_id, offset."""
    rows = settle(tokenised(docs, path, end_id, id_col, text_col), "packing")
    totals = settle(rows.groupBy("part").agg(F.sum("doc_tokens").alias("total")), "packing-totals")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("part").alias("base_part"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    if totals.count() <= _BROADCAST_PARTS:
        bases = F.broadcast(bases)
    placed = rows.join(bases, rows["part"] == bases["base_part"]).withColumn("at", F.col("base") + F.col("start_in_part"))
    windows = F.sequence(F.expr(f"at div {length}"), F.expr(f"(at + doc_tokens - 1) div {length}"))
    cut = placed.select("id", "ids", "doc_tokens", "at", F.explode(windows).alias("sequence_id"))
    first = F.greatest(F.col("sequence_id") * length, F.col("at"))
    last = F.least((F.col("sequence_id") + 1) * length, F.col("at") + F.col("doc_tokens"))
    cut = cut.select("id", "ids", "doc_tokens", "sequence_id", (first - F.col("at")).alias("start"), (last - first).alias("length"), (first - F.col("sequence_id") * length).alias("offset"))
    piece = F.substring("ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    return cut.select(F.col("id").alias(id_col), "start", "length", piece.alias("ids"), "doc_tokens", "sequence_id", "offset")
