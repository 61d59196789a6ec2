"""Document and question sources: path resolution, text, HTML, questions, answers, cached chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import html_text
from marlstone.operators.chunking import CHUNK_SCHEMA, table_text

#: Order in which a document's files are preferred.
PREFERENCE = ("txt", "html", "htm", "pdf")
QUESTION_SCHEMA = "qid string, domain string, split string, question string, options map<string,string>, answer_format string, type string, doc_ids array<string>"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem, kind, content) of every file below a folder; stems are lower-case."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return raw.select("path", F.lower(F.regexp_replace(name, r"\.[^.]*$", "")).alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("kind"), "content")


def resolve(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Each wanted (domain, doc_id) with its preferred file: a path under its domain first, then by kind."""
    order = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in PREFERENCE]), F.col("kind")), F.lit(99))
    met = wanted.join(found, F.lower(wanted["doc_id"].cast("string")) == found["stem"], "left")
    inside = F.col("path").contains(F.concat(F.lit("/"), F.col("domain"), F.lit("/")))
    best = F.min_by(F.struct("path", "kind", "content"), F.struct((~inside).alias("a"), order.alias("b"), F.col("path").alias("c")))
    return met.groupBy("domain", "doc_id").agg(best.alias("f")).select("domain", "doc_id", "f.path", "f.kind", "f.content")


def texts(resolved: DataFrame, readers: dict[str, Callable[[bytes], tuple[str, list[list[list]]]]] | None = None) -> DataFrame:
    """(domain, doc_id, text, tables, status): text and HTML decoded, other kinds by ``readers``.

    A reader gets a file's bytes and returns its text and its tables as rows of cells; it runs in
    the executors. A kind without a reader is ``unsupported``, a file that its reader can't read ``unreadable``.
    """
    body = F.col("content").cast("string")
    text = F.when(F.col("kind").isin("html", "htm"), html_text(body)).when(F.col("kind") == "txt", body)
    status = F.when(F.col("path").isNull(), "missing").when(text.isNull(), "unsupported").otherwise("ok")
    plain = resolved if not readers else resolved.where(F.col("kind").isNull() | ~F.col("kind").isin(*readers))
    out = plain.select("domain", "doc_id", text.alias("text"), F.array().cast("array<string>").alias("tables"), status.alias("status"))
    if not readers:
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for domain, doc_id, kind, content in zip(pdf["domain"], pdf["doc_id"], pdf["kind"], pdf["content"]):
                try:
                    said, tables = readers[kind](bytes(content))
                    rows.append((domain, doc_id, said, [t for t in map(table_text, tables) if t], "ok"))
                except Exception:  # whatever a caller's reader raises is about this file
                    rows.append((domain, doc_id, None, [], "unreadable"))
            yield pd.DataFrame(rows, columns=["domain", "doc_id", "text", "tables", "status"])

    kinds = dict(resolved.dtypes)
    read = resolved.where(F.col("kind").isin(*readers)).select("domain", "doc_id", "kind", "content")
    return out.unionByName(read.mapInPandas(run, f"domain {kinds['domain']}, doc_id {kinds['doc_id']}, text string, tables array<string>, status string"))


def read_questions(spark: SparkSession, path: str, domains: list[str] | None = None) -> DataFrame:
    """Question JSON arrays, one file a domain."""
    rows = spark.read.schema(QUESTION_SCHEMA).json(path, multiLine=True)
    return rows.where(F.col("domain").isin(domains)) if domains else rows


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Answer CSV without its summary row."""
    rows = spark.read.csv(path, header=True).where("qid <> 'summary'")
    counts = [F.col(c).try_cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens") if c in rows.columns]
    return rows.select("qid", F.coalesce("answer", F.lit("")).alias("answer"), *counts)


def cached_chunks(spark: SparkSession, path: str, version: int, build) -> DataFrame:
    """Chunks stored for a version, or built, stored and read back."""
    where = f"{path}/version={version}"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        build().write.mode("overwrite").parquet(where)
    return spark.read.schema(CHUNK_SCHEMA).parquet(where)
