"""Checks of result tables, overlays and resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.vocabulary import INTENTS, PATTERNS, TYPES


def issues(patterns: DataFrame, predicted: DataFrame, keys: tuple[str, str] = ("stock_code", "transaction_date")) -> DataFrame:
    """(issue, key, detail): what is wrong with two result tables; empty if nothing is."""
    keys = list(keys)
    key = F.concat_ws("/", *keys)
    only = lambda a, b, name: a.join(b.select(*keys).distinct(), keys, "left_anti").select(F.lit(name).alias("issue"), key.alias("key"), F.lit("").alias("detail"))
    outside = lambda df, column, allowed, name: df.where(F.col(column).isNull() | ~F.col(column).isin(*allowed)).select(F.lit(name).alias("issue"), key.alias("key"), F.coalesce(column, F.lit("")).alias("detail"))
    twice = lambda df, name: df.groupBy(*keys).count().where("count > 1").select(F.lit(name).alias("issue"), key.alias("key"), F.col("count").cast("string").alias("detail"))
    counts = patterns.agg(F.count("*").alias("a")).join(predicted.agg(F.count("*").alias("b")), F.lit(True)).where("a <> b")
    found = [
        counts.select(F.lit("row counts differ").alias("issue"), F.lit("").alias("key"), F.concat_ws(" and ", "a", "b").alias("detail")),
        only(patterns, predicted, "key without prediction"),
        only(predicted, patterns, "key without pattern"),
        outside(patterns, "pattern_type", PATTERNS, "unknown pattern"),
        outside(predicted, "capital_type", TYPES, "unknown type"),
        outside(predicted, "capital_intention", INTENTS, "unknown intent"),
        twice(patterns, "pattern key repeats"),
        twice(predicted, "prediction key repeats"),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    return out


def column_issues(df: DataFrame, expected: list[str]) -> list[str]:
    """What is wrong with a table's columns."""
    return [] if df.columns == expected else [f"columns are {df.columns}, not {expected}"]


def normal_answer(answer: Column, answer_format: Column) -> Column:
    """Letters A to D of an answer: sorted and distinct for multi, else the first."""
    letters = F.regexp_extract_all(F.upper(F.coalesce(answer, F.lit(""))), F.lit("([ABCD])"), F.lit(1))
    return F.when(answer_format == "multi", F.array_join(F.array_sort(F.array_distinct(letters)), "")).otherwise(F.coalesce(F.get(letters, 0), F.lit("")))


def answer_issues(answers: DataFrame, expected: int | None = None) -> DataFrame:
    """(issue, qid): repeated ids, malformed or unsorted answers, and a wrong number of ids."""
    bad = answers.where(F.col("answer").isNull() | ~F.col("answer").rlike("^[A-D]+$")).select(F.lit("malformed").alias("issue"), "qid")
    unsorted = answers.where(F.col("answer").rlike("^[A-D]+$") & (F.col("answer") != normal_answer(F.col("answer"), F.lit("multi")))).select(F.lit("unsorted").alias("issue"), "qid")
    twice = answers.groupBy("qid").count().where("count > 1").select(F.lit("repeated").alias("issue"), "qid")
    out = bad.unionAll(unsorted).unionAll(twice)
    if expected is not None:
        count = answers.agg(F.countDistinct("qid").alias("n")).where(F.col("n") != expected)
        out = out.unionAll(count.select(F.lit("wrong number").alias("issue"), F.col("n").cast("string").alias("qid")))
    return out


def overlay(base: DataFrame, overrides: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(result, issues): base with values overridden; overrides of unknown keys or without change are issues."""
    new = overrides.select(F.col(key), F.col(value).alias("override"))
    result = base.join(new, key, "left").withColumn(value, F.coalesce("override", value)).drop("override")
    unknown = new.join(base, key, "left_anti").select(F.lit("unknown key").alias("issue"), F.col(key))
    same = new.join(base, key).where(F.col("override") == F.col(value)).select(F.lit("no change").alias("issue"), F.col(key))
    return result, unknown.unionAll(same)


def pending(questions: DataFrame, answers: DataFrame, key: str = "qid") -> DataFrame:
    """Questions without an answer row that spent tokens."""
    return questions.join(answers.where("total_tokens > 0").select(key), key, "left_anti")


def first_questions(questions: DataFrame, limit: int | None = None, order: str = "ordinal") -> DataFrame:
    """The first ``limit`` questions in order; all of them for None or 0."""
    return questions.orderBy(order).limit(limit) if limit else questions
