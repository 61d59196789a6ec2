"""Quality rules: a threshold table compiled into one projection of built-in functions.

Words are runs of anything but ASCII white space. All figures come from the whole text of a row,
inside that row: no shuffle, no user function. Repeated three-word windows are found by sorting
the window hashes of a text with their positions and comparing neighbours.

Null text: no words, so the base rule fails. Rows are neither dropped nor merged by ``judged``;
extra columns are carried and those named like an output are replaced. ``keep`` returns the rows
whose verdict is to keep, with the columns of the input.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import SPACE, quoted, without

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for on was with as be by at this are or from an a "
    "le la les de des du et un une en que qui dans pour par sur au est "
    "der die das und von den dem mit zu im nicht auf ist für als auch ein eine "
    "el los las del y que en se con una es no lo su al"
).split()


@dataclass(frozen=True)
class Rule:
    """``ratio`` (an SQL expression over the measures) must lie in [low, high]; high may be open."""

    name: str
    ratio: str
    low: float
    high: float = math.inf

    def condition(self, suffix: str = "") -> str:
        """The rule as SQL; ``suffix`` marks numbers as doubles where a dialect asks for it."""
        low = f"({self.ratio}) >= {self.low!r}{suffix}"
        return low if math.isinf(self.high) else f"{low} and ({self.ratio}) <= {self.high!r}{suffix}"


#: The threshold table. Measures: n_words, word_chars, n_symbols, n_dup_lines, n_lines,
#: n_repeat_words, n_stop_words, n_marks (``!`` and ``?``).
RULES = (
    Rule("words", "n_words", 50),
    Rule("mean_word_length", "word_chars / greatest(n_words, 1)", 2.0, 15.0),
    Rule("symbols_per_word", "n_symbols / greatest(n_words, 1)", 0.0, 0.3),
    Rule("marks_per_word", "n_marks / greatest(n_words, 1)", 0.0, 0.3),
    Rule("stop_word_share", "n_stop_words / greatest(n_words, 1)", 0.02, 1.0),
    Rule("duplicate_line_share", "n_dup_lines / greatest(n_lines, 1)", 0.0, 0.4),
    Rule("repeated_word_share", "n_repeat_words / greatest(n_words, 1)", 0.0, 0.5),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(words: str, windows: str) -> Column:
    """Words inside three-word windows that occur twice or more; ``windows`` is sorted (hash, at)."""
    twin = (
        f"filter(transform({windows}, (x, i) -> if((i > 0 and x.h = {windows}[i - 1].h) or (i + 1 < size({windows}) and x.h = {windows}[i + 1].h), x.at, -1)), p -> p >= 0)"
    )
    return F.expr(
        f"if(size({windows}) = 0, 0L, aggregate(sort_array({twin}), named_struct('last', -3, 'n', 0L), "
        "(s, p) -> named_struct('last', p, 'n', s.n + least(3, p - s.last)), s -> s.n))"
    )


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, measures...): each input row as a struct beside the figures of its text."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), text.alias("t"))
    rows = rows.select(
        "row",
        "t",
        F.array_remove(F.split("t", SPACE + "+"), "").alias("w"),
        F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    window = "if(size(w) < 3, array(), transform(slice(w, 1, size(w) - 2), (x, i) -> xxhash64(x, w[i + 1], w[i + 2])))"
    rows = rows.withColumn("h", F.expr(f"cast({window} as array<bigint>)"))
    empty = "cast(array() as array<struct<h:bigint,at:int>>)"
    rows = rows.withColumn("s", F.expr(f"if(size(array_distinct(h)) = size(h), {empty}, sort_array(transform(h, (x, i) -> named_struct('h', x, 'at', i))))"))
    stops = ", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))
    length = lambda c: F.length(c).cast("long")
    measures = F.struct(
        F.size("w").cast("long").alias("n_words"),
        length(F.array_join("w", "")).alias("word_chars"),
        (length("t") - length(F.regexp_replace("t", r"[#*$%&|<>]", ""))).alias("n_symbols"),
        (length("t") - length(F.regexp_replace("t", r"[!?]", ""))).alias("n_marks"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"cast(size(filter(w, x -> lower(x) in ({stops}))) as bigint)").alias("n_stop_words"),
        _repeated("w", "s").alias("n_repeat_words"),
    )
    # A generator of one row: filters on measures stay above it. Below, the optimizer would write
    # each measure's whole expression into the filter, and the expressions into each other.
    return rows.select("row", F.explode(F.array(measures)).alias("m")).select("row", "m.*")


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression."""
    return F.expr(" and ".join(r.condition("D") for r in rules))


def judged(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the measures, ``base_failed`` and ``kept``."""
    outputs = (*MEASURES, "base_failed", "kept")
    names = without(docs, *outputs).columns
    base = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    rows = measured(docs, text_col).withColumn("base_failed", base)
    fields = [F.col("row").getField(c).alias(c) for c in names]
    return rows.select(*fields, *MEASURES, "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept"))


def keep(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    base = F.expr("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words")
    return measured(docs, text_col).where(base & verdict(rules)).select("row.*")
