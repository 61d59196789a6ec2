"""Chat formatting from an event log.

Reconstruction: the log is partitioned by conversation, once, and sorted by sequence inside each
message; a ``delta`` appends to the message, an ``edit`` replaces it, a ``regenerate`` starts it anew, a
``delete`` takes it away until a later edit or regeneration. Folding needs one pass: everything
before the last event that isn't a delta is void.

Rendering: each role has an opening and a closing mark. Inside texts ``<``, ``[`` and backslash
are followed by a backslash, so no mark can be spelled by a text, and reading back is one regular
expression. The loss mask is a list of spans (start from 1, length, in code points) over the
formatted string that covers exactly the assistant's texts.

Null text: empty. Null role: the empty role, marked like any unknown role. Null sequence: first.
Null conversation: a conversation of its own. Messages of one position are ordered by role, then
text. Repeated rows are messages of their own. An empty log gives no conversation. Columns that
aren't named in the call are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.shared import quoted

# The marks of the template.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER_OPEN, OTHER_MIDDLE, OTHER_CLOSE = "<|", "|>", "<|end|>"


def _escaped(text: Column, also: str = "") -> Column:
    return F.regexp_replace(text, rf"([<\[\\{also}])", r"$1\\")


def _plain(text: Column, also: str = "") -> Column:
    return F.regexp_replace(text, rf"([<\[\\{also}])\\", "$1")


def reconstruct(events: DataFrame, conv: str = "conv_id", message: str = "message", seq: str = "seq", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, message, at, role, text): the final messages; ``at`` is the message's first sequence."""
    log = events.repartition(quoted(conv)).select(
        quoted(conv).alias("conv"),
        quoted(message).alias("message"),
        F.struct(quoted(seq).alias("seq"), F.coalesce(quoted(kind), F.lit("delta")).alias("kind"), quoted(role).alias("role"), F.coalesce(quoted(text), F.lit("")).alias("text")).alias("e"),
    )
    # All that follows groups by the conversation or finer, so its one exchange serves every step.
    told = log.groupBy("conv", "message").agg(F.array_sort(F.collect_list("e")).alias("es"))
    # The last event that isn't a delta, counted from 1; 0 if all are deltas. What precedes it is void.
    last = F.expr("greatest(array_max(transform(es, (e, i) -> if(e.kind = 'delta', 0, i + 1))), 0)")
    told = told.select("conv", "message", "es", last.alias("last"))
    shown = told.where(F.expr("last = 0 or get(es, last - 1).kind <> 'delete'"))
    return shown.select(
        "conv",
        "message",
        F.expr("es[0].seq").alias("at"),
        F.expr("get(filter(transform(es, e -> e.role), r -> r is not null), 0)").alias("role"),
        F.expr("array_join(transform(slice(es, greatest(last, 1), size(es)), e -> e.text), '')").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv, formatted, loss): loss is an array of (start, length) spans of the formatted text."""
    role = F.coalesce(F.col("role"), F.lit(""))
    opening, closing = F.concat(F.lit(OTHER_OPEN), _escaped(role, "|"), F.lit(OTHER_MIDDLE)), F.lit(OTHER_CLOSE)
    for name, (a, b) in MARKS.items():
        opening, closing = F.when(role == name, F.lit(a)).otherwise(opening), F.when(role == name, F.lit(b)).otherwise(closing)
    parts = messages.select("conv", F.struct("at", role.alias("role"), "text", "message").alias("key"), opening.alias("a"), _escaped(F.coalesce("text", F.lit(""))).alias("t"), closing.alias("b"), (role == "assistant").alias("learned"))
    order = Window.partitionBy("conv").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    chars = F.length("a") + F.length("t") + F.length("b")
    parts = parts.select("conv", "key", F.concat("a", "t", "b").alias("said"), "learned", F.length("t").cast("long").alias("n"), (F.coalesce(F.sum(chars.cast("long")).over(order), F.lit(0)) + F.length("a") + 1).alias("start"))
    whole = parts.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("start", "n", "learned", "said"))).alias("ps"))
    return whole.select(
        "conv",
        F.array_join(F.transform("ps", lambda p: p["said"]), "").alias("formatted"),
        F.expr("transform(filter(ps, p -> p.learned), p -> named_struct('start', p.start, 'length', p.n))").alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv, formatted_chars, turns, learned): turns as (role, text), learned texts by the mask."""
    marks = "|".join([*(rf"\Q{a}\E" for a, _ in MARKS.values()), r"<\|(?:[^<\[|\\]|[<\[|\\]\\)*+\|>"])
    closes = "|".join(rf"\Q{b}\E" for b in [*(b for _, b in MARKS.values()), OTHER_CLOSE])
    turn = rf"({marks})((?:[^<\[]|[<\[]\\)*+)(?:{closes})"
    opened, texts = F.regexp_extract_all("formatted", F.lit(turn), F.lit(1)), F.regexp_extract_all("formatted", F.lit(turn), F.lit(2))

    def role_of(mark: Column) -> Column:
        found = _plain(F.substring(mark, F.lit(3), F.length(mark) - 4), "|")
        for name, (a, _) in MARKS.items():
            found = F.when(mark == a, F.lit(name)).otherwise(found)
        return found

    rows = formatted.select("conv", "formatted", "loss", opened.alias("opened"), texts.alias("texts"))
    return rows.select(
        "conv",
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.zip_with("opened", "texts", lambda a, t: F.struct(role_of(a).alias("role"), _plain(t).alias("text"))).alias("turns"),
        F.transform("loss", lambda s: _plain(F.substring("formatted", s["start"].cast("int"), s["length"].cast("int")))).alias("learned"),
    )
