"""Documents to chunks: semantic sentence groups, prose chunks and table chunks.

Chunking is a walk through one document, so each document is one call inside an Arrow batch;
documents are independent, nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import BRIDGE_TERMS, CHINESE, HEADING, Preset

CHUNK_SCHEMA = "doc_id string, domain string, chunk_id int, text string, is_table boolean, section string, region string, chunk_type string, char_count int"
_HAN, _HAN_ONLY = re.compile("[一-鿿]"), re.compile("[一-鿿]+")
_NUMBER = re.compile(r"\d+(?:\.\d+)?%?")
_PREAMBLE, _TABLE_MARK = "__preamble__", "[表格]\n"


_compiled = lru_cache(regex.compile)


def sentence_list(text: str, preset: Preset = CHINESE) -> list[str]:
    found = (s.strip() for s in _compiled(preset.sentence).findall(text))
    return [s for s in found if s]


def term_set(text: str, preset: Preset = CHINESE) -> set[str]:
    """Terms of a sentence; a Chinese run of over four characters also gives its bigrams."""
    runs = _compiled(preset.term).findall(text)
    if not _HAN.search(text):
        return set(runs)
    pairs = {r[i : i + 2] for r in runs if len(r) > 4 and _HAN_ONLY.fullmatch(r) for i in range(len(r) - 1)}
    return {*runs, *pairs}


def bridge(left: str, right: str) -> float:
    """What ties two sentences beside shared terms: bridge terms in both, or a number in both."""
    both = sum(t in left and t in right for t in BRIDGE_TERMS) if _HAN.search(left) else 0
    if both:
        return min(0.45, 0.22 * both)
    numbers = _NUMBER.findall(left)
    return 0.12 if numbers and not set(numbers).isdisjoint(_NUMBER.findall(right)) else 0.0


def cohesion(left: set[str], right: set[str]) -> float:
    """Shared terms over the geometric mean of two term sets."""
    return len(left & right) / (len(left) * len(right)) ** 0.5 if left and right else 0.0


def semantic_groups(paragraph: str, most: int = 8, threshold: float = 0.08, similarity: Callable[[str, str], float] | None = None, preset: Preset = CHINESE) -> list[str]:
    """A paragraph as groups of neighbouring sentences that hang together."""
    parts = sentence_list(paragraph, preset)
    if len(parts) < 2:
        return parts or [paragraph.strip()]
    terms = [] if similarity else [term_set(p, preset) for p in parts]
    joiner = "" if preset is CHINESE else " "
    groups, size = [parts[0]], 1
    for i in range(1, len(parts)):
        like = similarity(parts[i - 1], parts[i]) if similarity else cohesion(terms[i - 1], terms[i])
        if size >= most or like < threshold and (similarity or like + bridge(parts[i - 1], parts[i]) < threshold):
            groups.append(parts[i])
            size = 1
        else:
            groups[-1] += joiner + parts[i]
            size += 1
    return groups


class _Prose:
    """Collects sentence groups into chunks of about ``size`` characters."""

    def __init__(self, size: int, overlap: int, least: int):
        self.size, self.overlap, self.least = size, overlap, least
        self.section, self.text, self.done = "", "", []

    def close(self) -> None:
        if body := self.text.strip():
            self.done.append((self.section, body))
        self.text = ""

    def heading(self, title: str) -> None:
        self.close()
        self.section, self.text = title, title + "\n"

    def add(self, group: str) -> None:
        full = len(self.text) + len(group) + 1 > self.size
        if full and len(self.text.strip()) >= self.least:
            tail = self.text[-self.overlap :]
            self.close()
            self.text = (self.section + "\n" if self.section else "") + tail
        self.text += group + "\n"


def prose_chunks(text: str, size: int = 1000, overlap: int = 150, least: int = 180, preset: Preset = CHINESE) -> list[tuple[str, str]]:
    """(section, text) of each chunk: headings open sections, long sections are cut at groups."""
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()
    out = _Prose(size, overlap, least)
    for line in filter(None, map(str.strip, text.split("\n"))):
        if len(line) <= 100 and re.match(HEADING, line):
            out.heading(line)
        else:
            for group in semantic_groups(line, preset=preset):
                out.add(group)
    out.close()
    return out.done


def table_pieces(table: str, size: int = 1000) -> list[str]:
    """A table whole, or cut between lines where it is over one and a half sizes."""
    if len(table) <= 1.5 * size:
        return [table]
    pieces = [""]
    for line in table.split("\n"):
        if len(pieces[-1]) + len(line) + 1 > size:
            pieces.append("")
        pieces[-1] += line + "\n"
    return [p.strip() for p in pieces if p.strip()]


def chunk_rows(doc_id: str, domain: str, text: str, tables: list[str], preset: Preset = CHINESE) -> list[tuple]:
    """Rows of CHUNK_SCHEMA of one document; tables follow prose and are regions of their own."""
    prose = prose_chunks(text or "", preset=preset)
    rows = [(doc_id, domain, i, body, False, section, section or _PREAMBLE, "prose", len(body)) for i, (section, body) in enumerate(prose)]
    for piece in (p for t in tables for p in table_pieces(t)):
        rows.append((doc_id, domain, len(rows), _TABLE_MARK + piece, True, "table", str(len(rows)), "table", len(piece) + 5))
    return rows


def chunked(docs: DataFrame, preset: Preset = CHINESE) -> DataFrame:
    """Chunks of documents (doc_id, domain, text, tables array<string>)."""
    names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
    slim = docs.select(F.col("doc_id").cast("string"), F.col("domain").cast("string"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("tables", F.array().cast("array<string>")).alias("tables"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [r for d, m, t, ts in zip(pdf["doc_id"], pdf["domain"], pdf["text"], pdf["tables"]) for r in chunk_rows(d, m, t, list(ts), preset)]
            yield pd.DataFrame(rows, columns=names)

    return slim.mapInPandas(run, CHUNK_SCHEMA)


def table_text(rows: list[list]) -> str:
    """Table rows as ``a | b`` lines; blank rows go; too little is nothing."""
    lines = [" | ".join("" if c is None else str(c).strip() for c in row) for row in rows if any(str(c or "").strip() for c in row)]
    text = "\n".join(lines)
    return text if len(lines) >= 2 and len(text) > 20 else ""
