"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols sit in the leaves of a segment tree; a leaf holds the rank of the pair it forms
with the next living symbol, joined with its position, so the root yields the leftmost pair of the
lowest rank. A merge touches three leaves and their paths to the root. Short words are merged
many at a time, one tree to a row of a numpy matrix; long ones one by one, in plain lists. Merging is done once
for each distinct word that a worker meets, within a bounded table.

Null text: encoded as the empty text (no ids). Null ids: decoded as the empty text. Extra columns
are carried; those named as the output are replaced. Rows are neither dropped nor merged.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from marlstone.llm.shared import quoted, slices, with_fields, without

#: No merge: above every rank and every leaf, which joins a rank with a position.
_NONE = np.iinfo(np.int64).max
#: Words of a batch are merged together up to this many bytes.
_WIDEST = 64
#: Bytes of distinct words and ids that a worker keeps (with about 250 a word of overhead), and
#: characters that it splits at once.
_KEPT_BYTES, _OVERHEAD, _SLICE = 160 << 20, 250, 1_000_000


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(own))}
    return [rest.get(b, chr(b)) for b in range(256)]


def _ranges(points: Iterable[int]) -> str:
    """A regular-expression class body for code points."""
    out, run = [], []
    for p in [*sorted(points), None]:
        if run and p != run[-1] + 1:
            out.append(f"\\u{run[0]:04x}-\\u{run[-1]:04x}")
            run = []
        if p is not None:
            run.append(p)
    return "".join(out)


class WordBpe:
    """A word-level BPE tokenizer read from a ``tokenizers`` JSON file with word ends."""

    #: Below this code point composition changes nothing, so text needs no library normaliser.
    PLAIN = 0x250

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *specials.values()]) + 1)
        for token, i in [*vocab.items(), *specials.items()]:
            self.tokens[i] = token
        symbols = _byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.final = np.array([vocab[s + self.suffix] for s in symbols], np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        pairs = left << 32 | right
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.pair_rank = pairs[order], order.astype(np.int64)
        self.special_ids = {s: np.array([i], "<u4").tobytes() for s, i in specials.items()}
        self.special_re = re.compile("(" + "|".join(sorted(map(re.escape, specials), key=len, reverse=True)) + ")") if specials else None
        points = range(self.PLAIN)
        letter = _ranges(p for p in points if category(chr(p))[0] == "L")
        number = _ranges(p for p in points if category(chr(p))[0] == "N")
        space = r"\t-\r \x85\xa0"
        short = "'s|'t|'re|'ve|'m|'ll|'d"
        self.plain_re = re.compile(f"{short}|[{letter}]+|[{number}]|[^{space}{letter}{number}]+")
        self.other_re = re.compile(f"[^\\x00-\\u{self.PLAIN - 1:04x}]")
        self.full_re = regex.compile(short + r"|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        self.path, self.known, self.held, self.rank_of, self._library = path, {}, 0, {}, None

    # -- words ------------------------------------------------------------------------------

    def _normalised(self, text: str) -> str:
        """Text beyond the plain range: the library's normaliser, whose Unicode tables count."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).normalizer
        return self._library.normalize_str(text)

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, in order."""
        if text.isascii() or not self.other_re.search(text):
            low = text.lower()
            if low.isascii() or not self.other_re.search(low):
                return self.plain_re.findall(low)
            return self.full_re.findall(low)
        return self.full_re.findall(self._normalised(text))

    # -- merging ----------------------------------------------------------------------------

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; _NONE where they don't merge."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], _NONE)

    def _merge_rows(self, words: list[bytes], wide: int) -> list[bytes]:
        """Ids, as little-endian 32-bit bytes, of words of at most ``wide`` (a power of two) bytes."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        raw = np.zeros((n, wide), np.uint8)
        raw[np.arange(wide) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        ids = self.inner[raw]
        row = np.arange(n)
        ids[row, size - 1] = self.final[raw[row, size - 1]]
        after = np.broadcast_to(np.arange(1, wide + 1), (n, wide)).copy()
        before = np.broadcast_to(np.arange(-1, wide - 1), (n, wide)).copy()
        alive = np.arange(wide) < size[:, None]
        tree = np.full((n, 2 * wide), _NONE, np.int64)
        r, c = np.nonzero(alive[:, 1:])
        rank = self._rank(ids[r, c], ids[r, c + 1])
        tree[r, wide + c] = np.where(rank == _NONE, _NONE, rank * wide + c)
        for node in range(wide - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])

        flat_tree, flat_ids = tree.reshape(-1), ids.reshape(-1)
        flat_after, flat_before = after.reshape(-1), before.reshape(-1)

        def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            base, node = rows * (2 * wide), leaf + wide
            flat_tree[base + node] = value
            for _ in range(wide.bit_length() - 1):  # all leaves are on one level
                pair = base + (node & -2)
                node = node >> 1
                value = np.minimum(flat_tree[pair], flat_tree[pair + 1])
                flat_tree[base + node] = value

        row = row[tree[:, 1] != _NONE]
        while len(row):
            best, at = flat_tree[row * (2 * wide) + 1], row * wide
            i, merged = best % wide, self.made[best // wide]
            j = flat_after[at + i]
            k = flat_after[at + j]
            flat_ids[at + i] = merged
            alive[row, j] = False
            flat_after[at + i] = k
            put(row, j, _NONE)
            has = k < size[row]
            flat_before[(at + k)[has]] = i[has]
            rank = np.full(len(row), _NONE, np.int64)
            rank[has] = self._rank(merged[has], flat_ids[(at + k)[has]])
            put(row, i, np.where(rank == _NONE, _NONE, rank * wide + i))
            h = flat_before[at + i]
            has = h >= 0
            if has.any():
                rows, h = row[has], h[has]
                rank = self._rank(flat_ids[rows * wide + h], merged[has])
                put(rows, h, np.where(rank == _NONE, _NONE, rank * wide + h))
            row = row[flat_tree[row * (2 * wide) + 1] != _NONE]
        flat = ids[alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _merge_long(self, raw: bytes) -> bytes:
        """Ids of one long word: the same tree in plain lists, which cost less a step for a single row."""
        if not self.rank_of:
            self.rank_of = dict(zip(self.pairs.tolist(), self.pair_rank.tolist()))
        n, wide, none, rank_of, made = len(raw), 1 << (len(raw) - 1).bit_length(), int(_NONE), self.rank_of, self.made
        first = self.inner[np.frombuffer(raw, np.uint8)]
        first[-1] = self.final[raw[-1]]
        rank = self._rank(first[:-1], first[1:])
        level = np.full(wide, _NONE, np.int64)
        level[: n - 1] = np.where(rank == _NONE, _NONE, rank * wide + np.arange(n - 1))
        levels = [level]
        while len(level) > 1:
            level = np.minimum(level[::2], level[1::2])
            levels.append(level)
        tree = [none, *np.concatenate(levels[::-1]).tolist()]
        ids, after, before = first.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        while (best := tree[1]) != none:
            i = best % wide
            merged = int(made[best // wide])
            j, h = after[i], before[i]
            k = after[j]
            ids[i], ids[j], after[i] = merged, -1, k
            changed = [(j, none)]
            if k < n:
                before[k] = i
                rank = rank_of.get(merged << 32 | ids[k])
                changed.append((i, none if rank is None else rank * wide + i))
            else:
                changed.append((i, none))
            if h >= 0:
                rank = rank_of.get(ids[h] << 32 | merged)
                changed.append((h, none if rank is None else rank * wide + h))
            for leaf, value in changed:
                node = leaf + wide
                tree[node] = value
                while node > 1:
                    other = tree[node ^ 1]
                    if other < value:
                        value = other
                    node >>= 1
                    if tree[node] == value:
                        break
                    tree[node] = value
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def learn(self, words: Iterable[str]) -> None:
        """Put the ids of new words into the table."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            by_width.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((w, raw))
        for wide, some in by_width.items():
            step = max(1, 250_000 // wide)
            for a in range(0, len(some), step):
                part = some[a : a + step]
                raws = [raw for _, raw in part]
                for (w, _), ids in zip(part, self._merge_rows(raws, wide) if wide <= _WIDEST else map(self._merge_long, raws)):
                    self.known[w] = ids
                    self.held += len(w) + len(ids) + _OVERHEAD

    def forget(self) -> None:
        """Drop the later part of a table that has outgrown its bytes; words met first are the common ones."""
        if self.held <= _KEPT_BYTES:
            return
        kept, self.held = {}, 0
        for w, ids in self.known.items():
            self.held += len(w) + len(ids) + _OVERHEAD
            if self.held > _KEPT_BYTES // 2:
                break
            kept[w] = ids
        self.known = kept

    # -- texts ------------------------------------------------------------------------------

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit bytes."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            chars, end = 0, at
            while end < len(texts) and (end == at or chars < _SLICE):
                chars += len(texts[end] or "")
                end += 1
            self.forget()
            get, read, new = self.known.get, [], set()
            for text in texts[at:end]:
                parts = self.special_re.split(text) if text and self.special_re is not None and "<|" in text else [text or ""]
                for x in parts:
                    if x in self.special_ids:
                        read.append(([self.special_ids[x]], ()))
                        continue
                    words = self.words(x)
                    found = list(map(get, words))
                    # Each word is looked up once; those that the table lacks are filled in below.
                    lacking, i = [], -1
                    try:
                        while True:
                            i = found.index(None, i + 1)
                            lacking.append((i, words[i]))
                    except ValueError:
                        pass
                    new.update(w for _, w in lacking)
                    read.append((found, lacking))
                read.append(None)
            self.learn(new)
            known, ids = self.known, []
            for item in read:
                if item is None:
                    out.append(b"".join(ids))
                    ids = []
                    continue
                found, lacking = item
                for i, w in lacking:
                    found[i] = known[w]
                ids.append(b"".join(found))
            at = end
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of ids joined by one space, as the library does for a file without decoder."""
        return " ".join([self.tokens[i] for i in ids.tolist() if 0 <= i < len(self.tokens) and self.tokens[i]])


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """The tokenizer of a file, once for each process."""
    return WordBpe(path)


def _listed(raw: list[bytes]) -> pa.ListArray:
    """Arrow lists of ids from their little-endian bytes."""
    ends = np.cumsum([0, *map(len, raw)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32)))


def encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with the token ids of each whole text as array<int>."""
    slim = without(docs, out_col).withColumn(text_col, quoted(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in slices(batches):
            raw = bpe.encode(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, _listed(raw)], [*batch.schema.names, out_col])

    return slim.mapInArrow(run, with_fields(slim, (out_col, "array<int>")))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with the text of each array of ids; unknown ids give nothing, as in the library."""
    slim = without(rows, out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in slices(batches):
            lists = batch.column(batch.schema.get_field_index(ids_col))
            texts = [bpe.decode(np.asarray(x.values)) if x.is_valid else "" for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out_col])

    return slim.mapInArrow(run, with_fields(slim, (out_col, "string")))


def round_trip(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """docs without the text, with its ids and what these decode to, in one pass through one worker."""
    slim = without(docs, ids_col, out_col).withColumn(text_col, quoted(text_col).cast("string"))
    rest = [c for c in slim.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in slices(batches):
            raw = bpe.encode(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
            texts = [bpe.decode(np.frombuffer(ids, "<u4")) for ids in raw]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), _listed(raw), pa.array(texts, pa.string())], [*rest, ids_col, out_col])

    return slim.mapInArrow(run, with_fields(slim.select(*map(quoted, rest)), (ids_col, "array<int>"), (out_col, "string")))
