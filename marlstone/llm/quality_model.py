"""Quality classifier: histogram gradient-boosted trees over statistics of whole documents.

Statistics come from the bytes, words and lines of a text. Training bins each statistic into
quantiles, grows trees of fixed depth level by level from histograms of gradients and hessians of
the logistic loss, and is done in numpy on the driver over a bounded sample of labelled documents
(``per_class``), weighted so that the mix of classes is that of all labelled ones. The trees are complete and flattened into arrays (feature, threshold, leaf), so
scoring a block of documents is ``depth`` rounds of numpy indexing for all trees at once.

Null text: the empty text, which is scored like any other. Repeated rows are each scored. No
labels of one class: the score is the share of label 1 (one half without any). An empty table
gives an empty table. Extra columns are carried; those named as the output are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marlstone.llm.shared import quoted, slices, with_fields, without

# Frequent function words of English, French, German and Spanish.
_STOPS = frozenset("the of and to in is that it for on with as be by le la les de des et un une que der die das und von den mit zu el los las y del se con para".split())


def statistics(text: str | None) -> list[float]:
    """The statistics of one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    words = text.split()
    n, chars, size = len(words), len(text), max(1, len(raw))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = np.fromiter(map(len, words), float, n) if n else np.zeros(1)
    share = seen[seen > 0] / size
    upper, lower, digits = seen[65:91].sum(), seen[97:123].sum(), seen[48:58].sum()
    of = lambda marks: sum(seen[ord(c)] for c in marks)
    pairs = len(set(zip(words, words[1:])))
    return [
        math.log1p(chars),
        math.log1p(n),
        lengths.mean(),
        lengths.std(),
        lengths.max(),
        of("#*$%&") / max(1, n),
        of("|") / max(1, n),
        of("<>{}[]\\=_~^`") / max(1, n),
        of("!?") / max(1, n),
        of(".,;:") / max(1, n),
        upper / max(1.0, upper + lower),
        digits / size,
        seen[128:].sum() / size,
        len(counts) / max(1, n),
        max(counts.values(), default=0) / max(1, n),
        1 - pairs / max(1, n - 1),
        sum(c for w, c in counts.items() if w.lower() in _STOPS) / max(1, n),
        math.log1p(len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        chars / max(1, len(lines)),
        -(share * np.log2(share)).sum() if len(raw) else 0.0,
        sum(a == b for a, b in zip(words, words[1:])) / max(1, n - 1),
    ]


def _matrix(texts: list[str | None]) -> np.ndarray:
    """Statistics of texts, a row each."""
    return np.array([statistics(t) for t in texts], float).reshape(len(texts), _WIDTH)


_WIDTH = len(statistics(""))


@dataclass
class Forest:
    """Complete trees of one depth, flattened: inner nodes in heap order, then leaves."""

    feature: np.ndarray  # (trees, 2**depth - 1) int32
    threshold: np.ndarray  # (trees, 2**depth - 1) float64: go right if above
    leaf: np.ndarray  # (trees, 2**depth) float64
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of statistics."""
        trees, inner = self.feature.shape
        node = np.zeros((len(x), trees), np.int64)
        row, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        for _ in range(inner.bit_length()):
            right = x[row, self.feature[tree, node]] > self.threshold[tree, node]
            node = 2 * node + 1 + right
        total = self.base + self.leaf[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 1.0, weight: np.ndarray | None = None) -> Forest:
    """Boost ``trees`` trees on statistics x and labels y (0 or 1); weights are scaled to a mean of 1."""
    inner = 2**depth - 1
    weight = np.ones(len(y)) if weight is None or not len(y) else weight / weight.mean()
    positive = ((weight * y).sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    base = math.log(positive / (1 - positive))
    forest = Forest(np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), base)
    if len(y) == 0 or y.min() == y.max():
        return forest
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    logit, features = np.full(len(y), base), x.shape[1]
    column = np.arange(features) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (features * bins) + column + binned).ravel()
            gs = np.bincount(at, np.repeat(g, features), width * features * bins).reshape(width, features, bins)
            hs = np.bincount(at, np.repeat(h, features), width * features * bins).reshape(width, features, bins)
            gl, hl = gs.cumsum(axis=2), hs.cumsum(axis=2)
            ga, ha = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
            gain[(hl < least) | (ha - hl < least)] = -np.inf
            for f, e in enumerate(edges):
                gain[:, f, len(e) :] = -np.inf
            best = gain.reshape(width, -1).argmax(axis=1)
            split = np.take_along_axis(gain.reshape(width, -1), best[:, None], 1)[:, 0] > 1e-9
            cut = np.zeros(width, np.int64)
            for k in np.flatnonzero(split):
                f, b = divmod(int(best[k]), bins)
                forest.feature[t, first + k], forest.threshold[t, first + k], cut[k] = f, edges[f][b], b
            here = node - first
            right = split[here] & (binned[np.arange(len(y)), forest.feature[t, node]] > cut[here])
            node = 2 * node + 1 + right
        sums = np.bincount(node - inner, g, inner + 1), np.bincount(node - inner, h, inner + 1)
        forest.leaf[t] = -rate * sums[0] / (sums[1] + ridge)
        logit += forest.leaf[t][node - inner]
    return forest


def train(examples: list[tuple[str, int]], weights: dict[int, float] | None = None) -> Forest:
    """A forest from (text, label) pairs, each standing for ``weights`` documents of its class."""
    x = _matrix([t for t, _ in examples])
    weight = np.array([(weights or {}).get(y, 1.0) for _, y in examples], float)
    return fit(x, np.array([y for _, y in examples], float), weight=weight)


def scored(docs: DataFrame, forest: Forest, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with each whole text's probability of label 1."""
    slim = without(docs, out_col).withColumn(text_col, quoted(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index(text_col))
            x = _matrix([t.as_py() for t in texts])
            p = np.concatenate([forest.score(x[a : a + 1000]) for a in range(0, len(x), 1000)]) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, out_col])

    return slim.mapInArrow(run, with_fields(slim, (out_col, "double")))
