"""The pipeline's near-dedup stage against all pairs of five-word shingle sets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import neardup


@pytest.mark.parametrize("small", [32, 3])
def test_near_dedup_stage_against_all_pairs(spark, sf, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL", small)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(900)]
    texts = [" ".join(rng.choice(words, 150)) for _ in range(40)]
    for i in range(40):  # edited copies on both sides of the threshold, and a dense group of them
        for edits in (1, 2, 3, 5) if i else [1, 2, 2, 3, 3, 4] * 8:
            own = texts[i].split()
            for at in rng.choice(150, edits, replace=False):
                own[at] = f"new{int(rng.integers(0, 10**6))}"
            texts.append(" ".join(own))
    texts += ["short text", texts[3]]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    root = list(range(len(texts)))

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))
    left = corpus_pipeline.by_near_duplicates(spark, docs, sf)
    assert sorted(r.doc_id for r in left.collect()) == sorted({find(d) for d in range(len(texts))})


def test_near_dedup_stage_links_what_simhash_finds(spark, sf, monkeypatch):
    sketched = neardup._sketched
    monkeypatch.setattr(neardup, "_sketched", lambda rows: sketched(rows).withColumn("bands", F.array().cast("array<bigint>")))
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(900)]
    texts = [" ".join(rng.choice(words, 600)) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts + [texts[2] + " end"])), "doc_id long, text string")
    left = corpus_pipeline.by_near_duplicates(spark, docs, sf)
    assert sorted(r.doc_id for r in left.collect()) == [0, 1, 2, 3, 4]
