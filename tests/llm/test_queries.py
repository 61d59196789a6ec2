"""The registered queries: oracles, contracts, and the pipeline against plain code."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from marlstone.llm import queries, quality_rules

LIBRARY = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))


@pytest.fixture(scope="module")
def docs(sf):
    return pd.read_parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):  # what these oracles read
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = c.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
    as_set = lambda d: Counter(map(tuple, d.astype(str).values.tolist()))
    assert as_set(got) == as_set(want)


def test_op1(spark, sf, docs):
    got = queries.op1_sharding(spark, sf).toPandas().set_index("doc_id").sort_index()
    own = docs.set_index("doc_id").sort_index()
    assert list(got["size"]) == [len(t.encode()) + 1 for t in own["text"]]
    assert list(got["text_crc32"]) == [zlib.crc32(t.encode()) for t in own["text"]]
    counts = got.groupby("shard")["slot"].agg(["count", "max", "nunique"])
    assert len(counts) == 8 and (counts["count"] == counts["max"] + 1).all() and (counts["count"] == counts["nunique"]).all()
    assert counts["count"].max() - counts["count"].min() <= 1 and set(got["law"]) == {"rows"}


def test_op2_and_op4(spark, sf, docs):
    two = queries.op2_bpe(spark, sf).toPandas().set_index("doc_id")
    four = queries.op4_packing(spark, sf).toPandas()
    by_doc = dict(list(four.groupby("doc_id")))
    for d, t in zip(docs["doc_id"], docs["text"]):
        ids = LIBRARY.encode(t, add_special_tokens=False).ids
        row = two.loc[d]
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        ids.append(2)
        at = 0
        for p in by_doc[d].sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    assert (four["offset"] + four["length"]).max() <= 4096


@pytest.mark.parametrize("query, folds, held, cut", [(queries.op3_quality, 4, 2, 0.7), (queries.op6_toxicity, 5, 0, 0.5)])
def test_classifiers_follow_their_contract(spark, sf, docs, query, folds, held, cut):
    got = query(spark, sf).toPandas()
    assert sorted(got["doc_id"]) == sorted(docs["doc_id"])
    assert list(got["held_out"]) == [zlib.crc32(str(d).encode()) % folds == held for d in got["doc_id"]]
    assert got["score"].between(0, 1).all() and list(got["predicted"]) == [int(s >= cut) for s in got["score"]]


def test_op3_against_a_walk_through_its_trees(spark, sf, docs):
    from marlstone.llm import quality_model

    forest = queries.quality_forest(spark, sf)
    got = queries.op3_quality(spark, sf).toPandas().set_index("doc_id")["score"]
    for d, t in zip(docs["doc_id"], docs["text"]):
        row, total = quality_model.statistics(t), forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        assert got[d] == pytest.approx(1 / (1 + np.exp(-total)))


def test_op6_against_naive_kernels(spark, sf, docs):
    from tests.llm.test_operators import naive_scores

    machine = queries.toxicity_machine(spark, sf)
    got = queries.op6_toxicity(spark, sf).toPandas().set_index("doc_id")["score"]
    want = naive_scores(machine, list(docs["text"]))
    assert np.allclose(got.loc[docs["doc_id"]].to_numpy(), want, atol=5e-3)


def test_op10_folds_drafts_edits_and_regenerations(spark, sf):
    said = spark.read.parquet(f"{sf}/conversations.parquet")
    kinds = {r.kind: r["count"] for r in queries.chat_events(said).groupBy("kind").count().collect()}
    assert kinds["delta"] > kinds["edit"] > 0 and kinds["regenerate"] > 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    q = queries.op3_quality(spark, sf).toPandas().merge(labels, on="doc_id")
    q = q[q["held_out"]]
    assert (q["predicted"] == q["quality"]).mean() > 0.95
    t = queries.op6_toxicity(spark, sf).toPandas().merge(labels, on="doc_id")
    t = t[t["held_out"]]
    assert (t["predicted"] == t["toxic"]).mean() > 0.93


def test_op5_and_op8_return_every_document(spark, sf, docs):
    for query in (queries.op5_licenses, queries.op8_spotsigs):
        assert sorted(r.doc_id for r in query(spark, sf).select("doc_id").collect()) == sorted(docs["doc_id"])


def test_pipeline_against_plain_code(spark, sf, docs):
    """Rules by SQL, toxicity by naive kernels, near copies by all pairs, tokens by the library."""
    from marlstone.llm import labelled, toxicity
    from tests.llm.test_operators import naive_scores

    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    kept = set(c.sql(queries.ORACLE_SQL["op7_quality_rules"]).df().query("kept")["doc_id"])
    left = docs[docs["doc_id"].isin(kept)]
    table = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("doc_id").isin([int(d) for d in kept]))
    examples, weights = labelled.weighted(table, spark.read.parquet(f"{sf}/labels.parquet"), "toxic", F.lit(True), queries.SAMPLE, chars=queries.SAMPLE_CHARS)
    scores = naive_scores(toxicity.train(examples, weights=weights), list(left["text"]))
    unsure = set(left["doc_id"][np.abs(scores - 0.5) < 0.01])
    left = left[scores < 0.5]
    words = [t.translate(str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})).split() for t in left["text"]]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    ids, root = list(left["doc_id"]), {}
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                old, new = root.get(ids[i], ids[i]), root.get(ids[j], ids[j])
                root = {**{d: d for d in ids}, **root}
                root = {d: min(old, new) if r in (old, new) else r for d, r in root.items()}
    want = {d: len(LIBRARY.encode(t, add_special_tokens=False).ids) + 1 for d, t in zip(left["doc_id"], left["text"]) if root.get(d, d) == d}
    got = corpus_pipeline.run(spark, sf).toPandas()
    tokens = dict(zip(got["doc_id"], got["doc_tokens"]))
    assert {d: n for d, n in tokens.items() if d not in unsure} == {d: n for d, n in want.items() if d not in unsure}
    assert got["length"].sum() == sum(tokens.values()) and (got.groupby("sequence_id")["length"].sum().sort_index()[:-1] == 4096).all()


def test_pipeline_stages_work_on_what_is_kept(spark, sf, tmp_path):
    table, before = spark.read.parquet(f"{sf}/documents.parquet"), None
    columns = table.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, table, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        before, table = table, spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert table.columns == columns
            assert table.join(before, "doc_id", "left_anti").count() == 0
        if name == "quality rules":
            kept = quality_rules.judged(before).where("kept").count()
            assert table.count() == kept < before.count()
    assert sorted(r.doc_id for r in table.select("doc_id").distinct().collect()) == sorted(r.doc_id for r in before.select("doc_id").collect())
    whole = corpus_pipeline.run(spark, sf).select("doc_id", "start", "length", "ids_crc32").collect()
    key = lambda rows: Counter((r.doc_id, r.start == 0 and r.doc_id) for r in rows if r.start == 0)
    assert key(whole) == key(table.collect())


def test_pipeline_stages_on_awkward_tables(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "the of and " * 40, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as score", "2 as fp", "'x' as kept", "3 as row")
    for table in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, sf)
            assert out.columns == table.columns and out.count() <= table.count()
        assert corpus_pipeline.STAGES[-1][1](spark, table, sf).count() == table.count()
