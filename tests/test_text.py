import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions.text import LATIN, STOP_TOKENS
from marlstone.operators import answering, chunking, retrieval


def test_related_sentences_stay_together():
    groups = chunking.semantic_groups("2024年营业收入增长。净利润同比增长。资产负债率下降。监管机构发布新规。", threshold=0.2)
    assert any("营业收入" in g and "净利润" in g for g in groups) and "监管机构" in "".join(groups)
    assert chunking.semantic_groups("甲段。乙段。丙段。", threshold=0.5, similarity=lambda a, b: float(a == "甲段。")) == ["甲段。乙段。", "丙段。"]
    assert len(chunking.semantic_groups("同一句。" * 20)) == 3  # eight sentences a group at most


def test_chunks_of_a_section_share_its_region():
    rows = chunking.chunk_rows("d", "m", "第一节 财务情况\n" + "2024年净利润增长。" * 180, ["a | b\n" * 400])
    prose = [r for r in rows if not r[4]]
    assert len(prose) > 1 and {r[6] for r in prose} == {"第一节 财务情况"} and [r[2] for r in rows] == list(range(len(rows)))
    assert all(r[3].startswith("[表格]\n") and len(r[3]) <= 1010 for r in rows if r[4]) and sum(r[4] for r in rows) > 1


def test_chunked_frame(spark):
    docs = spark.createDataFrame([("a", "x", "One two. Three four.", ["h | k\n1 | 2"]), ("b", "x", None, None)], "doc_id string, domain string, text string, tables array<string>")
    rows = chunking.chunked(docs, LATIN).orderBy("chunk_id").collect()
    assert [(r.doc_id, r.is_table, r.region) for r in rows] == [("a", False, "__preamble__"), ("a", True, "1")]


CHOSEN = "qid string, position int, doc_id string, chunk_id int, section string, region string, is_table boolean, text string"


def _chosen(spark, *texts, table=False):
    return spark.createDataFrame([("q", i, "d", i, "", "r", table, t) for i, t in enumerate(texts)], CHOSEN)


def _asked(spark, **options):
    return spark.createDataFrame([("q", options)], "qid string, options map<string,string>")


def test_option_context_keeps_neighbours_in_budget(spark):
    chosen = _chosen(spark, "这是无关背景。2024年净利润为20亿元。后续还有无关说明。")
    got = answering.option_contexts(chosen, _asked(spark, A="2024年净利润为20亿元", B="x"), 80).collect()
    got = {r.option: r.context for r in got}
    assert "净利润" in got["A"] and "无关背景" in got["A"] and len(got["A"]) <= 80 and got["B"] == ""


def test_option_context_against_a_plain_walk(spark):
    rng = np.random.default_rng(3)
    words = [2 * c for c in "abcdefghijkl"]
    texts = [". ".join(" ".join(rng.choice(words, 4)) for _ in range(5)) + "." for _ in range(4)]
    option = " ".join(words[1:5])
    lines = []
    for i, t in enumerate(texts):
        parts = [x.strip() + "." for x in t.split(".") if x.strip()]
        for at, p in enumerate(parts):
            score = len(set(p[:-1].split()) & set(option.split()))
            if score:
                lines.append((-score, i, at, f"[d||rr] {''.join(parts[max(0, at - 1):at + 2])}"))
    for budget in (30, 100, 1000):
        want, left = [], budget
        for *_, line in sorted(lines):
            if left <= len("[d||rr] "):
                break
            want.append(line[:left])
            left -= len(want[-1])
        got = answering.option_contexts(_chosen(spark, *texts), _asked(spark, A=option), budget, LATIN).first().context
        assert got == "\n".join(want)


def test_context_is_cut_between_units(spark):
    prose = answering.contexts(_chosen(spark, "条件是资产负债率超过70%。因此必须提交股东大会审议。"), 60).first().context
    assert prose.endswith("。") and len(prose) <= 60
    assert "2023 | 10" in answering.contexts(_chosen(spark, "年份 | 净利润\n2023 | 10\n2024 | 20", table=True), 70).first().context


def test_context_against_a_plain_walk(spark):
    texts = ["One two three. Four five. Six.", "A much longer sentence stands here. Short one.", "Tail. End."]
    for budget in (20, 60, 90, 120, 400):
        want, left = [], budget
        for i, t in enumerate(texts):
            header = f"【来源: d #chunk{i} 章节:{answering.NO_SECTION} 区域:r】\n"
            if left - len(header) <= 0:
                break
            body = ""
            for unit in [x.strip() + "." for x in t.split(".") if x.strip()]:
                if len(body) + len(unit) > left - len(header):
                    break
                body += unit
            if body:
                want.append(header + body)
                left -= len(header) + len(body)
        assert answering.contexts(_chosen(spark, *texts), budget, LATIN).first().context == "\n\n".join(want)


def test_evidence(spark):
    chunk = "净利润为20亿元，营业收入同比增长。"
    asked = spark.createDataFrame([("q", {"A": "净利润20亿元", "B": "资产负债率66.15%", "C": "净利润和营业收入增长"})], "qid string, options map<string,string>")
    said = spark.createDataFrame([("q", chunk)], "qid string, text string")
    got = {r.option: r for r in answering.option_evidence(said, asked).collect()}
    assert got["A"].has_evidence and got["C"].has_evidence and not got["B"].has_evidence
    vague = spark.createDataFrame([("q", {"A": "公司相关情况中的净利润20亿元"})], "qid string, options map<string,string>")
    other = spark.createDataFrame([("q", "公司情况和相关信息说明。")], "qid string, text string")
    assert not answering.option_evidence(other, vague).first().has_evidence
    shares = answering.allocate([got["A"].strength, got["B"].strength], 700)
    assert sum(shares) == 700 and min(shares) >= 160 and shares[1] > shares[0]


@pytest.mark.parametrize("strengths, total", [([0.1, 0.9, 0.5], 1000), ([0, 0, 0, 0], 333), ([1, 1], 7), ([0.3], 50)])
def test_budgets_agree_and_sum(spark, strengths, total):
    plain = answering.allocate(strengths, total)
    df = spark.createDataFrame([("q", i, float(s)) for i, s in enumerate(strengths)], "qid string, option_at int, strength double")
    got = [r.budget for r in answering.budgets(df, total).orderBy("option_at").collect()]
    assert got == plain and sum(plain) == total


def test_question_budget_grows_and_is_capped(spark):
    rows = [("s", "research", "问", {"A": "甲"}, "mcq", ["d"]), ("c", "financial_reports", "1 和 2.5 与 3%", {"A": "4 5. 6% x 7"}, "multi", ["d", "e", "f"])]
    df = spark.createDataFrame(rows, "qid string, domain string, question string, options map<string,string>, answer_format string, doc_ids array<string>")
    got = {r.qid: (r.top_k, r.shared_chars, r.option_chars) for r in answering.question_budget(df).collect()}
    assert got["s"] == (10, 5600, 1000) and all(a > b for a, b in zip(got["c"], got["s"])) and got["c"] <= (16, 9000, 1800)


def test_bm25_golden(spark):
    docs = spark.createDataFrame([(0, list("aba")), (1, list("bc")), (2, list("cdef"))], "d long, toks array<string>").withColumn("s", F.lit(0))
    asked = spark.createDataFrame([(0, list("ab")), (1, ["c"])], "q long, toks array<string>").withColumn("s", F.lit(0))
    got = {(r.q, r.d): r.score for r in retrieval.bm25(docs, asked, "s", ["d"], ["q"]).collect()}
    assert got == pytest.approx({(0, 0): 1.818644, (0, 1): 0.497119, (1, 1): 0.497119, (1, 2): 0.445693}, abs=1e-6)
    ranks = spark.createDataFrame([(1, 1), (1, 2)], "d long, rank int")
    assert retrieval.fused(ranks, ["d"]).first().fused == pytest.approx(1 / 61 + 1 / 62)


def _slow_diverse(items, score, limit, cap):
    left, chosen, used = list(items), [], {}
    while left and len(chosen) < limit:
        best, value = None, -math.inf
        for x in left:
            if used.get((x["doc_id"], x["region"]), 0) >= cap:
                continue
            like = max((len(x["terms"] & y["terms"]) / min(len(x["terms"]), len(y["terms"])) if x["terms"] and y["terms"] else 0.0 for y in chosen), default=0.0)
            v = x[score] - 0.35 * like + (0.08 if x["is_table"] else 0)
            if v > value:
                best, value = x, v
        if best is None:
            break
        left.remove(best)
        chosen.append(best)
        used[best["doc_id"], best["region"]] = used.get((best["doc_id"], best["region"]), 0) + 1
    return chosen


def test_diverse_selection_against_plain_code():
    rng = np.random.default_rng(8)
    for _ in range(40):
        items = [{"doc_id": str(rng.integers(0, 3)), "chunk_id": i, "region": int(rng.integers(0, 3)), "is_table": bool(rng.integers(0, 2)), "terms": set(rng.choice(12, int(rng.integers(0, 6))).tolist()), "f": float(rng.random())} for i in range(12)]
        limit, cap = int(rng.integers(1, 9)), int(rng.integers(1, 3))
        assert [x["chunk_id"] for x in retrieval.diverse(items, "f", limit, cap)] == [x["chunk_id"] for x in _slow_diverse(items, "f", limit, cap)]


def _slow_covered(chosen, items, score, doc_ids, limit):
    out = list(chosen)
    for d in doc_ids:
        some = [x for x in items if x["doc_id"] == d and x not in out]
        if any(x["doc_id"] == d for x in out) or not some:
            continue
        new = max(some, key=lambda x: x[score])
        if len(out) < limit:
            out.append(new)
            continue
        docs = [x["doc_id"] for x in out]
        spare = [i for i, x in enumerate(out) if docs.count(x["doc_id"]) > 1]
        if spare:
            out[min(spare, key=lambda i: out[i][score])] = new
    return out[:limit]


def test_coverage_against_plain_code():
    rng = np.random.default_rng(4)
    for _ in range(200):
        items = [{"doc_id": str(rng.integers(0, 6)), "chunk_id": i, "f": float(rng.random())} for i in range(14)]
        limit = int(rng.integers(1, 8))
        chosen = items[: int(rng.integers(0, limit + 1))]
        ids = [str(i) for i in range(6)]
        assert retrieval.covered(chosen, items, "f", ids, limit) == _slow_covered(chosen, items, "f", ids, limit)


def test_every_document_is_covered():
    items = [{"doc_id": d, "chunk_id": i, "f": f} for i, (d, f) in enumerate([("a", 0.9), ("a", 0.8), ("a", 0.7), ("b", 0.2), ("c", 0.1)])]
    got = retrieval.covered(items[:3], items, "f", ["a", "b", "c"], 3)
    assert {x["doc_id"] for x in got} == {"a", "b", "c"} and len(got) == 3 and got[0]["chunk_id"] == 0


def test_retrieve_end_to_end(spark):
    rng = np.random.default_rng(10)
    vocab = [f"term{i}" for i in range(40)]
    chunks = spark.createDataFrame([(f"d{d}", "research", c, " ".join(rng.choice(vocab, 30)), False, "", f"r{c % 3}", "prose", 1) for d in range(3) for c in range(9)], chunking.CHUNK_SCHEMA)
    asked = spark.createDataFrame([("q1", "research", "term1 term2", {"A": "term3", "B": "term4 term5"}, "multi", ["d0", "d1", "d2"])], "qid string, domain string, question string, options map<string,string>, answer_format string, doc_ids array<string>")
    rows = retrieval.retrieve(chunks, asked, 8, 20, LATIN).collect()
    assert {r.doc_id for r in rows} == {"d0", "d1", "d2"} and len({(r.doc_id, r.chunk_id) for r in rows}) == len(rows) <= 8
    assert max(sum(1 for r in rows if (r.doc_id, r.region) == k) for k in {(r.doc_id, r.region) for r in rows}) == 1
    backwards = retrieval.retrieve(chunks, asked, 8, 20, LATIN, rerank=lambda some: some.select("qid", "place", (-F.col("place")).alias("rank"))).collect()
    assert {r.doc_id for r in backwards} == {"d0", "d1", "d2"} and backwards[0].doc_id == "d2" and rows[0].doc_id == "d0"
    context = answering.contexts(retrieval.retrieve(chunks, asked, 8, 20, LATIN), 500, LATIN).first().context
    assert context and len(context) <= 500 + 2 * 8
    replies = spark.createDataFrame([("q1", "A: 成立\nB: 不成立", "multi"), ("q2", None, "mcq"), ("q3", "没有", "mcq")], "qid string, reply string, answer_format string")
    assert {r.qid: (r.answer, r.status) for r in answering.parsed_answers(replies).collect()} == {"q1": ("A", "ok"), "q2": ("", "failed"), "q3": ("", "empty")}


def test_narrow_evidence_adds_chunks_for_options_without_any(spark):
    texts = ["alpha beta filler words here", "gamma delta other words there", "epsilon zeta more words again", "gamma epsilon zeta delta everything"]
    chunks = spark.createDataFrame([("d", "research", i, t, False, "", f"r{i}", "prose", len(t)) for i, t in enumerate(texts)], chunking.CHUNK_SCHEMA)
    asked = spark.createDataFrame([("q", "research", "what", {"A": "alpha beta", "B": "gamma delta", "C": "epsilon zeta"}, "multi", ["d"])], "qid string, domain string, question string, options map<string,string>, answer_format string, doc_ids array<string>")
    chosen = spark.createDataFrame([(0, "q", "d", 0, texts[0], False, "", "r0", 1.0)], retrieval._CHOSEN)
    got = answering.narrow_evidence(chunks, asked, chosen, 1, 24, LATIN).orderBy("position").collect()
    # B brings the chunk that also speaks to C, or C brings its own; nothing comes twice.
    ids = [r.chunk_id for r in got]
    assert ids[0] == 0 and len(set(ids)) == len(ids) and [r.position for r in got] == list(range(len(got)))
    said = answering.option_evidence(spark.createDataFrame([("q", r.text) for r in got], "qid string, text string"), asked, LATIN).collect()
    assert all(r.has_evidence for r in said)
    full = answering.narrow_evidence(chunks, asked, spark.createDataFrame([(i, "q", "d", i, t, False, "", f"r{i}", 1.0) for i, t in enumerate(texts)], retrieval._CHOSEN), 1, 24, LATIN)
    assert full.count() == 4


def test_models_are_asked_with_retries(spark):
    def chat(prompt):
        if "fail" in prompt:
            raise TimeoutError
        return prompt.upper(), len(prompt), 2

    rows = spark.createDataFrame([("a", "one"), ("b", "fail"), ("c", "two")], "qid string, prompt string")
    got = {r.qid: (r.reply, r.total_tokens) for r in answering.asked(rows, chat, attempts=2, pause=0.0, backoff=0.0).collect()}
    assert got == {"a": ("ONE", 5), "b": (None, 0), "c": ("TWO", 5)}


def test_query_variants(spark):
    rows = spark.createDataFrame([("q", "what 1,000", {"A": "x", "B": "百分之十"})], "qid string, question string, options map<string,string>")
    got = [r.query for r in retrieval.query_variants(rows).orderBy("variant").collect()]
    assert got == ["what 1,000", "what 1000", "what 1,000 x", "what 1000 x", "what 1,000 百分之十", "what 1000 10%"]


def test_table_text():
    assert chunking.table_text([["a", None], ["", None], ["value one", "value two"]]) == "a | \nvalue one | value two"
    assert chunking.table_text([["a", "b"]]) == ""


def _plain_tokens(text):
    import regex

    text = regex.sub(r"(?<=[0-9])[,，](?=[0-9])", "", text)
    text = regex.sub(r"(?<=[0-9])\s+(?=[0-9万亿元%])", "", text)
    return text, [t for t in regex.findall(LATIN.token, text) if t not in STOP_TOKENS]

def _plain_choice(parts, question, top_k=8, pool=20):
    """A question's chunks by plain loops: BM25 of every variant, fusion, local order, diverse choices, coverage."""
    options = [question["options"][k] for k in "ABCD"]
    raw = [question["question"], *(f"{question['question']} {o}" for o in options)]
    queries = [v for r in raw for v in dict.fromkeys([r, _plain_tokens(r)[0]])]
    own = [dict(c, toks=_plain_tokens(c["text"])[1], plain=_plain_tokens(c["text"])[0]) for d in question["doc_ids"] for c in parts.get(d, [])]
    n, mean = len(own), sum(len(c["toks"]) for c in own) / max(1, len(own))
    df = {}
    for c in own:
        for t in set(c["toks"]):
            df[t] = df.get(t, 0) + 1

    def score(query, c):
        total = 0.0
        for t in set(_plain_tokens(query)[1]):
            tf = c["toks"].count(t)
            if tf:
                total += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.7 + 0.3 * len(c["toks"]) / max(1.0, mean)))
        return round(total, 9)

    numbers, terms = set(), set()
    import regex

    plain, toks = _plain_tokens(" ".join(options))
    numbers = {x for x in regex.findall(r"\d[\d.%]*", plain) if len(x) >= 2}
    terms = {t for t in toks if len(t) >= 2}
    balanced = []
    for d in question["doc_ids"]:
        mine = [c for c in own if c["doc_id"] == d]
        fused = {}
        for q in queries:
            for rank, c in enumerate(sorted(mine, key=lambda c: (-score(q, c), c["chunk_id"]))[:pool], 1):
                fused[c["chunk_id"]] = fused.get(c["chunk_id"], 0.0) + 1 / (60 + rank)
        best = sorted((c for c in mine if c["chunk_id"] in fused), key=lambda c: (-round(fused[c["chunk_id"]], 12), c["chunk_id"]))[:pool]
        local = lambda c: 3.0 * sum(x in c["plain"] for x in numbers) + 0.5 * len(terms & set(c["toks"])) + (2.0 if c["is_table"] and question["domain"] == "financial_reports" else 0.0)
        best = sorted(best, key=lambda c: -local(c))
        items = [dict(c, terms=set(c["toks"]), f=fused[c["chunk_id"]]) for c in best]
        balanced += _slow_diverse(items, "f", max(4, top_k // max(1, len(question["doc_ids"])) + 2), 2)
    balanced = [dict(c, f=1.0 / (i + 1)) for i, c in enumerate(balanced)]
    return [(c["doc_id"], c["chunk_id"]) for c in _slow_covered(_slow_diverse(balanced, "f", top_k, 1), balanced, "f", question["doc_ids"], top_k)]


def test_balanced_retrieval_query_against_plain_code(spark, sf):
    from marlstone.plans import documents, registry

    asked = [r.asDict() for r in documents.questions(spark, sf).collect()]
    parts = {}
    for r in documents.chunks(spark, sf).orderBy("doc_id", "chunk_id").collect():
        parts.setdefault(r.doc_id, []).append(r.asDict())
    got = {}
    for r in registry.queries()["balanced_retrieval"](spark, sf).orderBy("qid", "position").collect():
        got.setdefault(r.qid, []).append((r.doc_id, r.chunk_id))
    for q in asked:
        assert got.get(q["qid"], []) == _plain_choice(parts, q), q["qid"]


def test_retrieve_doesnt_carry_a_questions_documents_with_each_chunk(spark):
    ids = [f"document-{d}" for d in range(1500)]
    chunks = spark.createDataFrame([(d, "research", 0, f"term{i % 7} word{i} more words", False, "", "r", "prose", 1) for i, d in enumerate(ids)], chunking.CHUNK_SCHEMA)
    asked = spark.createDataFrame([("q", "research", "term1 term2", {"A": "term3"}, "multi", ids)], "qid string, domain string, question string, options map<string,string>, answer_format string, doc_ids array<string>")
    context = spark.sparkContext._jsc.sc()

    def shuffled() -> int:
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = shuffled()
    assert retrieval.retrieve(chunks, asked, 8, 20, LATIN).count() == 8
    assert shuffled() - before < 500 * len(ids)


def test_narrow_evidence_doesnt_carry_a_questions_documents_with_each_chunk(spark):
    ids = [f"document-{d}" for d in range(1500)]
    chunks = spark.createDataFrame([(d, "research", 0, f"term{i % 7} word{i} more words", False, "", "r", "prose", 1) for i, d in enumerate(ids)], chunking.CHUNK_SCHEMA)
    asked = spark.createDataFrame([("q", "research", "what", {"A": "term1 word8"}, "multi", ids)], "qid string, domain string, question string, options map<string,string>, answer_format string, doc_ids array<string>")
    chosen = spark.createDataFrame([(0, "q", "document-0", 0, "term0 word0 more words", False, "", "r", 1.0)], retrieval._CHOSEN)
    context = spark.sparkContext._jsc.sc()

    def shuffled() -> int:
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = shuffled()
    got = {r.doc_id for r in answering.narrow_evidence(chunks, asked, chosen, 2, 24, LATIN).collect()}
    assert "document-0" in got and len(got) == 2
    assert shuffled() - before < 700 * len(ids)


def test_narrow_evidence_shuffles_a_documents_words_once_for_all_options(spark):
    words = [f"w{i:03d}x" for i in range(400)]
    said = [(f"d{d:03d}", c, " ".join(words[(d * 7 + c * 31 + i * (c + 1)) % 400] for i in range(120))) for d in range(300) for c in range(4)]
    chunks = spark.createDataFrame([(d, "research", c, t, False, "", f"r{c}", "prose", len(t)) for d, c, t in said], chunking.CHUNK_SCHEMA)
    options = {k: " ".join(words[i * 100 : i * 100 + 100]) for i, k in enumerate("ABCD")}
    asked = spark.createDataFrame([("q", "research", "what", options, "multi", sorted({d for d, _, _ in said}))], "qid string, domain string, question string, options map<string,string>, answer_format string, doc_ids array<string>")
    chosen = spark.createDataFrame([(0, "q", "d000", 9, "nothing", False, "", "r", 1.0)], retrieval._CHOSEN)
    context = spark.sparkContext._jsc.sc()

    def shuffled() -> int:
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = shuffled()
    got = [(r.doc_id, r.chunk_id) for r in answering.narrow_evidence(chunks, asked, chosen, 2, 24, LATIN).collect()]
    moved = shuffled() - before
    assert moved < 2 * sum(len(t) for _, _, t in said), moved
    read = retrieval.documents(chunks, asked, LATIN).localCheckpoint()
    assert [(r.doc_id, r.chunk_id) for r in answering.narrow_evidence(chunks, asked, chosen, 2, 24, LATIN, read).collect()] == got


def test_scores_inside_a_document_are_those_of_bm25(spark):
    texts = [("d", 0, ["a", "b", "a", "c"]), ("d", 1, ["b"]), ("e", 0, ["x", "y"]), ("e", 1, ["a", "c", "c", "c"])]
    rows = spark.createDataFrame([("q", *t) for t in texts], "scope string, doc_id string, chunk_id int, toks array<string>")
    queries = spark.createDataFrame([("q", 0, ["a", "b", "a"]), ("q", 1, ["c", "z"])], "scope string, variant int, toks array<string>")
    want = {(r.doc_id, r.chunk_id, r.variant): round(r.score, 9) for r in retrieval.bm25(rows, queries, "scope", ["doc_id", "chunk_id"], ["variant"]).collect()}
    plain = spark.createDataFrame([(d, c, False, "", " ".join(t)) for d, c, t in texts], "doc_id string, chunk_id int, is_table boolean, region string, text string")
    asked = spark.createDataFrame([("q", "q", "research", "a b a", {"A": "c z"}, ["d", "e"])], "qid string, of string, domain string, question string, options map<string,string>, doc_ids array<string>")
    read = retrieval.documents(plain, asked, LATIN)
    wanted = json.loads(retrieval._wanted(read, asked, LATIN).first().wanted[0])
    got = {}
    for r in read.collect():
        chunks = [{"chunk_id": i, "counts": Counter(w.split("\n")), "length": len(w.split("\n"))} for i, w in zip(r.chunk_id, r.words)]
        got |= {(r.doc_id, s["chunk_id"], s["variant"]): s["score"] for s in retrieval.scores(chunks, wanted)}
    # The second variant is the question with its option, so it asks all three terms.
    assert {k: v for k, v in got.items() if k[2] == 0} == {k: v for k, v in want.items() if k[2] == 0}
    both = {k[:2]: v for k, v in got.items() if k[2] == 1}
    assert len(both) == 3 and both == pytest.approx({k: want.get((*k, 0), 0) + want.get((*k, 1), 0) for k in both}, abs=1e-8)
