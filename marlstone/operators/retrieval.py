"""Retrieval: BM25, rank fusion, local re-ranking, diverse selection and document coverage.

Ranking is relational. A chunk keeps only the tokens that some query asks and is shuffled once, thin,
by its key; terms meet the queries' weights, which are counted and broadcast, so no common term
is a join key, and a chunk's scores are summed where it lies. Top-k uses ranks that Spark limits before
its shuffle.

``documents`` shuffles chunks once, as words, into one row a document, which any number of retrievals read.
``retrieve`` counts its terms there, then scores, ranks, re-ranks and chooses inside a document in one call, and
only the few chunks chosen there meet in the question's group for the last choice. Its tables are compressed
columns, written for one step and deleted after it.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.settling import Tables, settled, written
from marlstone.functions.text import CHINESE, OPTION_NUMBER, Preset, normal_numbers, plain_tokens, tokens

K1, B, RRF_K = 1.2, 0.3, 60
REDUNDANCY, TABLE_BONUS = 0.35, 0.08
#: Terms that are written into an expression, and weights (about 60 bytes each) that are broadcast, at most.
_MOST_TERMS, _MOST_WEIGHTS = 20_000, 500_000
#: Questions, and chosen chunks (at most about 1 KB each), that are broadcast, at most.
_MOST_ROWS = 50_000
#: A run of an option number's characters: such a number stands in a text if it does in one of these.
_NUMBER_RUN = r"[\d.%]+"
#: Counts that a task holds before it hands them on.
_MOST_COUNTS = 200_000


def corpus_statistics(chunks: DataFrame, scope: str, toks: str = "toks") -> DataFrame:
    """(scope, n, avgdl): chunks and mean token count of each corpus."""
    return chunks.groupBy(scope).agg(F.count("*").alias("n"), F.avg(F.size(toks)).alias("avgdl"))


def document_frequencies(chunks: DataFrame, scope: str, key: list[str], toks: str = "toks") -> DataFrame:
    """(scope, term, df): chunks of each corpus that hold a term."""
    return chunks.select(scope, *key, F.explode(F.array_distinct(toks)).alias("term")).groupBy(scope, "term").agg(F.count("*").alias("df"))


def _kept(toks: str, terms: DataFrame):
    """The tokens that are among terms; all of them where terms are too many for one expression."""
    words = [r["term"] for r in terms.limit(_MOST_TERMS + 1).collect()]
    return F.filter(toks, lambda t: t.isin(words)) if len(words) <= _MOST_TERMS else F.col(toks)


def bm25(chunks: DataFrame, queries: DataFrame, scope: str, key: list[str], query: list[str], toks: str = "toks") -> DataFrame:
    """(scope, key..., query..., score) of chunks that share a term with a query of their corpus.

    chunks: scope, key, tokens. queries: scope, query, tokens (repeats count once).
    """
    asked = settled(queries.select(scope, *query, F.explode(F.array_distinct(toks)).alias("term")))
    held = _kept(toks, asked.select("term").distinct())
    rows = written(chunks.select(scope, *key, F.size(toks).alias("dl"), held.alias("held")))
    df = rows.select(scope, F.explode(F.array_distinct("held")).alias("term")).groupBy(scope, "term").agg(F.count("*").alias("df"))
    stats = rows.groupBy(scope).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = settled(asked.join(df, [scope, "term"]).join(stats, scope).select(scope, *query, "term", "avgdl", idf.alias("idf")))
    if weights.count() <= _MOST_WEIGHTS:
        weights = F.broadcast(weights)
    # Terms, parts and sums of a chunk stay in its partition: every grouping below contains its key.
    near = rows.repartition(scope, *key).select(scope, *key, "dl", F.explode("held").alias("term"))
    tf = near.groupBy(scope, *key, "dl", "term").agg(F.count("*").alias("tf"))
    length = 1 - B + B * F.col("dl") / F.greatest(F.lit(1.0), F.col("avgdl"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * length)
    return tf.join(weights, [scope, "term"]).groupBy(scope, *key, *query).agg(F.sum(part).alias("score"))


def ranked(df: DataFrame, by: list[str], order: list, limit: int, rank: str = "rank") -> DataFrame:
    """The first ``limit`` rows of each group, numbered from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= limit)


def search(docs: DataFrame, queries: DataFrame, doc_key: str, query_key: str, k: int = 10, preset: Preset = CHINESE) -> DataFrame:
    """(query, doc, score, rank): top-k of every query over one corpus (columns key and text)."""
    chunks = docs.select(F.lit(0).alias("scope"), doc_key, tokens(F.lower("text"), preset).alias("toks"))
    asked = queries.select(F.lit(0).alias("scope"), query_key, tokens(F.lower("text"), preset).alias("toks"))
    scores = bm25(chunks, asked, "scope", [doc_key], [query_key]).withColumn("score", F.round("score", 6))
    return ranked(scores, [query_key], [F.desc("score"), doc_key], k).select(query_key, doc_key, "score", "rank")


def fused(ranks: DataFrame, by: list[str], rank: str = "rank") -> DataFrame:
    """Reciprocal rank fusion over the rank lists of a group's rows."""
    return ranks.groupBy(*by).agg(F.sum(1 / (RRF_K + F.col(rank))).alias("fused"))


def query_variants(questions: DataFrame) -> DataFrame:
    """(qid, variant, query): the question, and the question with each option, raw and normalised."""
    raw = F.concat(F.array("question"), F.transform(F.map_values("options"), lambda o: F.concat(F.col("question"), F.lit(" "), o)))
    both = F.flatten(F.transform(raw, lambda q: F.array_distinct(F.array(q, normal_numbers(q)))))
    return questions.select("qid", F.posexplode(both).alias("variant", "query"))


def _few(df: DataFrame) -> DataFrame:
    """df, for a broadcast where it is small enough."""
    return F.broadcast(df) if df.count() <= _MOST_ROWS else df


def local_score(chunk: dict, wanted: dict) -> float:
    """+3 for each option number in the text, +0.5 for each shared term, +2 for a table where they matter."""
    hits = sum(any(n in run for run in chunk["runs"]) for n in wanted["option_numbers"])
    shared = sum(t in chunk["terms"] for t in wanted["option_terms"])
    table = chunk["is_table"] and wanted["domain"] in ("financial_reports", "insurance")
    return hits * 3.0 + shared * 0.5 + (2.0 if table else 0.0)


def candidates(chunks: list[dict], scores: list[dict], wanted: dict, pool: int = 20) -> list[dict]:
    """A document's chunks worth choosing from, best first: the fused top ``pool``, re-ranked.

    chunks: chunk_id, terms, runs, is_table. scores: chunk_id, variant, score of chunks that share a term with
    a variant; the others score 0 and still rank, after those. wanted: variants (their number), domain,
    option_numbers, option_terms.
    """
    by = {(s["variant"], s["chunk_id"]): s["score"] for s in scores}
    ids, fused_ = sorted({c["chunk_id"] for c in chunks}), Counter()
    for v in range(wanted["variants"]):
        for rank, c in enumerate(sorted(ids, key=lambda c: (-by.get((v, c), 0.0), c))[:pool], 1):
            fused_[c] += 1 / (RRF_K + rank)
    pooled = sorted(fused_, key=lambda c: (-round(fused_[c], 12), c))[:pool]
    rank = {c: i for i, c in enumerate(pooled)}
    some = [dict(c, fused=fused_[c["chunk_id"]], local=local_score(c, wanted)) for c in chunks if c["chunk_id"] in rank]
    return sorted(some, key=lambda x: (-x["local"], rank[x["chunk_id"]]))


def _overlap(a: set, b: set) -> float:
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def diverse(items: list[dict], score: str, limit: int, cap: int) -> list[dict]:
    """Greedy choice of up to ``limit`` items: score less redundancy, tables favoured, ``cap`` a region.

    Items come in order of preference for ties. An item's redundancy is its greatest overlap with
    what has been chosen, so it is kept up to date instead of being computed anew.
    """
    left = [dict(x, seen=0.0) for x in items]
    chosen, used = [], Counter()
    while left and len(chosen) < limit:
        open_ = [x for x in left if used[x["doc_id"], x["region"]] < cap]
        if not open_:
            break
        best = max(open_, key=lambda x: x[score] - REDUNDANCY * x["seen"] + (TABLE_BONUS if x["is_table"] else 0.0))
        left = [x for x in left if x is not best]
        chosen.append(best)
        used[best["doc_id"], best["region"]] += 1
        for x in left:
            x["seen"] = max(x["seen"], _overlap(x["terms"], best["terms"]))
    return chosen


def covered(chosen: list[dict], items: list[dict], score: str, doc_ids: list[str], limit: int) -> list[dict]:
    """chosen with the best item of every document that has none.

    Documents without an item fill free places first, in order. The others replace spare items: those
    that leave their document another one, from the least score up.
    """
    held = Counter(x["doc_id"] for x in chosen)
    best: dict[str, dict] = {}
    for x in items:
        if not held[x["doc_id"]] and (x["doc_id"] not in best or x[score] > best[x["doc_id"]][score]):
            best[x["doc_id"]] = x
    fills = [best[d] for d in doc_ids if d in best]
    spare = []
    for at in sorted(range(len(chosen)), key=lambda i: chosen[i][score]):
        if held[chosen[at]["doc_id"]] > 1:
            held[chosen[at]["doc_id"]] -= 1
            spare.append(at)
    free = max(0, limit - len(chosen))
    out = chosen + fills[:free]
    for at, x in zip(spare, fills[free:]):
        out[at] = x
    return out[:limit]


def inside(items: list[dict], n_docs: int, top_k: int) -> list[dict]:
    """A diverse choice inside one of a question's documents, items in order of preference."""
    return diverse(items, "fused", max(4, top_k // max(1, n_docs) + 2), 2)


def final(some: list[dict], doc_ids: list[str], top_k: int) -> list[dict]:
    """A diverse choice across documents from an ordered one, all documents covered."""
    some = [dict(x, final=1.0 / (i + 1)) for i, x in enumerate(some)]
    return covered(diverse(some, "final", top_k, 1), some, "final", list(dict.fromkeys(doc_ids)), top_k)


_CHOSEN = "position int, qid string, doc_id string, chunk_id int, text string, is_table boolean, section string, region string, score double"


_SOME = "qid string, doc_at int, at int, doc_id string, chunk_id int, is_table boolean, region string, terms string"


def documents(chunks: DataFrame, questions: DataFrame, preset: Preset = CHINESE) -> DataFrame:
    """One row for each document that a question names: who names it, and its chunks as lists, words instead of texts."""
    names = questions.select("qid", F.size("doc_ids").alias("n_docs"), F.posexplode(F.array_distinct("doc_ids")).alias("doc_at", "doc_id"))
    names = names.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("qid").alias("of"), "n_docs", "doc_at")).alias("names"))
    told = chunks.select("doc_id", "chunk_id", "is_table", "region", normal_numbers(F.col("text")).alias("plain"))
    words = F.array_join(plain_tokens(F.col("plain"), preset), "\n").alias("words")
    runs = F.array_join(F.array_distinct(F.regexp_extract_all("plain", F.lit(_NUMBER_RUN), F.lit(0))), "\n").alias("runs")
    told = told.select("doc_id", F.struct("chunk_id", "is_table", "region", words, runs).alias("c")).groupBy("doc_id").agg(F.collect_list("c").alias("c"))
    return told.join(names.hint("merge"), "doc_id").select("doc_id", "names", "c.chunk_id", "c.is_table", "c.region", "c.words", "c.runs")


def _split(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def _named(read: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
    """Documents once for each name that ``of`` has a row of, with that row."""
    return read.select("doc_id", F.explode("names").alias("name"), *columns).select("doc_id", "name.*", *columns).join(_few(of), "of")


def _counted(read: DataFrame, terms: DataFrame) -> DataFrame:
    """(of, term, chunks, words): chunks that hold a term of terms (of, terms); without a term, all and their words."""
    kind = pa.schema([("of", pa.string()), ("term", pa.string()), ("chunks", pa.int64()), ("words", pa.int64())])

    def rows(held: dict, totals: dict) -> pa.RecordBatch:
        some = [{"of": of, "term": t, "chunks": n, "words": 0} for of, counts in held.items() for t, n in counts.items()]
        return pa.RecordBatch.from_pylist(some + [{"of": of, "term": None, "chunks": n, "words": w} for of, (n, w) in totals.items()], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, totals, asked = defaultdict(Counter), defaultdict(lambda: [0, 0]), lru_cache(1000)(lambda x: frozenset(_split(x)))
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                for d in batch.slice(start, 200).to_pylist():
                    for words in map(_split, d["words"]):
                        held[d["of"]].update(asked(d["terms"]).intersection(words))
                        totals[d["of"]][0] += 1
                        totals[d["of"]][1] += len(words)
                if sum(map(len, held.values())) > _MOST_COUNTS:
                    yield rows(held, totals)
                    held.clear()
                    totals.clear()
        yield rows(held, totals)

    found = _named(read, terms, "words").select("of", "words", "terms").mapInArrow(run, "of string, term string, chunks long, words long")
    return found.groupBy("of", "term").agg(F.sum("chunks").alias("chunks"), F.sum("words").alias("words"))


def _wanted(read: DataFrame, questions: DataFrame, preset: Preset) -> DataFrame:
    """(of, wanted): what each question of a name's asks, as JSON, with its terms' weights in that name's documents."""
    variants = query_variants(questions)
    asked = settled(variants.select("qid", "variant", F.explode(F.array_distinct(tokens(F.col("query"), preset))).alias("term")))
    of = questions.select("qid", "of")
    terms = asked.join(of, "qid").groupBy("of").agg(F.array_join(F.collect_set("term"), "\n").alias("terms"))
    # A name whose questions have no terms still has documents to count.
    counts = settled(_counted(read, settled(of.select("of").distinct().join(terms, "of", "left"))))
    totals = counts.where("term is null").select("of", F.col("chunks").alias("n"), (F.col("words") / F.col("chunks")).alias("avgdl"))
    idf = F.log(1 + (F.col("n") - F.col("chunks") + 0.5) / (F.col("chunks") + 0.5))
    weights = asked.groupBy("qid", "term").agg(F.collect_list("variant").alias("variants")).join(of, "qid").join(counts.where("term is not null"), ["of", "term"]).join(totals, "of")
    weights = weights.groupBy("qid").agg(F.collect_list(F.struct("term", idf.alias("idf"), "variants")).alias("weights"))
    options = normal_numbers(F.array_join(F.map_values("options"), " "))
    rows = questions.select(
        "qid",
        "of",
        "domain",
        F.array_distinct(F.filter(F.regexp_extract_all(options, F.lit(f"({OPTION_NUMBER})"), F.lit(1)), lambda n: F.length(n) >= 2)).alias("option_numbers"),
        F.array_distinct(F.filter(tokens(options, preset), lambda t: F.length(t) >= 2)).alias("option_terms"),
    ).join(variants.groupBy("qid").agg(F.count("*").cast("int").alias("variants")), "qid").join(totals, "of").join(weights, "qid", "left")
    wanted = F.to_json(F.struct("qid", "domain", "option_numbers", "option_terms", "variants", "avgdl", "weights"))
    return settled(rows.select("of", wanted.alias("wanted")).groupBy("of").agg(F.collect_list("wanted").alias("wanted")))


def scores(chunks: list[dict], wanted: dict) -> list[dict]:
    """BM25 scores (chunk_id, variant, score) of a document's chunks (chunk_id, counts, length) that share a term with a variant."""
    out = []
    for c in chunks:
        by: Counter = Counter()
        norm = K1 * (1 - B + B * c["length"] / max(1.0, wanted["avgdl"]))
        for w in wanted["weights"]:
            if tf := c["counts"].get(w["term"]):
                part = w["idf"] * tf * (K1 + 1) / (tf + norm)
                for v in w["variants"]:
                    by[v] += part
        out += [{"chunk_id": c["chunk_id"], "variant": v, "score": round(s, 9)} for v, s in by.items()]
    return out


def _chosen_inside(rows: DataFrame, top_k: int, pool: int) -> DataFrame:
    """(qid, doc_at, at, doc_id, chunk_id, is_table, region, terms): the choice inside each document, in order."""
    kind = pa.schema([("qid", pa.string()), ("doc_at", pa.int32()), ("at", pa.int32()), ("doc_id", pa.string()), ("chunk_id", pa.int32()), ("is_table", pa.bool_()), ("region", pa.string()), ("terms", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lru_cache(1000)(lambda x: {"domain": None, "option_numbers": [], "option_terms": [], "weights": []} | json.loads(x))
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                rows = []
                for d in batch.slice(start, 200).to_pylist():
                    chunks = []
                    for i, is_table, region, words, runs in zip(d["chunk_id"], d["is_table"], d["region"], map(_split, d["words"]), map(_split, d["runs"])):
                        counts = dict(Counter(words))
                        chunks.append({"doc_id": d["doc_id"], "chunk_id": i, "is_table": is_table, "region": region, "runs": runs, "counts": counts, "length": len(words), "terms": set(counts)})
                    for wanted in map(read, d["wanted"]):
                        some = inside(candidates(chunks, scores(chunks, wanted), wanted, pool), d["n_docs"], top_k)
                        rows += [{"qid": wanted["qid"], "doc_at": d["doc_at"], "at": i, "doc_id": x["doc_id"], "chunk_id": x["chunk_id"], "is_table": x["is_table"], "region": x["region"], "terms": "\n".join(x["counts"])} for i, x in enumerate(some)]
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return rows.mapInArrow(run, _SOME)


def retrieve(chunks: DataFrame, questions: DataFrame, top_k: int = 8, pool: int = 20, preset: Preset = CHINESE, rerank: Callable[[DataFrame], DataFrame] | None = None, read: DataFrame | None = None) -> DataFrame:
    """(qid, position, doc_id, chunk_id, text, is_table, section, region, score) of each question.

    A document's candidates are at most ``pool`` of its chunks; a question's group holds what was chosen
    inside each of its documents (four chunks, or more for questions of few documents), without
    texts, which join the chosen ones. Chunks are read twice, so they should be a stored table.
    ``read`` is a stored table of ``documents`` of these chunks; questions then have a column ``of``, the
    question there whose documents are theirs.
    ``rerank`` may order the balanced choice anew before the
    final one: it gets (qid, place, question, text) of questions with more than ``top_k`` chunks,
    texts of 600 characters at most, and returns (qid, place, rank); what it leaves out comes last.
    """
    tables = Tables()
    if read is None:
        read, questions = tables.write(documents(chunks, questions, preset)), questions.withColumn("of", F.col("qid"))
    named = _named(read, _wanted(read, questions, preset), "chunk_id", "is_table", "region", "words", "runs")
    some = tables.write(_chosen_inside(named, top_k, pool))
    tables.clear(but=some)
    order = ["doc_at", "at"]
    if rerank is not None:
        some = some.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(*order)) - 1)
        many = some.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") > top_k).select("qid")
        shown = some.join(many, "qid").join(questions.select("qid", "question"), "qid").join(chunks.select("doc_id", "chunk_id", "text"), ["doc_id", "chunk_id"])
        ranks = rerank(shown.select("qid", "place", "question", F.substring("text", 1, 600).alias("text")))
        some, order = some.join(ranks.select("qid", "place", "rank"), ["qid", "place"], "left"), ["rank", "place"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        doc_ids = list(pdf.sort_values("doc_at")["doc_id"].unique())
        pdf = pdf.sort_values(order, na_position="last")
        names = ["qid", "doc_id", "chunk_id", "is_table", "region"]
        items = [dict(zip(names, x[:-1]), terms=set(filter(None, (x[-1] or "").split("\n")))) for x in zip(*(pdf[c] for c in names), pdf["terms"])]
        rows = [(i, x["qid"], x["doc_id"], x["chunk_id"], x["final"]) for i, x in enumerate(final(items, doc_ids, top_k))]
        return pd.DataFrame(rows, columns=["position", "qid", "doc_id", "chunk_id", "score"])

    chosen = settled(some.groupBy("qid").applyInPandas(run, "position int, qid string, doc_id string, chunk_id int, score double"))
    tables.clear()
    told = chunks.select("doc_id", "chunk_id", "text", "is_table", "section", "region")
    rows = told.join(_few(chosen), ["doc_id", "chunk_id"]).select(*[c.split()[0] for c in _CHOSEN.split(", ")])
    return rows.repartition("qid").sortWithinPartitions("qid", "position")


def rerank_by_vectors(candidates_: DataFrame, vectors: DataFrame, query: str, key: str, limit: int) -> DataFrame:
    """Candidate pairs (query, key) re-ranked by the cosine of their vectors (key, vector array).

    Only pairs that are candidates are compared. A pair without a vector keeps its place at the
    end; ties go by key.
    """
    of = lambda name: vectors.select(F.col("key").alias(name), F.col("vector").alias(f"{name}_vector"))
    pairs = candidates_.join(of(query), query, "left").join(of(key), key, "left")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    a, b = F.col(f"{query}_vector"), F.col(f"{key}_vector")
    cosine = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    scored = pairs.select(query, key, F.round(cosine, 6).alias("cosine"))
    return ranked(scored, [query], [F.desc_nulls_last("cosine"), key], limit)
