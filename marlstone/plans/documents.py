"""Queries of the text and retrieval family and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import sequences, text
from marlstone.functions.numeric import minute_of_day, number, plain_date
from marlstone.functions.text import LATIN
from marlstone.operators import answering, chunking, daily, evaluation, retrieval, submission
from marlstone.operators.settling import Tables
from marlstone.plans.fixtures import settled, table
from marlstone.plans.registry import query
from marlstone.sources import sinks, ticks

_TRIM = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _digest(c) -> F.Column:
    return F.md5(c.cast("binary"))


@query("text_clean", f"with c as (select doc_id, {_TRIM.format(x=chr(10).join(['regexp_replace(regexp_replace(text,', chr(39) + '[ \\t]+' + chr(39) + ', ', chr(39) + ' ' + chr(39) + ', ', chr(39) + 'g' + chr(39) + '), ', chr(39) + '\\n{3,}' + chr(39) + ', chr(10) || chr(10), ', chr(39) + 'g' + chr(39) + ')']))} as t from documents) select doc_id, length(t)::bigint as n_chars, md5(t) as digest from c")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text.clean(F.col("text")).alias("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("n_chars"), _digest(F.col("t")).alias("digest"))


@query("sentences", f"with s as (select doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]?'), lambda x: {_TRIM.format(x='x')}), lambda x: x <> '') as s from documents) select doc_id, len(s)::bigint as n_sentences, md5(array_to_string(s, '|')) as digest from s")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text.sentences(F.col("text"), LATIN).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), _digest(F.array_join("s", "|")).alias("digest"))


def _plain_sql(x: str) -> str:
    for _ in range(2):
        x = f"regexp_replace({x}, '([0-9])[,，]([0-9])', '\\1\\2', 'g')"
    for _ in range(2):
        x = f"regexp_replace({x}, '([0-9])\\s+([0-9万亿元%])', '\\1\\2', 'g')"
    return x


def _tokens_sql(x: str) -> str:
    stops = ", ".join("'" + t + "'" for t in text.STOP_TOKENS)
    return f"list_filter(regexp_extract_all({_plain_sql(x)}, '[\\p{{L}}0-9%]+'), lambda t: t not in ({stops}))"


@query("tokens", f"with t as (select doc_id, {_tokens_sql('lower(text)')} as t from documents) select doc_id, len(t)::bigint as n_tokens, len(list_distinct(t))::bigint as n_terms, md5(array_to_string(t, ' ')) as digest from t")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.lower("text"), LATIN).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"), _digest(F.array_join("t", " ")).alias("digest"))


@query("normal_numbers", f"select doc_id, md5({_plain_sql('text')}) as digest, len(regexp_extract_all({_plain_sql('text')}, '[0-9][0-9.]*%?'))::bigint as n_numbers from documents")
def normal_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", _digest(text.normal_numbers(F.col("text"))).alias("digest"), F.size(text.numbers(F.col("text"))).cast("long").alias("n_numbers"))


@query("headings", r"""with p as (select doc_id, unnest(string_split(text, chr(10))) as p from documents)
select doc_id, count(*) filter (length(trim(p)) between 1 and 100 and regexp_matches(trim(p), '^(?:[0-9]{1,2}(?:\.[0-9]+)*[、.]|[A-Z][、.])'))::bigint as n_headings from p group by doc_id""")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("p"))
    return lines.groupBy("doc_id").agg(F.sum(text.is_heading(F.col("p")).cast("long")).alias("n_headings"))


def _html_sql() -> str:
    x = "html"
    for tag in ("script", "style", "nav", "header", "footer"):
        x = f"regexp_replace({x}, '(?is)<{tag}\\b.*?</{tag}\\s*>', chr(10), 'g')"
    x = f"regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', chr(10), 'g'), '(?s)<[^>]*>', chr(10), 'g')"
    for name, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{mark}')"
    return _TRIM.format(x=f"regexp_replace({x}, '[ \\t]*\\n\\s*', chr(10), 'g')")


@query("html_text", f"with t as (select page_id, {_html_sql()} as t from pages) select page_id, length(t)::bigint as n_chars, md5(t) as digest from t")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html")).alias("t"))
    return rows.select("page_id", F.length("t").cast("long").alias("n_chars"), _digest(F.col("t")).alias("digest"))


# -- BM25 and fusion: benchmark items ask the documents, alone and with the item that follows -----

BM25_SQL = f"""d as (select doc_id, {_tokens_sql('lower(text)')} as t from documents),
q as (select item_id, 0 as variant, list_distinct({_tokens_sql('lower(text)')}) as t from benchmark
      union all select item_id, 1, list_distinct({_tokens_sql("lower(text || ' ' || next)")}) from (select a.item_id, a.text, coalesce(b.text, '') as next from benchmark a left join benchmark b on b.item_id = a.item_id + 1)),
st as (select count(*) as n, avg(len(t)) as avgdl from d),
a as (select item_id, variant, unnest(t) as term from q),
h as (select doc_id, len(t) as dl, unnest(t) as term from d),
tf as (select doc_id, dl, term, count(*) as tf from h where term in (select term from a) group by all),
df as (select term, count(*) as df from tf group by term),
sc as (select item_id, variant, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.7 + 0.3 * dl / greatest(1, avgdl)))), 6) as score
       from a join tf using (term) join df using (term), st group by all),
rk as (select *, row_number() over (partition by item_id, variant order by score desc, doc_id) as rank from sc)"""


@query("bm25_top10", f"with {BM25_SQL} select item_id, doc_id, score, rank::int as rank from rk where variant = 0 and rank <= 10")
def bm25_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", 10, LATIN)


@query("rank_fusion", f"""with {BM25_SQL}, f as (select item_id, doc_id, sum(1.0::double / (60 + rank)) as fused from rk where rank <= 20 group by all),
o as (select item_id, doc_id, round(fused, 9) as fused, row_number() over (partition by item_id order by round(fused, 9) desc, doc_id) as place from f)
select item_id, doc_id, fused, place::int as place from o where place <= 10""")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = settled(table(spark, sf_dir, "documents").select(F.lit(0).alias("scope"), "doc_id", text.tokens(F.lower("text"), LATIN).alias("toks")))
    items = table(spark, sf_dir, "benchmark")
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next"))
    items = items.join(after, "item_id", "left").select("item_id", F.posexplode(F.array("text", F.concat_ws(" ", "text", F.coalesce("next", F.lit(""))))).alias("variant", "text"))
    asked = items.select(F.lit(0).alias("scope"), "item_id", "variant", text.tokens(F.lower("text"), LATIN).alias("toks"))
    scores = retrieval.bm25(chunks, asked, "scope", ["doc_id"], ["item_id", "variant"]).withColumn("score", F.round("score", 6))
    lists = retrieval.ranked(scores, ["item_id", "variant"], [F.desc("score"), "doc_id"], 20)
    both = retrieval.fused(lists, ["item_id", "doc_id"]).withColumn("fused", F.round("fused", 9))
    return retrieval.ranked(both, ["item_id"], [F.desc("fused"), "doc_id"], 10, "place")


@query("term_statistics", f"""with {BM25_SQL.split('sc as')[0].rstrip().rstrip(',')} select term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as idf from df, st where term in (select term from a where variant = 0)""")
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").select(F.lit(0).alias("scope"), "doc_id", text.tokens(F.lower("text"), LATIN).alias("toks"))
    asked = table(spark, sf_dir, "benchmark").select(F.explode(text.tokens(F.lower("text"), LATIN)).alias("term")).distinct()
    df = retrieval.document_frequencies(chunks, "scope", ["doc_id"]).join(asked, "term", "left_semi")
    return df.join(retrieval.corpus_statistics(chunks, "scope"), "scope").select("term", "df", F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


# -- questions: every document is a candidate of one of them -------------------------------------


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions with four options of six words each, documents dealt to them by id."""
    items = table(spark, sf_dir, "benchmark")
    n = items.agg(F.max("item_id") + 1).first()[0]
    ids = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % n).alias("item_id")).agg(F.transform(F.array_sort(F.collect_list("doc_id")), lambda d: d.cast("string")).alias("doc_ids"))
    words = F.split("text", r"\s+")
    option = lambda i: F.array_join(F.slice(words, F.lit(1 + 6 * i), F.lit(6)), " ")
    return items.join(ids, "item_id", "left").select(
        F.col("item_id").cast("string").alias("qid"),
        F.when(F.col("item_id") % 2 == 0, "financial_reports").otherwise("research").alias("domain"),
        F.col("text").alias("question"),
        F.create_map(*[x for i, k in enumerate("ABCD") for x in (F.lit(k), option(i))]).alias("options"),
        F.when(F.col("item_id") % 3 == 0, "multi").otherwise("mcq").alias("answer_format"),
        F.coalesce("doc_ids", F.array().cast("array<string>")).alias("doc_ids"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the documents; runs of piped lines are their tables."""
    lines = F.split("text", "\n")
    piped = F.filter(lines, lambda x: x.contains(" | "))
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.col("source").alias("domain"),
        F.array_join(F.filter(lines, lambda x: ~x.contains(" | ")), "\n").alias("text"),
        F.when(F.size(piped) > 0, F.array(F.array_join(piped, "\n"))).otherwise(F.array().cast("array<string>")).alias("tables"),
    )
    return chunking.chunked(docs, LATIN)


def _chunks_sql(size: int = 1000, overlap: int = 150, least: int = 180, most: int = 8, threshold: float = 0.08) -> str:
    """Lines to sentence groups by windows, then one fold a document over its headings and groups."""
    trim = lambda x: _TRIM.format(x=x)
    mark = chunking._TABLE_MARK.replace("\n", "' || chr(10) || '")
    return rf"""with recursive e as (select doc_id::varchar as doc_id, source as domain, list_filter(string_split(text, chr(10)), lambda x: not contains(x, ' | ')) as prose,
  list_filter(string_split(text, chr(10)), lambda x: contains(x, ' | ')) as piped from documents),
c as (select doc_id, string_split({trim(r"regexp_replace(regexp_replace(array_to_string(prose, chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")}, chr(10)) as ls from e),
l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as li from (select doc_id, list_filter(list_transform(ls, lambda x: {trim('x')}), lambda x: x <> '') as ls from c)),
h as (select *, length(line) <= 100 and regexp_matches(line, '{text.HEADING}') as heading from l),
p as (select doc_id, li, line, list_filter(list_transform(regexp_extract_all(line, '[^.!?]+[.!?]?'), lambda x: {trim('x')}), lambda x: x <> '') as ss from h where not heading),
u as (select doc_id, li, unnest(ss) as s, generate_subscripts(ss, 1) as si from (select doc_id, li, case when len(ss) > 0 then ss else [line] end as ss from p)),
t as (select *, list_distinct(regexp_extract_all(s, '[\p{{L}}0-9%]+')) as ts, list_distinct(regexp_extract_all(s, '[0-9]+(?:\.[0-9]+)?%?')) as ns from u),
w as (select *, lag(ts) over x as tb, lag(ns) over x as nb from t window x as (partition by doc_id, li order by si)),
b as (select *, (tb is null or (case when len(ts) > 0 and len(tb) > 0 then len(list_intersect(ts, tb)) / sqrt(len(ts) * len(tb)) else 0 end < {threshold} and len(list_intersect(ns, nb)) = 0))::int as opens from w),
r as (select *, sum(opens) over (partition by doc_id, li order by si) as run from b),
q as (select *, (row_number() over (partition by doc_id, li, run order by si) - 1) // {most} as part from r),
g as (select doc_id, li, run, part, false as heading, string_agg(s, ' ' order by si) as s from q group by all union all select doc_id, li, 0, 0, true, line from h where heading),
i as (select doc_id, heading, s, row_number() over (partition by doc_id order by li, run, part) as k from g),
f as (select doc_id, 0 as k, '' as section, '' as body, '' as out_section, '' as out from e
  union all select f.doc_id, i.k, case when i.heading then i.s else f.section end,
    case when i.heading then i.s || chr(10) when full_ then case when f.section <> '' then f.section || chr(10) else '' end || right(f.body, {overlap}) || i.s || chr(10) else f.body || i.s || chr(10) end,
    f.section, case when i.heading or full_ then {trim('f.body')} else '' end
  from (select f.*, i.heading as hd, i.s as txt, not i.heading and length(f.body) + length(i.s) + 1 > {size} and length({trim('f.body')}) >= {least} as full_ from f join i on i.doc_id = f.doc_id and i.k = f.k + 1) f
  join i on i.doc_id = f.doc_id and i.k = f.k + 1),
z as (select doc_id, max(k) as k from f group by doc_id),
o as (select doc_id, k, out_section as section, out as body from f where out <> '' union all select f.doc_id, f.k + 1, section, {trim('body')} from f join z using (doc_id, k) where {trim('body')} <> ''),
n as (select doc_id, row_number() over (partition by doc_id order by k) - 1 as chunk_id, section, body from o),
m as (select doc_id, array_to_string(piped, chr(10)) as piped, piped as rows from e where len(piped) > 0),
v as (select doc_id, unnest(rows) as line, generate_subscripts(rows, 1) as k from m where length(piped) > {size} * 1.5),
y as (select doc_id, 0::bigint as k, 0 as part, '' as piece from v where k = 1
  union all select y.doc_id, v.k, part + (length(piece) + length(line) + 1 > {size})::int, case when length(piece) + length(line) + 1 > {size} then '' else piece end || line || chr(10)
  from y join v on v.doc_id = y.doc_id and v.k = y.k + 1),
x as (select doc_id, part, {trim('arg_max(piece, k)')} as piece from y group by doc_id, part union all select doc_id, 0, piped from m where length(piped) <= {size} * 1.5),
j as (select doc_id, piece, (select count(*) from n where n.doc_id = x.doc_id) + row_number() over (partition by doc_id order by part) - 1 as chunk_id from x where piece <> '')
select n.doc_id, domain, chunk_id::int as chunk_id, body as text, false as is_table, section, case when section = '' then '{chunking._PREAMBLE}' else section end as region, 'prose' as chunk_type, length(body)::int as char_count from n join e using (doc_id)
union all select j.doc_id, domain, chunk_id::int, '{mark}' || piece, true, 'table', chunk_id::varchar, 'table', (length(piece) + 5)::int from j join e using (doc_id)"""


@query("chunks", _chunks_sql())
def chunks_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir)


def _asked(spark: SparkSession, sf_dir: str, tables: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Questions, chunks, their documents as retrieval reads them, and the chosen chunks."""
    asked = tables.write(questions(spark, sf_dir))
    parts = tables.write(chunks(spark, sf_dir))
    read = tables.write(retrieval.documents(parts, asked, LATIN))
    return asked, parts, read, settled(retrieval.retrieve(parts, asked.withColumn("of", F.col("qid")), 8, 20, LATIN, read=read))


@query("balanced_retrieval")
def balanced_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables()
    chosen = _asked(spark, sf_dir, tables)[-1]
    tables.clear()
    return chosen.select("qid", "position", "doc_id", "chunk_id", "is_table", "region", F.round("score", 6).alias("score"))


@query("narrow_evidence")
def narrow_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen chunks, with those that single options of multi questions bring."""
    tables = Tables()
    asked, parts, read, chosen = _asked(spark, sf_dir, tables)
    found = answering.narrow_evidence(parts, asked, chosen, 2, 24, LATIN, read).select("qid", "position", "doc_id", "chunk_id")
    tables.clear()
    return found


_N = "(select max(item_id) + 1 from benchmark)"
#: Documents as a question's chunks, by id; sentences as in ``sentences``.
_CHUNKS_SQL = f"""ch as (select (doc_id % {_N})::varchar as qid, row_number() over (partition by doc_id % {_N} order by doc_id) as pos, doc_id, text, lang,
  list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]?'), lambda x: {_TRIM.format(x='x')}), lambda x: x <> '') as u from documents)"""


def _whole(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Questions, and their documents whole as chosen chunks in order of id."""
    asked = questions(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    said = asked.select("qid", F.posexplode("doc_ids").alias("position", "doc_id")).join(docs, "doc_id")
    return asked, said.select("qid", "position", "doc_id", F.lit(0).alias("chunk_id"), "text", F.lit(False).alias("is_table"), F.lit("").alias("section"), F.col("lang").alias("region"))


_CONTEXT_SQL = f"""{_CHUNKS_SQL},
hd as (select *, '【来源: ' || doc_id || ' #chunk0 章节:' || '{answering.NO_SECTION}' || ' 区域:' || coalesce(lang, '?') || '】' || chr(10) as head, list_transform(range(1, len(u) + 1), lambda k: length(array_to_string(u[1:k], ''))) as ends from ch),
fo as (select qid, 0 as pos, {{budget}} as room, true as open, '' as ctx from ch group by qid
  union all select qid, pos, room - used, open and room > length(head) and room > used, case when used > 0 then ctx || case when ctx = '' then '' else chr(10) || chr(10) end || head || array_to_string(u[1:fits], '') else ctx end
  from (select *, case when open and room > length(head) and fits > 0 then length(head) + ends[fits] else 0 end as used
        from (select hd.qid, hd.pos, room, open, ctx, head, u, ends, len(list_filter(ends, lambda e: e <= room - length(head))) as fits from fo join hd on hd.qid = fo.qid and hd.pos = fo.pos + 1))),
cx as (select qid, arg_max(ctx, pos) as ctx from fo group by qid)"""


@query("contexts", f"with recursive {_CONTEXT_SQL.format(budget=5600)} select qid, length(ctx)::bigint as n_chars, md5(ctx) as digest from cx")
def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answering.contexts(_whole(spark, sf_dir)[1], 5600, LATIN)
    return rows.select("qid", F.length("context").cast("long").alias("n_chars"), _digest(F.col("context")).alias("digest"))


def _options_sql() -> str:
    words = "regexp_split_to_array(text, '\\s+')"
    return " union all ".join(f"select item_id::varchar as qid, {i} as option_at, '{k}' as option, array_to_string({words}[{1 + 6 * i}:{6 + 6 * i}], ' ') as o from benchmark" for i, k in enumerate("ABCD"))


def _signature_sql(x: str) -> tuple[str, str]:
    generic = ", ".join(f"'{t}'" for t in text.GENERIC_TERMS)
    return f"list_distinct(list_filter({_tokens_sql(x)}, lambda t: length(t) >= 2 and t not in ({generic})))", f"list_distinct(regexp_extract_all({_plain_sql(x)}, '[0-9][0-9.]*%?'))"


@query("option_contexts", f"""with {_CHUNKS_SQL}, o as ({_options_sql()}), os as (select qid, option, {_signature_sql('o')[0]} as ot, {_signature_sql('o')[1]} as onum from o),
pt as (select qid, pos, doc_id, lang, case when len(u) > 0 then u else [text] end as u from ch),
se as (select qid, pos, doc_id, lang, u, unnest(u) as s, generate_subscripts(u, 1) as at_ from pt),
sg as (select qid, pos, at_, '[' || doc_id || '||r' || coalesce(lang, '?') || '] ' as head, array_to_string(u[greatest(at_ - 1, 1):at_ + 1], '') as body, {_signature_sql('s')[0]} as st, {_signature_sql('s')[1]} as sn from se),
sc as (select qid, option, pos, at_, head, body, round(len(list_intersect(ot, st)) + 2.5 * len(list_intersect(onum, sn)), 6) as score from os join sg using (qid)),
rn as (select *, 1000 - coalesce(sum(length(head) + length(body)) over (partition by qid, option order by score desc, pos, at_ rows between unbounded preceding and 1 preceding), 0) - length(head) as room from sc where score > 0),
tx as (select qid, option, string_agg(head || left(body, room::int), chr(10) order by score desc, pos, at_) as c from rn where room > 0 group by all)
select qid, option, md5(coalesce(c, '')) as digest from os left join tx using (qid, option)""")
def option_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, said = _whole(spark, sf_dir)
    return answering.option_contexts(said, asked, 1000, LATIN).select("qid", "option", _digest(F.col("context")).alias("digest"))


@query("retrieval_quality", f"""with recursive {_CONTEXT_SQL.format(budget=5600)}, o as ({_options_sql()}), os as (select qid, option, {_signature_sql('o')[0]} as ot, {_signature_sql('o')[1]} as onum from o),
hf as (select * from ch where pos % 2 = 1), tt as (select qid, string_agg(text, ' ' order by pos) as text, count(distinct doc_id) as nd from hf group by qid),
ts as (select qid, nd, {_signature_sql('text')[0]} as ct, {_signature_sql('text')[1]} as cn from tt),
oc as (select qid, count(*) as n, coalesce(sum((len(list_intersect(ot, ct)) > 0 or len(list_intersect(onum, cn)) > 0)::int), 0) as hit from os left join ts using (qid) group by qid),
sz as (select qid, sum(length(text)) as chars, count(*) as asked from ch group by qid)
select round(sum(hit) / sum(n), 6) as option_coverage, round(sum(coalesce(nd, 0)) / sum(coalesce(asked, 0)), 6) as doc_coverage, round(sum(coalesce(length(ctx), 0)) / sum(chars), 6) as compression, count(*) as n_questions
from oc left join ts using (qid) left join sz using (qid) left join cx using (qid)""")
def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage where every other document of a question is chosen, and what contexts keep of all."""
    asked, said = _whole(spark, sf_dir)
    return answering.retrieval_quality(said.where("position % 2 = 0"), asked, said, answering.contexts(said, 5600, LATIN), LATIN)


EVIDENCE_SQL = f"""o as ({_options_sql()}),
os as (select qid, option_at, option, {_signature_sql('o')[0]} as ot, {_signature_sql('o')[1]} as onum from o),
ds as (select doc_id, {_signature_sql('text')[0]} as dt, {_signature_sql('text')[1]} as dn from documents),
m as (select qid, option_at, option, len(list_intersect(ot, dt)) as t, len(list_intersect(onum, dn)) as n from os left join ds on doc_id % {_N} = qid::bigint),
e as (select qid, option_at, option, coalesce(bool_or(t >= 2 or (t >= 1 and n >= 1)), false) as has_evidence, coalesce(max(least(1.0, t / 2) * 0.55 + least(1, n) * 0.35), 0.0) as strength from m group by all)"""


def _option_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    chosen = asked.select("qid", F.explode("doc_ids").alias("doc_id")).join(docs, "doc_id")
    return answering.option_evidence(chosen, asked, LATIN)


@query("option_evidence", f"with {EVIDENCE_SQL} select qid, option, has_evidence, round(strength, 6) as strength from e")
def option_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _option_evidence(spark, sf_dir).select("qid", "option", "has_evidence", F.round("strength", 6).alias("strength"))


@query("option_budgets", f"""with {EVIDENCE_SQL}, w as (select *, 2 - strength as w, count(*) over (partition by qid) as n from e),
f as (select *, least(160, 5600 // n) as fl from w), s as (select *, fl + floor((5600 - fl * n) * w / sum(w) over (partition by qid) + 1e-9) as share from f),
g as (select *, 5600 - sum(share) over (partition by qid) as short, row_number() over (partition by qid order by option_at) as at_ from s)
select qid, option, (share + floor(short / n) + (at_ <= short % n)::int)::int as budget from g""")
def option_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answering.budgets(_option_evidence(spark, sf_dir), 5600).select("qid", "option", "budget")


@query("question_budgets", f"""with q as (select item_id, text || ' ' || array_to_string([array_to_string(regexp_split_to_array(text, '\\s+')[1 + 6 * i:6 + 6 * i], ' ') for i in [0, 1, 2, 3]], ' ') as t from benchmark),
c as (select item_id, least(4, greatest(0, trunc((item_id % 3) * 1.5 + len(regexp_extract_all({_plain_sql('t')}, '[0-9][0-9.]*%?')) * 0.35 + case when item_id % 3 = 0 then 1 else 0 end)))::int as bump from q)
select item_id::varchar as qid, least(16, case when item_id % 2 = 0 then 12 else 10 end + bump)::int as top_k, least(9000, case when item_id % 2 = 0 then 6500 else 5600 end + bump * 500)::int as shared_chars,
  least(1800, case when item_id % 2 = 0 then 1200 else 1000 end + bump * 120)::int as option_chars from c""")
def question_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions over one to three documents each."""
    ids = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (F.col("qid").cast("int") % 3 + 1))
    return answering.question_budget(questions(spark, sf_dir).withColumn("doc_ids", ids), LATIN)


# -- answers ------------------------------------------------------------------------------------

_REPLY_SQL = "select conv_id, turn, text || chr(10) || 'Answer: ' || upper(md5(text)) as reply, case when turn % 2 = 0 then 'multi' else 'mcq' end as answer_format from conversations"


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    reply = F.concat("text", F.lit("\nAnswer: "), F.upper(_digest(F.col("text"))))
    return said.select("conv_id", "turn", reply.alias("reply"), F.when(F.col("turn") % 2 == 0, "multi").otherwise("mcq").alias("answer_format"))


@query("answer_letters", f"with r as ({_REPLY_SQL}), l as (select *, regexp_extract_all(right(reply, 32), '[ABCD]') as l from r) select conv_id, turn, array_to_string(list_distinct_ordered, '') as letters from (select conv_id, turn, list_filter(l, lambda x, i: list_position(l, x) = i) as list_distinct_ordered from l)")
def answer_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replies(spark, sf_dir).select("conv_id", "turn", F.array_join(text.answer_letters(F.col("reply")), "").alias("letters"))


@query("normal_answers", f"with r as ({_REPLY_SQL}), l as (select *, regexp_extract_all(upper(reply), '[ABCD]') as l from r) select conv_id, turn, case when answer_format = 'multi' then array_to_string(list_sort(list_distinct(l)), '') else coalesce(l[1], '') end as answer from l")
def normal_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replies(spark, sf_dir).select("conv_id", "turn", submission.normal_answer(F.col("reply"), F.col("answer_format")).alias("answer"))


@query("structured_answers", """select conv_id, turn, case when length(text) % 2 = 1 then 'A' else '' end || case when (length(text) // 2) % 2 = 1 then 'B' else '' end
  || case when (length(text) // 3) % 2 = 1 then 'C' else '' end || case when (length(text) // 4) % 2 = 1 then 'D' else '' end as letters from conversations""")
def structured_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    line = lambda k, i: F.concat(F.lit(f"{k}: "), F.when(F.expr(f"(n div {i + 1}) % 2") == 1, "成立").otherwise("不成立"))
    reply = F.concat_ws("\n", *[line(k, i) for i, k in enumerate("ABCD")])
    return said.select("conv_id", "turn", F.array_join(text.structured_letters(reply), "").alias("letters"))


_SCORES_SQL = """tr as (select item_id::varchar as qid, array_to_string(regexp_extract_all(upper(md5(text)), '[ABCD]'), '') as expected from benchmark),
pr as (select qid, case when qid::int % 4 = 0 then reverse(expected) else left(expected, 1) end as predicted from tr where qid::int % 3 <> 0),
qs as (select item_id::varchar as qid, case when item_id % 2 = 0 then 'financial_reports' else 'research' end as domain, case when item_id % 5 = 0 then 'multi' else 'mcq' end as answer_format from benchmark where item_id % 7 <> 0),
al as (select qid, coalesce(domain, '?') as domain, coalesce(answer_format, 'multi') as answer_format, coalesce(predicted, '') as predicted, expected from tr left join pr using (qid) left join qs using (qid)),
nl as (select *, regexp_extract_all(predicted, '[ABCD]') as p, regexp_extract_all(expected, '[ABCD]') as e from al),
sc as (select qid, domain, answer_format, predicted, expected, case when answer_format = 'multi' then list_sort(list_distinct(p)) = list_sort(list_distinct(e)) else coalesce(p[1], '') = coalesce(e[1], '') end as correct from nl)"""


def _answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to two thirds of the items, and descriptions of six sevenths, against all true answers."""
    items = table(spark, sf_dir, "benchmark").withColumn("qid", F.col("item_id").cast("string"))
    letters = F.array_join(F.regexp_extract_all(F.upper(_digest(F.col("text"))), F.lit("([ABCD])"), F.lit(1)), "")
    truth = items.select("qid", "item_id", letters.alias("answer"))
    said = truth.where("item_id % 3 <> 0").select("qid", F.when(F.col("item_id") % 4 == 0, F.reverse("answer")).otherwise(F.substring("answer", 1, 1)).alias("answer"))
    told = items.where("item_id % 7 <> 0").select("qid", F.when(F.col("item_id") % 2 == 0, "financial_reports").otherwise("research").alias("domain"), F.when(F.col("item_id") % 5 == 0, "multi").otherwise("mcq").alias("answer_format"))
    return evaluation.answer_scores(truth.select("qid", "answer"), said, told)


@query("answer_scores", f"with {_SCORES_SQL} select * from sc")
def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer_scores(spark, sf_dir)


@query("answer_accuracy", f"with {_SCORES_SQL} select domain, answer_format, count(*) as n, sum(correct::int)::bigint as n_correct, round(avg(correct::int), 6) as accuracy from sc group by grouping sets ((), (domain), (answer_format))")
def answer_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.grouped_accuracy(_answer_scores(spark, sf_dir), F.col("correct"), "domain", "answer_format")


@query("first_questions", "select item_id as qid from benchmark order by item_id limit 17")
def first_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    return submission.first_questions(items, 17, "qid")


@query("answer_sheet", """with q as (select conv_id, min(turn) as o from conversations group by 1), a as (select conv_id, length(string_agg(text, '')) as n from conversations where role = 'assistant' group by 1)
select 'summary' as qid, '' as answer, sum(n)::bigint as prompt_tokens, (2 * sum(n))::bigint as completion_tokens, (3 * sum(n))::bigint as total_tokens from a
union all select conv_id::varchar, 'A', n, 2 * n, 3 * n from a""")
def answer_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as answered questions, in the answer file's table."""
    said = table(spark, sf_dir, "conversations")
    asked = said.select(F.col("conv_id").cast("string").alias("qid"), F.col("conv_id").alias("ordinal")).distinct()
    n = F.sum(F.length("text")).cast("long")
    spent = said.where("role = 'assistant'").groupBy(F.col("conv_id").cast("string").alias("qid")).agg(F.lit("A").alias("answer"), n.alias("prompt_tokens"), (2 * n).alias("completion_tokens"), (3 * n).alias("total_tokens"))
    return sinks.answer_table(spent, asked)


@query("grouped_accuracy", """select lang, source, count(*) as n, sum((quality = (n_chars > 300)::int)::int)::bigint as n_correct, round(avg((quality = (n_chars > 300)::int)::int), 6) as accuracy
from labels join documents using (doc_id) group by grouping sets ((), (lang), (source))""")
def grouped_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    return evaluation.grouped_accuracy(rows, F.col("quality") == (F.col("n_chars") > 300).cast("int"), "lang", "source")


@query("token_totals", "select sum(length(text))::bigint as total_tokens, sum(length(text)) filter (role = 'user')::bigint as prompt_tokens, round(least(1, greatest(0, (5000000 - sum(length(text))) / 5000000)), 6) as token_score from conversations")
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("role", F.length("text").cast("long").alias("n"))
    sums = said.agg(F.sum("n").alias("total_tokens"), F.sum(F.when(F.col("role") == "user", F.col("n"))).alias("prompt_tokens"))
    return sums.withColumn("token_score", F.round(evaluation.token_score(F.col("total_tokens")), 6))


@query("answer_overlay", "select doc_id as qid, case when doc_id % 10 = 0 and quality = 1 then 0 else quality end as answer from labels")
def answer_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("qid"), F.col("quality").alias("answer"))
    changes = base.where("qid % 10 = 0 and answer = 1").select("qid", F.lit(0).alias("answer"))
    return submission.overlay(base, changes, "qid", "answer")[0]


@query("pending_questions", "select item_id as qid from benchmark where item_id not in (select doc_id from labels where toxic = 0)")
def pending_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("qid"), (1 - F.col("toxic")).alias("total_tokens"))
    return submission.pending(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid")), done)


@query("answer_issues", """with a as (select conv_id as qid, array_to_string(regexp_extract_all(upper(text), '[A-F]'), '') as answer from conversations)
select 'malformed' as issue, qid from a where not regexp_full_match(answer, '[A-D]+')
union all select 'unsorted', qid from a where regexp_full_match(answer, '[A-D]+') and answer <> array_to_string(list_sort(list_distinct(string_split(answer, ''))), '')
union all select 'repeated', qid from a group by qid having count(*) > 1""")
def answer_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.regexp_extract_all(F.upper("text"), F.lit("([A-F])"), F.lit(1))
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), F.array_join(letters, "").alias("answer"))
    return submission.answer_issues(said)


# -- books, sequences, identifiers --------------------------------------------------------------

_LINES_SQL = """b as (select l_orderkey as k, list(l_extendedprice / l_quantity order by l_linenumber, l_partkey, l_suppkey, l_shipdate) filter (l_returnflag = 'R') as bp,
  list(l_quantity order by l_linenumber, l_partkey, l_suppkey, l_shipdate) filter (l_returnflag = 'R') as bv, list(l_quantity order by l_linenumber, l_partkey, l_suppkey, l_shipdate) filter (l_returnflag <> 'R') as av,
  list(l_quantity * 10) as qs from lineitem group by 1)"""


@query("book_levels", f"""with {_LINES_SQL}, v as (select k, coalesce(bv, []) as bv, coalesce(av, []) as av from b), d as (select *, least(len(bv), len(av)) as n from v)
select k as order_key, n::int as depth, round(case when n > 0 then list_sum(list_transform(range(1, n + 1), lambda i: (bv[i] - av[i]) / i)) / (list_sum(list_transform(range(1, n + 1), lambda i: (bv[i] + av[i]) / i)) + 1e-9) else 0 end, 6) as imbalance,
  round(case when n > 1 then list_sum(list_transform(range(1, n + 1), lambda i: (i - 1 - (n - 1) / 2) * list_sum(bv[:i]))) / (list_sum(bv[:n]) + 1e-9) / (n * (n * n - 1) / 12) else 0 end, 6) as slope from d""")
def book_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as JSON book sides, parsed back: R lines bid, the others ask."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume")).alias("x"))
    side = lambda bid: F.to_json(F.transform(F.array_sort(F.collect_list(F.when((F.col("l_returnflag") == "R") == bid, F.col("x")))), lambda x: F.struct(x["price"].alias("price"), x["volume"].alias("volume"))))
    raw = lines.groupBy(F.col("l_orderkey").alias("order_key")).agg(side(F.lit(True)).alias("bids"), side(F.lit(False)).alias("asks"))
    rows = raw.select("order_key", *[F.transform(daily.parse_levels(F.col(c)), lambda x: x["volume"]).alias(c) for c in ("bids", "asks")])
    depth = F.least(F.size("bids"), F.size("asks"))
    return rows.select("order_key", depth.alias("depth"), F.round(sequences.weighted_imbalance(F.col("bids"), F.col("asks")), 6).alias("imbalance"), F.round(sequences.depth_slope(F.col("bids"), depth), 6).alias("slope"))


@query("order_statistics", f"""with {_LINES_SQL}, q as (select k, qs, list_transform(qs, lambda v: round_even(v / 100, 0) * 100) as bs from b)
select k as order_key, len(qs)::int as n, round(list_max(list_transform(bs, lambda x: len(list_filter(bs, lambda y: y = x)))) / len(qs), 6) as repeat, round(list_max(qs) / (list_sum(qs) + 1e-9), 6) as max_share,
  round(case when len(qs) > 1 then list_sum(list_transform(qs, lambda v: -(v / (list_sum(qs) + 1e-9)) * ln(v / (list_sum(qs) + 1e-9) + 1e-9))) / (ln(len(qs)) + 1e-9) else 0 end, 6) as entropy from q""")
def order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.collect_list(F.col("l_quantity") * 10).alias("qs"))
    rows = lists.select("order_key", sequences.order_stats(F.col("qs")).alias("s"))
    return rows.select("order_key", "s.n", *[F.round(f"s.{c}", 6).alias(c) for c in ("repeat", "max_share", "entropy")])


@query("sequence_parsing", "with s as (select l_orderkey, list(l_quantity order by l_quantity) as q from lineitem group by 1) select l_orderkey as order_key, len(q)::int as n, round(list_sum(q), 4) as total from s")
def sequence_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_quantity")), lambda x: x.cast("string")), ";;").alias("s"))
    rows = told.select("order_key", sequences.parse_sequence(F.col("s")).alias("q"))
    return rows.select("order_key", F.size("q").alias("n"), F.round(sequences.total(F.col("q")), 4).alias("total"))


@query("minutes_of_day", "select event_id, round(((epoch_us(ts) // 1000) / 1000.0 + 28800) % 86400 / 60, 6) as minute from events")
def minutes_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", F.round(minute_of_day(ms), 6).alias("minute"))


@query("wide_books", "select p_partkey as part_key, len(list_filter([p_retailprice - 1000, p_size - 25.0, 1.0], lambda x: x > 0))::int as levels from part")
def wide_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") - 1000).alias("BidPrice1"), (F.col("p_size") - 25.0).alias("BidPrice2"), F.lit("1").alias("BidPrice3"), F.lit(5).alias("BidOrderQty1"))
    return wide.select(F.col("p_partkey").alias("part_key"), F.size(daily.wide_to_levels(wide, "BidPrice{i}", "BidOrderQty{i}")).alias("levels"))


@query("plain_dates", "select o_orderkey as order_key, strftime(o_orderdate, '%Y%m%d') as date, coalesce(try_cast(o_orderpriority as double), 7.0) as priority from orders")
def plain_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("order_key"), plain_date(F.col("o_orderdate")).alias("date"), number(orders, "o_orderpriority", 7.0).alias("priority"))


@query("typical_days", "select event_type, n, round(share, 6) as share from (select event_type, count(*) as n, count(*) / sum(count(*)) over () as share from events group by 1)")
def typical_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = evaluation.distribution(table(spark, sf_dir, "events"), "event_type").withColumnRenamed("value", "event_type")
    whole = Window.partitionBy()
    return counts.select("event_type", "n", F.round(F.col("n") / F.sum("n").over(whole), 6).alias("share"))


@query("vector_rerank", """with v as (select vec_id, label, embedding::double[] as e from embeddings),
p as (select a.vec_id as query_id, b.vec_id as vec_id, round(list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))), 6) as cosine
  from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by cosine desc, vec_id) as rank from p) select query_id, vec_id, cosine, rank::int as rank from r where rank <= 5""")
def vector_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries (ids divisible by 50) against the vectors of their label."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    pairs = asked.join(rows.select("vec_id", "label"), "label").where("query_id <> vec_id").select("query_id", "vec_id")
    return retrieval.rerank_by_vectors(pairs, rows.select(F.col("vec_id").alias("key"), "vector"), "query_id", "vec_id", 5)


@query("key_filters", "select event_id, event_type as symbol, strftime(ts, '%Y%m%d') as dt from events where event_type in ('click', 'view') and strftime(ts, '%Y%m%d') in ('20240103', '20240117')")
def key_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("symbol"), F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd").alias("dt"))
    return ticks.selected(rows, ["click", "view"], ["2024-01-03", "20240117"])


@query("united_frames", "select c_custkey as key, c_name as name, c_mktsegment as segment, -1::bigint as size from customer union all select p_partkey, p_name, 'none', p_size from part")
def united_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ticks.renamed(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), {"c_custkey": "key", "c_name": "name", "c_mktsegment": "segment", "absent": "x"})
    b = ticks.renamed(table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_size").cast("long").alias("size")), {"p_partkey": "key", "p_name": "name"})
    return a.unionByName(b, allowMissingColumns=True).fillna({"segment": "none", "size": -1})


@query("symmetric_keys", "select s_suppkey as key, 'left' as side from supplier where s_suppkey not in (select l_suppkey from lineitem where l_quantity > 45) union all select distinct l_partkey, 'right' from lineitem where l_quantity > 49 and l_partkey not in (select s_suppkey from supplier)")
def symmetric_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that one side has and the other hasn't, as two anti joins."""
    lines, own = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"))
    sold = lines.where("l_quantity > 45").select(F.col("l_suppkey").alias("key")).distinct()
    parts = lines.where("l_quantity > 49").select(F.col("l_partkey").alias("key")).distinct()
    return own.join(sold, "key", "left_anti").withColumn("side", F.lit("left")).unionByName(parts.join(own, "key", "left_anti").withColumn("side", F.lit("right")))
