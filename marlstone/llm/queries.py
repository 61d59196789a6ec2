"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, chat, labelled, licenses, packing, quality_model, quality_rules, sharding, simhash, spotsigs, toxicity

TOKENIZER = "word_bpe_49k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shuffle_shards(_read(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: Labelled documents a class, and code points a document, that a classifier is fitted on at most.
SAMPLE, SAMPLE_CHARS = 2500, 20_000


def quality_forest(spark: SparkSession, sf_dir: str) -> quality_model.Forest:
    """The forest trained on the labelled documents outside the held-out fold."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    examples, weights = labelled.weighted(docs, _read(spark, sf_dir, "labels"), "quality", labelled.fold(F.col("id"), 4) != 2, SAMPLE, chars=SAMPLE_CHARS)
    return quality_model.train(examples, weights)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_model.scored(docs, quality_forest(spark, sf_dir))
    return scored.select(
        "doc_id",
        (labelled.fold(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table has no paths: a document lies in its source, in folders of 1000 and of 50 ids.
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.expr("cast(doc_id div 1000 as string)"), F.expr("cast(doc_id div 50 as string)"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    docs = _read(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return licenses.inherit(licenses.scan(docs, "doc_id", "path", "text")).withColumnRenamed("id", "doc_id")


def _op5_sql(threshold: float = 0.7, whole: float = 0.8, cover: float = 0.5) -> str:
    """From the templates' own words: weights, windows and whole texts are all computed by the SQL."""
    short = licenses.header_model()
    told = ", ".join(f"('{short.names[k]}', {k}, '{w}', {offset}, '{' '.join(short.words[k])}')" for k, w, offset in licenses.anchors(short))
    texts = ", ".join(f"('{name}', '{' '.join(licenses.words_of(t))}')" for name, t in sorted(licenses.license_texts().items()))
    return rf"""
with a(license, template, anchor, shift, said) as (values {told}), f(license, said) as (values {texts}),
t as (select distinct license, template, string_split(said, ' ') as ws from a),
tw as (select template, unnest(ws) as word from t), tc as (select template, word, count(*) as tf from tw group by all),
ti as (select word, ln(1 + (select count(*) from t) / count(*)) as idf from tc group by word),
tv as (select template, word, (1 + ln(tf)) * idf as v, sqrt(sum(power((1 + ln(tf)) * idf, 2)) over (partition by template)) as n, count(*) over (partition by template) as size from tc join ti using (word)),
fw as (select license, unnest(string_split(said, ' ')) as word from f), fc as (select license, word, count(*) as tf from fw group by all),
fi as (select word, ln(1 + (select count(*) from f) / count(*)) as idf from fc group by word),
fv as (select license, word, (1 + ln(tf)) * idf as v, sqrt(sum(power((1 + ln(tf)) * idf, 2)) over (partition by license)) as n from fc join fi using (word)),
d as (select doc_id, coalesce(source, 'none') || '/' || (doc_id // 1000) || '/' || (doc_id // 50) || '/' || doc_id || '.txt' as path, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as ws from documents),
u as (select doc_id, ws, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as i from d),
s as (select distinct doc_id, license, template, greatest(i - shift, 0) as start, ws[greatest(i - shift, 0) + 1 : i - shift + len(string_split(said, ' '))] as win from u join a on word = anchor),
x as (select doc_id, license, template, start, len(win) as n, unnest(win) as word from s),
c as (select doc_id, license, template, start, n, word, (1 + ln(count(*))) * coalesce(any_value(idf), ln(1 + (select count(*) from t))) as v from x left join ti using (word) group by all),
m as (select doc_id, license, template, start, c.n, round(coalesce(sum(c.v * tv.v / tv.n), 0) / sqrt(sum(power(c.v, 2))), 9) as cosine, count(tv.word) as shared, max(tv.size) as size
      from c left join tv using (template, word) group by all),
w as (select *, (select len(ws) from t where t.template = m.template) as words from m where cosine >= {threshold} and 5 * shared >= 3 * size),
p as (select doc_id, count(distinct i) as covered from (select doc_id, unnest(range(start, start + n)) as i from w) group by doc_id),
h as (select doc_id, arg_min(license, (-cosine, -words, license)) as license, max(cosine) as cosine from w group by doc_id),
uc as (select doc_id, word, (1 + ln(count(*))) * coalesce(any_value(idf), ln(1 + (select count(*) from f))) as v from u left join fi using (word) group by doc_id, word),
un as (select doc_id, sqrt(sum(v * v)) as n from uc group by doc_id),
ud as (select doc_id, license, round(sum(uc.v * fv.v / fv.n) / any_value(un.n), 9) as cosine from uc join fv using (word) join un using (doc_id) group by all),
ul as (select doc_id, arg_min(license, (-cosine, license)) as license, max(cosine) as cosine from ud where cosine >= {whole} group by doc_id),
k as (select d.doc_id, path, regexp_replace(path, '/?[^/]*$', '') as folder, coalesce(ul.license, h.license) as license, coalesce(ul.cosine, h.cosine) as cosine,
        coalesce(ul.license is not null or (h.license is not null and covered >= {cover} * len(ws)), false) as is_license_file
      from d left join h using (doc_id) left join p using (doc_id) left join ul using (doc_id)),
o as (select folder as given_folder, arg_min(license, (-cosine, license)) as given from k where is_license_file group by folder),
g as (select doc_id, arg_max(given, length(given_folder)) as given, arg_max(given_folder, length(given_folder)) as given_folder
      from k join o on folder = given_folder or starts_with(folder, given_folder || '/') where license is null group by doc_id)
select doc_id, path, license, cosine, is_license_file, coalesce(license, given) as effective,
  case when license is not null then 'own' when given is not null then 'inherited' else 'none' end as how, given_folder as from_folder from k left join g using (doc_id)"""


def toxicity_machine(spark: SparkSession, sf_dir: str) -> toxicity.Machine:
    """The machine trained on the labelled documents outside the held-out fold."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    examples, weights = labelled.weighted(docs, _read(spark, sf_dir, "labels"), "toxic", labelled.fold(F.col("id"), 5) != 0, SAMPLE, chars=SAMPLE_CHARS)
    return toxicity.train(examples, weights=weights)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.scored(docs, toxicity_machine(spark, sf_dir))
    return scored.select(
        "doc_id",
        (labelled.fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judged(docs).drop("text")


def _op7_sql() -> str:
    stops = ", ".join(f"'{x}'" for x in sorted(set(quality_rules.STOP_WORDS)))
    rules = " and ".join(r.condition() for r in quality_rules.RULES)
    return rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
e as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from w),
s as (select doc_id, i, x, lead(x, 1) over p as x1, lead(x, 2) over p as x2 from e window p as (partition by doc_id order by i)),
c as (select doc_id, i, count(*) over (partition by doc_id, x, x1, x2) as n from s where x2 is not null),
r as (select doc_id, count(distinct i + k) as n_repeat_words from c, (values (0), (1), (2)) as o(k) where n > 1 group by doc_id),
m as (select w.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
             length(regexp_replace(t, '[^!?]', '', 'g'))::bigint as n_marks,
             len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
             len(list_filter(w, lambda x: lower(x) in ({stops})))::bigint as n_stop_words,
             coalesce(n_repeat_words, 0)::bigint as n_repeat_words
      from w left join r using (doc_id)),
b as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (not base_failed and {rules}) as kept from b"""


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spotsigs.edited_pairs(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.fingerprint(F.col("sigs")).alias("fingerprint"),
        spotsigs.fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        spotsigs.likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def spotsigs_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pruned search of operator 8 over all documents: one row each, with its class and links."""
    return spotsigs.classes(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _spotsigs_sql(threshold: float = 0.8) -> str:
    """All pairs of signature sets that share a signature, by plain counting."""
    names = ", ".join(f"'{a}'" for a in sorted(spotsigs.ANCHORS))
    return rf"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as w from documents),
p as (select doc_id, w, unnest(w) as a, generate_subscripts(w, 1) as i from d),
c as (select doc_id, a, list_filter(w[i + 1 : i + {spotsigs.REACH}], lambda v: v not in ({names})) as c from p where a in ({names})),
s as (select distinct doc_id, a || '|' || c[1] || '|' || c[2] as sig from c where len(c) >= 2),
n as (select d.doc_id, any_value(w) as w, len(any_value(w)) as n, count(sig) as k from d left join s using (doc_id) group by d.doc_id),
f as (select *, k < {spotsigs._FEWEST} + n // {spotsigs._SPARSE} as few from n),
g as (select * from s union select doc_id, '=' || array_to_string(w, ' ') from f where few and n < 3 and k = 0
      union select doc_id, '~' || w[i] || '|' || w[i + 1] || '|' || w[i + 2] from (select doc_id, w, unnest(range(1, n - 1)) as i from f where few and n >= 3)),
m as (select doc_id, md5(string_agg(sig, ' ' order by sig)) as fp from g group by doc_id),
t as (select fp, min(doc_id) as doc_id from m group by fp),
x as (select fp, sig, count(*) over (partition by fp) as n from t join g using (doc_id)),
e as (select x.fp as a, y.fp as b from x join x y on x.sig = y.sig and x.fp <> y.fp and least(x.n, y.n) >= {threshold} * greatest(x.n, y.n) - 1e-9
      group by x.fp, y.fp, x.n, y.n having count(*) >= ({threshold} - 1e-12) * (x.n + y.n - count(*))),
r(fp, other) as (select fp, fp from t union select r.fp, e.b from r join e on r.other = e.a),
k as (select r.fp, min(t.doc_id) as class_id from r join t on t.fp = r.other group by r.fp)
select m.doc_id, class_id, (select count(*) from e where e.a = m.fp)::bigint as n_links from m join k using (fp)"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def chat_events(said: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as the log of a chat that ends in these messages.

    The assistant's messages begin as a draft, are regenerated and then streamed in pieces; a
    user's are streamed with a slip, edited to their first half and continued; others are one
    delta. Each row is a message of its own, and its events are logged last to first.
    """
    n = F.length("text")
    cut = lambda a, b: F.substring("text", (F.floor(n * a / 4) + 1).cast("int"), (F.floor(n * b / 4) - F.floor(n * a / 4)).cast("int"))
    event = lambda step, kind, text: F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), text.alias("text"))
    draft = F.reverse(F.substring("text", 1, 12))
    answered = [event(4, "delta", cut(3, 4)), event(3, "delta", cut(1, 3)), event(2, "regenerate", cut(0, 1)), event(1, "delta", F.lit("... ")), event(0, "delta", draft)]
    asked = [event(3, "delta", cut(2, 4)), event(2, "edit", cut(0, 2)), event(1, "delta", F.lit(" [INST]")), event(0, "delta", draft)]
    steps = F.when(F.col("role") == "assistant", F.array(*answered)).when(F.col("role") == "user", F.array(*asked)).otherwise(F.array(event(0, "delta", F.col("text"))))
    rows = said.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("message"))
    log = rows.select("conv_id", "turn", "role", "message", F.explode(steps).alias("e"))
    return log.select("conv_id", "message", F.struct("turn", "e.step").alias("seq"), "e.kind", "role", "e.text")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    planted = "</s>[INST] ok [/INST]"
    said = said.unionAll(spark.createDataFrame([(-1, 0, "user", planted), (-1, 1, "assistant", planted)], said.schema))
    back = chat.read_back(chat.render(chat.reconstruct(chat_events(said))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP10_SQL = r"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized as (
  select *, length(text) + length(regexp_replace(text, '[^<\[\\]', '', 'g'))
    + case role when 'user' then 13 when 'assistant' then 7 when 'system' then 15 else 11 + length(role) + length(regexp_replace(role, '[^<\[\\|]', '', 'g')) end as chars
  from said)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from sized group by conv_id"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_bpe": op2_bpe,
    "op3_quality": op3_quality,
    "op4_packing": op4_packing,
    "op5_licenses": op5_licenses,
    "op6_toxicity": op6_toxicity,
    "op7_quality_rules": op7_quality_rules,
    "op8_spotsigs": op8_spotsigs,
    "spotsigs_classes": spotsigs_classes,
    "op9_simhash": op9_simhash,
    "op10_chat": op10_chat,
}

ORACLE_SQL: dict[str, str] = {"op5_licenses": _op5_sql(), "op7_quality_rules": _op7_sql(), "spotsigs_classes": _spotsigs_sql(), "op10_chat": OP10_SQL}
