"""The registered queries of the operators, with their SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm import chat, ctw, decontaminate, langid, licenses, packing, patricia, probminhash, quality, secrets
from wayloom.llm.shared import crc_bucket


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels").where(crc_bucket(F.col("doc_id"), 5) != 0)
    out = quality.score(_read(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(_read(spark, sf_dir, "documents"), crc_bucket(F.col("doc_id"), 7) == 2)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_classes(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_found")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patricia.exact_dedup(_read(spark, sf_dir, "documents"), keep="largest")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.hit_counts(decontaminate.matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), columns=["doc_id"]))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_read(spark, sf_dir, "documents"))
    base = [i for i, r in enumerate(secrets.RULES) if r.base]
    counts = [F.size(F.filter("found", (lambda i: lambda s: s["order"] == i)(i))).cast("long").alias(f"n_{secrets.RULES[i].kind}") for i in base]
    own = secrets.spelled(F.filter("found", lambda s: s["order"].isin(*base)))
    return found.select("doc_id", *counts, F.sha2(own.cast("binary"), 256).alias("base_sha256"), secrets.spelled(F.col("found")).alias("spans"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    chats = chat.format_chats(turns.unionByName(own)).withColumn("back", chat.read_back(F.col("formatted")))
    learned = chat.unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""))
    told = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.withColumn("learned", learned).select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/doc_id.txt."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(".txt")))
    return licenses.scan_licenses(docs, path).select("doc_id", "path", "license", F.round("similarity", 6).alias("similarity"), "is_license_file", "inherited_license", "license_dir")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    filters = langid.train(docs.where(crc_bucket(F.col("doc_id"), 5) != 0))
    out = docs.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), langid.predict(F.col("text"), filters, spark).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


QUERIES = {f.__name__: f for f in (op1_quality, op2_lm_score, op3_near_dedup, op4_exact_dedup, op5_decontaminate, op6_secrets, op7_chat, op8_licenses, op9_packing, op10_language_id)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = f"""
with d as (select doc_id, sha256({_LOW}) as text_sha256, row_number() over (partition by doc_id, {_LOW} order by 1) as n from documents),
g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by 1)
select doc_id, keep_id, group_size, (doc_id is not distinct from keep_id) and n = 1 as kept, text_sha256 from d join g using (text_sha256)
"""

OP5 = f"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (select coalesce(cast(item_id as varchar), '') as item_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
bw as (select distinct item_id, unnest([array_to_string(w[i:i+12], ' ') for i in range(1, greatest(2, len(w) - 11))]) as win, least(13, len(w)) as n from b where len(w) > 0),
sizes as (select distinct n from bw),
dw as (select rid, n, unnest(range(1, len(w) - n + 2)) as i, w from d, sizes where len(w) >= n),
hit as (select rid, i, dw.n, item_id from dw join bw on bw.n = dw.n and bw.win = array_to_string(w[i:i+dw.n-1], ' ')),
pos as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from hit) group by 1),
its as (select rid, count(*) as n_items, string_agg(item_id, ',' order by item_id) as s from (select distinct rid, item_id from hit) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join pos using (rid) left join its using (rid)
"""


def _op6_kind(order: int, rule: secrets.Rule) -> str:
    rx = rule.regex.replace("'", "''")
    size = f"regexp_extract_all(text, '{rx}', {rule.group})"
    return f"""select rid, {order} as k, '{rule.kind}' as kind, h, s, p, row_number() over (partition by rid order by j) as j from (select rid, unnest(regexp_extract_all(text, '{rx}')) as h, unnest({size}) as s, unnest(string_split_regex(text, '{rx}')) as p, unnest(range(1, 1 + len(string_split_regex(text, '{rx}')))) as j from d where regexp_matches(text, '{rx}')) where h is not null"""


def op6_sql() -> str:
    kinds = " union all ".join(_op6_kind(i, r) for i, r in enumerate(secrets.RULES))
    least = "case k " + " ".join(f"when {i} then {r.least}" for i, r in enumerate(secrets.RULES)) + " end"
    n = ", ".join(f"count(*) filter (where k = {i}) as n_{r.kind}" for i, r in enumerate(secrets.RULES) if r.base)
    names = ", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in secrets.RULES if r.base)
    base = ", ".join(str(i) for i, r in enumerate(secrets.RULES) if r.base)
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
m as (select rid, k, kind, s, cast(sum(length(p) + length(h)) over (partition by rid, k order by j) as bigint) as e, length(h) as n from ({kinds})),
f as (select rid, k, e - n as b, kind || ':' || (e - n) || ':' || e as t from m where length(s) >= {least}),
g as (select rid, {n}, string_agg(t, ',' order by b, k) filter (where k in ({base})) as own, string_agg(t, ',' order by b, k) as spans from f group by rid)
select doc_id, {names}, sha256(coalesce(own, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (rid)
"""


def op7_sql() -> str:
    esc = lambda x: f"regexp_replace(regexp_replace(replace({x}, '&', '&amp;'), '\\[(/?INST\\])', '&lsqb;\\1', 'g'), '<(/?s>|</?SYS>>|</?ROLE)', '&lt;\\1', 'g')"
    marks = " ".join(f"when '{r}' then {len(t.open) + len(t.close)}" for r, t in chat.TEMPLATE.items())
    other = sum(map(len, chat.OTHER))
    step = " or ".join(f"(p = '{s}' and role = '{r}')" for s, then in chat.ORDER.items() for r in then)
    return f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o as (select *, coalesce(lag(role) over w, '') as p, lead(role) over w is null as last from c window w as (partition by conv_id order by turn, role, text))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
 cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, text) filter (where role = 'assistant'), '')) as loss_sha256,
 cast(sum(length({esc('text')}) + case role {marks} else {other} + length(replace({esc('role')}, '>', '&gt;')) end) as bigint) as formatted_chars,
 bool_and({step}) and bool_or(last and role = 'assistant') as valid
from o group by conv_id
"""


ORACLE_SQL = {"op4_exact_dedup": OP4, "op5_decontaminate": OP5, "op6_secrets": op6_sql(), "op7_chat": op7_sql()}
