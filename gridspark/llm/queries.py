"""The queries opN_<name>, each over its whole table, and their SQL where DuckDB can say it."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embeddings, langid, mixing, packing, quality, rules, simhash, suffix, tokens
from .common import table

#: Files of public tokenizers, by their folder's own lookup; operators take the path as a parameter.
BPE, PIECES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")

Query = Callable[[SparkSession, str], DataFrame]


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(table(spark, sf_dir, "documents"), PIECES)
    return counted.select(F.col("id").alias("doc_id"), "n_chars", "n_tokens")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(table(spark, sf_dir, "documents"), BPE)
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(pieces)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"])
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.stop - s.start)
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))) % 4 == 2
    model = quality.learn(docs, table(spark, sf_dir, "labels"), use=~held_out("doc_id"))
    out = quality.score(docs, model)
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.judge(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.format_turns(turns))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), ["doc_id"])
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken", "copies", "part")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))) % 3 == 1
    model = langid.learn(docs, PIECES, use=~held_out("doc_id"))
    found = langid.identify(docs, model, PIECES)
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_embedding_dedup, op2_token_counts, op3_packing, op4_suffix_dedup, op5_simhash, op6_quality_classifier, op7_quality_rules, op8_chat_format, op9_mix, op10_language_id)}

#: SQL over the same tables for the queries that DuckDB can express: no fingerprints, vocabularies, trained models or hash-random keys.
ORACLE: dict[str, str] = {
    "op1_embedding_dedup": """
with recursive v as (select vec_id as id, embedding::double[] as e from embeddings),
link as (select a.id as a, b.id as b from v a join v b on a.id <> b.id and list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) as (select id, id from v union select r.a, l.b from reach r join link l on r.b = l.a),
comp as (select a, min(b) as component_id from reach group by 1),
n as (select a, count(*) as n_links from link group by 1)
select id as vec_id, coalesce(n_links, 0) as n_links, component_id, id = component_id as kept
from v join comp on v.id = comp.a left join n on v.id = n.a""",
    "op4_suffix_dedup": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
w as (select doc_id, s, substr(h, 2 * s + 1, 200) as x from (select doc_id, h, unnest(range(greatest(n - 99, 0))) as s from d)),
later as (select doc_id, s from (select doc_id, s, row_number() over (partition by x order by doc_id, s) as k from w) where k > 1),
runs as (select doc_id, s, sum(fresh) over (partition by doc_id order by s) as run
         from (select doc_id, s, case when s <= lag(s) over (partition by doc_id order by s) + 100 then 0 else 1 end as fresh from later)),
spans as (select doc_id, run, min(s) as a, max(s) + 100 as b from runs group by 1, 2),
cuts as (select doc_id, sum(b - a)::bigint as n_removed, count(*) as n_spans, list(b order by a) as ends, list(a order by a) as starts from spans group by 1),
kept as (select doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' order by lo) as k
         from (select d.doc_id, h, unnest([0] || ends) as lo, unnest(starts || [n]) as hi from d join cuts using (doc_id)) group by 1)
select d.doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256
from d left join cuts using (doc_id) left join kept using (doc_id)""",
    "op8_chat_format": """
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, n, r, chr(92) || '### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) x(n, r)),
e as (select *, length(role) + length(text) + 24 as plain,
      length(regexp_replace(role || chr(10) || text, '[^' || chr(92) || chr(92) || ']', '', 'g')) + (length(role || chr(10) || text) - length(replace(role || chr(10) || text, '<|', '|'))) as escapes from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(plain + escapes)::bigint as formatted_chars
from e group by 1""",
}
