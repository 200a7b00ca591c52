"""The corpus pipeline: quality rules, near-dedup, removal of repeats, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each to the shared folder and reads it back
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import mixing, packing, rules, simhash, suffix
from gridspark.llm.common import Staged, table
from gridspark.llm.queries import BPE

NULL_ID = -(1 << 63)
#: Ids to drop are broadcast up to this many (two longs each); beyond it the join shuffles.
BROADCAST_DROPPED = 500_000


def _key() -> list[Column]:
    """A row's own key, of 128 bits: id (null: the least long) and text hash. Rows equal in both are told apart by nothing, and treated alike but where one of them stays."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("k_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("k_text")]


def _without(docs: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    """docs but those whose (id, text hash) is in dropped, which is written once and counted."""
    dropped = Staged(docs.sparkSession, name).put(dropped.select("k_id", "k_text").distinct())
    dropped = F.broadcast(dropped) if dropped.count() <= BROADCAST_DROPPED else dropped
    return docs.withColumns(dict(zip(("k_id", "k_text"), _key()))).join(dropped, ["k_id", "k_text"], "left_anti").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null, empty and short texts among them. Rows equal in id and text have one verdict; an empty table stays empty."""
    keyed = docs.select(*_key(), "text", "lang", "source").withColumn("row_key", F.xxhash64("k_id", "k_text"))
    staged = Staged(spark, "rules-judged")
    judged = rules.judge(keyed, id_col="row_key", staged=staged).where("not kept").select(F.col("id").alias("row_key"))
    out = _without(docs, keyed.select("k_id", "k_text", "row_key").join(judged, "row_key", "left_semi"), "rules-stage")
    staged.clear()
    return out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id (null first) and then text hash. Near: five-word shingles, Jaccard
    similarity 0.8 or more. Texts without words, null ones included, are one group; rows that share an id and are unlike all stay."""
    work, kept = Staged(spark, "near-work"), Staged(spark, "near-stage")
    found = work.put(simhash.similar_groups(docs, staged=work))
    first = (F.col("id") == F.col("component_id")) & (F.col("text_hash") == F.col("component_hash"))
    out = _without(docs, found.where(~first).select(F.col("id").alias("k_id"), F.col("text_hash").alias("k_text")), "near-dropped")
    # Of rows equal in id and text one stays. There are few, so the others are never shuffled.
    equal = found.where(first).groupBy(F.col("id").alias("k_id"), F.col("text_hash").alias("k_text")).agg(F.count("*").alias("n")).where("n > 1").select("k_id", "k_text")
    equal = kept.put(equal)
    n = equal.count()
    work.clear()
    if not n:
        return out
    equal = F.broadcast(equal) if n <= BROADCAST_DROPPED else equal
    keyed = out.withColumns(dict(zip(("k_id", "k_text"), _key())))
    several = keyed.join(equal, ["k_id", "k_text"], "left_semi").dropDuplicates(["k_id", "k_text"])
    return keyed.join(equal, ["k_id", "k_text"], "left_anti").unionByName(several).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that occur earlier are cut out of the texts; a character that loses a byte goes. Null texts stay null, texts shorter
    than that as they are; every row stays, rows equal in id and text with equal results."""
    out = suffix.remove_repeats(docs, as_text=True)
    text = F.when(F.col("row.text").isNotNull(), F.col("text"))
    changed = F.size("spans") > 0
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        text.alias("text"),
        F.col("row.lang").alias("lang"),
        F.col("row.source").alias("source"),
        F.when(changed, F.length(text).cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars"),
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them; the last one of a source may be cut at a word. A null source is one of its own;
    texts without words are never taken; repeated rows and ties are taken by their hash-random keys; an empty table stays empty."""
    out = mixing.copies(mixing.mix(docs, ["doc_id", "text", "lang", "source", "n_chars"]))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document's tokens: its place in sequences of at most 1024. A null text is its end token alone; rows that
    share an id or are equal are packed each; an empty table gives none."""
    pieces = packing.tokenize(docs, BPE)
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("repeated_passages", repeated_passages),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: SQL cannot express the estimates, fingerprints and vocabularies of the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, staged = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"), Staged(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, staged.put(stage(spark, docs, sf_dir))
        if k:
            staged.drop(before)  # its successor is written
    return STAGES[-1][1](spark, docs, sf_dir)
