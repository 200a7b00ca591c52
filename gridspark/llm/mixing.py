"""Mixing sources to target weights, in DataFrame operations only.

Every row gets a hash-random key. Within its source the keys are cut into equal
ranges (a range partition whose bounds are known, because the keys are uniform);
sums per range, a prefix sum over the ranges and a sort of the one range that
holds the cut give the exact key at which a source's budget ends. The decision for a
row then only compares its key with its source's cut, so the documents
themselves are never shuffled and a source that holds a third of all rows costs no more
than many small ones.

Defined results: a null or empty text has size 0 and takes 0; a null source is a
source of its own, last in order; null ids are allowed; rows that are equal in id and text share
what is left at the cut evenly (rounded down); an empty table gives an empty table; carried
columns come back inside one struct, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, Staged, col, n_words, small

WEIGHTS = (5.0, 2.0, 1.0)


def targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """Adds `target` to (src, source_size, source_rows): weight shares of all sizes, held below
    max_epochs times a source's size, the excess shared again by weight until none is above.

    The sources that stop at their limit are those with the smallest limit per weight, so
    prefix sums in that order find them without iterating. One row a source.
    """
    order = W.orderBy(F.col("src").asc_nulls_last())
    rank = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (rank % len(weights) + 1).cast("int"))
    t = totals.withColumn("w", weight).withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy(F.col("cap") / F.col("w"), F.col("src").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumns({"all": F.sum("source_size").over(every).cast("double"), "all_w": F.sum("w").over(every)})
    t = t.withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "w_before": F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    t = t.withColumn("full", (F.col("all") - F.col("cap_before")) * F.col("w") >= F.col("cap") * (F.col("all_w") - F.col("w_before")))
    on_full = lambda x: F.coalesce(F.sum(F.when(F.col("full"), F.col(x))).over(every), F.lit(0.0))
    left = t.withColumns({"rest": F.col("all") - on_full("cap"), "rest_w": F.col("all_w") - on_full("w")})
    share = F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * F.col("rest") / F.nullif(F.col("rest_w"), F.lit(0.0)))
    return left.select("src", "source_size", "source_rows", F.coalesce(share, F.lit(0.0)).alias("target"))


def mix(
    docs: DataFrame,
    keep: Sequence[str] | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    max_epochs: int = 3,
    seed: int = 20_240_229,
    rows_per_range: int = 4096,
) -> DataFrame:
    """One row per input row: `row` (a struct of the `keep` columns), size, source_size, target,
    copies (whole repeats), part (words of one further copy that is cut) and taken (words in all)."""
    spark, keep = docs.sparkSession, list(docs.columns if keep is None else keep)
    text, whole = col(text_col).cast("string"), text_col in keep
    base = docs.select(
        F.struct(*[col(c).alias(c) for c in keep]).alias("row"),
        col(source_col).cast("string").alias("src"),
        n_words(text).alias("size"),
        F.xxhash64(col(id_col), text, F.lit(seed)).alias("key"),
    )
    staged = Staged(spark, "mixing")
    slim = staged.put(base.drop("row") if whole else base)
    base = base if whole else slim

    totals = slim.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    goals = targets(totals, weights, max_epochs)
    budget = F.floor("target").cast("long")
    size = F.greatest("source_size", F.lit(1))
    goals = goals.withColumn("copies", F.least(F.lit(max_epochs), (budget / size).cast("long")))
    goals = goals.withColumn("rest", F.when(F.col("copies") < max_epochs, budget - F.col("copies") * F.col("source_size")).otherwise(0))
    goals = staged.put(goals.withColumn("ranges", F.ceil(F.col("source_rows") / rows_per_range)), 1)
    n = goals.count()
    goals_to = goals.select(F.col("src").alias("g_src"), "rest", "ranges")

    # How far into its source's key space a row lies, in equal ranges.
    at = F.floor((F.col("key").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64) * F.col("ranges"))
    ranged = slim.drop("row").join(small(goals_to, n), F.col("src").eqNullSafe(F.col("g_src"))).drop("g_src").withColumn("at", F.least(at, F.col("ranges") - 1))
    upto = W.partitionBy("src").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy("src", "at", "rest").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    cut_range = sums.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))).select(F.col("src").alias("c_src"), F.col("at").alias("c_at"), "before")
    cut_range = staged.put(cut_range, 1)

    # The rows of one range a source: sort by key, and find the key at which the budget ends.
    rows = ranged.join(small(cut_range, n), F.col("src").eqNullSafe(F.col("c_src")) & (F.col("at") == F.col("c_at")))
    keys = rows.groupBy("src", "rest", "before", "key").agg(F.sum("size").alias("words"), F.count("*").alias("same"))
    within = W.partitionBy("src").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    keys = keys.withColumn("start", F.col("before") + F.coalesce(F.sum("words").over(within), F.lit(0)))
    cuts = keys.where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("words")))
    cuts = cuts.select(F.col("src").alias("k_src"), F.col("key").alias("cut"), F.floor((F.col("rest") - F.col("start")) / F.col("same")).cast("long").alias("cut_words"))
    plan = goals.join(cuts, F.col("src").eqNullSafe(F.col("k_src")), "left")
    plan = plan.select(F.col("src").alias("p_src"), "source_size", "target", F.col("copies").alias("p_copies"), "rest", "cut", "cut_words")
    plan = staged.put(plan, 1)

    out = base.join(small(plan, n), F.col("src").eqNullSafe(F.col("p_src")))
    # Without a cut nothing is left over (a budget of exactly whole copies has its cut at the first key).
    more = F.when(F.col("key") < F.col("cut"), F.col("size")).when(F.col("key") == F.col("cut"), F.least("size", "cut_words")).otherwise(0)
    out = out.withColumn("more", more)
    whole_copy = (F.col("more") == F.col("size")) & (F.col("size") > 0)
    return out.select(
        "row",
        "size",
        "source_size",
        "target",
        (F.col("p_copies") + F.when(whole_copy, 1).otherwise(0)).alias("copies"),
        F.when(whole_copy, 0).otherwise(F.col("more")).cast("long").alias("part"),
        (F.col("p_copies") * F.col("size") + F.col("more")).cast("long").alias("taken"),
    )


def copies(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mixed corpus itself: each row's whole copies, and the cut copy with the text of its words taken."""
    names = mixed.schema["row"].dataType.names
    whole = mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    text = F.regexp_replace(F.col("row").getField(text_col), rf"^[{SPACE}]+", "")
    words = F.split(text, rf"(?<=[{SPACE}])(?=[^{SPACE}])")
    cut = F.array_join(F.slice(words, 1, F.col("part").cast("int")), "")
    cut = mixed.where("part > 0").withColumn("row", F.col("row").withField(f"`{text_col}`", cut)).withColumn("copy", F.col("copies").cast("int") + 1)
    rows = whole.select("row", "copy").unionByName(cut.select("row", "copy"))
    return rows.select(*[F.col("row").getField(n).alias(n) for n in names])
