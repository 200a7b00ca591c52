"""Streams that grow an array: each micro-batch is appended along the first axis, or written over cells.

State is a table of cells per batch in the shared folder, named by batch id, so a batch that is run again after a failure writes the same folder and nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import types as G
from ..extents import Extents
from ..operators.array import ArrayFrame


def append_batches(stream: DataFrame, order: str, value: str, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends `value` of a stream to a vector in order of `order` within each batch; trigger as for writeStream (availableNow=True by default)."""

    def put(batch: DataFrame, number: int) -> None:
        # The place within a batch is a rank by order: ranges of the order are counted first, so no task holds the batch.
        v = batch.select(F.col(order).alias("o_"), F.col(value).alias("v"))
        ranged = v.repartitionByRange("o_").sortWithinPartitions("o_").withColumn("p_", F.spark_partition_id())
        ranged.write.mode("overwrite").parquet(f"{folder}/cells/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_appended(spark: SparkSession, folder: str, type: G.Type = G.F64) -> ArrayFrame:
    """The vector of all batches so far: sizes of (batch, part) give each part's first place, ranks within parts the rest."""
    cells = spark.read.parquet(f"{folder}/cells")
    parts = cells.groupBy("batch", "p_").agg(F.count("*").alias("n"))
    first = F.coalesce(F.sum("n").over(W.orderBy("batch", "p_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a part
    parts = parts.withColumn("first", first)
    at = F.row_number().over(W.partitionBy("batch", "p_").orderBy("o_")) - 1
    df = cells.withColumn("k_", at).join(parts, ["batch", "p_"]).select((F.col("first") + F.col("k_")).alias("d0"), "v")
    total = parts.agg(F.sum("n")).first()[0] or 0
    return ArrayFrame(df, Extents.of([(total, None)]), type, chunk=(1 << 16,))


def windowed_counts(stream: DataFrame, time: str, length: str, late: str) -> DataFrame:
    """Counts of a stream's rows by tumbling window, late ones within a watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")
