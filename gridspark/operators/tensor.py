"""Small dense algebra over ArrayFrames: products are joins on the shared axis and sums, the rest is column arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import types as G
from ..errors import SelectionError
from ..extents import Extents
from .array import BROADCAST_POINTS, ArrayFrame


def matmul(a: ArrayFrame, b: ArrayFrame) -> ArrayFrame:
    """The product of two matrices, in double precision; missing cells count as zero. b is broadcast only by its size."""
    if a.ndim != 2 or b.ndim != 2 or a.shape[1] != b.shape[0]:
        raise SelectionError(f"{a.shape} times {b.shape}")
    right = b.df.select(F.col("d0").alias("d1"), F.col("d1").alias("j"), F.col("v").cast("double").alias("w"))
    right = F.broadcast(right) if b.size <= BROADCAST_POINTS else right
    df = a.df.join(right, "d1").groupBy("d0", F.col("j").alias("d1")).agg(F.sum(F.col("v").cast("double") * F.col("w")).alias("v"))
    return ArrayFrame(df.select("d0", "d1", "v"), Extents.of((a.shape[0], b.shape[1])), G.F64)


def each(a: ArrayFrame, f) -> ArrayFrame:
    """A column expression put on every stored value."""
    return ArrayFrame(a.df.withColumn("v", f(F.col("v"))), a.extents, a.type, a.fill, a.chunk)


def relu(a: ArrayFrame) -> ArrayFrame:
    return each(a, lambda v: F.greatest(v, F.lit(0).cast(a.type.spark())))
