"""What ranks of a parallel program do together, as aggregates over a rank column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .array import ArrayFrame


def allreduce(df: DataFrame, value: str, how: str, rank: str = "rank") -> DataFrame:
    """(rank, value): every rank with the sum, min or max over ranks; min and max of doubles leave NaN out."""
    v = F.col(value)
    if how not in ("sum", "min", "max"):
        raise ValueError(how)
    if how != "sum" and dict(df.dtypes)[value] in ("float", "double"):
        v = F.when(~F.isnan(v), v)
    total = df.agg(getattr(F, how)(v).alias(value))
    return df.select(rank).distinct().crossJoin(F.broadcast(total))  # one row on the right


def gather(df: DataFrame, value: str, rank: str = "rank") -> DataFrame:
    """One row: the ranks' values in order of rank (one value a rank)."""
    pairs = F.sort_array(F.collect_list(F.struct(rank, value)))
    return df.agg(F.transform(pairs, lambda p: p.getField(value)).alias("gathered"))


def allgather(df: DataFrame, value: str, rank: str = "rank") -> DataFrame:
    """(rank, gathered): every rank with the values of all, in order of rank."""
    return df.select(rank).distinct().crossJoin(F.broadcast(gather(df, value, rank)))  # one row on the right


def barrier(df: DataFrame, rank: str = "rank") -> int:
    """Waits until the rows of all ranks are there; how many ranks came."""
    return df.select(rank).distinct().count()


def bcast(df: DataFrame, value: str, root: int = 0, rank: str = "rank") -> DataFrame:
    one = df.where(F.col(rank) == root).select(F.col(value).alias(value))
    return df.select(rank).distinct().crossJoin(F.broadcast(one))  # one row on the right


def rank_of(key: str | Column, size: int) -> Column:
    return F.pmod(F.col(key) if isinstance(key, str) else key, F.lit(size)).cast("int")


def merge(base: ArrayFrame, log: DataFrame, rank: str = "rank") -> ArrayFrame:
    """Writes of all ranks (coordinates, v, rank) put over an array: replayed in order of rank, the later rank stays."""
    return base.upsert(log.select(*base.names, "v", F.col(rank).alias("ord")))
