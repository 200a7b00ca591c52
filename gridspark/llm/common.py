"""Shared helpers of the llm operators: tables, staged intermediates, bounded joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import shared_dir

#: The characters that separate words: space and the ASCII controls tab to carriage return.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: A dimension table is broadcast up to this many rows; beyond it the join shuffles.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of whole texts that one Arrow batch may hold.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def in_batches(texts: DataFrame) -> DataFrame:
    """The same rows; the session's Arrow batches are made small enough that whole texts, however long, fit a worker's memory many times over."""
    conf = texts.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key, None)
        if now is None or not str(now).lstrip("-").isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return texts


#: Result rows of groups that go back together.
GROUPED_ROWS = 10_000


def _new(b: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """The rows but the first that differ from the one before in a key (nulls are equal)."""
    new = np.zeros(b.num_rows - 1, bool)
    for k in keys:
        x, y = b.column(k).slice(1), b.column(k).slice(0, b.num_rows - 1)
        new |= pc.or_(pc.fill_null(pc.not_equal(x, y), False), pc.xor(pc.is_null(x), pc.is_null(y))).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new) + 1


def by_group(rows: DataFrame, keys: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], ddl: str) -> DataFrame:
    """What f returns for the rows of each group, like groupBy().applyInPandas(); keys are columns without an order of their own (no structs, no NaN).

    Spark 4.1.2 keeps the Arrow buffers of every grouped Python task allocated until its executor ends, about 32 KB a column, so memory grows
    with the number of tasks. mapInArrow frees them, and its batches are bounded where those of a group are not."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        out: list[pa.Table] = []
        n = 0

        def take() -> int:
            """The held rows are a whole group."""
            group = pa.Table.from_batches(held)
            held.clear()
            got = pa.Table.from_pandas(f(group.to_pandas()), schema=schema, preserve_index=False)
            if got.num_rows:
                out.append(got)
            return got.num_rows

        for b in batches:
            if not b.num_rows:
                continue
            if held and any(held[-1].column(k)[-1].as_py() != b.column(k)[0].as_py() for k in keys):
                n += take()
            cuts = [0, *_new(b, keys).tolist(), b.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if i:
                    n += take()
                held.append(b.slice(i, j - i))
                if n >= GROUPED_ROWS:
                    yield from pa.concat_tables(out).combine_chunks().to_batches()
                    out.clear()
                    n = 0
        if held:
            n += take()
        if n:
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    return in_batches(rows.repartition(*keys).sortWithinPartitions(*keys)).mapInArrow(run, ddl)


class Staged:
    """Tables written to the shared folder to cut lineage; `drop` removes those no longer read, the rest goes when the session's JVM ends.

    deleteOnExit takes only paths that exist, so the folder is made first."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        path = self._path(self.root)
        fs = path.getFileSystem(self._conf())
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def put(self, df: DataFrame, partitions: int | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        (df.coalesce(partitions) if partitions else df).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Deletes all its tables; nothing may read them any more."""
        path = self._path(self.root)
        path.getFileSystem(self._conf()).delete(path, True)

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
                path = self._path(f)
                path.getFileSystem(self._conf()).delete(path, True)


def col(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(base: str, taken: list[str]) -> str:
    """`base`, or with underscores added until no column has that name (Spark ignores case)."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base += "_"
    return base


def small(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast only when the counted rows are within the bound."""
    return F.broadcast(df) if rows <= bound else df


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
