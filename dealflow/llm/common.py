"""Helpers of the operators: shared storage, free column names, joins by a hot key."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (used as pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than 1/HOT_SHARE of all rows is hot; there are fewer than HOT_SHARE such keys.
HOT_SHARE = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a scratch folder only where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _scratch_folder()
    return folder.rstrip("/")


@cache
def _scratch_folder() -> str:
    return tempfile.mkdtemp(prefix="dealflow-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` computed once into a table in the shared folder; it survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def released(*tables: DataFrame) -> None:
    """Delete ``stored`` tables that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until it differs from every column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def columns(df: DataFrame, **named: str) -> DataFrame:
    """Only the given columns of ``df``, renamed: whatever else ``df`` holds cannot clash."""
    return df.select(*[df[f"`{column}`"].alias(name) for name, column in named.items()])


def joined(left: DataFrame, right: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """Inner join with ``right``, which has one row per key and, in ``rows``, its rows in ``left``.

    Keys with more than ``total / HOT_SHARE`` rows are fewer than HOT_SHARE, so their side is
    broadcast, by the driver's list of them, and the hot rows stay where they are. All other keys are joined by a shuffle, in
    which no key has more than that share. ``right`` should be stored, ``left`` cheap to scan.
    """
    limit = total // HOT_SHARE + 1
    hot = right.filter(F.col(rows) > limit)
    keys = [r[0] for r in hot.select(key).collect()]
    if not keys:
        return left.join(right, key)
    cold = left.filter(~F.col(key).isin(keys)).join(right.filter(F.col(rows) <= limit), key)
    return left.join(F.broadcast(hot), key).unionByName(cold)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def chunks(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``size`` bytes of text each, one row at least."""
    values = batch.column(column)
    lengths = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_numpy()
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > size:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if batch.num_rows > start:
        yield batch.slice(start)
