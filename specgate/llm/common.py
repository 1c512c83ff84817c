"""Helpers shared by the operators: scratch tables, running sums in a global order, worker calls, batches by bytes."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specgate.session import checkpoint_dir, delete_at_exit

#: See join_counted.
HOT_KEYS = 1000
#: Words are maximal runs of characters other than space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of rows that reach a Python worker at once, so that many long texts need no more memory than short ones.
ARROW_BYTES = 8 << 20


class Scratch:
    """Intermediate tables in the cluster's shared folder (`spark.checkpoint.dir`).

    Written tables cut the lineage and survive lost executors. Tables that no returned plan reads are dropped
    as soon as their last reader has run.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/specgate-{name}-{uuid.uuid4().hex}"
        self.n = 0
        delete_at_exit(spark, self.root)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def running(
    scratch: Scratch, df: DataFrame, order: list[str | Column], sums: dict[str, str | Column], by: list[str] | None = None
) -> DataFrame:
    """Adds exclusive running sums `name` and totals `name_total` of integer columns, per group `by`, in `order`.

    The rows are range-partitioned by (by, order) and written once; sums inside a partition are added to the sums
    of the partitions before it. A group of any size is spread over as many partitions as its rows need. Rows that
    tie in `order` get a fixed order by being written. Columns of `by` must not be null.
    """
    by = by or []
    names = [f"_key{i}" for i in range(len(order))]
    keyed = df.select("*", *[(F.col(o) if isinstance(o, str) else o).alias(k) for k, o in zip(names, order, strict=True)],
                      *[(F.col(v) if isinstance(v, str) else v).cast("long").alias(k) for k, v in sums.items()])
    placed = scratch.write(keyed.repartitionByRange(*by, *names)
                           .select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")))
    parts = placed.groupBy("_part", *by).agg(*[F.sum(k).alias(f"_sum_{k}") for k in sums])
    across = Window.partitionBy(*by).orderBy("_part") if by else Window.orderBy("_part")
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    parts = parts.select("_part", *by, *[c for k in sums for c in (
        F.coalesce(F.sum(f"_sum_{k}").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_before_{k}"),
        F.sum(f"_sum_{k}").over(whole).alias(f"{k}_total"))])
    inside = Window.partitionBy("_part", *by).orderBy(*names, "_row").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumns({k: F.coalesce(F.sum(k).over(inside), F.lit(0)) for k in sums})
    return (local.join(parts, ["_part", *by])
            .withColumns({k: F.col(k) + F.col(f"_before_{k}") for k in sums})
            .drop("_part", "_row", *names, *[f"_before_{k}" for k in sums]))


def join_counted(rows: DataFrame, counts: DataFrame, key: str, n_rows: int) -> DataFrame:
    """`rows` joined with their key's row of `counts` (key, f: rows of that key).

    Keys that hold more than one row in `HOT_KEYS` are that many at most, whatever the table: they are broadcast, and
    their rows stay where they are instead of meeting in one task.
    """
    hot = F.broadcast(counts.filter(F.col("f") > n_rows // HOT_KEYS))
    cold = counts.filter(F.col("f") <= n_rows // HOT_KEYS)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def on_workers(function: Callable, *args) -> Callable:
    """`function(batches, *args)` for mapInArrow; workers import it from its module, so its caches live as long as they do."""
    module, name, root = function.__module__, function.__qualname__, str(Path(__file__).resolve().parents[2])

    def call(batches):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.append(root)
        yield from getattr(importlib.import_module(module), name)(batches, *args)
        importlib.import_module("specgate.llm.common").release()

    return call


def release() -> None:
    """Gives freed memory back, so that idle workers hold little while other stages run."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        sizes = [0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()]
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)
