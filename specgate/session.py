"""Session defaults. A cluster sets its own master, memory and checkpoint folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "specgate", cpus: str | None = None) -> SparkSession:
    """Local session for tests and the benchmark; on a cluster use the session it provides."""
    spark = (
        SparkSession.builder.master(f"local[{cpus or os.environ.get('BENCH_CPUS', '8')}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", os.environ.get("BENCH_CPUS", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "10g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster. Only a local session may fall back to a temporary one."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if configured is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return configured or sc.getCheckpointDir()


_written: list[tuple[SparkSession, str]] = []


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Intermediate tables go when the application ends; what it returned has been read or written elsewhere by then."""
    if not _written:
        atexit.register(_delete_written)
    _written.append((spark, path))


def _delete_written() -> None:
    for spark, path in _written:
        try:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        except Exception:  # noqa: BLE001  the session has ended before; clearing is left to the cluster
            return


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate result that several branches read to the shared folder.

    It survives lost executors and cuts the lineage. Files of repeating keys are many times smaller than their rows in
    memory, and by file size the planner would send millions of rows through the driver, so joins with it sort and merge.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/specgate-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")
