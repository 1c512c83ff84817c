"""Incremental arrival of files: equal contents pass once (A2, streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgate.sources.readers import ACCEPTED_GLOB, clean_name, dedupe_by_content

FILE = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """Accepted files as they arrive. The source would leave out files that are a week older than the newest one."""
    reader = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", ACCEPTED_GLOB)
    d = reader.option("maxFileAge", "36500d").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return d.select("path", clean_name(name).alias("filename"), "modificationTime", F.sha2("content", 256).alias("sha256"))


#: Leading hex digits of the content hash that name a bucket of the ledger.
PREFIX = 2


def _ledger(spark: SparkSession, target: str, digest: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(f"{digest} string, bucket string, batch bigint").option("basePath", target).parquet(target)


def ingest_available(stream: DataFrame, target: str, state: str, order: str, digest: str = "sha256") -> DataFrame:
    """Process everything that has arrived, then stop; restarts continue from `state`. Returns the table at `target`.

    The target is the ledger, in buckets by the first digits of the content hash: a batch reads the buckets of its own
    contents only, keeps the contents that no earlier batch has, one row each (first by `order`), and writes them under its
    own number, so a batch that is run again after a failure replaces itself. No watermark: files of any age are taken, and
    copies are known for ever. `compact` joins the files of former batches.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        batch = batch.withColumn("bucket", F.substring(digest, 1, PREFIX)).persist()
        try:
            buckets = [r[0] for r in batch.select("bucket").distinct().collect()]  # at most 16^PREFIX
            ledger = _ledger(session, target, digest)
            if ledger is None:
                earlier = session.createDataFrame([], f"{digest} string")
            else:
                earlier = ledger.where(F.col("bucket").isin(buckets) & (F.col("batch") < number)).select(digest)
            new = dedupe_by_content(batch, earlier, order, digest).withColumn("batch", F.lit(number))
            new.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket", "batch").parquet(target)
        finally:
            batch.unpersist()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).drop("bucket", "batch")


def compact(spark: SparkSession, target: str) -> None:
    """Joins the files of all batches of a bucket under the latest batch number of that bucket, while no batch runs.

    The joined files are written beside the ledger and take its place at the end, so a failure before leaves it as it was.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    d = spark.read.option("basePath", target).parquet(target)
    latest = d.groupBy("bucket").agg(F.max("batch").alias("batch"))
    joined = d.drop("batch").join(latest, "bucket").repartition("bucket")
    joined.write.partitionBy("bucket", "batch").parquet(f"{target}.compacted")
    old, new, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (target, f"{target}.compacted", f"{target}.former"))
    files = old.getFileSystem(conf)
    files.rename(old, aside)
    files.rename(new, old)
    files.delete(aside, True)
