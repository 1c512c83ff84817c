"""Mixing sources to target weights by systematic sampling.

Every source gets a target in words: its weight's share of the mix, but never more than `most` times its size; what a
stopped source leaves over is shared again by weight. Inside a source the documents are put in order of size, their
expected copies (target over size of the source, the same for each) are prefix-summed, one random offset per source is
added, and a document is emitted once for each integer that its interval crosses. The order by size makes the sample
hit every stretch of sizes in proportion, so the words taken stay close to the target.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 are
sampled like others and take no words; a source without words has target 0 and emits nothing; repeated rows are
separate documents; an empty table gives an empty mix. Only `doc_id`, `text`, `source` are read, so other columns may
have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specgate.llm.common import WORD, Scratch, running

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target of a table (source, size). The windows run over one row per source.

    With the sources in order of the level at which they stop (most * size / weight), the final level is the first one
    that leaves its own source unstopped when all before it are stopped.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    totals = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank - 1) % len(weights) + 1))
    totals = totals.withColumn("stop", most * F.col("source_size") / F.col("weight"))
    before = Window.orderBy("stop", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    totals = totals.withColumn("level", (
        share * F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    level = F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "level"))).over(everything)["level"]
    return totals.select("source", "source_size",
                         F.least((most * F.col("source_size")).cast("double"), level * F.col("weight")).alias("target"))


def offset_of(source: Column, seed: int) -> Column:
    """The source's random offset in [0, 1), the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 1) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for every row of `docs`; the mix has each row `copies` times."""
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.write(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    grouped = sizes.withColumns({"group": F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))})
    ranked = running(scratch, grouped, ["size", "doc_id"], {"rank": F.lit(1)}, by=["group"])
    targets = source_targets(sizes, weights, share, most).withColumn(
        "group", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).drop("source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = offset_of(F.col("source"), seed)
    copies = F.floor(rate * (F.col("rank") + 1) + offset) - F.floor(rate * F.col("rank") + offset)
    return ranked.join(targets, "group").select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of `docs` themselves, each as often as the mix takes it. Rows must differ in `doc_id` or in nothing.

    Rows that share a `doc_id` are told apart by their rank among equal ids, so repeated rows keep their own copies.
    """
    keep = docs.columns
    by_id = Window.partitionBy("doc_id").orderBy("source", "_size", "_copies")
    chosen = mix(docs, **parameters).select("doc_id", "source", F.col("size").alias("_size"), F.col("copies").alias("_copies"))
    chosen = chosen.withColumn("_nth", F.row_number().over(by_id)).filter("_copies > 0")
    rows = docs.withColumn("_size", n_words(F.col("text")))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("source", "_size"))).drop("_size")
    chosen = chosen.select(F.col("doc_id").alias("_id"), F.col("_nth").alias("_m"), "_copies")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_nth") == F.col("_m"))
    emitted = rows.join(chosen, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return emitted.select(*keep)


def op10_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies",
                        (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sizes GROUP BY source
), stops AS (
  SELECT *, 2 * source_size / weight AS stop FROM totals
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM stops WINDOW before AS (ORDER BY stop, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least((2 * source_size)::DOUBLE, weight * (
    SELECT level FROM levels WHERE level <= stop ORDER BY stop, level LIMIT 1)) AS target
  FROM levels
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1 AS rank,
         ('0x' || substr(md5('1:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
  FROM sizes
), emitted AS (
  SELECT doc_id, r.source, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate, rank, shift
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target,
       (floor(rate * (rank + 1) + shift) - floor(rate * rank + shift))::BIGINT AS copies,
       (floor(rate * (rank + 1) + shift) - floor(rate * rank + shift))::BIGINT * size AS taken
FROM emitted
"""
