"""Near-duplicate embeddings by spherical-cap filters with structured random product codes.

Vectors are scaled to length one and turned by a fixed random rotation. A filter is a pair of code words, one for each
half of the coordinates; it takes the vectors whose inner product with the pair reaches a threshold, a spherical cap. The
code has CODE x CODE filters, but a vector's filters are list-decoded from 2 x CODE inner products: code words of the
first half in falling order, each with the leading code words of the second half. Vectors that share a filter and a label
meet in an equi-join, in which a 64-bit sketch of signs must agree too; the pairs left are verified in double precision.

The threshold gives a vector `FILTERS` filters on average. A pair at cosine 0.98 shares about 0.7 of them, and differs
in 4 signs of 64 on average where 20 may, so missing one is very unlikely; tests measure the recall. Equal vectors of a
label are one class, compared once and counted by its size, so copies make no pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label,
link with nothing; vectors of different length do not link; short vectors are decoded with zeros behind them; repeated rows are vectors of one class; an empty table gives
an empty result. Only `vec_id`, `embedding`, `label` are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgate.llm.common import Scratch, on_workers
from specgate.llm.components import components

CODE = 512
FILTERS = 56.0
SIGNS_APART = 20
LEAST = 0.98
#: Shorter vectors get zeros up to this length before the rotation.
LEAST_DIM = 16
#: Vectors that a worker decodes at once.
ROWS = 512

POST = "class long, label int, dim int, filter int, signs long"


@functools.cache
def code(dim: int, size: int, filters: float) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, float]:
    """Rotation, code words of both halves, sign directions, and the threshold, for vectors of `dim` components."""
    random = np.random.default_rng(dim)
    turn = np.linalg.qr(random.standard_normal((dim, dim)))[0]
    halves = []
    for d in (dim // 2, dim - dim // 2):
        words = random.standard_normal((size, d))
        halves.append(words / np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1e-300))
    signs = random.standard_normal((dim, 64))
    probe = random.standard_normal((400, dim))
    probe /= np.linalg.norm(probe, axis=1, keepdims=True)
    low, high = (probe[:, : dim // 2] @ halves[0].T, probe[:, dim // 2 :] @ halves[1].T)
    top = min(size * size, 4096)
    scores = np.concatenate([np.partition((a[:, None] + b[None, :]).ravel(), -top)[-top:] for a, b in zip(low, high, strict=True)])
    keep = min(len(scores), int(filters * len(probe)))
    return turn, halves, signs, float(np.partition(scores, -keep)[-keep])


def decode(units: np.ndarray, size: int, filters: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of every filter whose cap holds a row's vector, its nearest filter in any case."""
    turn, halves, _, least = code(units.shape[1], size, filters)
    turned, d = units @ turn, units.shape[1] // 2
    low, high = turned[:, :d] @ halves[0].T, turned[:, d:] @ halves[1].T
    order = np.argsort(-high, axis=1)
    rows, found = [], []
    for r in range(len(units)):
        own = min(least, low[r].max() + high[r, order[r, 0]])
        first = np.flatnonzero(low[r] >= own - high[r, order[r, 0]])
        falling = -high[r, order[r]]
        counts = np.searchsorted(falling, low[r, first] - own, "right")
        n = int(counts.sum())
        place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
        found.append(np.repeat(first, counts) * size + order[r, place])
        rows.append(np.full(n, r))
    return np.concatenate(rows), np.concatenate(found)


def _posts(batches: Iterator[pa.RecordBatch], size: int, filters: float) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, len(whole), ROWS):
            batch = whole.slice(at, ROWS)
            vectors = batch.column("embedding").to_pylist()
            dims = np.array([len(v) for v in vectors])
            ids, labels = (batch.column(c).to_numpy() for c in ("class", "label"))
            for dim in np.unique(dims):
                at_dim = np.flatnonzero(dims == dim)
                x = np.array([vectors[i] for i in at_dim], "f8")
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                x = np.pad(x, ((0, 0), (0, max(0, LEAST_DIM - int(dim)))))
                signs = np.packbits(x @ code(x.shape[1], size, filters)[2] > 0, axis=1).view("i8")[:, 0]
                row, found = decode(x, size, filters)
                own = at_dim[row]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[own], pa.int64()), pa.array(labels[own], pa.int32()), pa.array(np.full(len(own), dim), pa.int32()),
                    pa.array(found, pa.int32()), pa.array(signs[row], pa.int64())], names=["class", "label", "dim", "filter", "signs"])


def _verified(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, len(whole), ROWS):
            batch, keep = whole.slice(at, ROWS), []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.array(x, "f8"), np.array(y, "f8")
                keep.append(bool(x @ y / np.sqrt((x @ x) * (y @ y)) >= least))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def near_vectors(vectors: DataFrame, least: float = LEAST, size: int = CODE, filters: float = FILTERS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors`."""
    scratch = Scratch(vectors.sparkSession, "caps")
    rows = vectors.select("vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<float>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    usable = F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    classes = scratch.write(rows.filter(usable).groupBy("label", "embedding").agg(
        F.min("vec_id").alias("class"), F.count("*").alias("size")))
    posts = scratch.write(classes.select("class", "label", "embedding").mapInArrow(on_workers(_posts, size, filters), POST))
    other = posts.select(F.col("class").alias("b"), F.col("label").alias("l"), F.col("dim").alias("d"), F.col("filter").alias("f"), F.col("signs").alias("s"))
    meet = (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")) & (F.col("filter") == F.col("f")) & (F.col("class") < F.col("b"))
    pairs = posts.join(other, meet & (F.bit_count(F.col("signs").bitwiseXOR(F.col("s"))) <= SIGNS_APART))
    pairs = pairs.select(F.col("class").alias("a"), "b").distinct()
    x, y = (classes.select(F.col("class").alias(i), F.col("embedding").alias(v)) for i, v in (("a", "x"), ("b", "y")))
    links = scratch.write(pairs.join(x, "a").join(y, "b").mapInArrow(on_workers(_verified, least), "a long, b long"))
    scratch.drop(posts)
    sizes = classes.select("class", "size")
    ends = links.union(links.select("b", "a")).toDF("class", "other").join(sizes.toDF("other", "linked"), "other")
    counts = ends.groupBy("class").agg(F.sum("linked").alias("linked"))
    named = sizes.join(counts, "class", "left").join(components(scratch, links).withColumnRenamed("v", "class"), "class", "left").select(
        "class", (F.coalesce("linked", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "class").alias("component_id"))
    owners = classes.select(F.col("label").alias("l"), F.col("embedding").alias("e"), "class").join(named, "class").drop("class")
    found = rows.join(owners, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")), "left")
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                        F.coalesce("component_id", "vec_id").alias("component_id"),
                        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"))


def op1_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
