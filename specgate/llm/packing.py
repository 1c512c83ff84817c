"""Bulk-synchronous best-fit packing of token sequences.

A document's ids and an end id are cut, only if longer than a sequence, into full pieces with the shorter one first. Each
superstep takes the longest unplaced length: its pieces, ranked by a range sort, are matched with the tightest gaps that
hold them (the successor of the length among the gap sizes), the n-th piece with the n-th place by rank so that no two
claim one gap, the gaps shrink, and the next length follows; pieces without a gap open new sequences. This is best fit in
order of falling length, exactly.

Lengths and gaps are whole numbers up to the sequence length, so the sorted documents and the sorted gaps are run-length
encoded: the sweep works on at most 1023 runs of lengths and on runs of gaps, never on rows. A superstep splits at most
one run and opens at most two, and a run's gap at least halves with each match, so a plan has at most about
3 * 1023 * 10 lines, whatever the corpus; it is the only table that is broadcast. Ranks and placement are Spark joins.

Defined cases: a null or empty text is its end id alone; repeated rows are separate documents, told apart by row_id; ties
are ranked in a fixed order; an empty table gives no pieces. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgate.llm.common import Scratch, by_bytes, on_workers, running
from specgate.llm.encoding import BATCH_BYTES, default_path, encoder

LENGTH = 1024
END = 2

PIECES = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end: int, most: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    row, tail = TaskContext.get().partitionId() << 40, np.array([end], "u4")
    for batch in by_bytes(batches, "text", BATCH_BYTES):
        ids, offsets = encoder(path).encode(batch.column("text"))
        out: dict[str, list] = {name.split()[0]: [] for name in PIECES.split(", ")}
        for doc, low, high in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own, start, piece = memoryview(np.concatenate([ids[low:high], tail]).tobytes()), 0, 0
            while start < high - low + 1:
                length = (high - low + 1 - start) % most or most
                crc = zlib.crc32(own[4 * start : 4 * (start + length)])
                for values, value in zip(out.values(), (row, doc, piece, start, length, crc), strict=True):
                    values.append(value)
                start, piece = start + length, piece + 1
            row += 1
        types = {"piece": pa.int32()}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()})


def pieces_of(docs: DataFrame, path: str | None = None, end: int = END, most: int = LENGTH) -> DataFrame:
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(on_workers(_pieces, path or default_path(), end, most), PIECES)


def plan(counts: dict[int, int], most: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """Lines (length, first rank, end rank, first sequence, pieces a sequence takes, offset of the first).

    counts: pieces of each length up to `most`.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, sequences)
    sizes: list[int] = []
    lines, opened = [], 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                bisect.insort(sizes, gap)
                gaps[gap] = []
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            gap = sizes[at] if at < len(sizes) else most
            each = gap // length
            need = -(-left // each)
            if at < len(sizes):
                first, n = gaps[gap].pop()
                if n > need:
                    gaps[gap].append((first + need, n - need))
                    n = need
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            else:
                first, n = opened, need
                opened += need
            placed = min(left, n * each)
            lines.append((length, rank, rank + placed, first, each, most - gap))
            full, over = divmod(placed, each)
            put(gap - each * length, first, full)
            if over:
                put(gap - over * length, first + full, 1)
            rank, left = rank + placed, left - placed
    return lines


def pack(docs: DataFrame, path: str | None = None, end: int = END, most: int = LENGTH) -> DataFrame:
    """row_id, doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of `docs`."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "packing")
    pieces = scratch.write(pieces_of(docs, path, end, most))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `most` rows
    lines = spark.createDataFrame(
        plan(counts, most), "of long, first_rank long, end_rank long, first_sequence long, each long, filled long")
    ranked = running(scratch, pieces, ["row_id", "piece"], {"rank": F.lit(1)}, by=["length"])
    inside = (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank"))
    nth = F.col("rank") - F.col("first_rank")
    return ranked.join(F.broadcast(lines), inside).select(
        "row_id", "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(nth / F.col("each"))).alias("sequence_id"),
        (F.col("filled") + nth % F.col("each") * F.col("length")).alias("offset"))


def op3_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
