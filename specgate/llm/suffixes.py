"""Repeated passages by sparse suffix arrays.

A suffix is retained where the hash of its first `KEY` words is the least among `least - KEY + 1` neighbouring positions.
The choice depends on the words alone, so every repeated passage of `least` words or more keeps the same suffix in all its
copies, with at least `KEY` words of the passage behind it. Suffixes whose first words nobody else has are dropped; the
others are sorted by key and place. Each stands for all windows of `least` words around its first words, so every window
that two texts share is hashed at the same suffix of both, and all its places but the earliest are marked; longer passages
are covered by the overlapping windows.

Documents of equal text are compared once; the later ones are repeated as a whole. The sort is by ranges of (key,
place), so a passage that a third of all documents share is dealt over many tasks; the earliest windows of the first and
last key of each range then are compared across ranges.

Words are maximal runs of characters other than space and the controls from tab to carriage return, without regard to
A-Z or a-z. Defined cases: null, empty and short texts (fewer than `least` words) repeat nothing; repeated rows of one id
are one document; a passage repeated inside a document marks its later places; an empty table gives an empty result. Only
`doc_id` and `text` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specgate.llm.common import Scratch, by_bytes, join_counted, on_workers
from specgate.llm.shingles import mix64, words_of, _powers

LEAST = 50
KEY = 25
BATCH_BYTES = 1 << 20

PLACE = "key long, doc_id long, pos int"
SUFFIX = "key long, doc_id long, pos int, after binary, before binary"
MATCH = "doc_id long, start int, end int, source_doc_id long, window long"


def _retained(words: np.ndarray, first: np.ndarray, key: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of retained suffixes in the joined words of a batch, and the hashes of their first words."""
    n = len(words) - key + 1
    window = least - key + 1
    if n < 1:
        return np.zeros(0, "i8"), np.zeros(0, "u8")
    power, inverse = _powers(1 << max(10, (len(words) + 1).bit_length()))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * power[: len(words)], dtype="u8")])
    keys = mix64((sums[key:] - sums[:-key]) * inverse[:n])
    room = np.repeat(first[1:], np.diff(first))[:n] - np.arange(n)  # words left in the document
    rank = np.where(room >= key, keys >> np.uint64(1), np.uint64(1 << 63))
    if n < window:
        return np.zeros(0, "i8"), np.zeros(0, "u8")
    least_at = np.argmin(np.lib.stride_tricks.sliding_window_view(rank, window), axis=1)
    at = np.unique(least_at + np.arange(len(least_at)))
    at = at[room[at] >= key]
    return at, keys[at]


def _places(batches: Iterator[pa.RecordBatch], key: int, least: int) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text", BATCH_BYTES):
        words, _, _, first = words_of(batch.column("text"))
        at, keys = _retained(words, first, key, least)
        row = np.searchsorted(first, at, "right") - 1
        yield pa.RecordBatch.from_arrays([
            pa.array(keys.view("i8")), batch.column("doc_id").take(pa.array(row)), pa.array((at - first[row]).astype("i4"))],
            names=["key", "doc_id", "pos"])


def _contexts(batches: Iterator[pa.RecordBatch], key: int, least: int) -> Iterator[pa.RecordBatch]:
    """The suffixes at the given positions, with the words around their first ones as big-endian 32-bit hashes."""
    reach = least - key
    for batch in by_bytes(batches, "text", BATCH_BYTES):
        words, _, _, first = words_of(batch.column("text"))
        short = (words >> np.uint64(32)).astype(">u4")
        out: tuple[list, ...] = ([], [], [], [], [])
        power, inverse = _powers(1 << max(10, (len(words) + 1).bit_length()))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(words * power[: len(words)], dtype="u8")])
        for row, (doc, positions) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("positions").to_pylist(), strict=True)):
            low, high = first[row], first[row + 1]
            own = short[low:high]
            at = np.asarray(positions, "i8") + low
            out[0].append(mix64((sums[at + key] - sums[at]) * inverse[at]).view("i8"))
            for pos in positions:
                out[1].append(doc)
                out[2].append(pos)
                out[3].append(own[pos + key : pos + key + reach].tobytes())
                out[4].append(own[max(0, pos - reach) : pos][::-1].tobytes())
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate(out[0]) if out[0] else np.zeros(0, "i8")), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()),
            pa.array(out[3], pa.binary()), pa.array(out[4], pa.binary())], names=["key", "doc_id", "pos", "after", "before"])


def _windows(rows: pa.RecordBatch, key: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of `least` words around each suffix's first words, by the number of its words before them, and
    which of these windows the text has."""
    reach = least - key
    sums, sizes = [], []
    for side in ("before", "after"):
        raw = rows.column(side).to_pylist()
        table = np.frombuffer(b"".join(c.ljust(4 * reach, b"\0") for c in raw), ">u4").reshape(len(raw), reach).astype("u8")
        power = _powers(1 << 10 if reach < 1 << 10 else 1 << reach.bit_length())[0][:reach]
        sums.append(np.concatenate([np.zeros((len(raw), 1), "u8"), np.cumsum(mix64(table) * power, axis=1, dtype="u8")], axis=1))
        sizes.append(np.array([len(c) // 4 for c in raw])[:, None])
    before = np.arange(reach + 1)
    keys = mix64(rows.column("key").to_numpy().view("u8"))[:, None] + before.astype("u8")
    return mix64(mix64(mix64(keys) + sums[0]) + sums[1][:, ::-1]), (before <= sizes[0]) & (reach - before <= sizes[1])


def _compare(batches: Iterator[pa.RecordBatch], key: int, least: int) -> Iterator[pa.RecordBatch]:
    """Marks every window that stands earlier too, of suffixes sorted by key and place. The earliest windows of the
    partition's first and last key come along with their hash, for the comparison across partitions."""
    names = ["doc_id", "start", "end", "source_doc_id", "window"]
    held = [np.zeros(0, t) for t in ("u8", "i8", "i8", "i8")]  # earliest windows of the key that goes on: hash, doc_id, pos, words before
    first_key = last_key = None
    first_open = True

    def edge(hashes: np.ndarray, docs: np.ndarray, pos: np.ndarray, before: np.ndarray) -> pa.RecordBatch:
        start = (pos - before).astype("i4")
        return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(start), pa.array(start + np.int32(least)), pa.nulls(len(docs), pa.int64()),
                                           pa.array(hashes.view("i8"))], names=names)

    for batch in batches:
        if not len(batch):
            continue
        keys, docs, pos = (batch.column(f).to_numpy() for f in ("key", "doc_id", "pos"))
        if last_key is not None and last_key != keys[0]:
            if first_open:
                yield edge(*held)
                first_open = False
            held = [h[:0] for h in held]
        first_key = keys[0] if first_key is None else first_key
        hashes, there = _windows(batch, key, least)
        row, before = np.nonzero(there)
        every = [np.concatenate(x) for x in zip(held, (hashes[row, before], docs[row], pos[row].astype("i8"), before), strict=True)]
        _, earliest, which = np.unique(every[0], return_index=True, return_inverse=True)
        source, at = (x[earliest[which]][len(held[0]) :] for x in every[1:3])
        later = (source != docs[row]) | (at != pos[row])
        row_of, before_of = row[later], before[later]
        marked = np.unique(row_of)
        most, fewest, least_source = np.zeros(len(batch), "i8"), np.full(len(batch), least), np.full(len(batch), np.iinfo("i8").max)
        np.maximum.at(most, row_of, before_of)
        np.minimum.at(fewest, row_of, before_of)
        np.minimum.at(least_source, row_of, source[later])
        yield pa.RecordBatch.from_arrays([
            pa.array(docs[marked]), pa.array((pos[marked] - most[marked]).astype("i4")), pa.array((pos[marked] + least - fewest[marked]).astype("i4")),
            pa.array(least_source[marked]), pa.nulls(len(marked), pa.int64())], names=names)
        kept = np.sort(earliest)
        of = np.concatenate([np.full(len(held[0]), keys[0]), keys[row]])[kept]
        if first_open and keys[-1] != first_key:
            yield edge(*(x[kept[of == first_key]] for x in every))
            first_open = False
        held, last_key = [x[kept[of == keys[-1]]] for x in every], keys[-1]
    if last_key is not None:
        yield edge(*held)


def repeated_passages(docs: DataFrame, least: int = LEAST, key: int = KEY) -> DataFrame:
    """doc_id, start_word, n_words, source_doc_id: stretches of words that stand, as parts of passages of at least
    `least` words, at an earlier place too (by doc_id, then position); source_doc_id is the least id they were found in."""
    if not 0 < key <= least:
        raise ValueError("key must be from 1 to least")
    scratch = Scratch(docs.sparkSession, "suffixes")
    digest = F.md5(F.col("text").cast("binary"))
    known = docs.filter("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text")
    narrow = scratch.write(known.select("doc_id", digest.alias("digest"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("n")))
    first = narrow.groupBy("digest").agg(F.min("doc_id").alias("source_doc_id"))
    copies = narrow.filter(F.col("n") >= least).join(first, "digest").filter("doc_id > source_doc_id")

    places = scratch.write(known.mapInArrow(on_workers(_places, key, least), PLACE))
    shared = places.groupBy("key").agg(F.count("*").alias("f")).filter("f > 1")
    copied = copies.select("doc_id").distinct()
    kept = join_counted(places, shared, "key", places.count()).groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("positions"))
    kept = scratch.write(kept.join(copied, "doc_id", "left_anti"))

    suffixes = known.join(kept.hint("shuffle_hash"), "doc_id").mapInArrow(on_workers(_contexts, key, least), SUFFIX)
    suffixes = scratch.write(suffixes)
    scratch.drop(places, kept)
    ordered = suffixes.repartitionByRange("key", "doc_id", "pos").sortWithinPartitions("key", "doc_id", "pos")
    found = scratch.write(ordered.mapInArrow(on_workers(_compare, key, least), MATCH))
    place = F.struct("doc_id", "start")
    across = found.filter("window IS NOT NULL").withColumn("earliest", F.min(place).over(Window.partitionBy("window"))).filter(place > F.col("earliest"))
    across = across.select("doc_id", "start", "end", F.col("earliest.doc_id").alias("source_doc_id"))
    spans = found.filter("window IS NULL").select("doc_id", "start", "end", "source_doc_id").unionByName(across)
    spans = spans.unionByName(copies.select("doc_id", F.lit(0).alias("start"), F.col("n").cast("int").alias("end"), "source_doc_id"))

    so_far = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.when(F.coalesce(F.col("start") > F.max("end").over(so_far), F.lit(True)), 1).otherwise(0)
    spans = spans.groupBy("doc_id", "start", "end").agg(F.min("source_doc_id").alias("source_doc_id")).withColumn("begins", begins)
    spans = spans.withColumn("nth", F.sum("begins").over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy("doc_id", "nth").agg(F.min("start").alias("start_word"), F.max("end").alias("end"), F.min("source_doc_id").alias("source_doc_id"))
    scratch.drop(suffixes)
    return merged.select("doc_id", "start_word", (F.col("end") - F.col("start_word")).alias("n_words"), "source_doc_id")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text", BATCH_BYTES):
        _, starts, ends, first = words_of(batch.column("text"))
        out = []
        for row, (text, spans) in enumerate(zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist(), strict=True)):
            if text is not None and spans:
                raw, at, kept = text.encode(), 0, []
                for span in sorted(spans, key=lambda s: s["start_word"]):
                    kept.append(raw[at : starts[first[row] + span["start_word"]]])
                    at = ends[first[row] + span["start_word"] + span["n_words"] - 1]
                text = b"".join([*kept, raw[at:]]).decode()
            out.append(text)
        names = [n for n in batch.schema.names if n != "_spans"]
        yield batch.select(names).set_column(names.index("text"), "text", pa.array(out, pa.string()))


def without_repeats(docs: DataFrame, least: int = LEAST, key: int = KEY) -> DataFrame:
    """The rows and columns of `docs`; repeated passages are cut from the later documents, the earliest keeps its own."""
    spans = repeated_passages(docs, least, key).groupBy("doc_id").agg(
        F.collect_list(F.struct("start_word", "n_words")).alias("_spans"))
    return docs.join(spans.hint("shuffle_hash"), "doc_id", "left").select(*docs.columns, "_spans").mapInArrow(
        on_workers(_cut), docs.schema)


def op6_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
