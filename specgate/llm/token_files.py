"""Token ids in directly addressable codes, and random access to any of them.

An id is split into chunks of 8 bits, lowest first, as many as it needs. Level k holds the k-th chunks of all ids that
have one, in order; a bitmap says for each chunk of a level whether its id goes on in the next level. The place there is
the number of set bits before it, which a rank directory gives in constant time: an absolute count every 4096 bits and a
relative one every 64. So the id at any position is read without decoding the ids before it.

A file is one row of the written table: its payload in this format (little endian)

    "DAC1", levels u32, per level: chunks u64, chunk bytes; but for the last level also the bitmap in 64-bit words,
    the absolute counts u64 and the relative counts u16

with the ids, places and lengths of its documents, which are never cut between files. The files follow ascending doc_id.

Defined cases: a null or empty text is its end id alone; repeated rows are separate documents, in the order in which
they were written; a null doc_id comes first; an empty table gives no files. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgate.llm.common import Scratch, by_bytes, on_workers, running
from specgate.llm.encoding import BATCH_BYTES, default_path, encoder

END = 0
#: A file is closed at the first document that takes it to this many ids.
FILE_IDS = 1 << 20
#: Ids that a worker reads back at once.
READ_IDS = 1 << 15
WORD_BITS, BLOCK_BITS = 64, 4096

FILES = "file_part long, file_seq long, n_ids long, payload binary, doc_ids array<long>, starts array<long>, lengths array<long>"


def encode_ids(ids: np.ndarray) -> bytes:
    """The payload of an array of unsigned 32-bit ids."""
    levels, rest = [], ids.astype("<u4", copy=False)
    while True:
        chunks, more = (rest & 255).astype("u1"), rest > 255
        if not more.any():
            levels.append((chunks, None))
            break
        words = np.packbits(more, bitorder="little")
        words = np.pad(words, (0, -len(words) % 8)).view("<u8")
        counts = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype="<u8")])[:-1]
        blocks = counts[:: BLOCK_BITS // WORD_BITS]
        inside = (counts - np.repeat(blocks, BLOCK_BITS // WORD_BITS)[: len(counts)]).astype("<u2")
        levels.append((chunks, (words, blocks.astype("<u8"), inside)))
        rest = rest[more] >> 8
    out = [b"DAC1", len(levels).to_bytes(4, "little")]
    for chunks, marks in levels:
        out += [len(chunks).to_bytes(8, "little"), chunks.tobytes()]
        out += [m.tobytes() for m in marks or ()]
    return b"".join(out)


class Reader:
    """Random access to the ids of one payload."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != b"DAC1":
            raise ValueError("not a file of directly addressable codes")
        n_levels, at = int.from_bytes(payload[4:8], "little"), 8

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, dtype, n, at)
            at += out.nbytes
            return out

        self.levels = []
        for level in range(n_levels):
            n = int(take("<u8", 1)[0])
            chunks, words = take("u1", n), -(-n // WORD_BITS)
            last = level == n_levels - 1
            self.levels.append((chunks, None if last else (take("<u8", words), take("<u8", -(-n // BLOCK_BITS)), take("<u2", words))))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def get(self, positions: np.ndarray) -> np.ndarray:
        """The ids at any positions, in any order."""
        out = np.zeros(len(positions), "<u4")
        rows, at = np.arange(len(positions)), np.asarray(positions, "i8")
        for level, (chunks, marks) in enumerate(self.levels):
            out[rows] |= chunks[at].astype("<u4") << np.uint32(8 * level)
            if marks is None:
                break
            words, blocks, inside = marks
            word, bit = at >> 6, (at & 63).astype("u8")
            own = words[word]
            on = (own >> bit & np.uint64(1)).astype(bool)
            rows, at, word = rows[on], at[on], word[on]
            below = own[on] & ((np.uint64(1) << bit[on]) - np.uint64(1))
            at = (blocks[at >> 12].astype("i8") + inside[word] + np.bitwise_count(below)).astype("i8")
        return out


def _files(batches: Iterator[pa.RecordBatch], path: str, end: int, file_ids: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, seq, tail = TaskContext.get().partitionId(), 0, np.array([end], "u4")
    docs, lengths, held, n_ids = [], [], [], 0

    def close() -> pa.RecordBatch:
        ids = np.concatenate(held)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype("i8")
        return pa.RecordBatch.from_pydict({
            "file_part": pa.array([part], pa.int64()), "file_seq": pa.array([seq], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()),
            "payload": pa.array([encode_ids(ids)], pa.binary()), "doc_ids": pa.array([docs], pa.list_(pa.int64())),
            "starts": pa.array([starts], pa.list_(pa.int64())), "lengths": pa.array([lengths], pa.list_(pa.int64()))})

    for batch in by_bytes(batches, "text", BATCH_BYTES):
        ids, offsets = encoder(path).encode(batch.column("text"))
        for doc, low, high in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            docs.append(doc)
            held += [ids[low:high], tail]
            lengths.append(high - low + 1)
            n_ids += lengths[-1]
            if n_ids >= file_ids:
                yield close()
                docs, lengths, held, n_ids, seq = [], [], [], 0, seq + 1
    if docs:
        yield close()


def write_files(scratch: Scratch, docs: DataFrame, path: str | None = None, end: int = END, file_ids: int = FILE_IDS) -> DataFrame:
    """The table of files of all documents, written in ascending doc_id order."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return scratch.write(ordered.mapInArrow(on_workers(_files, path or default_path(), end, file_ids), FILES))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            reader, crcs, k = Reader(row["payload"]), [], len(row["starts"])
            starts, ends = np.array(row["starts"]), np.array(row["starts"]) + np.array(row["lengths"])
            while len(crcs) < k:  # some documents at once, for speed
                first, low = len(crcs), starts[len(crcs)]
                after = max(first + 1, int(np.searchsorted(ends, low + READ_IDS, "right")))
                ids = memoryview(reader.get(np.arange(low, ends[after - 1])).tobytes())
                crcs += [zlib.crc32(ids[4 * (a - low) : 4 * (b - low)]) for a, b in zip(starts[first:after], ends[first:after], strict=True)]
            yield pa.RecordBatch.from_pydict({
                "file_part": pa.array([row["file_part"]] * k, pa.int64()), "file_seq": pa.array([row["file_seq"]] * k, pa.int64()),
                "doc_id": pa.array(row["doc_ids"], pa.int64()), "place": pa.array(row["starts"], pa.int64()),
                "n_tokens": pa.array(row["lengths"], pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})


def read_documents(scratch: Scratch, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, its ids read by random access from the files."""
    bases = running(scratch, files.select("file_part", "file_seq", "n_ids"), ["file_part", "file_seq"], {"base": "n_ids"})
    found = files.mapInArrow(on_workers(_documents),
                             "file_part long, file_seq long, doc_id long, place long, n_tokens long, ids_crc32 long")
    found = found.join(bases.select("file_part", "file_seq", "base"), ["file_part", "file_seq"])
    return found.select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "file_part", "file_seq")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    return read_documents(scratch, write_files(scratch, spark.read.parquet(f"{sf_dir}/documents.parquet")))
