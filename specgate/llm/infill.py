"""Documents rearranged for fill-in-the-middle training, and restored from the rearranged text.

A text is a row of units: a run of A-Z and a-z, or any other single character. Two unit ranks, drawn from a hash of the
document's id, cut it into prefix, middle and suffix. An indexable skip list over the units finds where a rank lies: every
lane's nodes carry how many units and how many code points they span, and the descent adds both until the rank is met.
A unit's height follows from a hash of its number, so the same text always gives the same list.

Forms: `psm` is <P>prefix<S>suffix<M>middle, `spm` is <S>suffix<P>prefix<M>middle, `plain` is the text as it is. A text
that is empty or holds one of the marks stays plain. No mark ends as another begins, so the first mark found after the one
before it is the real one, and the text can be restored from output and form alone.

Defined cases: a null text is empty; a null doc_id counts as no digits; repeated rows are rearranged alike, each for itself;
an empty table gives no rows; other columns are not read. Texts of any length are cut whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specgate.llm.common import by_bytes, on_workers

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
SEED = 1
#: Documents of 100 that are rearranged, and of these the ones of 100 in the order suffix, prefix, middle.
REARRANGED, SUFFIX_FIRST = 90, 20
#: A node reaches the next lane with a chance of one in 2^LANE_BITS.
LANE_BITS = 5
#: Nodes of a lane that a descent adds up at once.
STRIDE = 64
_LETTER = np.zeros(128, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class SkipList:
    """The units of a text, found by rank."""

    def __init__(self, text: str) -> None:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        letter = _LETTER[np.minimum(points, 127)]
        first = ~letter
        first[1:] |= ~letter[:-1]
        first[:1] = True
        places = np.flatnonzero(first)
        self.n_units, self.n_points = len(places), len(points)
        units = np.arange(self.n_units)
        mixed = (units.astype("u4") * np.uint32(0x9E3779B1)) ^ np.uint32(0x85EBCA6B)
        heights = (mixed * np.uint32(0xC2B2AE35)) >> np.uint32(7)
        self.lanes = []
        lane = 0
        while len(units):
            down = np.searchsorted(below, units) if lane else None
            self.lanes.append((np.diff(units, append=self.n_units), np.diff(places[units], append=self.n_points), down))
            below, lane = units, lane + 1
            up = heights[units] & np.uint32((1 << LANE_BITS) - 1) == 0
            heights = heights >> np.uint32(LANE_BITS)
            if len(units) < STRIDE or not up[1:].any():
                break
            up[0] = True  # the head stands in every lane
            units = units[up]

    def place(self, rank: int) -> int:
        """The code points before the unit of this rank; those of the whole text for the rank after the last."""
        if rank >= self.n_units:
            return self.n_points
        node, place = 0, 0
        for units, points, down in reversed(self.lanes):
            while True:  # along the lane, as long as whole nodes lie before the rank
                reach = np.cumsum(units[node : node + STRIDE])
                steps = int(np.searchsorted(reach, rank, "right"))
                if steps:
                    rank -= int(reach[steps - 1])
                    place += int(points[node : node + steps].sum())
                    node += steps
                if steps < len(reach) or node == len(units):
                    break
            if down is not None:
                node = int(down[node])
        return place


def rearrange(doc_id: int | None, text: str, seed: int, rearranged: int, suffix_first: int) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, output."""
    units = SkipList(text)
    n = units.n_units
    hexa = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexa[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or h3 % 100 >= rearranged or any(mark in text for mark in MARKS):
        return n, "plain", None, None, text
    low, high = (units.place(rank) for rank in sorted((h1 % (n + 1), h2 % (n + 1))))
    before, middle, after = text[:low], text[low:high], text[high:]
    if h4 % 100 < suffix_first:
        return n, "spm", low, high - low, f"{SUFFIX}{after}{PREFIX}{before}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{before}{SUFFIX}{after}{MIDDLE}{middle}"


ROWS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _rearranged(batches: Iterator[pa.RecordBatch], seed: int, rearranged: int, suffix_first: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in ROWS.split(", ")]
    for batch in by_bytes(batches, "text"):
        ids = batch.column("doc_id").to_pylist()
        rows = [rearrange(i, t or "", seed, rearranged, suffix_first) for i, t in zip(ids, batch.column("text").to_pylist(), strict=True)]
        columns = [ids, *(list(c) for c in zip(*rows, strict=True))]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def fill_in_middle(docs: DataFrame, seed: int = SEED, rearranged: int = REARRANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(on_workers(_rearranged, seed, rearranged, suffix_first), ROWS)


def _split(text: Column, mark: str) -> tuple[Column, Column]:
    """What stands before the first mark, and behind it."""
    at = F.instr(text, mark)
    return F.substring(text, F.lit(1), at - 1), F.substring(text, at + len(mark), F.length(text))


def restored(output: Column, form: Column) -> Column:
    """The text that output and form were made from."""
    body = F.substring(output, F.lit(1 + len(PREFIX)), F.length(output))
    before, rest = _split(body, SUFFIX)
    after, middle = _split(rest, MIDDLE)
    psm = F.concat(before, middle, after)
    after, rest = _split(body, PREFIX)
    before, middle = _split(rest, MIDDLE)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(before, middle, after))


def op13_skip_list_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


_H = [f"CAST('0x' || substr(sha, {1 + 8 * i}, 8) AS BIGINT)" for i in range(4)]
SQL = f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
    sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS sha
  FROM documents),
ranks AS (
  SELECT *, len(units) AS n, {_H[0]} % (len(units) + 1) AS r1, {_H[1]} % (len(units) + 1) AS r2,
    CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR {_H[2]} % 100 >= {REARRANGED}
      THEN 'plain' WHEN {_H[3]} % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT *, array_to_string(units[1 : least(r1, r2)], '') AS p, array_to_string(units[least(r1, r2) + 1 : greatest(r1, r2)], '') AS m,
    array_to_string(units[greatest(r1, r2) + 1 :], '') AS s
  FROM ranks)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m
    ELSE '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""
