"""Token files and packing against the tokenizers library and plain loops."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from specgate.llm import packing, token_files
from specgate.llm.common import Scratch
from specgate.llm.encoding import default_path, encoder
from tests.llm.conftest import edge_rows


def ids_of(text: str | None, end: int) -> np.ndarray:
    return np.array([*encoder(default_path()).tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def twins() -> list[str]:
    """Pairs of texts, each the other one with two letters swapped, that sums of powers modulo 2^64 do not tell apart."""
    bits = [bin(k).count("1") & 1 for k in range(8_192)]
    return ["".join(letters[b] for b in bits[:n]) for n in (512, 1_024, 2_048, 4_096, 8_192) for letters in ("ab", "ba")]


def test_encoder_equals_library():
    r = random.Random(3)
    parts = ["a", "Bc", "é", " ", "\n", ".", ",", "\t", "'s", "1", "!!", " ", " ", "<|endoftext|>", "“", "\r", "\x1c", "日"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(4000)] + [None, ""]
    texts += ["a" * n + c for n in range(14, 19) for c in ("", "b", "\0", "\0\0", " \0")] + twins()
    ids, offsets = encoder(default_path()).encode(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == ids_of(text, 0)[:-1].tolist(), text


def test_codes_round_trip():
    r = np.random.default_rng(1)
    for ids in (np.zeros(0), np.arange(5), r.integers(0, 50_257, 20_011), r.integers(0, 1 << 32, 9_000), np.full(5_000, 255)):
        ids = ids.astype("u4")
        reader = token_files.Reader(token_files.encode_ids(ids))
        assert len(reader) == len(ids)
        places = r.permutation(len(ids))
        assert (reader.get(places) == ids[places]).all()


def test_token_files(spark, edges, empty):
    for frame, rows in ((edges, edge_rows()), (empty, [])):
        scratch = Scratch(spark, "test")
        got = token_files.read_documents(scratch, token_files.write_files(scratch, frame, file_ids=100)).orderBy("start").collect()
        want, start = [], 0
        for doc, text, *_ in sorted(rows, key=lambda x: (x[0] is not None, x[0])):
            ids = ids_of(text, token_files.END)
            want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        assert [tuple(r)[:4] for r in got] == want


def test_packing(edges, empty):
    assert packing.pack(empty).count() == 0
    got = packing.pack(edges).collect()
    whole: dict[int, list] = {}
    for r in got:
        whole.setdefault(r["row_id"], []).append(r)
    found = Counter()
    for pieces in whole.values():
        pieces.sort(key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        assert all(p["length"] == packing.LENGTH for p in pieces[1:])
        found[pieces[0]["doc_id"], tuple((p["start"], p["length"], p["ids_crc32"]) for p in pieces)] += 1
    want = Counter()
    for doc, text, *_ in edge_rows():
        ids, parts, start = ids_of(text, packing.END), [], 0
        while start < len(ids):
            n = (len(ids) - start) % packing.LENGTH or packing.LENGTH
            parts.append((start, n, zlib.crc32(ids[start : start + n].tobytes())))
            start += n
        want[doc, tuple(parts)] += 1
    assert found == want
    sequences: dict[int, list] = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= packing.LENGTH


def test_plan_is_best_fit():
    """The plan by runs gives as many sequences as best fit, document by document, in order of falling length."""
    r = random.Random(5)
    for most, n in ((10, 40), (1024, 500), (1024, 3_000)):
        lengths = [r.randint(1, most) for _ in range(n)]
        gaps: list[int] = []
        for length in sorted(lengths, reverse=True):
            fit = [g for g in gaps if g >= length]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - length)
            else:
                gaps.append(most - length)
        lines = packing.plan(Counter(lengths), most)
        assert 1 + max(first + (end - start - 1) // each for _, start, end, first, each, _ in lines) == len(gaps)
        assert Counter({k: sum(e - s for n_, s, e, *_ in lines if n_ == k) for k in set(lengths)}) == Counter(lengths)
