"""Spelling variants against plain loops over all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from specgate.llm import variants
from specgate.llm.common import Scratch
from tests.llm.conftest import edge_rows


def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words_of(rows) -> Counter:
    found = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return Counter({w: n for w, n in found.items() if len(w) >= 5 and n >= 3})


def plain_forms(words: dict[str, int]) -> dict:
    out = {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v)) if others else None
        form = best if best is not None and words[best] >= 2 * n else None
        out[w] = [n, len(others), form, form and words[form]]
    for w in out:
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        out[w].append(root)
    return out


def check(spark, words: dict[str, int]):
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    got = variants.forms(Scratch(spark, "test"), frame).collect()
    assert len(got) == len(words)
    assert {r["word"]: [r["n"], r["n_near"], r["form"], r["form_n"], r["root"]] for r in got} == plain_forms(words)


def test_pairs_with_hot_chunks(spark):
    """All pairs are found once, however far the chunks are split."""
    r = random.Random(6)
    words = {"".join(r.choice("abé") for _ in range(r.randint(5, 8))) for _ in range(500)}
    words |= {"longstart" * 3 + "".join(r.choice("abcà") for _ in range(4)) for _ in range(150)}
    words |= {"".join(r.choice("ab") for _ in range(3)) + "longending" * 2 for _ in range(20)}
    words |= {"aaaaa", "aaaaaa", "aaaaaaa", "x" * 500, "x" * 501, "x" * 250 + "y" + "x" * 250}
    frame = spark.createDataFrame([(w,) for w in sorted(words)], "word string").repartition(4)
    want = {(a, b) for a in words for b in words if near(a, b) and (len(a), a) < (len(b), b)}
    for hot in (1, 50, 1_000_000):
        pairs = [tuple(p) for p in variants.near_pairs(Scratch(spark, "test"), frame, hot).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_forms_and_roots(spark):
    r = random.Random(8)
    words = {"".join(r.choice("abc") for _ in range(r.randint(5, 7))): r.randint(3, 4_000) for _ in range(300)}
    words |= {"chainaaa": 3, "chainaab": 6, "chainabb": 12, "chainbbb": 24, "chbinbbb": 48, "alonewordhere": 9, "tiedwords": 3, "tiedwordt": 8, "tiedwordu": 8}
    check(spark, words)


def test_words(spark, edges, empty):
    assert {r["word"]: r["n"] for r in variants.counted_words(edges).collect()} == words_of(edge_rows())
    scratch = Scratch(spark, "test")
    assert variants.forms(scratch, scratch.write(variants.counted_words(empty))).count() == 0


def test_removed_letters(documents_of):
    rows = [(k, "Straße ÀÉÎ× aZ9Word word's " * 2 + "x", "en", "a") for k in range(300)] + [(None, "Straße zz", "en", "a")]
    assert {r["word"]: r["n"] for r in variants.counted_words(documents_of(rows)).collect()} == words_of(rows)
    assert set(words_of(rows)) > {"straße"}
