"""Rearranged documents against regular expressions and plain slices."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from specgate.llm import infill
from tests.llm.conftest import edge_rows

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def test_places_equal_regex():
    r = random.Random(4)
    texts = ["", "a", " ", "ab cd", "é\n", "\U0001F600x\U0001F600", "x" * 5_000, " " * 5_000]
    texts += ["".join(r.choice(["word", "X", " ", "\n", "é", "\U0001F600", "1"]) for _ in range(n)) for n in (10, 100, 1_000, 40_000)]
    for text in texts:
        units = infill.SkipList(text)
        ends = [m.end() for m in UNIT.finditer(text)]
        places = [0, *ends]
        assert units.n_units == len(ends) and units.n_points == len(text)
        for rank in {0, len(ends), *(r.randint(0, len(ends)) for _ in range(300))}:
            assert units.place(rank) == places[rank]


def plain(doc_id, text):
    """Form, units, code points and output by slices of the list of units."""
    text, units = text or "", UNIT.findall(text or "")
    n = len(units)
    hexa = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexa[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or h3 % 100 >= 90 or any(m in text for m in ("<P>", "<S>", "<M>")):
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_rows_and_restored(edges, empty, documents_of):
    r = random.Random(9)
    near = ["<", "<P", "P>", "<S", "S>", "<M", "M>", ">", "a", " ", "é"]
    rows = [*edge_rows(), (20, "has <M> inside", "en", "a"), (21, "<P>", "en", "a")]
    rows += [(100 + k, "".join(r.choice(near) for _ in range(r.randint(0, 9))), "en", "a") for k in range(400)]
    frame = infill.fill_in_middle(documents_of(rows, clashing=True).repartition(3))
    got = frame.withColumn("restored", infill.restored(F.col("output"), F.col("form"))).collect()
    assert sorted([tuple(x)[:6] for x in got], key=repr) == sorted([plain(*x[:2]) for x in rows], key=repr)
    texts = {x[0]: x[1] or "" for x in rows}
    assert all(x["restored"] == texts[x["doc_id"]] for x in got)
    assert {x["form"] for x in got} == {"plain", "spm", "psm"}
    assert infill.fill_in_middle(empty).count() == 0
    assert infill.fill_in_middle(edges).count() == len(edge_rows())
