"""Near duplicates, repeated passages and vectors against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from specgate.llm import caps, minhash, suffixes
from specgate.llm.components import components
from specgate.llm.common import Scratch
from tests.llm.test_tokens import twins
from tests.llm.conftest import edge_rows, prose

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))


def least_labels(vertices, links) -> dict:
    parent = {v: v for v in vertices}

    def root(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {v: root(v) for v in vertices}


def near(rows, n: int, percent: int) -> dict:
    sets = {}
    for doc, text, *_ in rows:
        w = words(text)
        sets[doc] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    ids = [d for d in sets if d is not None]
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {d: (len(sets[d]), c) for d, c in least_labels(ids, links).items()}


def family_rows() -> list[tuple]:
    """Copies of one text with more and more changed words, chains of small changes, and texts that share one line."""
    r, rows = random.Random(9), []
    base = prose(50, 200).split(" ")
    for k in range(120):
        own = list(base)
        for _ in range(k // 8):
            own[r.randrange(len(own))] = prose(1000 + r.randrange(10_000), 1)
        rows.append((k, " ".join(own), "en", "a"))
    chain = prose(51, 150).split(" ")
    for k in range(120, 150):
        chain[r.randrange(len(chain))] = prose(20_000 + k, 1)
        rows.append((k, " ".join(chain), "en", "a"))
    line = prose(52, 40)
    rows += [(k, line + "\n" + prose(300 + k, 60), "en", "b") for k in range(150, 250)]
    return rows


def test_matches():
    assert minhash.least_matches(85, 40) < 34 and minhash.least_matches(80, 40) < minhash.least_matches(85, 40)


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(documents_of, n, percent):
    rows = family_rows()
    got = minhash.near_duplicates(documents_of(rows).repartition(4), n, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near(rows, n, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_swapped_letters(documents_of):
    """Words whose letters are swapped, which sums of powers modulo 2^64 do not tell apart, link with nothing."""
    rows = [(k, f"{text} {text} {text}", "en", "a") for k, text in enumerate(twins())] + [(90, "ab " * 3, "en", "a"), (91, "ba " * 3, "en", "a")]
    assert len({r[1] for r in rows}) == len(rows)
    assert all(r["component_id"] == r["doc_id"] for r in minhash.near_duplicates(documents_of(rows), 3, 85).collect())


def test_near_duplicates_edges(edges, empty):
    got = minhash.near_duplicates(edges, 3, 85).collect()
    assert len(got) == len(edge_rows())
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == near(edge_rows(), 3, 85)
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.without_duplicates(edges)
    assert kept.columns == edges.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted([-1, 1, 2, 3, 4, 5, 8, 9, 10, 11, 12, 14])


def covered(rows, least: int) -> dict[int, set[int]]:
    """Words in windows of `least` words that stand at an earlier place too."""
    seen, out = set(), {}
    for doc, text, *_ in sorted((r for r in {(r[0], r[1]) for r in rows} if r[0] is not None)):
        w = words(text)
        for i in range(len(w) - least + 1):
            window = tuple(w[i : i + least])
            if window in seen:
                out.setdefault(doc, set()).update(range(i, i + least))
            seen.add(window)
    return out


def passage_rows() -> list[tuple]:
    r, rows = random.Random(4), []
    passages = [prose(600 + k, n) for k, n in enumerate((51, 49, 60, 200, 75))]
    for k in range(200):
        text = prose(700 + k, r.randint(5, 90))
        if k % 3 == 0:
            text += "\n" + passages[r.randrange(5)] + "\n" + prose(9_000 + k, r.randint(0, 40))
        rows.append((k, text, "en", "a"))
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_repeated_passages(spark, documents_of, parts):
    rows = passage_rows()
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got: dict[int, set[int]] = {}
        for r in suffixes.repeated_passages(documents_of(rows).repartition(parts)).collect():
            assert r["source_doc_id"] <= r["doc_id"]
            got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["start_word"] + r["n_words"]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    want = covered(rows, suffixes.LEAST)
    assert got.keys() == want.keys()
    assert all(got[d] <= want[d] for d in got)
    assert sum(map(len, got.values())) >= 0.99 * sum(map(len, want.values()))


@pytest.mark.parametrize("parts", [1, 7])
def test_interleaved_leads(spark, documents_of, parts):
    """A shared line after one of two leads, unique words after it: by what follows, copies with one lead are no neighbours."""
    line, leads = prose(800, 35), [prose(801, 20), prose(802, 20)]
    rows = [(k, f"{prose(900 + k, 20)} {leads[k % 2]} {line} {prose(1200 + k, 40)}", "en", "a") for k in range(120)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["doc_id"]: set(range(r["start_word"], r["start_word"] + r["n_words"])) for r in suffixes.repeated_passages(documents_of(rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert got == covered(rows, suffixes.LEAST) and set(got) == set(range(2, 120))


def test_repeats_edges(edges, empty):
    got = {(r["doc_id"], r["start_word"], r["n_words"], r["source_doc_id"]) for r in suffixes.repeated_passages(edges).collect()}
    assert got == {(6, 0, 120, 5), (7, 0, 120, 5), (9, 40, 60, 8)}
    assert suffixes.repeated_passages(empty).count() == 0
    cut = suffixes.without_repeats(edges)
    assert cut.columns == edges.columns
    texts = sorted(((r["doc_id"] or -1, r["text"]) for r in cut.collect()), key=str)
    left = {**{r[0] or -1: r[1] for r in edge_rows()}, 6: "", 7: " ending", 9: prose(5, 40) + "\n\n" + prose(6, 5)}
    assert texts == sorted(((r[0] or -1, left[r[0] or -1]) for r in edge_rows()), key=str)


def test_one_passage_everywhere(documents_of):
    """A passage that all texts share is found in each of them, whatever range of the sort a copy falls into."""
    passage = prose(77, 55)
    rows = [(k, prose(5_000 + k, 30) + " " + passage + " " + prose(6_000 + k, 30), "en", "a") for k in range(300)]
    got = suffixes.repeated_passages(documents_of(rows).repartition(5)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1, 300))
    assert all(55 <= r["n_words"] <= 57 for r in got)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, class string, size string, other string")


def test_near_vectors(spark):
    r, rows = np.random.default_rng(2), []
    for k in range(700):
        x = r.standard_normal(64)
        rows.append((x, int(k % 4)))
        for _ in range(int(k % 7 == 0) * 5):
            y = x / np.linalg.norm(x) + r.standard_normal(64) / 8 * r.uniform(0.05, 0.25)
            rows.append((y * r.uniform(0.5, 2), int(k % 4)))
    rows += [rows[3]] * 40
    table = [(i, [float(np.float32(v)) for v in x], y, "x", "x", "x") for i, (x, y) in enumerate(rows)]
    bad = [(10_001, None, 1), (10_002, [], 1), (10_003, [0.0] * 64, 1), (10_004, [float("nan")] * 64, 1), (10_005, [None] * 64, 1),
           (10_006, [1.0] * 64, None), (10_007, [1.0] * 64, None), (10_008, [float("inf")] * 64, 1), (10_009, [1.0, 2.0], 1), (10_010, [2.0, 4.0], 1)]
    got = {x["vec_id"]: x for x in caps.near_vectors(vectors(spark, table + [(*b, "x", "x", "x") for b in bad]).repartition(3)).collect()}
    m = np.array([x for _, x, *_ in table])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    labels = np.array([t[2] for t in table])
    linked = (m @ m.T >= caps.LEAST) & (labels[:, None] == labels)
    np.fill_diagonal(linked, False)
    names = least_labels(range(len(table)), np.argwhere(np.triu(linked)))
    assert [got[i]["n_links"] for i in range(len(table))] == linked.sum(axis=1).tolist()
    assert [got[i]["component_id"] for i in range(len(table))] == [names[i] for i in range(len(table))]
    for i, *_ in bad:
        assert (got[i]["n_links"], got[i]["component_id"]) == ((1, 10_009) if i in (10_009, 10_010) else (0, i))
    assert caps.near_vectors(vectors(spark, [])).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200)]
    got = {r["v"]: r["component"] for r in components(Scratch(spark, "test"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 130)}, 200: 200}
