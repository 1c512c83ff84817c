"""The piece encoder and decoder against the sentencepiece library."""

from __future__ import annotations

import hashlib
import random

from specgate.llm import pieces
from tests.llm.conftest import edge_rows

ALPHABET = [*"abcdehnorst", " ", "  ", "   ", "\n", "1", "2", ".", "é", "ü", "日", "本", "\U0001F600", "▁", "\t", "\x00", "\r\n",
            "the", "ing", "ation", "　", "​", "�", "<s>", "</s>", "<0x41>", "<unk>"]


def test_encode_equals_library():
    model, r = pieces.pieces(pieces.default_path()), random.Random(1)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(1, 14))) for _ in range(20_000)]
    texts += [" " * n + "x" * (n % 3) for n in range(1, 70)] + [c * n for c in "a▁日\n1" for n in (1, 2, 3, 50, 5_000)]
    texts += ["ab" * 20_000, "thethethe" * 3_000, "".join(r.choice("abcdefgh") for _ in range(50_000))]
    for text in texts:
        ids = model.encode(text).tolist()
        assert ids == model.model.encode(text), text[:50]
        assert model.decode([*ids, model.end]) == model.model.decode(ids) == text.replace("▁", " ")


def test_whole_text_is_one_chunk():
    """Without cuts the result is the same."""
    model, r = pieces.pieces(pieces.default_path()), random.Random(2)
    for _ in range(2_000):
        text = "".join(r.choice(ALPHABET) for _ in range(r.randint(1, 40)))
        tokens = model.tokens_of(model.model.normalize(text))
        assert [i for t in tokens for i in model.ids[t]] == model.encode(text).tolist()


def test_decode_equals_library_on_any_ids():
    model, r = pieces.pieces(pieces.default_path()), random.Random(3)
    for _ in range(20_000):
        pool = (0, 1, 2, 3, 13, r.randint(3, 258), r.randint(195, 258), r.randint(259, 31_999), 259, 29_871)
        ids = [r.choice(pool) for _ in range(r.randint(0, 8))]
        assert model.decode(ids) == model.model.decode(ids), ids


def test_rows(edges, empty):
    library = pieces.pieces(pieces.default_path()).model
    got = pieces.decode(pieces.encode(edges)).collect()
    want = []
    for doc, text, *_ in edge_rows():
        ids = library.encode(text or "")
        want.append((doc, text, [*ids, 2], library.decode(ids)))
    assert sorted([(r["doc_id"], r["text"], r["piece_ids"], r["decoded"]) for r in got], key=repr) == sorted(want, key=repr)
    assert set(edges.columns) < set(got[0].asDict())
    assert pieces.decode(pieces.encode(empty)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    library = pieces.pieces(pieces.default_path()).model
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "")
        digest = hashlib.sha256(" ".join(map(str, [*ids, 2])).encode()).hexdigest()
        want.add((r["doc_id"], len(ids) + 1, digest, hashlib.sha256(library.decode([*ids, 2]).encode()).hexdigest()))
    assert {tuple(r) for r in pieces.op11_piece_backtracking(spark, sf).collect()} == want
