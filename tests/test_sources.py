"""Readers, incremental ingest and page choice on real files and odd documents: rows in are rows out."""

from __future__ import annotations

from pathlib import Path

import hashlib
import os
import time

from specgate.operators import pages as P
from specgate.sources import readers as S
from specgate.streaming import ingest as I


def put(folder, name: str, content: bytes, days: int = 0) -> None:
    (folder / name).write_bytes(content)
    when = time.time() - 86400 * days
    os.utime(folder / name, (when, when))


def test_scan_files(spark, tmp_path):
    for name in ("1-a b.pdf", "2-C.Pdf", "3-d.JPEG", "4-e+f %41.pNg", "5-g.txt", "6-h i.jpg"):
        put(tmp_path, name, name.encode())
    got = {r["filename"]: r["sha256"] for r in S.scan_files(spark, str(tmp_path)).collect()}
    names = {"a_b.pdf": "1-a b.pdf", "C.Pdf": "2-C.Pdf", "d.JPEG": "3-d.JPEG", "e+f_%41.pNg": "4-e+f %41.pNg", "h_i.jpg": "6-h i.jpg"}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in names.items()}


def test_file_stream(spark, tmp_path):
    """An old file that comes late, a copy, and restarts: every content exactly once."""
    source, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()

    def ingest() -> list[str]:
        return sorted(r["filename"] for r in I.ingest_available(I.file_stream(spark, str(source)), target, state, "path").collect())

    put(source, "1-new.pdf", b"new")
    assert ingest() == ["new.pdf"]
    put(source, "2-old.Pdf", b"old", days=30)
    put(source, "3-copy.png", b"new")
    put(source, "4-twin.png", b"old")
    assert ingest() == ["new.pdf", "old.Pdf"]
    assert ingest() == ["new.pdf", "old.Pdf"]
    I.compact(spark, target)
    assert ingest() == ["new.pdf", "old.Pdf"] and len(list(Path(target).rglob("*.parquet"))) == 2


def test_no_document_vanishes(spark):
    """Good and rejected documents together are all documents."""
    grid = '{"pages": [{"page": 1, "grid": "a"}]}'
    cases = {
        S.rejected_extractions: (S.parse_extractions, ['{"items": [{"name": "a"}]}', "not json", '{"items": 5}', '{"items": []}', None, ""], 1),
        S.rejected_grids: (S.read_grids, [grid, "not json", '{"error": "no table"}', '{"pages": []}', None], 1),
        S.rejected_tokens: (S.tokens_from_json, ['[{"text": "a", "x": 1}]', "[", "[]", "5", None], 1),
    }
    for rejected, (good, documents, n) in cases.items():
        df = spark.createDataFrame(list(enumerate(documents)), "doc_id long, json string")
        kept = {r["doc_id"] for r in good(df).collect()}
        bad = {r["doc_id"]: r["reason"] for r in rejected(df).collect()}
        assert len(kept) == n and kept | set(bad) == set(range(len(documents))) and not kept & set(bad), rejected
        assert bad[1] == "not json" and None not in bad.values()


def test_read_tokens(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"text": "x", "score": 0.5, "x": 1, "y": 2, "y1": 1, "y2": 3, "x2": 4},\n {"text": "y"}]')
    got = S.read_tokens(spark, str(tmp_path)).orderBy("token_seq").collect()
    assert [(r["filename"], r["token_seq"], r["text"], r["x2"]) for r in got] == [("a.json", 0, "x", 4.0), ("a.json", 1, "y", None)]


def test_page_choice(spark):
    rows = [(1, 1, "text-layer", "x" * 400), (1, 1, "tesseract", "t"), (1, 2, "text-layer", "thin"), (1, 3, "rapidocr", "y" * 60), (1, 4, "tesseract", "")]
    chosen = P.select_page_text(spark.createDataFrame(rows, "doc_id long, page int, engine string, text string"))
    good, refused = P.strict_split(chosen)
    assert {r["page"]: r["engine"] for r in good.collect()} == {1: "text-layer", 3: "rapidocr"}
    assert {r["page"]: (r["engine"], r["error"]) for r in refused.collect()} == {
        2: (None, "no readable text"), 4: ("tesseract", "primary recognition missing or thin")}
    missing = P.missing_images(chosen, chosen.where("page < 3")).collect()
    assert sorted(r["page"] for r in missing) == [3, 4]
