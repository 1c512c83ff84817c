from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

#: Names that the operators use inside, as extra columns of the input.
CLASHING = ["rank", "size", "key", "group", "_part", "_row", "f", "n", "tokens", "spans", "positions", "class", "digest", "score", "shard", "copies"]


def prose(seed: int, n: int) -> str:
    """Words of a small invented vocabulary; the same for the same seed."""
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ka", "lo", "mi", "tu", "re", "sa", "no", "pi"]) for _ in range(r.randint(2, 5))) for _ in range(n))


def edge_rows() -> list[tuple]:
    base = prose(1, 120)
    passage = prose(2, 60)
    return [
        (1, None, "en", None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "one", None, "b"), (5, base, "en", "b"), (6, base, "en", None),
        (6, base, "en", None), (7, base + " ending", "de", "c"), (8, prose(3, 30) + " " + passage + " " + prose(4, 30), "en", "c"),
        (9, prose(5, 40) + "\n" + passage.upper() + "\n" + prose(6, 5), "en", "c"), (10, prose(7, 40_000), "en", "d"), (11, "x" * 50_000, "fr", "d"),
        (12, "tie tie tie", "en", "d"), (13, "tie tie tie", "en", "d"), (14, "é “ü”   \U0001F600 <|endoftext|> .,\r\n", "en", "e"), (None, "no id here", "en", "e"),
    ]


@pytest.fixture(scope="session")
def documents_of(spark):
    """A table of documents from (doc_id, text, lang, source), with clashing extra columns on demand."""
    def make(rows: list[tuple], clashing: bool = False):
        fields = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType())]
        fields += [(c, T.StringType()) for c in CLASHING] if clashing else []
        extra = ["x"] * (len(fields) - 5)
        return spark.createDataFrame([(*r, len(r[1] or ""), *extra) for r in rows], T.StructType([T.StructField(*f) for f in fields]))
    return make


@pytest.fixture(scope="session")
def edges(documents_of):
    return documents_of(edge_rows(), clashing=True).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(documents_of):
    return documents_of([], clashing=True)
