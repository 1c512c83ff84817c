"""Toxicity by a learned lexicon, a Levenshtein automaton over its trie, and context windows.

The lexicon (words, and beginnings of words, outside quotation marks) and the weights are learned from labelled rows only. The trie of the lexicon
is intersected with the automaton of one edit; the product is determinised as words pass through it, so a word costs a
few table steps until no entry is within reach, and misspelled terms are found without comparing word pairs. Hits are
then read in their context: between quotation marks they count as quotation, outside as abuse, with the densest window
of `WINDOW` words. A logistic regression turns the counts into a score.

The model is fitted on at most `SAMPLE_ROWS` labelled rows, those with the least hash of doc_id; every document is scored
on its whole text. For the weights, each half of the sample is read with the lexicon of the other half, so that words
that one half only happens to have do not count as evidence.

Defined cases: null and empty texts have no hits and get the score of a text without hits; rows without a label, with a
null label or held out teach nothing; without any labelled rows, or with one class only, the score is the share of toxic
labels (0 if none); repeated rows are scored alike; a null doc_id is not held out. Only `doc_id`, `text` and labels'
`doc_id`, `toxic` are read.
"""

from __future__ import annotations

import functools
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgate.llm.common import Scratch, by_bytes, on_workers

SAMPLE_ROWS = 20_000
#: An entry must tell toxic from clean texts with this G statistic and be toxic in this share of its texts.
LEAST_G, LEAST_SHARE = 16.0, 0.8
#: The lexicon's size at most, by G.
ENTRIES = 2_000
#: Shortest beginning that can be an entry, and shortest entry that is also found with one edit.
LEAST_START, LEAST_EDITED = 4, 5
WINDOW = 20
CACHE_WORDS = 100_000
THRESHOLD = 0.7

WORDS = re.compile(r"[^\W_]+")
#: Pairs of quotation marks; those that open and close alike are counted by parity.
PAIRED, ALIKE = (("“", "”"), ("«", "»"), ("„", "“")), ('"',)

MARKS = frozenset("".join([*ALIKE, *(a + b for a, b in PAIRED)]))

EXACT, START, EDITED = 1, 2, 3


class Automaton:
    """Words within one edit of an entry, or that begin with an entry of the other kind.

    A state is a set of (trie node, edits left, or the mark of a finished start). States and steps are made on demand.
    """

    def __init__(self, words: list[str], starts: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]  # length of the word that ends here
        self.opens: list[bool] = [False]
        for entries, is_word in ((words, True), (starts, False)):
            for entry in entries:
                node = 0
                for ch in entry:
                    if ch not in self.children[node]:
                        self.children[node][ch] = len(self.children)
                        self.children.append({})
                        self.ends.append(0)
                        self.opens.append(False)
                    node = self.children[node][ch]
                if is_word:
                    self.ends[node] = len(entry)
                else:
                    self.opens[node] = True
        self.numbers: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.kinds: list[int] = []
        self.dead = self._state(frozenset())
        self.begin = self._state(self._closed({(0, 1)}))
        self.known: dict[str, int] = {}

    def _closed(self, members: set[tuple[int, int]]) -> frozenset:
        """With what is reached by leaving out one character of an entry."""
        more = {(child, 0) for node, left in members if left for child in self.children[node].values()}
        return frozenset(members | more)

    def _state(self, members: frozenset) -> int:
        if members not in self.numbers:
            self.numbers[members] = len(self.members)
            self.members.append(members)
            self.steps.append({})
            if any(left == 1 and self.ends[node] for node, left in members):
                kind = EXACT
            elif any(left == 2 for _, left in members):
                kind = START
            else:
                kind = EDITED if any(self.ends[node] >= LEAST_EDITED for node, left in members if left == 0) else 0
            self.kinds.append(kind)
        return self.numbers[members]

    def _step(self, state: int, ch: str) -> int:
        after = set()
        for node, left in self.members[state]:
            if left == 2:
                after.add((node, 2))
                continue
            child = self.children[node].get(ch)
            if child is not None:
                after.add((child, left))
                if left == 1 and self.opens[child]:
                    after.add((child, 2))
            if left == 1:
                after.add((node, 0))
                after.update((other, 0) for other in self.children[node].values())
        more = {(child, 0) for node, left in after if left == 1 for child in self.children[node].values()}
        self.steps[state][ch] = out = self._state(frozenset(after | more))
        return out

    def kind(self, word: str) -> int:
        """0, EXACT, START or EDITED."""
        state, steps = self.begin, self.steps
        for ch in word:
            after = steps[state].get(ch)
            state = self._step(state, ch) if after is None else after
            if state == self.dead:
                return 0
        return self.kinds[state]

    def hits(self, words: set[str]) -> dict[str, int]:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for word in words.difference(known):
            known[word] = self.kind(word)
        return {w: k for w in words if (k := known[w])}


@functools.lru_cache(maxsize=2)
def automaton(words: tuple[str, ...], starts: tuple[str, ...]) -> Automaton:
    return Automaton(list(words), list(starts))


def quoted(text: str, at: int) -> bool:
    """Whether `at` lies between quotation marks of its line."""
    begin = text.rfind("\n", 0, at) + 1
    if any(text.count(mark, begin, at) % 2 for mark in ALIKE):
        return True
    return any(text.rfind(a, begin, at) > text.rfind(b, begin, at) for a, b in PAIRED if a != b)


def features(text: str, machine: Automaton) -> list[float]:
    """Counts of hits by kind and context, from the whole text."""
    low = text.lower()
    words = WORDS.findall(low)
    hits = machine.hits(set(words))
    if not hits:
        return [0.0] * 6
    counts, places = {(k, q): 0 for k in (EXACT, START, EDITED) for q in (False, True)}, []
    for i, m in enumerate(WORDS.finditer(low)):
        if kind := hits.get(m[0]):
            inside = quoted(low, m.start())
            counts[kind, inside] += 1
            if kind != EDITED and not inside:
                places.append(i)
    dense = max((bisect_right(places, p + WINDOW - 1) - i for i, p in enumerate(places)), default=0)
    abuse, quotation = counts[EXACT, False] + counts[START, False], counts[EXACT, True] + counts[START, True]
    return [math.log1p(abuse), math.log1p(quotation), math.log1p(counts[EDITED, False]), float(min(abuse, 2)),
            math.log1p(dense), min(1.0, 20 * abuse / len(words))]


def _sample_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        words, toxic, half = [], [], []
        for text, t, h in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "half")), strict=True):
            low = text.lower()
            own = {m[0] for m in WORDS.finditer(low) if not quoted(low, m.start())} if MARKS.intersection(low) else set(WORDS.findall(low))
            words += own
            toxic += [t] * len(own)
            half += [h] * len(own)
        yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "toxic": pa.array(toxic, pa.int32()), "half": pa.array(half, pa.int32())})


def _sample_features(batches: Iterator[pa.RecordBatch], lexicons: list[tuple]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        rows = [features(t, automaton(*lexicons[1 - h])) for t, h in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "x": pa.array(rows, pa.list_(pa.float64()))})


def _scores(batches: Iterator[pa.RecordBatch], lexicon: tuple, weights: list[float]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        x = np.array([features(t, automaton(*lexicon)) for t in batch.column("text").to_pylist()]).reshape(-1, 6)
        score = 1 / (1 + np.exp(-(x @ np.array(weights[1:]) + weights[0])))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Bias and weights by Newton steps; counts of abuse cannot speak for a clean text."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)]) * len(x) / 10
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(len(w))
        w = w - np.linalg.solve(hessian, x.T @ (p - y) + penalty @ w)
        w[1:] = np.maximum(w[1:], 0)
    return w


def _lexicon(counts: DataFrame, totals: dict[str, int], column: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Entries that tell the classes apart, from texts per word and class. At most `ENTRIES` rows reach the driver."""
    toxic, clean = F.col(f"toxic_{column}"), F.col(f"clean_{column}")
    share = totals[f"toxic_{column}"] / max(1, totals[f"toxic_{column}"] + totals[f"clean_{column}"])

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    def chosen(df: DataFrame) -> DataFrame:
        n = toxic + clean
        g = 2 * (part(toxic, n * share) + part(clean, n * (1 - share)))
        return df.withColumn("g", g).filter((F.col("g") >= LEAST_G) & (toxic >= LEAST_SHARE * n))

    starts = counts.filter(toxic > 0).select("word").withColumn(
        "start", F.explode(F.sequence(F.lit(LEAST_START), F.greatest(F.lit(LEAST_START), F.length("word") - 1))))
    starts = starts.filter(F.length("word") > F.col("start")).select(F.expr("left(word, start)").alias("start")).distinct()
    every = counts.withColumn("at", F.explode(F.sequence(F.lit(LEAST_START), F.greatest(F.lit(LEAST_START), F.length("word"))))).select(
        F.expr("left(word, at)").alias("start"), toxic, clean)
    every = every.join(starts, "start", "left_semi").groupBy("start").agg(F.sum(toxic).alias(f"toxic_{column}"), F.sum(clean).alias(f"clean_{column}"))
    words = [r["word"] for r in chosen(counts).orderBy(F.desc("g"), "word").limit(ENTRIES).select("word").collect()]
    found = [r["start"] for r in chosen(every).orderBy(F.desc("g"), "start").limit(ENTRIES).select("start").collect()]
    return tuple(sorted(words)), tuple(sorted(found))


def learn(scratch: Scratch, docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[tuple, list[float]]:
    """Lexicon and weights from the rows that are not held out."""
    known = labels.filter("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    known = F.broadcast(known)  # at most sample_rows ids, so that no text but the sample's is shuffled
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(known, "doc_id")
    sample = sample.groupBy("text").agg(F.min(F.struct("doc_id", "toxic")).alias("first")).select("text", "first.*")  # copies count once
    sample = sample.select("text", "toxic", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)).cast("int").alias("half"))
    sample = scratch.write(sample)
    sides = {f"{c}_{h}": (F.col("toxic") == t) & ((F.col("half") == h) if h != "all" else F.lit(True))
             for c, t in (("toxic", 1), ("clean", 0)) for h in (0, 1, "all")}
    ones = [F.sum(on.cast("long")).alias(k) for k, on in sides.items()]
    totals = {k: v or 0 for k, v in sample.agg(*ones).first().asDict().items()}
    if not totals["toxic_all"] or not totals["clean_all"]:
        share = totals["toxic_all"] / max(1, totals["toxic_all"] + totals["clean_all"])
        return ((), ()), [math.log(max(share, 1e-9) / max(1 - share, 1e-9)), *[0.0] * 6]
    counts = scratch.write(sample.mapInArrow(on_workers(_sample_words), "word string, toxic int, half int").groupBy("word").agg(*ones))
    halves, lexicon = [_lexicon(counts, totals, h) for h in ("0", "1")], _lexicon(counts, totals, "all")
    rows = sample.mapInArrow(on_workers(_sample_features, halves), "toxic int, x array<double>").toPandas()  # at most sample_rows rows
    x, y = np.array(rows["x"].tolist()).reshape(-1, 6), rows["toxic"].to_numpy(float)
    order = np.lexsort([y, *x.T])  # sums in one order, so that reruns agree to the last bit
    weights = fit_logistic(x[order], y[order])
    scratch.drop(sample, counts)
    return lexicon, weights.tolist()


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`."""
    lexicon, weights = learn(Scratch(docs.sparkSession, "toxicity"), docs, labels, sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    scored = texts.mapInArrow(on_workers(_scores, lexicon, weights), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _clean(batches: Iterator[pa.RecordBatch], lexicon: tuple, weights: list[float], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        x = np.array([features(t or "", automaton(*lexicon)) for t in batch.column("text").to_pylist()]).reshape(-1, 6)
        score = 1 / (1 + np.exp(-(x @ np.array(weights[1:]) + weights[0])))
        yield batch.filter(pa.array(score < threshold))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of `docs` that score below the threshold."""
    lexicon, weights = learn(Scratch(docs.sparkSession, "toxicity"), docs, labels, sample_rows)
    return docs.mapInArrow(on_workers(_clean, lexicon, weights, threshold), docs.schema)


def op9_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
