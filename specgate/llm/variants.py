"""Spelling variants of the words of a corpus: words one edit apart, and the frequent form that each of them stands for.

Near words are found by asymmetric chunks. The shorter word of a pair (the lesser one if they are equally long) contributes
two disjoint chunks, its halves; the other one contributes its positional grams of the same sizes. One edit lies in one half
and leaves the other as it is: a chunk before the edit stands at its own place, one behind it at a shift of the difference
in length, zero or one. So the grams within that shift are joined with the chunks on (length, place, chunk), and the pairs
are verified. A pair belongs to the half in which the two words first differ, so it is found once.

A chunk that many words share would compare them all. Where chunk and grams make more than `HOT` pairs, the same is done in
the half that is left: one edit leaves one of its two halves as it is, and that joins the chunk. This goes on until no chunk
is hot or the part left is one character, where every pair is a real one. Nothing is dropped and no group meets in one task.

Defined cases: a null or empty text has no words; a null doc_id counts as no digits; repeated rows count again; an empty table
gives no rows; among near words of equal count the smallest in code-point order is the form; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specgate.llm.common import Scratch

#: Runs of letters; the upper ones of ASCII are lowered.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS, LEAST_COUNT = 5, 3
#: One run in so many, by its hash, gets a letter removed.
MISSPELT = 97
#: A form is at least so many times as frequent.
RATIO = 2
#: Pairs of one chunk that are verified without a further split.
HOT = 4096
KEY = ["length", "low", "high", "chunk"]


def counted_words(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, misspelt: int = MISSPELT) -> DataFrame:
    """word and n, how often it occurs in all texts."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text").filter(F.col("text").isNotNull())
    runs = texts.select("doc", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % misspelt == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _kept(word: Column, low: Column, high: Column) -> Column:
    """What stands before and behind a part."""
    return F.concat(F.substring(word, F.lit(1), low), F.substring(word, high + 1, F.length(word)))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice, with the edit in the first and in the second half of its part; `chunk` is what stays as it is.

    `low` and `high` bound the part in the word that contributes chunks; in the other one it is longer by `shift`.
    """
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    parts = F.explode(F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high"))))
    rows = rows.select("word", "shift", "length", parts.alias("part")).select("word", "shift", "length", "part.*")
    return rows.withColumn("chunk", _kept(F.col("word"), F.col("low"), F.col("high") + F.coalesce("shift", F.lit(0))))


def near_pairs(scratch: Scratch, words: DataFrame, hot: int = HOT) -> DataFrame:
    """a, b: all pairs of distinct words of the column `word` that differ by one edit, each pair once, a not the longer one."""
    # `shift` is null for the word that contributes chunks
    size = F.length("word")
    roles = F.explode(F.array(*[F.struct(s.cast("int").alias("shift"), (size - F.coalesce(s, F.lit(0))).alias("length"))
                                for s in (F.lit(None), F.lit(0), F.lit(1))]))
    rows = words.select("word", roles.alias("role")).select("word", "role.*", F.lit(0).alias("low"), F.col("role.length").alias("high"))
    found = None
    while True:
        rows = scratch.write(_halves(rows))
        chunk = F.col("shift").isNull()
        sizes = rows.groupBy(*KEY).agg(F.count_if(chunk).alias("n_chunks"), F.count_if(~chunk).alias("n_grams"))
        large = (F.col("n_chunks") * F.col("n_grams") > hot) & (F.col("high") - F.col("low") > 1)
        sizes = sizes.filter("n_chunks * n_grams > 1").select(*KEY, large.alias("hot"))
        placed = scratch.write(rows.join(sizes, KEY))
        scratch.drop(rows)
        cold = placed.filter(~F.col("hot"))
        a = cold.filter(chunk).select(*KEY, F.col("word").alias("a"))
        b = cold.filter(~chunk).select(*KEY, F.col("word").alias("b"), "shift")
        # past the part both words go on alike, so words that first differ behind it belong to the next part
        first = (F.col("high") == F.col("length")) | (F.substring("a", F.lit(1), F.col("high")) != F.substring("b", F.lit(1), F.col("high")))
        pairs = a.join(b, KEY).filter(first & ((F.col("shift") == 1) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
        pairs = scratch.write(pairs.select("a", "b"))
        found = pairs if found is None else found.unionByName(pairs)
        rest = placed.filter("hot")
        if rest.isEmpty():
            return found
        rows = rest.select("word", "shift", "length", "low", "high")


def forms(scratch: Scratch, words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n and root of every row of (word, n)."""
    pairs = near_pairs(scratch, words)
    ends = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"))))
    links = pairs.select(ends.alias("link")).select("link.*")
    links = links.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = links.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    taken = -F.col("best.less") >= ratio * F.col("n")
    found = scratch.write(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best.other")).alias("form"),
        F.when(taken, -F.col("best.less")).alias("form_n")))
    return found.join(_roots(scratch, found), "word")


def _roots(scratch: Scratch, found: DataFrame) -> DataFrame:
    """word and root. A form is `RATIO` times as frequent as its word, so chains are short and no chain is a ring."""
    root = scratch.write(found.select("word", F.coalesce("form", "word").alias("root"), F.col("form").isNotNull().alias("moved")))
    while not root.filter("moved").isEmpty():
        # only words that are not their own root have a row to join: the others end a chain
        further = root.filter(F.col("root") != F.col("word")).select(F.col("word").alias("root"), F.col("root").alias("next"))
        root = scratch.write(root.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
    return root.select("word", "root")


def op12_asymmetric_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "variants")
    words = scratch.write(counted_words(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return forms(scratch, words).select("word", "form", "root", "n", "n_near", "form_n")


#: Near words in SQL: equal after one character is left out of each at the same place, or of the longer one.
SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, _: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b) ORDER BY b) AS t
  FROM (SELECT CAST(range AS BIGINT) AS b FROM range(256))),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS run
  FROM documents),
counted AS (SELECT doc, run, count(*) AS k FROM runs GROUP BY ALL),
bytes AS (
  SELECT *, flatten(list_transform(list_transform(string_split(doc || ':' || run, ''), lambda c: CAST(unicode(c) AS BIGINT)),
    lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 + (u >> 6), 128 + u % 64] END)) AS b
  FROM counted),
hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(b, lambda c, x: xor(t[CAST(xor(c, x) % 256 AS INT) + 1], c >> 8), CAST(4294967295 AS BIGINT))) AS h
  FROM bytes, crc_table),
spelt AS (
  SELECT CASE WHEN h % {MISSPELT} = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2)
    ELSE run END AS word, k
  FROM hashed),
words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n, length(word) AS l FROM spelt WHERE length(word) >= {LEAST_CHARS}
  GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
gaps AS (SELECT word, n, l, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, l + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.l = b.l AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN gaps b ON a.word = b.rest
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS most, arg_min(other, (-other_n, other)) AS other FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {RATIO} * n THEN other END AS form,
    CASE WHEN most >= {RATIO} * n THEN most END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS reached, 0 AS step FROM forms
  UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON f.word = c.reached WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(reached, step) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
