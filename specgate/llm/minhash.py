"""Near-duplicate documents by a signature-coordinate inverted join.

Every distinct shingle set has a MinHash signature of `COORDINATES` values. Each (coordinate, value) is a token under
which the set is posted; two sets are candidates if they share at least `MATCHES` tokens, and links are confirmed on the
full sets.

* Documents of one shingle set form a class that is compared once.
* A token that one class alone has matches nothing. Of the others, a class is posted under the rarest ones only: two
  classes with MATCHES tokens in common share one of their COORDINATES - MATCHES + 1 rarest (prefix filter; rarest by
  the count over all classes). Classes with fewer than MATCHES shared tokens are out.
* Hot groups: in rounds every class is compared with the leaders of its postings (first those of most common tokens, then
  any), the nearest one of each foreign component, which joins a large group of copies in linear work. Rounds go on while
  they link one class in `FEW` at least. Only pairs of different components are then joined, under their first common
  token, and only if the shingles that each side shares with any candidate at all could make a link and a sketch of `BITS`
  bits is near enough; these, the count of common tokens and the comparison of the full sets are part of the join
  condition, so no pair but the links that rounds have missed leaves it.

Matches of a pair are binomial in its similarity; MATCHES is the largest number that a pair at the least similarity
misses with a chance of `MISS` at most, so links are complete but for that chance. All else is exact.

Defined cases: null, empty and white-space texts have an empty set, link with nothing and are kept; a text shorter than a
shingle is one shingle; repeated rows are documents of one class; ties take the smallest doc_id; an empty table gives an
empty result. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

import functools
import hashlib
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specgate.llm.common import Scratch, by_bytes, join_counted, on_workers
from specgate.llm.components import components
from specgate.llm.shingles import shingle_hashes, signature, words_of

COORDINATES = 40
#: Rounds of leaders end when they link fewer than one class in so many, and leaders of a token from the second round on.
FEW, LEADERS = 200, 4
#: Chance that a pair at the least similarity has too few matches.
MISS = 2e-6
#: Coordinates of which one bit is kept, for the pairs that leaders leave.
BITS = 1024
#: Bytes of text that a worker turns into hashes at once.
BATCH_BYTES = 1 << 20

SKETCH = "doc_id long, n_shingles long, digest binary, tokens array<long>"
SETS = "doc_id long, digest binary, hashes array<long>, bits array<long>"


def least_matches(percent: int, coordinates: int, miss: float = MISS) -> int:
    """The largest m such that a pair of that similarity has fewer than m matches with a chance of `miss` at most."""
    p, below = percent / 100, 0.0
    for m in range(coordinates + 1):
        below += math.comb(coordinates, m) * p**m * (1 - p) ** (coordinates - m)
        if below > miss:
            return max(1, m)
    return coordinates


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    for batch in by_bytes(batches, "text", BATCH_BYTES):
        words, _, _, first = words_of(batch.column("text"))
        yield batch.column("doc_id").to_pylist(), [shingle_hashes(words[a:b], n) for a, b in zip(first[:-1], first[1:], strict=True)]


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sketches(batches: Iterator[pa.RecordBatch], n: int, coordinates: int) -> Iterator[pa.RecordBatch]:
    places = np.arange(coordinates, dtype="i8") << 32
    for ids, sets in _sets(batches, n):
        tokens = np.concatenate([places | signature(s, coordinates) for s in sets]) if sets else np.zeros(0, "i8")
        yield pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()),
            pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * coordinates, pa.int32()), pa.array(tokens, pa.int64())),
        ], names=["doc_id", "n_shingles", "digest", "tokens"])


def _bits(shingles: np.ndarray) -> np.ndarray:
    """The last bit of `BITS` coordinates; of two sets, a share of (1 + similarity) / 2 agrees."""
    return np.packbits((signature(shingles, BITS) & np.uint32(1)).astype(bool)).view("i8")


def most_unlike(percent: int, bits: int = BITS, deviations: float = 4.7) -> int:
    """Bits in which a pair at the least similarity differs, with that many standard deviations to spare."""
    apart = (1 - percent / 100) / 2
    return math.ceil(bits * apart + deviations * math.sqrt(bits * apart * (1 - apart)))


def _full_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for ids, sets in _sets(batches, n):
        yield pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()),
            pa.array([s.view("i8") for s in sets], pa.list_(pa.int64())),
            pa.array([_bits(s) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "digest", "hashes", "bits"])


def _linked(x: str, y: str, percent: int) -> Column:
    """Whether two full sets have that many hundredths of their union in common."""
    return (100 + percent) * F.size(F.array_intersect(x, y)) >= percent * (F.size(x) + F.size(y))


def _confirm(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    x = sets.select(F.col("class").alias("a"), F.col("hashes").alias("x"))
    y = sets.select(F.col("class").alias("b"), F.col("hashes").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").where(_linked("x", "y", percent)).select("a", "b")


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, coordinates: int = COORDINATES, miss: float = MISS
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs`: sets of `shingle` words that have at least
    `percent` hundredths of their union in common are linked."""
    scratch, matches = Scratch(docs.sparkSession, "minhash"), least_matches(percent, coordinates, miss)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sketches = scratch.write(texts.mapInArrow(on_workers(_sketches, shingle, coordinates), SKETCH))
    classes = sketches.filter("n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("class"), F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens"))
    classes = scratch.write(classes)

    posts = classes.select("class", "n", F.explode("tokens").alias("token"))
    common = posts.groupBy("token").agg(F.count("*").alias("f")).filter("f > 1")
    shared = join_counted(posts, common, "token", classes.count() * coordinates).groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("common"))
    shared = shared.filter(F.size("common") >= matches).select(
        "class", "n", F.col("common.token").alias("tokens"), F.aggregate("common.f", F.lit(0).cast("long"), lambda s, f: s + f).alias("fame"),
        F.greatest(F.lit(0), F.size("common") - matches + 1).alias("prefix"))
    shared = scratch.write(shared)

    owners = classes.join(shared.select("class"), "class", "left_semi").select("digest", "class")
    wanted = owners.select(F.col("class").alias("doc_id"), F.col("digest").alias("own"))
    chosen = texts.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(on_workers(_full_sets, shingle), SETS)
    chosen = chosen.withColumnRenamed("doc_id", "class")
    sets = scratch.write(chosen.join(owners.hint("shuffle_hash"), ["class", "digest"], "left_semi").select("class", "hashes", "bits"))
    own = sets.select("class", F.explode("hashes").alias("hash")).groupBy("hash").agg(F.min("class").alias("class"), F.count("*").alias("f"))
    own = own.filter("f = 1").groupBy("class").agg(F.count("*").alias("own"))
    shared = shared.join(own, "class", "left").withColumn("usable", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
    shared = scratch.write(shared.filter(100 * F.col("usable") >= percent * F.col("n")))  # else no text is near enough

    prefix = F.slice("tokens", F.lit(1), F.col("prefix"))
    posted = scratch.write(shared.select("class", "fame", F.explode(prefix).alias("token")))
    one = shared.select("class", "n", "usable", "tokens", "fame")
    two = shared.select(F.col("class").alias("leader"), F.col("n").alias("m"), F.col("usable").alias("their_usable"), F.col("tokens").alias("theirs"))
    fit = (100 * F.col("n") >= percent * F.col("m")) & (100 * F.col("m") >= percent * F.col("n"))
    fit = fit & ((100 + percent) * F.least("usable", "their_usable") >= percent * (F.col("n") + F.col("m")))
    common = F.size(F.array_intersect("tokens", "theirs"))

    links, component, number, n_shared = None, shared.select("class", F.col("class").alias("component")), 0, shared.count()
    while True:
        members = posted.join(component, "class").withColumn("part", F.lit(0) if number == 0 else F.pmod(F.xxhash64("class", F.lit(number)), F.lit(LEADERS)))
        order = F.struct("fame", -F.col("class")) if number == 0 else F.xxhash64("class", "token", F.lit(number))
        leaders = members.groupBy("token", "part").agg(F.max_by(F.struct(F.col("class").alias("leader"), F.col("component").alias("theirs")), order).alias("l"))
        leaders = leaders.groupBy("token").agg(F.collect_list("l").alias("leaders"))  # at most LEADERS
        followed = members.join(leaders, "token").select("class", "component", F.explode("leaders").alias("l")).filter("component != l.theirs")
        followed = followed.select("class", "l.leader", F.col("l.theirs").alias("foreign")).distinct()
        near = followed.join(one, "class").join(two, "leader").filter(fit).withColumn("common", common).filter(F.col("common") >= matches)
        best = near.groupBy("class", "foreign").agg(F.max_by("leader", F.struct("common", -F.col("leader"))).alias("leader"))
        found = scratch.write(_confirm(sets, best.select(F.col("class").alias("a"), F.col("leader").alias("b")), percent))
        links = found if links is None else links.union(found)
        joined = components(scratch, links).select(F.col("v").alias("class"), F.col("component").alias("now"))
        component = scratch.write(shared.select("class").join(joined, "class", "left").select("class", F.coalesce("now", "class").alias("component")))
        number += 1
        last = found.count() * FEW <= n_shared
        members = posted.join(component, "class")  # tokens whose classes are all joined link nothing any more
        mixed = members.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high")
        members = scratch.write(members.join(mixed.select("token"), "token", "left_semi").select("class", "fame", "token"))
        scratch.drop(posted)
        posted = members
        if last:
            break

    posted = posted.select("class", "token").join(component, "class")
    posted = posted.join(shared.select("class", "n", "usable", "tokens", prefix.alias("first")), "class")
    posted = scratch.write(posted.join(sets, "class"))
    other = posted.select(F.col("token").alias("t"), F.col("class").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("theirs"),
                          F.col("first").alias("their_first"), F.col("component").alias("c"), F.col("usable").alias("their_usable"),
                          F.col("bits").alias("their_bits"), F.col("hashes").alias("their_hashes"))
    apart = (F.col("token") == F.col("t")) & (F.col("class") < F.col("b")) & (F.col("component") != F.col("c"))
    once = F.get(F.array_intersect("first", "their_first"), F.lit(0)) == F.col("token")
    unlike = functools.reduce(operator.add, [F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("their_bits", F.lit(i)))) for i in range(BITS // 64)])
    like = unlike <= most_unlike(percent)
    rest = posted.join(other, apart & fit & like & once & (common >= matches) & _linked("hashes", "their_hashes", percent)).select(F.col("class").alias("a"), "b")
    links = scratch.write(links.union(rest))
    whole = components(scratch, links)
    named = classes.select("digest", "class").join(whole.withColumnRenamed("v", "class"), "class", "left").select(
        "digest", F.coalesce("component", "class").alias("component_id"))
    scratch.drop(sets, posted)
    linked = sketches.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    linked = linked.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return linked.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def without_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of `docs` but those of documents that a smaller doc_id of their component stands for."""
    gone = near_duplicates(docs, **parameters).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti")


def op8_inverted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, percent=85)
