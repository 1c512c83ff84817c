"""Sharding by balanced label propagation over links between documents of equal text.

Documents of equal text are linked. They start text by text, the largest first, end to end over the shards in proportion
to the quotas, so at most one text is cut between two shards; in each round a document may move to the shard that holds
most of its neighbours, if that shard has room under its quota, and the moves with most neighbours go first, until no move
is left.
Unlinked documents have no preferred shard: they fill what the quotas leave open. The law is `rows`: the quotas add up
to the number of documents and differ by one at most, so the final counts do too.

Linked documents of one text are interchangeable, so the rounds work on (text, shard, count) instead of on documents or
pairs; the documents get their shards at the end, by their rank inside their text. No group is handled by one task:
ranks come from range partitions, and the join back is salted by rank.

Defined cases: a null text has size 8 and checksum 0 and is linked with nothing; empty texts are equal texts; repeated
rows are linked documents; groups larger than a shard fill whole shards; an empty table gives an empty result. Only
`doc_id` and `text` are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specgate.llm.common import Scratch, running

SHARDS = 24
#: Rows of one text that meet one copy of its table of shards.
SALT_ROWS = 4096


def _propagate(scratch: Scratch, state: DataFrame, quotas: list[int]) -> tuple[DataFrame, list[int]]:
    """state: (key, shard, cnt). Returns the state when no move is left, and the linked documents per shard.

    Every move gathers documents of a text where more of them are, so the rounds end."""
    while True:
        loads = dict(state.groupBy("shard").agg(F.sum("cnt")).collect())  # one row per shard
        loads = [loads.get(s, 0) for s in range(len(quotas))]
        rooms = F.array(*[F.lit(q - n).cast("long") for q, n in zip(quotas, loads, strict=True)])
        room = F.element_at(rooms, F.col("shard") + 1)
        pull = F.struct("cnt", F.xxhash64("key", "shard").alias("tie"), "shard")
        best = F.max(F.when(room > 0, pull)).over(Window.partitionBy("key"))
        moves = state.withColumns({"best": best, "pull": pull}).filter(
            (F.col("best.shard") != F.col("shard")) & (F.col("best") > F.col("pull"))
        ).select("key", F.col("shard").alias("source"), F.col("best.shard").alias("target"), "cnt",
                 (-F.col("best.cnt")).alias("gain"))
        queued = running(scratch, moves, ["gain", "key", "source"], {"ahead": "cnt"}, by=["target"])
        left = F.element_at(rooms, F.col("target") + 1) - F.col("ahead")
        accepted = scratch.write(queued.select("key", "source", "target", F.least("cnt", left).alias("cnt")).filter("cnt > 0"))
        if accepted.isEmpty():
            return state, loads
        changes = accepted.select("key", F.explode(F.array(
            F.struct(F.col("source").alias("shard"), (-F.col("cnt")).alias("cnt")),
            F.struct(F.col("target").alias("shard"), F.col("cnt"))))).select("key", "col.*")
        moved = state.select("key", "shard", "cnt").unionByName(changes)
        after = scratch.write(moved.groupBy("key", "shard").agg(F.sum("cnt").alias("cnt")).filter("cnt > 0"))
        scratch.drop(state, accepted)
        state = after


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of `docs`."""
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce("text", F.lit(""))
    narrow = scratch.write(docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("key")))
    ranked = scratch.write(running(scratch, narrow, ["doc_id"], {"rank": F.lit(1)}, by=["key"]))
    linked = (F.col("key") != "") & (F.col("rank_total") > 1)
    n = ranked.count()
    quotas = [n // shards + (s < n % shards) for s in range(shards)]
    groups = ranked.filter(linked & (F.col("rank") == 0)).select("key", F.col("rank_total").alias("n"))
    n_linked = groups.agg(F.sum("n")).first()[0] or 0
    ends = [n_linked * sum(quotas[:s]) // max(n, 1) for s in range(shards + 1)]  # no shard gets more than its quota
    bounds = F.array(*[F.lit(e).cast("long") for e in ends])
    begun = running(scratch, groups, [-F.col("n"), F.col("key")], {"first": "n"})
    begun = begun.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(
        "key", "shard", (F.least(F.col("first") + F.col("n"), F.element_at(bounds, F.col("shard") + 2))
                         - F.greatest("first", F.element_at(bounds, F.col("shard") + 1))).alias("cnt"))
    state, loads = _propagate(scratch, scratch.write(begun.filter("cnt > 0")), quotas)

    upto = F.sum("cnt").over(Window.partitionBy("key").orderBy("shard"))
    places = state.withColumn("upto", upto).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("places"))
    salts = F.sequence(F.lit(0).cast("long"), F.floor(F.element_at("places", -1)["upto"] / SALT_ROWS))
    places = places.withColumn("salt", F.explode(salts))
    members = ranked.filter(linked).withColumn("salt", F.floor(F.col("rank") / SALT_ROWS)).join(places, ["key", "salt"])
    members = members.select("doc_id", "size", "text_crc32", F.element_at(
        F.filter("places", lambda p: p["upto"] > F.col("rank")), 1)["shard"].alias("shard"))

    free = running(scratch, ranked.filter(~linked).select("doc_id", "size", "text_crc32"), ["doc_id"], {"rank": F.lit(1)})
    shard, filled = F.lit(None).cast("int"), 0
    ends = []
    for s in range(shards):
        filled += quotas[s] - loads[s]
        ends.append((filled, s))
    for end, s in reversed(ends):
        shard = F.when(F.col("rank") < end, s).otherwise(shard)
    free = free.select("doc_id", "size", "text_crc32", shard.alias("shard"))
    placed = running(scratch, members.unionByName(free), ["doc_id", "text_crc32"], {"slot": F.lit(1)}, by=["shard"])
    return placed.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")


def op7_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
