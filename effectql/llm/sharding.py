"""Sharding by balanced label propagation.

Linked documents start in shards dealt by a hash. Each group of them sees where its members lie and asks
for the shard of most of them; shards let groups in as far as their places go. Places of members that lie
elsewhere, or that leave, count as free, so that full shards exchange members. Groups that were refused
ask again among the shards that still have room for them, until none is left; large groups go first. Only groups
larger than a shard, of which there are fewer than shards, are seated one by one. A group that fits nowhere
whole any more takes the places left, next to each other. Documents without links then fill every shard up to
its exact size.

Links are given as a hub of each node: nodes of a hub are linked with each other.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, park, table

#: Buckets in which groups are let into a shard; a round deals groups to so many for each shard.
ADMISSION = 512
#: Groups with more than half of a shard go first, those with more than this share of one next.
LARGE = 16


def _place(amounts: list[int], number: Column) -> Column:
    """The interval, of those as long as ``amounts``, that holds a number."""
    total, ends = 0, []
    for a in amounts:
        total += a
        ends.append(total)
    return F.size(F.filter(F.array(*map(F.lit, ends)), lambda x: x <= number))


def seat(groups: list[tuple[int, int]], free: list[int]) -> list[tuple[int, int, int, int]]:
    """(hub, from, to, shard) for groups (hub, size), largest first; takes their places from ``free``.

    A group goes where it leaves least room, or, if it fits nowhere, fills the emptiest shards first.
    """
    out = []
    for hub, n in sorted(groups, key=lambda g: (-g[1], g[0])):
        at = 0
        while at < n:
            fits = [s for s, room in enumerate(free) if room >= n - at]
            s = min(fits, key=free.__getitem__) if fits else max(range(len(free)), key=free.__getitem__)
            taken = min(n - at, free[s])
            out.append((hub, at, at + taken, s))
            free[s] -= taken
            at += taken
    return out


def propagate(groups: DataFrame, free: list[int]) -> tuple[list[DataFrame], DataFrame]:
    """Tables (hub, shard) of groups that were let in, and the groups that no shard has room for.

    ``groups``: hub, n and how many members lie in which shard, votes (array of votes, shard). Takes the
    places of those let in from ``free``. The driver sees sums by shard and bucket, never groups. A round that
    lets nothing in is followed by one of finer buckets, of which ADMISSION take their turn.
    """
    spark = groups.sparkSession
    placed, k, fine = [], 0, 0
    while True:
        k += 1
        room = F.array(*(F.lit(x).cast("long") for x in free))
        # most votes; among equals, by a hash, so that equal groups don't all want the same shard
        tie = lambda s, k=k: F.xxhash64("hub", s, F.lit(k))
        open_ = F.filter("votes", lambda v: F.element_at(room, v["shard"] + 1) >= F.col("n"))
        liked = F.array_max(F.transform(open_, lambda v: F.struct(v["votes"].alias("votes"), tie(v["shard"]).alias("tie"), v["shard"].alias("shard"))))
        others = F.filter(F.sequence(F.lit(0), F.lit(len(free) - 1)), lambda s: F.element_at(room, s + 1) >= F.col("n"))
        anywhere = F.array_max(F.transform(others, lambda s: F.struct(tie(s).alias("tie"), s.alias("shard"))))
        wanted = groups.select(
            "*", F.coalesce(liked["shard"], anywhere["shard"]).alias("target"), F.pmod(F.xxhash64("hub", F.lit(1000 + k)), F.lit(ADMISSION << fine)).alias("bucket")
        )
        asked = wanted.where(F.col("target").isNotNull()).where(F.col("bucket") < ADMISSION).groupBy("target", "bucket").agg(F.sum("n").alias("n")).collect()
        let_in = []  # of shards x ADMISSION sums those that fit, the largest first
        for r in sorted(asked, key=lambda r: (r["target"], -r["n"], r["bucket"])):
            if r["n"] <= free[r["target"]]:
                free[r["target"]] -= r["n"]
                let_in.append((r["target"], r["bucket"], r["target"]))
        if not let_in:
            if wanted.where(F.col("target").isNotNull()).isEmpty():
                return placed, groups
            fine += 1
            continue
        admitted = spark.createDataFrame(let_in, "target int, bucket long, shard int")
        after = park(wanted.join(F.broadcast(admitted), ["target", "bucket"], "left").select("hub", "n", "votes", "shard"), f"groups-{k}")
        placed.append(after.where("shard is not null").select("hub", "shard"))
        groups = after.where("shard is null").select("hub", "n", "votes")


def shard_rows(nodes: DataFrame, shards: int, hub: str = "hub") -> DataFrame:
    """Adds shard and slot to ``nodes`` (unique column ``node``): counts at most one apart, slots gapless.

    Rows of equal ``hub`` are linked; a null hub links with nothing. ``nodes`` is read several times and
    should be parked. An empty table gives no rows.
    """
    spark = nodes.sparkSession
    total = nodes.count()
    free = [total // shards + (s < total % shards) for s in range(shards)]
    whole = max(free)
    known = park(nodes.where(F.col(hub).isNotNull()).select("node", F.xxhash64(hub).alias("hub")), "edges")
    votes = known.groupBy("hub", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("votes"))
    groups = votes.groupBy("hub").agg(F.sum("votes").alias("n"), F.collect_list(F.struct("votes", "shard")).alias("votes"))
    groups = park(groups.where("n > 1"), "groups")
    seats = seat([(r["hub"], r["n"]) for r in groups.where(F.col("n") > whole).select("hub", "n").collect()], free)  # fewer than shards
    placed, refused, most = [], [], whole
    for least in (whole // 2, whole // LARGE, 1):  # large groups first, as small ones find room everywhere
        let_in, last = propagate(groups.where((F.col("n") > least) & (F.col("n") <= most)), free)
        placed, refused, most = placed + let_in, [*refused, last.select("hub", F.lit(True).alias("refused"))], min(most, max(1, least))
    refused = functools.reduce(DataFrame.unionByName, refused)
    parted = {h for h, start, _, _ in seats if start}
    seated = spark.createDataFrame([(h, None if h in parted else s, True) for h, start, _, s in seats if not start], "hub long, shard int, seated boolean")
    pieces = spark.createDataFrame([x for x in seats if x[0] in parted], "hub long, start long, end long, shard int")
    let_in = spark.createDataFrame([], "hub long, shard int")
    for x in placed:
        let_in = let_in.unionByName(x)
    marked = known.join(F.broadcast(seated), "hub", "left")
    split = park(marked.where("seated and shard is null").select("node", "hub"), "parted")  # hubs: fewer than shards
    split = numbered(split, ["hub"], ["node"], "__number").join(F.broadcast(pieces), "hub").where("__number >= start and __number < end")
    labels = park(
        marked.where("shard is not null").select("node", "shard").unionByName(split.select("node", "shard"))
        .unionByName(marked.where("seated is null").select("node", "hub").join(let_in, "hub", "left").select("node", "shard"))
        .unionByName(nodes.where(F.col(hub).isNull()).select("node", F.lit(None).cast("int").alias("shard"))),
        "labels",
    )
    # members of a refused group stand next to each other, so that they share shards where they can
    left = labels.where("shard is null").join(known.join(refused, "hub").select("node", "hub"), "node", "left")
    left = park(left.select("node", F.coalesce("hub", "node").alias("__by"), F.col("hub").isNull().cast("int").alias("__one")), "left")
    behind = left.where("__one = 0").count()
    order = numbered(left, ["__one"], ["__by", "node"], "__number", buckets=4096, spread=["__by"])
    filled = order.select("node", _place(free, F.col("__number") + F.when(F.col("__one") == 1, behind).otherwise(0)).alias("shard"))
    placed = park(labels.where("shard is not null").unionByName(filled), "placed")
    return nodes.join(numbered(placed, ["shard"], ["node"], "slot", buckets=256), "node")


def cut_groups(placed: DataFrame, hub: str = "hub") -> DataFrame:
    """groups, whole: hubs with two rows or more, and those of them that lie in a single shard."""
    found = placed.groupBy(hub).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("shard").alias("shards")).where("n > 1")
    return found.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("shards") == 1).alias("whole"))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: the law ``rows``.

    Size is the UTF-8 length of the text (null: none) plus 8. Rows of equal text are linked; null counts
    as empty text. Rows are told apart by their place, so repeated ids do no harm, and a null id has its
    row as any other. Only doc_id and text are read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    nodes = park(
        docs.select(
            F.col("doc_id").cast("long"), (F.octet_length(text).cast("long") + 8).alias("size"),
            F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("hub"),
        ).withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    return shard_rows(nodes, shards, "hub").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


NAME = "op3_sharding"
SQL = None
