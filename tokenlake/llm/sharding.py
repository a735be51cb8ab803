"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked.  Every document starts in the shard that a hash of its id gives; in each round a group's pieces
(its documents of one starting shard: at most one row for each shard, however large the group) want to move to the shard that holds most of the
group, and as many move as the receiving shard's quota allows.  At last each shard keeps as many documents as the law allows it, those of whole groups first;
its surplus, single documents first and then those of groups that are parted anyway, fills the shards that lack some.  So propagation decides where groups are, and links are cut only where a shard
holds more linked documents than it may keep.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_GROUP = ["g1", "g2", "g3"]


def propagate(pieces: DataFrame, shards: int, total: int, slack: float = 1.1, rounds: int = 6) -> DataFrame:
    """pieces: group, start, n, all (of its group).  Adds `shard`, after the rounds of balanced label propagation; quotas are `slack` times an even share.

    A group's pieces want to go where most of it is; after two rounds, groups that are still parted prefer shards that have room for all of them.
    """
    quota = slack * total / shards
    now = pieces.withColumn("shard", F.col("start")).checkpoint()
    of = lambda numbers, s: F.element_at(F.array(*[F.lit(float(x)) for x in numbers]), s + 1)
    inside = {r["shard"]: r["n"] for r in now.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard
    singles = max(0.0, total - sum(inside.values())) / shards
    for step in range(rounds):
        room = [quota - singles - inside.get(s, 0) for s in range(shards)]
        votes = now.groupBy(*_GROUP, "shard").agg(F.sum("n").alias("votes"), F.max("all").alias("all"))
        fits = F.lit(step < 2) | (F.col("all") <= F.col("votes") + of(room, F.col("shard")))
        tie = F.xxhash64(F.lit(step // 2), *_GROUP, "shard")
        best = votes.groupBy(*_GROUP).agg(F.max(F.struct(fits.alias("fits"), "votes", tie.alias("tie"), "shard")).alias("b")).select(*_GROUP, F.col("b.shard").alias("to"))
        wish = now.join(best, _GROUP)
        flow = {(r["shard"], r["to"]): r["n"] for r in wish.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}  # shards * shards rows
        if not any(a != b for a, b in flow):
            break
        going = {s: sum(n for (a, b), n in flow.items() if a == s != b) for s in range(shards)}
        coming = {s: sum(n for (a, b), n in flow.items() if b == s != a) for s in range(shards)}
        share = [min(1.0, max(0.0, room[s] + going[s]) / coming[s]) if coming[s] else 1.0 for s in range(shards)]
        draw = F.pmod(F.xxhash64(F.lit(step), *_GROUP, "start"), F.lit(1 << 30)) / float(1 << 30)
        now = wish.withColumn("shard", F.when((F.col("to") != F.col("shard")) & (draw < of(share, F.col("to"))), F.col("to")).otherwise(F.col("shard"))).drop("to").checkpoint()
        inside = {r["shard"]: r["n"] for r in now.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return now


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds `rank`, from 0 over the whole table in this order, by a range partitioning and each partition's offset."""
    at = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("at", at).checkpoint()
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # one row a partition
    offsets, total = [], 0
    for r in sizes:
        offsets.append((r["part"], total))
        total += r["n"]
    table = rows.sparkSession.createDataFrame(offsets or [(0, 0)], "part long, offset long")
    return placed.withColumn("part", part).join(F.broadcast(table), "part").withColumn("rank", F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "offset", "at")


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", rounds: int = 6) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row of docs; law `rows`: shard counts are at most one apart.

    size: UTF-8 bytes of the text plus 1 (null: 1); text_crc32: CRC-32 of these bytes (null: of none, 0).  Groups are equal texts, null and empty ones together.
    slot: 0 upwards in each shard; grown_shard: null under this law.  A group larger than a shard is parted; texts of any length are hashed whole.  Repeated rows, and rows with a
    null id, are rows like any other.  Fewer rows than shards leave shards empty; an empty table gives none.  rounds: of label propagation; without any, groups stay where hashes put them.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g1"))
    rows = rows.withColumn("g2", F.col("text_crc32")).withColumn("g3", F.col("size")).withColumn("start", F.pmod(F.xxhash64("doc_id", "g1"), F.lit(shards)).cast("int")).checkpoint()
    total = rows.count()
    pieces = rows.groupBy(*_GROUP, "start").agg(F.count("*").alias("n"))
    linked = pieces.groupBy(*_GROUP).agg(F.sum("n").alias("all")).where(F.col("all") > 1)
    moved = propagate(pieces.join(linked, _GROUP), shards, total, rounds=rounds)
    apart = moved.groupBy(*_GROUP).agg((F.min("shard") < F.max("shard")).cast("int").alias("loose"))
    moved = moved.join(apart, _GROUP).select(*_GROUP, "start", F.col("shard").alias("moved"), "loose")
    # loose: 0 in a group that is whole, 1 in one that is parted already, 2 alone.
    placed = rows.join(moved, [*_GROUP, "start"], "left").withColumn("home", F.coalesce("moved", "start")).withColumn("loose", F.coalesce("loose", F.lit(2)))
    final = ranked(placed.select("doc_id", "size", "text_crc32", "home", "loose", "g1", "g3"), ["home", "loose", "g1", "g3", "doc_id"])
    held = {r["home"]: r["n"] for r in final.groupBy("home").agg(F.count("*").alias("n")).collect()}  # one row a shard
    held = [held.get(s, 0) for s in range(shards)]
    # The shards that hold most may keep one more, as far as the law has any to give.
    most = sorted(range(shards), key=lambda s: -held[s])[: total % shards]
    keeps = [total // shards + (s in most) for s in range(shards)]
    before = list(accumulate([0, *held[:-1]]))
    surplus = list(accumulate([0, *(max(0, h - k) for h, k in zip(held, keeps))]))
    lacks = list(accumulate([0, *(max(0, k - h) for h, k in zip(held, keeps))]))
    of = lambda numbers, s: F.element_at(F.array(*[F.lit(x).cast("long") for x in numbers]), s + 1)
    at = final.withColumn("at", F.col("rank") - of(before, F.col("home")))
    pool = at.withColumn("pool", F.when(F.col("at") >= of(keeps, F.col("home")), F.col("at") - of(keeps, F.col("home")) + of(surplus, F.col("home"))))
    to = sum((F.col("pool") >= F.lit(x)).cast("int") for x in lacks[1:])
    out = pool.withColumn("shard", F.when(F.col("pool").isNull(), F.col("home")).otherwise(to).cast("int"))
    slot = F.when(F.col("pool").isNull(), F.col("at")).otherwise(of(held, F.col("shard")) + F.col("pool") - of(lacks, F.col("shard")))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def cut_links(sharded: DataFrame) -> DataFrame:
    """(groups, parted, links, cut) of a result of `shard`: groups of two rows or more, those in several shards, each group's links (a row less than it has), and those cut.

    Groups are told by text_crc32 and size.  A link joins a row to another of its group; cut are as few as the group's number of shards allows.
    """
    pieces = sharded.groupBy("text_crc32", "size", "shard").agg(F.count("*").alias("n"))
    groups = pieces.groupBy("text_crc32", "size").agg(F.sum("n").alias("n"), F.max("n").alias("largest"), F.count("*").alias("shards")).where("n > 1")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return groups.agg(F.count("*").alias("groups"), F.count(F.when(F.col("shards") > 1, 1)).alias("parted"), total(F.col("n") - 1).alias("links"), total(F.col("n") - F.col("largest")).alias("cut"))
