"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Only DataFrame functions are used.

Sources in code point order (null last) weigh as the given cycle says and share a
multiple of all words.  A source stops at ``most`` times its own size and the rest is
shared anew by weight: that is a water level, found by one pass over the sources.
The targets then vote for blocks of ``BLOCK`` words: seats go to the highest
quotients ``votes / (2 s - 1)``, first to sources, then inside a source to its shards
by their sizes.  A large source has many shards, so none of this depends on how the
rows are dealt over sources; from ``FAN`` shards on the seats go to groups of shards
first, level by level, so no ranking is longer than ``FAN`` parties.  In a shard, documents lie one after the other in a
seeded order and are cut into blocks; whole rounds take all blocks, and the rest of
the quota takes blocks in a second seeded order, the last one in part.

Null text has no words.  Null ids are mixed like others.  Repeated rows count each.
Extra columns are ignored.  Reruns agree: all orders come from seeded hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from maploom.llm.tables import join_small, stored

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 256
SHARD_WORDS = 1 << 18
#: Shards, or groups of them, that share out seats among themselves.
FAN = 1024
#: Sources up to which the table of sources is broadcast.
BROADCAST_ROWS = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sainte_lague(parties: DataFrame, group: list[str], key: str, votes: str, seats: str) -> DataFrame:
    """``parties`` with ``won``: of ``seats`` in a group, those that go to the highest quotients ``votes / (2 s - 1)``.

    Ties go to the lower ``key``.  Instead of all quotients it ranks the few around
    the divisor ``votes in all / seats``: at a slightly larger divisor no more seats
    than there are can be won, and all but some of the rest are certain.
    """
    whole = W.partitionBy(*group)
    n = F.count(F.lit(1)).over(whole)
    p = parties.withColumn("_all", F.sum(votes).over(whole).cast("double")).withColumn("_n", n)
    share = F.when(F.col("_all") > 0, F.col(votes) / F.col("_all")).otherwise(0.0)
    p = p.withColumn("_share", share)
    p = p.withColumn("_sure", F.floor(F.greatest(F.col(seats) - F.col("_n"), F.lit(0)) * F.col("_share") + 0.5))
    p = p.withColumn("_left", F.col(seats) - F.sum("_sure").over(whole))
    p = p.withColumn("_more", F.when(F.col("_share") > 0, F.ceil(2 * F.col("_n") * F.col("_share")) + 2).otherwise(0))
    seat = p.filter("_more > 0").withColumn("_seat", F.explode(F.sequence(F.col("_sure") + 1, F.col("_sure") + F.col("_more"))))
    rank = F.row_number().over(whole.orderBy(F.desc(F.col(votes) / (2 * F.col("_seat") - 1)), key, "_seat"))
    extra = seat.withColumn("_rank", rank).filter("_rank <= _left").groupBy(*group, key).agg(F.count(F.lit(1)).alias("_extra"))
    out = p.join(extra, [*group, key], "left")
    return out.withColumn("won", (F.col("_sure") + F.coalesce("_extra", F.lit(0))).cast("long")).drop("_all", "_n", "_share", "_sure", "_left", "_more", "_extra")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``source, place, weight, source_size, target`` of each source."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())  # one row a source
    s = sources.withColumn("place", (F.row_number().over(order) - 1).cast("long"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    s = s.withColumn("most", most * F.col("source_size")).withColumn("full_at", F.col("most") / F.col("weight"))
    total = s.agg((share * F.sum("source_size")).alias("total"))
    rise = W.orderBy("full_at", "place")
    before = F.sum("most").over(rise) - F.col("most")
    open_ = F.sum("weight").over(rise.rowsBetween(0, W.unboundedFollowing))
    level = s.crossJoin(F.broadcast(total)).select(((F.col("total") - before) / open_).alias("level"), "full_at", F.row_number().over(rise).alias("r"))  # total is one row
    level = level.filter("level <= full_at").agg(F.min_by("level", "r").alias("level"))
    s = s.crossJoin(F.broadcast(level))
    return s.select("source", "place", "weight", "source_size", F.least(F.col("most"), F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def shard_seats(lengths: DataFrame, sources: DataFrame) -> DataFrame:
    """``lengths`` (``place, shard, length``) with ``won``: each shard's part of its source's blocks."""
    levels, most = 1, sources.agg(F.max("shards")).first()[0] or 1
    while FAN**levels < most:
        levels += 1
    above = sources.select("place", F.lit(0).cast("long").alias("parent"), F.col("source_blocks").alias("seats"))
    for level in reversed(range(levels)):
        unit = FAN**level
        parties = lengths.withColumn("party", F.floor(F.col("shard") / unit)).groupBy("place", "party").agg(F.sum("length").alias("length"))
        parties = join_small(parties.withColumn("parent", F.floor(F.col("party") / FAN)), above, ["place", "parent"], "inner", BROADCAST_ROWS)
        won = sainte_lague(parties, ["place", "parent"], "party", "length", "seats")
        above = won.select("place", F.col("party").alias("parent"), F.col("won").alias("seats"))
        if level:
            above = stored(above, "seats")
    return won.select("place", F.col("party").alias("shard"), "length", "won")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    sizes = stored(docs, "sizes")
    targets = source_targets(sizes, weights, share, most)
    targets = targets.withColumn("group", F.lit(0)).withColumn("blocks", F.round(F.sum("target").over(W.partitionBy("group")) / BLOCK).cast("long"))
    targets = sainte_lague(targets, ["group"], "place", "target", "blocks").drop("group", "blocks").withColumnRenamed("won", "source_blocks")
    targets = stored(targets.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / SHARD_WORDS), F.lit(1))), "targets")

    known = targets.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("nameless"), "place", "source_size", "target", "shards")
    placed = sizes.withColumn("name", F.coalesce("source", F.lit(""))).withColumn("nameless", F.col("source").isNull())
    placed = join_small(placed, known, ["name", "nameless"], "inner", BROADCAST_ROWS)
    ticket = F.xxhash64(F.lit(seed), "doc_id", "size")
    placed = placed.withColumn("shard", F.pmod(ticket, F.col("shards"))).withColumn("ticket", F.xxhash64(F.lit(seed + 1), "doc_id", "size"))

    lengths = stored(placed.groupBy("place", "shard").agg(F.sum("size").alias("length")), "shards")
    shards = shard_seats(lengths, targets.select("place", "source_blocks", "shards"))
    quota = F.least(F.col("won") * BLOCK, (most * F.col("length")).cast("long"))
    shards = shards.filter("length > 0").withColumn("quota", quota).withColumn("rounds", F.floor(F.col("quota") / F.col("length")))
    shards = stored(shards.select("place", "shard", "length", "rounds", (F.col("quota") - F.col("rounds") * F.col("length")).alias("rest")), "quotas")

    # how many words each block of a shard gives: a shard has some SHARD_WORDS / BLOCK blocks
    blocks = shards.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / BLOCK))))
    blocks = blocks.withColumn("width", F.least(F.lit(BLOCK), F.col("length") - F.col("block") * BLOCK))
    drawn = W.partitionBy("place", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "place", "shard", "block"), "block")
    room = F.col("rest") - (F.sum("width").over(drawn) - F.col("width"))
    blocks = blocks.select("place", "shard", "rounds", F.struct("block", F.greatest(F.least("width", room), F.lit(0)).cast("int").alias("gives")).alias("b"))
    gives = F.transform(F.array_sort(F.collect_list("b")), lambda b: b["gives"])
    drawn_shards = stored(blocks.groupBy("place", "shard").agg(F.first("rounds").alias("rounds"), gives.alias("gives")), "blocks")

    lie = W.partitionBy("place", "shard").orderBy("ticket", "doc_id", "size")
    laid = placed.withColumn("end", F.sum("size").over(lie.rowsBetween(W.unboundedPreceding, 0))).withColumn("begin", F.col("end") - F.col("size"))
    # both sides lie by shard; not broadcast, as it grows with the corpus
    laid = laid.join(drawn_shards.hint("merge"), ["place", "shard"], "left")

    def overlap(total: Column, b: Column) -> Column:
        return total + F.greatest(F.least(F.col("end"), b * BLOCK + F.get("gives", b.cast("int"))) - F.greatest(F.col("begin"), b * BLOCK), F.lit(0))

    spans = F.sequence(F.floor(F.col("begin") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))
    part = F.when((F.col("size") > 0) & F.col("gives").isNotNull(), F.aggregate(spans, F.lit(0).cast("long"), overlap)).otherwise(0)
    return laid.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.coalesce("rounds", F.lit(0)) + part).cast("long").alias("taken"))
