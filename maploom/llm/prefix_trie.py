"""Conversation prefix trie: nodes are the distinct beginnings of rebuilt conversations, rolled up by depth bands.

*Turns.*  A range sort puts each conversation's turns in order; a turn's place is its
place in its sorted partition plus the turns before that partition, so one very long
conversation is spread over many tasks.  Texts leave the data there: each turn keeps two
64-bit hashes and its number of code points.  A beginning is known by the exclusive-or of its
turns' hashes, each taken with its depth (128 bits), which adds up over partitions
and gives a node's parent without looking at the turn before.

*Bands.*  ``BAND`` depths make a band.  A node explodes to its ancestors within its band
only.  The nodes at band tops then form a tree of their own, a depth a band, which is rolled
up in the same way; completed totals of band tops are added to their ancestors in the band
above.  A node makes at most ``2 * BAND`` rows, and the rounds grow with the logarithm of the
depth.

*Defined results.*  Null role or text is empty; turns are ordered by turn (null first), then role and text.
Rows without ``conv_id`` belong to no conversation.  Repeated rows are turns of their own.  ``c % 100`` has the
sign of ``c``.  Sums that don't fit a long are null.  Extra columns are ignored.  An empty table has no
node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from maploom.llm.tables import HUBS, join_hot, stored

#: Depths of a band.
BAND = 8
#: Conversation ids that one piece of a digest's text can hold.
IDS = 4096
#: A conversation takes its first turns from the one at the head of its block.
BLOCK = 100
KEY = ["a", "b"]
PARENT = ["pa", "pb"]


def _shared(conv: Column) -> Column:
    """How many turns a conversation takes from the head of its block: at most 5."""
    return F.crc32(conv.cast("string").cast("binary")) % 6


def _depth_hash(depth: Column) -> list[Column]:
    return [F.xxhash64(depth, "x", "y").alias("a"), F.xxhash64("y", depth, "x").alias("b")]


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, a, b, pa, pb, chars, last`` of every beginning of every rebuilt conversation, depth 0 included.

    ``a, b`` name the beginning and ``pa, pb`` the one a turn shorter; ``last`` marks the whole conversation.
    """
    t = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).filter("conv_id is not null")
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    t = t.repartitionByRange(*order).sortWithinPartitions(*order)
    t = t.select("conv_id", F.monotonically_increasing_id().alias("at"), F.xxhash64(F.lit(1), "role", "text").alias("x"), F.xxhash64(F.lit(2), "text", "role").alias("y"), F.length("text").cast("long").alias("chars"))
    t = stored(t, "turns").withColumn("run", F.shiftright("at", 33))
    # a run: the turns of one conversation in one partition
    runs = t.groupBy("conv_id", "run").agg(F.min("at").alias("begin"), F.count(F.lit(1)).alias("n_run"))
    by_conv = W.partitionBy("conv_id")
    runs = runs.select("conv_id", "run", "begin", (F.sum("n_run").over(by_conv.orderBy("run")) - F.col("n_run")).alias("skip"), F.sum("n_run").over(by_conv).alias("n"), F.count(F.lit(1)).over(by_conv).alias("n_runs"))
    runs = stored(runs, "turn-runs")
    turns = t.join(runs.filter(F.col("conv_id") % BLOCK == 0), ["conv_id", "run"]).withColumn("place", F.col("at") - F.col("begin") + 1 + F.col("skip"))
    # the first five turns of each head, with the names of the beginnings they end
    few = turns.filter("place <= 5").select("conv_id", "place", "chars", *_depth_hash(F.col("place")))
    upto = by_conv.orderBy("place")
    few = few.select("conv_id", "place", "chars", F.bit_xor("a").over(upto).alias("ga"), F.bit_xor("b").over(upto).alias("gb"))
    heads = few.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "ga", "gb", "chars"))).alias("head"))
    own = F.col("conv_id")
    convs = runs.filter("skip = 0").select("conv_id", "n", _shared(own).alias("h"), (own - own % BLOCK).alias("first"))
    convs = convs.join(heads.withColumnRenamed("conv_id", "first"), "first", "left").drop("first")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.array().cast("array<struct<place: bigint, ga: bigint, gb: bigint, chars: bigint>>"))
    convs = convs.withColumn("head", head).withColumn("k", F.size("head").cast("long"))
    convs = stored(convs, "conversations")
    whole = F.col("n") <= F.col("h")  # nothing of its own is left
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in (*KEY, *PARENT, "chars")], (whole & (F.col("k") == 0)).alias("last"))
    lent = convs.select("conv_id", "k", "n", "h", "head", F.explode("head").alias("e"))
    up = F.when(F.col("e.place") > 1, F.element_at("head", F.greatest(F.col("e.place") - 1, F.lit(1)).cast("int")))
    lent = lent.select("conv_id", F.col("e.place").alias("depth"), F.col("e.ga").alias("a"), F.col("e.gb").alias("b"), F.coalesce(up["ga"], F.lit(0)).alias("pa"), F.coalesce(up["gb"], F.lit(0)).alias("pb"), F.col("e.chars").alias("chars"), (whole & (F.col("e.place") == F.col("k"))).alias("last"))
    # turns of its own: a running exclusive-or inside each run, then over a conversation's runs
    tail = F.element_at("head", -1)
    info = runs.join(convs.filter("n > h").select("conv_id", "h", "k", *[F.when(F.col("k") > 0, tail[g]).otherwise(0).alias(g) for g in ("ga", "gb")]), "conv_id")
    rest = t.join(info, ["conv_id", "run"]).withColumn("place", F.col("at") - F.col("begin") + 1 + F.col("skip")).filter("place > h")
    rest = rest.withColumn("depth", F.col("place") - F.col("h") + F.col("k"))
    rest = rest.select("conv_id", "run", "at", "n_runs", "depth", "ga", "gb", "chars", (F.col("place") == F.col("n")).alias("last"), *[h.alias(f"own_{c}") for h, c in zip(_depth_hash(F.col("depth")), KEY)])
    along = W.partitionBy("conv_id", "run").orderBy("at")
    rest = stored(rest.select("*", *[F.bit_xor(f"own_{c}").over(along).alias(c) for c in KEY]).drop("at"), "turn-names")
    # conversations in several partitions have at most two runs a partition in all, so this is bounded by the partitions
    sums = rest.filter("n_runs > 1").groupBy("conv_id", "run").agg(*[F.bit_xor(f"own_{c}").alias(f"sum_{c}") for c in KEY])
    before = by_conv.orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("conv_id", "run", *[F.coalesce(F.bit_xor(f"sum_{c}").over(before), F.lit(0)).alias(f"sum_{c}") for c in KEY])
    rest = rest.join(F.broadcast(sums), ["conv_id", "run"], "left")
    named = {c: F.col(c).bitwiseXOR(F.coalesce(f"sum_{c}", F.lit(0))).bitwiseXOR(F.col(f"g{c}")) for c in KEY}
    rest = rest.select("conv_id", "depth", *[named[c].alias(c) for c in KEY], *[named[c].bitwiseXOR(F.col(f"own_{c}")).alias(f"p{c}") for c in KEY], "chars", "last")
    return root.unionByName(lent).unionByName(rest)


def _within_bands(paths: DataFrame, sources: DataFrame, values: list[str]) -> DataFrame:
    """Sums of ``values`` over the rows of ``sources`` (``conv_id, band, depth`` and values) at each beginning of its conversation in that band, up to its depth."""
    line = paths.select("conv_id", F.expr(f"depth div {BAND}").alias("band"), F.struct("depth", *KEY).alias("line"), F.lit(None).alias("source"))
    source = F.struct("depth", *values)
    both = line.unionByName(sources.select("conv_id", "band", F.lit(None).alias("line"), source.alias("source")))
    met = both.groupBy("conv_id", "band").agg(F.collect_list("line").alias("line"), F.collect_list("source").alias("source")).filter(F.size("source") > 0)  # BAND rows and BAND + 1 at most
    met = met.select("line", F.explode("source").alias("source")).select("source", F.explode(F.filter("line", lambda x: x["depth"] <= F.col("source.depth"))).alias("line"))
    return met.groupBy(F.col("line.a").alias("a"), F.col("line.b").alias("b")).agg(*[F.try_sum(F.col("source")[v]).alias(v) for v in values])


def subtree_sums(paths: DataFrame, nodes: DataFrame, values: list[str], deepest: int) -> DataFrame:
    """``a, b`` and the sums of ``values`` over each node's subtree, itself included.

    ``paths``: ``conv_id, depth, a, b`` of every beginning; ``nodes``: each beginning once, by one of its conversations, with its values.
    """
    band = F.expr(f"depth div {BAND}")
    inside = _within_bands(paths, nodes.select("conv_id", band.alias("band"), "depth", *values), values)
    if deepest < BAND:
        return inside
    inside = stored(inside, "band-sums")
    tops = nodes.filter(F.col("depth") % BAND == 0).select("conv_id", band.alias("depth"), *KEY)
    totals = subtree_sums(paths.filter(F.col("depth") % BAND == 0).select("conv_id", band.alias("depth"), *KEY), tops.join(inside, KEY), values, deepest // BAND)
    # a top's total goes to its ancestors in the band above, all of which are less deep than it
    lower = tops.filter("depth > 0").join(totals, KEY).select("conv_id", (F.col("depth") - 1).alias("band"), (F.col("depth") * BAND).alias("depth"), *values)
    carried = _within_bands(paths, lower, values)
    return inside.unionByName(carried).groupBy(*KEY).agg(*[F.try_sum(v).alias(v) for v in values])


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's ascending ids, comma-joined: pieces of up to ``IDS`` ids stream through one hash a node."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest = None, None
        for pdf in frames:
            out = []
            for a, b, text in zip(pdf["a"], pdf["b"], pdf["text"]):
                if (a, b) == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = (a, b), hashlib.sha256()
                digest.update(text.encode())
            yield pd.DataFrame(out, columns=["a", "b", "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(*now, digest.hexdigest())], columns=["a", "b", "ends_sha256"])

    piece = F.floor(F.col("conv_id") / IDS).alias("piece")
    pieces = ends.groupBy(*KEY, piece).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("text"))
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").mapInPandas(run, "a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``conversations``: ``conv_id, turn, role, text``.  ``saved_tokens`` sums (n_convs - 1) times the code points of the last
    text over the subtree, ``n_leaves`` counts its childless nodes, ``ends_sha256`` digests the conversations that end here.
    """
    paths = stored(rebuilt_paths(conversations), "paths")
    nodes = paths.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.count(F.lit(1)).alias("n_convs"))
    nodes = stored(nodes, "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    spared = F.expr("try_multiply(n_convs - 1, chars)")
    nodes = stored(nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", spared), "nodes")
    size = nodes.agg(F.max("depth"), F.count(F.lit(1))).first()
    values = ["n_leaves", "saved_tokens"]
    sums = subtree_sums(paths.select("conv_id", "depth", *KEY), nodes.select("conv_id", "depth", *KEY, *values), values, size[0] or 0)
    out = nodes.drop(*values).join(sums, KEY).join(_digests(paths.filter("last").select("conv_id", *KEY)), KEY, "left")
    out = stored(out, "trie")
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    below = join_hot(out.filter("depth > 0"), parents, PARENT, size[1], HUBS)
    top = out.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    nothing = hashlib.sha256(b"").hexdigest()
    return below.unionByName(top).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
