"""Reading inputs, storing intermediate tables, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tasks that the rows of one key are dealt over where both sides are large.
SALTS = 16
#: Nodes of high degree whose rows never meet in one task.
HUBS = 250_000
LEAST_DEGREE = 1000

_fallback: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a folder of its own; a cluster is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="spark-maploom-")
    return _fallback[app]


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/maploom-{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def join_small(big: DataFrame, side: DataFrame, on: str | list[str], how: str, rows: int) -> DataFrame:
    """Join that broadcasts ``side`` only after counting that it has at most ``rows`` rows, else a salted shuffle join."""
    return big.join(F.broadcast(side), on, how) if small(side, rows) else join_salted(big, side, on, how)


def join_salted(big: DataFrame, side: DataFrame, on: str | list[str], how: str, salts: int = SALTS) -> DataFrame:
    """Shuffle join that deals the rows of one key of ``big`` over ``salts`` tasks; ``side`` is repeated for each.

    For inner, left, left semi and left anti joins.  Equal rows of ``big`` get different salts in different partitions.
    """
    on = [on] if isinstance(on, str) else on
    salt = F.pmod(F.xxhash64(*big.columns, F.spark_partition_id()), F.lit(salts))
    side = side.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return big.withColumn("_salt", salt).join(side, [*on, "_salt"], how).drop("_salt")


def join_hot(big: DataFrame, side: DataFrame, on: str | list[str], n_rows: int, hubs: int) -> DataFrame:
    """Inner join in which the rows of keys that ``big`` has very often stay where they are.

    ``side`` has each key once.  Keys with more than ``n_rows / hubs`` rows of ``big`` (so at most ``hubs`` of them)
    are joined by broadcast, all others by shuffle.
    """
    most = max(LEAST_DEGREE, n_rows // hubs)
    hot = big.groupBy(on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(on)
    first = big.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), on, "left")
    often = first.filter("_hot").drop("_hot").join(F.broadcast(side.join(F.broadcast(hot), on, "left_semi")), on)
    return often.unionByName(first.filter("_hot is null").drop("_hot").join(side, on))


def _least(edges: DataFrame, n_edges: int, smallest: bool) -> DataFrame:
    """``edges`` (``u, v``) with ``m``: the smallest of ``v`` over ``u``, or of ``u`` too if ``smallest``.

    Rows of nodes of high degree stay where they are, and the few such nodes (at most ``2 * HUBS``, as each takes
    a share of the edges) are broadcast; only the others are shuffled for the join.
    """
    most = max(LEAST_DEGREE, n_edges // HUBS)
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n"))
    if smallest:
        low = low.withColumn("m", F.least("u", "m"))
    hubs = low.filter(F.col("_n") > most).select("u", "m")
    first = edges.join(F.broadcast(hubs), "u", "left")
    rest = first.filter("m is null").drop("m").join(low.filter(F.col("_n") <= most).select("u", "m"), "u")
    return first.filter("m is not null").unionByName(rest)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph given as ``a, b`` (long).

    Returns ``node, component`` for every node of an edge between two different
    nodes; ``component`` is the smallest node.  Alternates the large-star and
    small-star steps, so a long chain needs a number of rounds that grows with
    the logarithm of its length.
    """
    def mark(df: DataFrame) -> tuple:
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stored(e, "edges")
    before = mark(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, 2 * before[0], True).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        star = _least(stored(large, "stars"), 2 * before[0], False)
        moved = star.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = stored(moved.union(star.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        after = mark(nxt)
        e = nxt
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
