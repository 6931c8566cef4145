"""Mappings from the driver's tables to the operators' inputs, for Spark and for DuckDB.

Each mapping is a function for Spark and a SQL text for the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def events(spark, sf_dir) -> DataFrame:
    """``seq, key, kind, us, value, k``"""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), F.col("event_type").alias("kind"), micros("ts").alias("us"), "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


EVENTS = "select event_id as seq, user_id as key, event_type as kind, epoch_us(ts) as us, value, cast(json_extract(props, '$.k') as bigint) as k from events"

ORIGIN_US = 1704067200000000


def clock(spark, sf_dir) -> DataFrame:
    """``events`` on a second-scale clock: adds ``ns``."""
    return events(spark, sf_dir).withColumn("ns", 1 + 1000 * F.expr(f"(us - {ORIGIN_US}) div 20000"))


CLOCK = f"select *, 1 + 1000 * ((us - {ORIGIN_US}) // 20000) as ns from ({EVENTS})"


def trajectory(spark, sf_dir) -> DataFrame:
    """``key, seq, t (seconds), x, y`` of each user's path."""
    e = events(spark, sf_dir)
    return e.select("key", "seq", ((F.col("us") - ORIGIN_US) / 1e6).alias("t"), F.col("value").alias("x"), (F.col("seq") % 100).cast("double").alias("y"))


TRAJECTORY = f"select key, seq, (us - {ORIGIN_US}) / 1e6 as t, value as x, cast(seq % 100 as double) as y from ({EVENTS})"


def points(spark, sf_dir) -> DataFrame:
    """``id, label, x, y, z`` from the embeddings."""
    e = table(spark, sf_dir, "embeddings")
    at = [(10 * F.col("embedding")[i].cast("double")).alias(c) for i, c in enumerate("xyz")]
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("label"), *at)


POINTS = "select vec_id as id, cast(label as bigint) as label, 10 * cast(embedding[1] as double) as x, 10 * cast(embedding[2] as double) as y, 10 * cast(embedding[3] as double) as z from embeddings"


def parts(spark, sf_dir) -> DataFrame:
    """``id, name, x, y, z`` from the parts."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") - 900).alias("y"), (F.col("p_partkey") % 7).cast("double").alias("z"))


PARTS = "select p_partkey as id, p_name as name, cast(p_size as double) as x, p_retailprice - 900 as y, cast(p_partkey % 7 as double) as z from part"


def places(spark, sf_dir) -> DataFrame:
    """``place, room, building, x, y, z`` from suppliers."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    s = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)  # 25 nations
    return s.select(F.col("s_suppkey").alias("place"), F.col("s_nationkey").cast("bigint").alias("room"), F.col("n_regionkey").cast("bigint").alias("building"), (F.col("s_suppkey") * 5).cast("double").alias("x"), F.col("s_nationkey").cast("double").alias("y"), F.lit(0.0).alias("z"))


PLACES = "select s_suppkey as place, cast(s_nationkey as bigint) as room, cast(n_regionkey as bigint) as building, cast(s_suppkey * 5 as double) as x, cast(s_nationkey as double) as y, 0.0::double as z from supplier join nation on s_nationkey = n_nationkey"


def observations(spark, sf_dir) -> DataFrame:
    """``entity, local, us, x, y, z, confidence, seq`` from line items."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("local"), micros("l_shipdate").alias("us"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"), (F.col("l_discount") * 10).alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


OBSERVATIONS = "select l_suppkey as entity, l_partkey as local, epoch_us(l_shipdate) as us, l_quantity as x, l_discount * 100 as y, l_tax * 100 as z, l_discount * 10 as confidence, l_orderkey * 10 + l_linenumber as seq from lineitem"


def tracks(spark, sf_dir) -> DataFrame:
    """``frame, track, area, depth_valid, x, y`` from line items, one row per frame and track."""
    li = table(spark, sf_dir, "lineitem")
    t = li.select(F.col("l_orderkey").alias("frame"), (F.col("l_partkey") % 50).alias("track"), (F.col("l_quantity") * 100).alias("area"), (F.col("l_returnflag") != "R").alias("depth_valid"), F.col("l_discount").alias("x"), F.col("l_tax").alias("y"))
    return t.groupBy("frame", "track").agg(F.max("area").alias("area"), F.bool_or("depth_valid").alias("depth_valid"), F.max("x").alias("x"), F.max("y").alias("y"))


TRACKS = "select l_orderkey as frame, l_partkey % 50 as track, max(l_quantity * 100) as area, bool_or(l_returnflag <> 'R') as depth_valid, max(l_discount) as x, max(l_tax) as y from lineitem group by 1, 2"


def pixels(spark, sf_dir) -> DataFrame:
    """``frame, u, v, depth, label, conf``: one row per pixel, that of the smallest order and part; 7000 orders make seven frames."""
    li = table(spark, sf_dir, "lineitem")
    p = li.select(F.expr("l_linenumber + 7 * (l_orderkey div 7000)").alias("frame"), (F.col("l_orderkey") % 64).alias("u"), (F.col("l_partkey") % 48).alias("v"), F.struct(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"), (F.col("l_quantity") / 10).alias("depth"), (F.col("l_suppkey") % 5).alias("label"), (F.col("l_discount") * 10).alias("conf")).alias("s"))
    p = p.groupBy("frame", "u", "v").agg(F.min("s").alias("s"))
    return p.select("frame", "u", "v", "s.depth", "s.label", "s.conf")


PIXELS = "select frame, u, v, s.depth as depth, s.label as label, s.conf as conf from (select l_linenumber + 7 * (l_orderkey // 7000) as frame, l_orderkey % 64 as u, l_partkey % 48 as v, min({'o': l_orderkey, 'p': l_partkey, 'depth': l_quantity / 10, 'label': l_suppkey % 5, 'conf': l_discount * 10}) as s from lineitem group by 1, 2, 3)"


def poses(spark, sf_dir) -> DataFrame:
    """``frame, pose``: a camera for each pixel frame, which pans, rolls and moves over seven frames and then starts again."""
    f = table(spark, sf_dir, "lineitem").select(F.expr("l_linenumber + 7 * (l_orderkey div 7000)").alias("frame")).distinct()
    m = (F.col("frame") % 7).cast("double")
    a, b = m / 200, m / 100  # tangents of half the angles
    ca, sa, cb, sb = (1 - a * a) / (1 + a * a), 2 * a / (1 + a * a), (1 - b * b) / (1 + b * b), 2 * b / (1 + b * b)
    o = F.lit(0.0)
    return f.select("frame", F.array(cb * ca, -sb, cb * sa, m * 0.02, sb * ca, cb, sb * sa, m * 0.01, -sa, o, ca, m * 0.05, o, o, o, F.lit(1.0)).alias("pose"))


POSES = """select frame, m * 0.02 as tx, m * 0.01 as ty, m * 0.05 as tz, (1 - a * a) / (1 + a * a) as ca, 2 * a / (1 + a * a) as sa, (1 - b * b) / (1 + b * b) as cb, 2 * b / (1 + b * b) as sb
from (select frame, m, m / 200 as a, m / 100 as b from (select distinct l_linenumber + 7 * (l_orderkey // 7000) as frame, ((l_linenumber + 7 * (l_orderkey // 7000)) % 7)::double as m from lineitem))"""


def runs(spark, sf_dir) -> DataFrame:
    """``experiment, variant, seed, repeat, metric``, averaged per key."""
    o = table(spark, sf_dir, "orders")
    o = o.select(F.col("o_orderpriority").alias("experiment"), F.col("o_orderstatus").alias("variant"), (F.col("o_custkey") % 40).alias("seed"), (F.col("o_orderkey") % 3).alias("repeat"), "o_totalprice")
    return o.groupBy("experiment", "variant", "seed", "repeat").agg(F.avg("o_totalprice").alias("metric"))


RUNS = "select o_orderpriority as experiment, o_orderstatus as variant, o_custkey % 40 as seed, o_orderkey % 3 as repeat, avg(o_totalprice) as metric from orders group by 1, 2, 3, 4"


def corrections(spark, sf_dir) -> DataFrame:
    """``op, entity, revision, label, confidence, us, seq``"""
    e = events(spark, sf_dir)
    op = F.sha2(F.concat_ws("|", F.col("key").cast("string"), F.col("k").cast("string"), "kind"), 256)
    return e.select(op.alias("op"), F.col("key").alias("entity"), (F.col("k") % 3).alias("revision"), F.col("kind").alias("label"), (F.col("value") / 500).alias("confidence"), "us", "seq")


CORRECTIONS = f"select sha256(key || '|' || k || '|' || kind) as op, key as entity, k % 3 as revision, kind as label, value / 500 as confidence, us, seq from ({EVENTS})"


def entities(spark, sf_dir) -> DataFrame:
    """``entity, name, locked, deleted``"""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("name"), (F.col("c_custkey") % 5 == 0).alias("locked"), (F.col("c_acctbal") < 0).alias("deleted"))


ENTITIES = "select c_custkey as entity, c_mktsegment as name, c_custkey % 5 = 0 as locked, c_acctbal < 0 as deleted from customer"


def versions(spark, sf_dir) -> DataFrame:
    """``entity, revision, us, seq, status``"""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("entity"), (F.year("o_orderdate") - 1990).cast("bigint").alias("revision"), micros("o_orderdate").alias("us"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"))


VERSIONS = "select o_custkey as entity, year(o_orderdate) - 1990 as revision, epoch_us(o_orderdate) as us, o_orderkey as seq, o_orderstatus as status from orders"
