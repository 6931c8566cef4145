"""P: stream operators, in their batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from maploom.operators import merging as ME
from maploom.operators import scenes as SC
from maploom.operators import sequences as Q
from maploom.operators import streams as S
from maploom.plans import fixtures as fx
from maploom.plans import query
from maploom.plans.memory import _observed
from maploom.sources.tables import shared_dir
from maploom.streaming.machines import activity_sessions, merge_stream


def rows(spark, sf_dir):
    """The machines' input: a sequence per user on the second-scale clock."""
    c = fx.clock(spark, sf_dir)
    return c.select("key", "seq", "ns", "value", "k", "kind", F.col("k").alias("track"), (F.col("value") / 100).alias("x"), ((F.col("seq") % 100) / 100).alias("y"), ((F.col("seq") * 7) % 360).cast("double").alias("yaw"), (F.col("k") > 60).alias("content"), F.lit(0).alias("revision"), (F.col("value") / 200).alias("std"), F.col("kind").alias("label"))


def sightings(spark, sf_dir):
    """Sightings of a scene per user: three-dimensional, with sizes, label shares and a motion score."""
    c = fx.clock(spark, sf_dir)
    labels = F.create_map(F.col("kind"), F.lit(0.7), F.concat(F.lit("k"), (F.col("k") % 3).cast("string")), F.lit(0.3))
    return c.select(
        "key", "seq", "ns", (F.col("k") % 7).alias("track"), (F.col("value") / 100).alias("x"), ((F.col("seq") % 100) / 100).alias("y"), (F.col("k") / 200).alias("z"), (0.05 + F.col("k") / 1000).alias("std"),
        (1 + F.col("k") / 50).alias("sx"), (1 + (F.col("seq") % 3) / 2).alias("sy"), F.lit(1.0).alias("sz"), ((F.col("seq") * 7 % 10) / 12).alias("motion"), labels.alias("labels"),
    )


@query("p1_dynamic_objects")
def p1(spark, sf_dir):
    return SC.replay_scenes(sightings(spark, sf_dir))


@query("p2_expire_objects")
def p2(spark, sf_dir):
    return SC.object_histories(SC.replay_scenes(sightings(spark, sf_dir)))


@query("p3_validate_pose_stream")
def p3(spark, sf_dir):
    return S.replay(rows(spark, sf_dir), S.PoseGate)


@query("p4_dedupe_operations", f"select op, min(seq) as seq from ({fx.CORRECTIONS}) group by 1")
def p4(spark, sf_dir):
    return fx.corrections(spark, sf_dir).groupBy("op").agg(F.min("seq").alias("seq"))


@query("p5_entity_merge_stream")
def p5(spark, sf_dir):
    """Entities as they stand after the stream: the observations run through the keyed-state machine to the end, into a table."""
    folder = f"{shared_dir(spark)}/maploom-merge-{uuid.uuid4().hex}"
    _observed(spark, sf_dir).write.parquet(f"{folder}/observations")
    schema = spark.read.parquet(f"{folder}/observations").schema
    merged = merge_stream(spark.readStream.schema(schema).parquet(f"{folder}/observations"), 4.0)
    run = merged.writeStream.format("parquet").option("path", f"{folder}/merged").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return ME.merged_entities(spark.read.schema(ME.MERGE_SCHEMA).parquet(f"{folder}/merged"))


@query("p6_stage_metrics_window", f"select (us // 21600000000) * 21600000000 as start_us, kind as stage, count(*) as n, round(quantile_cont(value, 0.5), 6) as p50, max(value) as max from ({fx.EVENTS}) group by 1, 2")
def p6(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("t", "6 hours").alias("w"), F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("value", 0.5), 6).alias("p50"), F.max("value").alias("max"))
    return g.select(F.unix_micros("w.start").alias("start_us"), "stage", "n", "p50", "max")


@query("p7_activity_sessions", f"with g as (select *, us - lag(us) over (partition by key order by us) >= 43200000000 as cut from ({fx.EVENTS})), s as (select *, sum(coalesce(cut, false)::int) over (partition by key order by us rows unbounded preceding) as s from g) select key, min(us) as start_us, max(us) + 43200000000 as end_us, count(*) as n from s group by key, s")
def p7(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("t"))
    s = activity_sessions(e, "key", "t", "12 hours")
    return s.select("key", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("p8_admission_filter", f"""with d as (select *, k % 5 as val, case when k % 3 < 1 then 'stale_revision' when k > 90 then 'deadline_expired' end as why from ({fx.EVENTS})), r as (select *, row_number() over (partition by us // 3600000000, why is null order by val desc, us, seq) as r from d)
select seq, coalesce(why, case when r > 3 then case when val = 0 then 'strict_duplicate' else 'lower_content_value' end end, 'admitted') as decision from r""")
def p8(spark, sf_dir):
    e = fx.events(spark, sf_dir)
    e = e.select("seq", "us", (F.col("k") % 5).alias("value"), (F.col("k") % 3).alias("revision"), F.when(F.col("k") > 90, F.col("us") - 1).otherwise(F.col("us")).alias("deadline"), F.expr("us div 3600000000").alias("tick"))
    return S.admission_filter(e, 1, "us", 3, "tick")


@query("p10_keyframe_select")
def p10(spark, sf_dir):
    return S.replay(rows(spark, sf_dir), S.KeyframeGate)


@query("p9_rate_gate")
def p9(spark, sf_dir):
    return Q.rate_gate(fx.clock(spark, sf_dir).select("key", "seq", "ns"), "key", "ns", 1.0)


@query("p11_merge_paths")
def p11(spark, sf_dir):
    r = Q.resample_path(fx.trajectory(spark, sf_dir), "key", "seq", 64)
    return S.merge_paths(r.select((F.col("key") % 10).alias("map"), F.col("key").alias("path"), "i", "x", "y"), 60.0, 0.6, 0.3)


@query("p12_best_pending_candidate", f"select key, arg_max(seq, {{'r': k % 3, 'a': value, 'u': us, 's': seq}}) as seq, count(*) - 1 as replaced from ({fx.EVENTS}) group by 1")
def p12(spark, sf_dir):
    e = fx.events(spark, sf_dir).withColumn("revision", F.col("k") % 3).withColumnRenamed("value", "area")
    return S.best_pending(e, "key")


@query("p13_telemetry_clean", f"select seq, case when k < 95 then value end as value, case when k = 3 then 'kind' else '' end as missing from ({fx.EVENTS})")
def p13(spark, sf_dir):
    e = fx.events(spark, sf_dir)
    odd = F.when(F.col("k") >= 98, float("nan")).when(F.col("k") >= 95, float("inf")).otherwise(F.col("value"))
    e = e.withColumn("value", odd).withColumn("kind", F.when(F.col("k") != 3, F.col("kind")))
    return S.telemetry_clean(e, ["value"], ["kind", "us"]).select("seq", "value", "missing")
