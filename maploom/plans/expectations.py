"""J: expectations, gates and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from maploom.functions.geometry import quat_to_matrix
from maploom.operators import expectations as X
from maploom.operators import faults as FA
from maploom.operators import gates as G
from maploom.operators import trajectories as TR
from maploom.plans import fixtures as fx
from maploom.plans import query
from maploom.plans.aggregates import rounded


@query("j1_check_corrections", f"select seq as id, rule from (select seq, unnest([case when not (confidence between 0 and 0.4) then 'confidence' end, case when not (revision >= 1) then 'revision' end]) as rule from ({fx.CORRECTIONS})) where rule is not null")
def j1(spark, sf_dir):
    rules = X.correction_rules() | {"confidence": F.col("confidence").between(0, 0.4), "revision": F.col("revision") >= 1}
    return X.check_rules(fx.corrections(spark, sf_dir), "seq", rules)


@query("j2_check_monotonic", f"with b as (select key, seq, coalesce(value <= lag(value) over (partition by key order by seq), false) as bad from ({fx.EVENTS})) select key, not bool_or(bad) as passed, min(seq) filter (bad) as first_offender from b group by 1")
def j2(spark, sf_dir):
    return X.check_monotonic(fx.events(spark, sf_dir), "key", "value", "seq")


@query("j3_check_pose", f"select id, rule from (select id, unnest(case when id % 10 = 3 then ['orthonormal', 'determinant'] when id % 10 = 7 then ['homogeneous'] else [] end) as rule from ({fx.PARTS}))")
def j3(spark, sf_dir):
    a = F.radians(F.col("id") % 179 + 0.5) / 2
    p = fx.parts(spark, sf_dir).withColumn("m", quat_to_matrix([F.lit(0.0), F.lit(0.0), F.sin(a), F.cos(a)], [F.col(c) for c in "xyz"]))
    bad = F.transform("m", lambda x, i: F.when((F.col("id") % 10 == 3) & (i == 10), 1.1).when((F.col("id") % 10 == 7) & (i == 15), 2.0).otherwise(x))
    return X.check_pose(p.withColumn("m", bad), "id", "m")


@query("j3_check_covariance", f"select id, id % 4 <> 0 as passed from ({fx.PARTS})")
def j3_cov(spark, sf_dir):
    off = F.when(F.col("id") % 4 == 0, 2.0).otherwise(0.5)
    p = fx.parts(spark, sf_dir).withColumn("cov", F.array(F.lit(1.0), off, off, F.lit(1.0)))
    return p.select("id", X.covariance_ok(F.col("cov")).alias("passed"))


@query("j4_check_unique", "select o_custkey, o_orderstatus, count(*) as n from orders group by 1, 2 having count(*) > 1")
def j4(spark, sf_dir):
    return X.check_unique(fx.table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"])


@query("j5_check_manifest", "select 'rows' as item, 500::bigint as declared, count(*) as found, count(*) = 500 as passed from embeddings union all select 'labels', 10, count(distinct label), count(distinct label) = 10 from embeddings union all select 'dimension', 32, max(len(embedding)), max(len(embedding)) = 32 from embeddings")
def j5(spark, sf_dir):
    return X.check_manifest(fx.table(spark, sf_dir, "embeddings"), {"rows": 500, "labels": 10, "dimension": 32})


#: One row of evidence a user, as a run: what the gates read, from the user's events.
_EV = f"""(select key as id, key % 17 <> 0 as has_time, key % 11 <> 0 as valid, max(value) / 40 as stereo, case when key % 13 = 0 then 'fisheye' else 'pinhole' end as projection,
avg((k < 40)::int) as near, case when key % 5 <> 0 then avg((k < 65)::int) end as both_, avg(value) / 100 as step, stddev_pop(value) / 2.5 as turn, case when key % 9 <> 0 then 0.1::double end as spread, avg((k = 0)::int) as leak, avg((k < 55)::int) as unknown,
max(value) / 15 as pose_ms, avg(value) / 2 as queue_ms, avg(value) * 20 as cycle_ms, count(*) filter (k >= 9) as processed, count(*) filter (k < 9) as dropped, (key % 19 = 0)::int as errors, key % 4 as restarts,
avg((k < 12)::int) as largest, count(*) * 16 as comps, key % 3 = 0 as fine, case when key % 21 = 0 then 0.004 else 0.005 end::double as area, count(*) * 15 as sig, avg((k = 1)::int) as tiny,
key % 2 = 0 as required, count(*) filter (k < 5) as pending, count(*) filter (k >= 5) as applied, key % 7 <> 0 as ready, (key % 23 = 0)::int as graph_errors, key % 8 <> 0 as attached, (key % 10 = 0)::int as graph_pending from ({fx.EVENTS}) group by key)"""
_RULES = {
    "time": "case when not has_time then 'time.missing_evidence' when valid and stereo <= 10 and projection = 'pinhole' then 'time.contract' else 'time.contract_violation' end",
    "depth": "case when both_ is null then 'depth.missing_lr_evidence' when near >= 0.15 and 1.1 - near >= 0.7 and both_ >= 0.6 and near >= 0.25 then 'depth.quality' else 'depth.inconsistent' end",
    "pose": "case when step <= 0.5 and turn <= 20 and spread <= 0.5 then 'pose.quality' else 'pose.jump_or_uncertainty' end",
    "dynamic": "case when leak <= 0.01 and unknown <= 0.6 then 'dynamic.isolation' else 'dynamic.static_contamination' end",
    "runtime": "case when errors > 0 then 'runtime.stage_error' when pose_ms > 30 or queue_ms > 30 or cycle_ms > 1000 or dropped / (processed + dropped) > 0.1 then 'runtime.p95_exceeded' when restarts > 2 then 'runtime.resource_exceeded' else 'runtime.latency' end",
    "map": "case when fine and area <> 0.005 then 'map.metric_contract_mismatch' when largest >= 0.1 and (case when fine then sig <= 1000 and tiny <= 0.05 else comps <= 1000 end) then 'map.connectivity' else 'map.fragmented_mesh' end",
    "semantic": "case when required and not ready then 'semantic.worker_unavailable' when pending / (pending + applied) > 0.1 then 'semantic.pending_backlog' when required and graph_errors > 0 then 'semantic.graph_error' when required and not attached then 'semantic.graph_not_attached' when required and graph_pending > 0 then 'semantic.graph_pending' else 'semantic.delivery' end",
}
_GOOD = "('time.contract', 'depth.quality', 'pose.quality', 'dynamic.isolation', 'runtime.latency', 'map.connectivity', 'semantic.delivery')"


def _gated(spark, sf_dir):
    e, share = fx.events(spark, sf_dir), lambda c: F.avg(c.cast("double"))
    key, k, n = F.col("id"), F.col("k"), F.count(F.lit(1))
    a = e.groupBy(F.col("key").alias("id")).agg(
        F.max("value").alias("top"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), n.alias("n"), share(k < 40).alias("near"), share(k < 65).alias("both"), share(k == 0).alias("leak"), share(k < 55).alias("unknown"),
        share(k < 12).alias("largest"), share(k == 1).alias("tiny"), F.count_if(k < 9).alias("dropped"), F.count_if(k < 5).alias("pending"),
    )
    stage = lambda name, service, queue, way: F.struct(F.lit(name).alias("stage"), service.alias("service_p95"), queue.alias("queue_p95"), way.alias("end_to_end_p95"))
    none, fine = F.lit(None).cast("double"), key % 3 == 0
    true, zero = F.lit(True), F.lit(0)
    return G.stage_gates(a.select(
        "id",
        F.when(key % 17 != 0, F.struct((key % 11 != 0).alias("valid"), true.alias("monotonic"), true.alias("pose_exact_match"), true.alias("relative_time_consistent"), (F.col("top") / 40).alias("stereo_delta_ms"), F.when(key % 13 == 0, "fisheye").otherwise("pinhole").alias("projection"))).alias("time"),
        F.struct(F.col("near").alias("valid_ratio"), (1.1 - F.col("near")).alias("temporal_agreement"), F.when(key % 5 != 0, F.col("both")).alias("left_right_consistency"), F.col("near").alias("left_right_coverage"), F.lit(None).cast("boolean").alias("left_right_available")).alias("depth"),
        F.struct((F.col("mean") / 100).alias("translation_step"), (F.col("sd") / 2.5).alias("rotation_step"), F.when(key % 9 != 0, 0.1).alias("position_std"), true.alias("timestamps_monotonic")).alias("pose"),
        F.struct(F.col("leak").alias("contamination"), F.col("unknown").alias("unknown_ratio")).alias("dynamic"),
        F.struct(F.array(stage("pose", F.col("top") / 15, F.col("mean") / 2, none), stage("global", none, none, F.col("mean") * 20)).alias("stages"), (F.col("n") - F.col("dropped")).alias("processed"), "dropped", (key % 19 == 0).cast("int").alias("errors"), zero.alias("gpu_bytes"), zero.alias("worker_bytes"), (key % 4).alias("restarts")).alias("runtime"),
        F.struct("largest", (F.col("n") * 16).alias("components"), F.when(fine, F.when(key % 21 == 0, 0.004).otherwise(0.005)).alias("significant_area"), F.when(fine, F.col("n") * 15).alias("significant_components"), F.when(fine, F.col("tiny")).alias("tiny_area_ratio")).alias("map"),
        F.struct((key % 2 == 0).alias("required"), "pending", (F.col("n") - F.col("pending")).alias("applied"), zero.alias("rejected"), F.lit(None).cast("long").alias("submitted"), (key % 7 != 0).alias("workers_ready"), (key % 23 == 0).cast("int").alias("graph_errors"), (key % 8 != 0).alias("graph_attached"), (key % 10 == 0).cast("int").alias("graph_pending"), zero.alias("graph_unmapped"), F.col("n").alias("graph_applied")).alias("semantic"),
    ))


_GSQL = "select id, stage, code, case when code in " + _GOOD + " then 'PASS' else 'FAIL' end as status, true as hard from (" + " union all ".join(f"select id, '{s}' as stage, {r} as code from {_EV}" for s, r in _RULES.items()) + ")"


@query("j6_run_gates", _GSQL)
def j6(spark, sf_dir):
    return _gated(spark, sf_dir)


@query("j6_gate_summary", f"with g as ({_GSQL}) select id, count(*) filter (status = 'FAIL') = 0 as passed, count(*) filter (status = 'FAIL') as hard_failures, 0::bigint as warnings, coalesce(string_agg(code, ',' order by code) filter (status = 'FAIL'), '') as blocking from g group by 1")
def j6_summary(spark, sf_dir):
    return G.gate_summary(_gated(spark, sf_dir))


#: The run record of a user: counts of its orders, and flags by its number.
_RUN = "(select o_custkey as run, count(*) as n, count(*) filter (o_orderstatus <> 'P') as done, avg(o_totalprice) as price, o_custkey % 3 as m, o_custkey % 5 as f from orders group by o_custkey)"
_CHECKS = {
    "provenance.clean_head": "f <> 4", "provenance.git_sha": "run % 19 <> 0", "configuration.rate": "run % 17 <> 0", "configuration.replay_pacing_rate": "run % 13 <> 0", "configuration.stage_rate_multiplier": "run % 11 <> 0",
    "configuration.throttled": "run % 23 <> 0", "configuration.no_source_bursts": "run % 29 <> 0", "configuration.full_dataset": "run % 31 <> 0", "configuration.no_fault_injection": "run % 37 <> 0 and run % 41 <> 0", "configuration.standard_quality_gates": "run % 43 <> 0",
    "run.complete": "done > 0", "run.all_frames_completed": "done = n", "run.full_dataset": "run % 7 <> 0", "run.all_frames_dispatched": "true", "run.no_resume": "m <> 2 or f <> 1", "run.zero_drops": "n = done",
    "quality.all_hard_gates": "m <> 0 or f <> 2", "runtime.zero_errors": "run % 47 <> 0", "runtime.zero_scheduler_drops": "n = done", "runtime.real_segmentation": "done > 0", "runtime.real_tracking": "run % 53 <> 0",
    "runtime.semantic_metric_consistency": "done = n", "runtime.full_rate_tracking": "true", "runtime.mapping_cycle_p95": "price / 2000 <= 100", "runtime.replay_pacing_evidence": "run % 29 <> 0 and f <> 3",
    "depth.resolved_profile": "case when m = 1 then n > 3 else run % 59 <> 0 end", "semantic.mode": "run % 61 <> 0", "semantic.real_corrections": "done > 1", "semantic.graph_ack": "m <> 2", "semantic.drain_complete": "run % 6 <> 0", "semantic.resolved_models": "f <> 0",
}
_CSQL = " union all ".join(f"select run, '{c}' as code, coalesce({r}, false) as passed from {_RUN}" for c, r in _CHECKS.items())


def _runs(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    r = o.groupBy(F.col("o_custkey").alias("run")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") != "P").alias("done"), F.avg("o_totalprice").alias("price"))
    c, n, done = F.col("run"), F.col("n"), F.col("done")
    m, f = c % 3, c % 5
    bad = lambda k, wrong, right: F.when(c % k == 0, wrong).otherwise(right)
    return r.select(
        "run", (f != 4).alias("clean"), bad(19, "", F.concat(F.lit("g"), m.cast("string"))).alias("git_sha"), f.alias("dataset"), bad(17, 9.0, 10.0).alias("rate_hz"), bad(13, F.lit(None).cast("double"), F.lit(10.0)).alias("paced_rate_hz"), bad(11, 2.0, 1.0).alias("rate_multiplier"),
        (c % 23 == 0).alias("no_throttle"), (c % 29 == 0).alias("allow_bursts"), bad(31, F.lit(5), F.lit(None)).alias("max_frames"), bad(37, F.lit("depth"), F.lit(None)).alias("fault_stage"), bad(41, F.lit(3.0), F.lit(None)).alias("fault_delay_ms"), F.lit(None).cast("int").alias("fault_every"),
        bad(43, "other", "standard").alias("gates_digest"), F.when(done > 0, "complete").otherwise("failed").alias("status"), n.alias("frames_requested"), done.alias("frames_completed"), n.alias("frames_dispatched"), bad(7, n + 1, n).alias("dataset_frames"),
        F.when((m == 2) & (f == 1), 4).otherwise(0).alias("frames_resumed_from"), (n - done).alias("dropped_frames"), ((m != 0) | (f != 2)).alias("gates_passed"), F.lit(0).alias("hard_failures"), F.lit(True).alias("report_passed"), bad(47, 1, 0).alias("errors"), (n - done).alias("scheduler_drops"),
        done.alias("segmentation_processed"), F.lit(1.0).alias("segmentation_p95"), n.alias("segmentation_calls"), n.alias("tracking_processed"), bad(53, F.lit(None).cast("double"), F.lit(1.0)).alias("tracking_p95"), n.alias("tracking_calls"), (F.col("price") / 2000).alias("cycle_p95_ms"),
        F.lit(True).alias("times_preserved"), F.when(f == 3, -1.0).otherwise(n / 10.0).alias("sleep_s"), (n / 5.0).alias("elapsed_s"), F.lit(8).alias("depth_iterations"), F.lit("half").alias("depth_precision"), F.lit("d").alias("depth_digest"), (m == 1).alias("depth_precomputed"), (n - 3).alias("depth_processed"), F.lit(0).alias("depth_failed"),
        bad(59, F.lit(None).cast("double"), F.lit(1.0)).alias("depth_scale"), bad(61, "none", "language").alias("semantic_mode"), n.alias("prompts"), (done - 1).alias("corrections"), F.lit(True).alias("graph_attached"), (m != 2).alias("commit_valid"), n.alias("graph_applied"), F.lit(0).alias("graph_pending"), F.lit(0).alias("graph_unmapped"), F.lit(None).cast("int").alias("graph_errors"),
        F.lit(True).alias("workers_ready"), F.lit(2).alias("workers"), bad(6, 1, 2).alias("workers_drained"), F.lit(False).alias("timed_out"), F.lit(5).alias("models"), F.when(f == 0, 4).otherwise(5).alias("models_resolved"),
    )


@query("j7_run_checks", _CSQL)
def j7(spark, sf_dir):
    return G.run_checks(_runs(spark, sf_dir), G.run_rules(10.0, "standard"))


@query("j7_run_authority", f"with c as ({_CSQL}) select run, count(*) filter (not passed) = 0 and run % 5 <> 4 as authoritative, count(*) filter (not passed) as failed, coalesce(string_agg(code, ',' order by code) filter (not passed), '') as blocking from c group by run")
def j7_authority(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return G.run_authority(G.run_checks(runs, G.run_rules(10.0, "standard")), runs)


@query("j7_compare_runs", f"with r as (select run, case when run % 19 = 0 then '' else 'g' || m end as sha, f from {_RUN}) select x.run as a, y.run as b, x.sha = y.sha as same_commit, x.f = y.f as same_dataset from r x join r y on y.run = x.run + 15 or y.run = x.run + 4")
def j7_pairs(spark, sf_dir):
    runs = _runs(spark, sf_dir).select("run", "git_sha", "dataset")
    return G.compare_runs(runs.select(F.col("run").alias("a"), F.explode(F.array(F.col("run") + 15, F.col("run") + 4)).alias("b")), runs)


@query("j8_check_graph_commit", f"""with o as (select o_orderkey as id, o_custkey * 2 as entity, case when o_orderkey % 9 = 0 then '' else o_orderpriority end as name, o_orderkey % 130 as parent, count(*) over (partition by o_custkey) as n from orders)
select id, rule from (select id, unnest([case when name = '' then 'described' end, case when n <> 1 then 'unique_entity' end, case when e.name_ is null then 'in_memory' end, case when deleted is null or deleted then 'active' end, case when s_suppkey is null then 'has_place' end, case when e.name_ is null or lower(e.name_) <> lower(name) then 'same_name' end]) as rule
from o left join (select entity, name as name_, deleted from ({fx.ENTITIES})) e using (entity) left join supplier on s_suppkey = parent) where rule is not null""")
def j8(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") * 2).alias("entity"), F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(F.col("o_orderpriority")).alias("name"), (F.col("o_orderkey") % 130).alias("parent"))
    return X.check_graph_commit(o, fx.places(spark, sf_dir), fx.entities(spark, sf_dir))


#: Paths in three dimensions: a user's events in order, each kind of event one traversal; turned by ``k`` degrees about z, then by the value about x.
_PATH = f"""select key, kind, seq, t, x, y, z, cos(h) as ch, sin(h) as sh, cos(v) as cv, sin(v) as sv from (
select key, kind, seq, (us - {fx.ORIGIN_US}) / 1e6 as t, value as x, cast(seq % 100 as double) as y, k / 2.0::double as z, radians(k::double) as h, radians(value) as v from ({fx.EVENTS}))"""
#: Sensor events: four streams in order of arrival, some of them stamped too early.
_SENSED = f"""select key, ['imu', 'stereo_left', 'stereo_right', 'spare'][(seq % 4 + 1)::int] as stream, seq, (us - {fx.ORIGIN_US}) / 1e6 - case when seq % 97 = 0 then 1e6 else 0 end as t from ({fx.EVENTS})"""
_LIMITS = {"least_duration": 2400000.0, "least_rate": 2e-5, "most_loop": 60.0, "most_loop_deg": 60.0, "most_p95": 45.0, "samples": 32}


def _paths(spark, sf_dir):
    h, v = F.radians(F.col("k").cast("double")) / 2, F.radians("value") / 2
    q = [F.cos(h) * F.sin(v), F.sin(h) * F.sin(v), F.sin(h) * F.cos(v), F.cos(h) * F.cos(v)]
    e = fx.events(spark, sf_dir).select("key", "kind", "seq", "k", "value", ((F.col("us") - fx.ORIGIN_US) / 1e6).alias("t"), F.col("value").alias("x"), (F.col("seq") % 100).cast("double").alias("y"), (F.col("k") / 2).alias("z"))
    return e.withColumn("m", quat_to_matrix(q, [F.col(c) for c in "xyz"])).drop("k", "value")


def _sensed(spark, sf_dir):
    n = F.col("seq") % 4
    stream = F.when(n == 0, "imu").when(n == 1, "stereo_left").when(n == 2, "stereo_right").otherwise("spare")
    late = F.when(F.col("seq") % 97 == 0, 1e6).otherwise(0.0)
    return fx.events(spark, sf_dir).select("key", stream.alias("stream"), "seq", ((F.col("us") - fx.ORIGIN_US) / 1e6 - late).alias("t"))


_CLOSED = f"""with p as ({_PATH}), a as (select key, count(*) as n, arg_min(p, seq) as a, arg_max(p, seq) as b from p group by 1),
d as (select key, n, b.t - a.t as duration, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2) as loop,
a.ch * b.ch + a.sh * b.sh + a.sh * a.cv * b.sh * b.cv + a.ch * a.cv * b.ch * b.cv + a.sh * a.sv * b.sh * b.sv + a.ch * a.sv * b.ch * b.sv + a.sv * b.sv + a.cv * b.cv as trace from a)
select key, round(duration, 6) as duration, round(case when duration > 0 then (n - 1) / duration else 0 end, 9) as rate, round(loop, 6) as loop, round(degrees(acos(least(greatest((trace - 1) / 2, -1), 1))), 5) as loop_deg from d"""


@query("j9_trajectory_acceptance", f"""select *, duration >= 2400000 and rate >= 2e-5 and loop <= 60 and loop_deg <= 60 as passed from ({_CLOSED})""")
def j9(spark, sf_dir):
    a = TR.loop_closure(_paths(spark, sf_dir), "key", "seq").drop("n")
    a = rounded(rounded(rounded(rounded(a, ["duration"], 6), ["rate"], 9), ["loop"]), ["loop_deg"], 5)
    return a.withColumn("passed", (F.col("duration") >= 2400000) & (F.col("rate") >= 2e-5) & (F.col("loop") <= 60) & (F.col("loop_deg") <= 60))


_STREAMS = f"""select key, stream, count(*) as n, round(arg_max(t, seq) - arg_min(t, seq), 6) as duration, round(max(step), 6) as gap, coalesce(bool_and(step > 0), true) as monotonic,
round(case when arg_max(t, seq) > arg_min(t, seq) then (count(*) - 1) / (arg_max(t, seq) - arg_min(t, seq)) else 0 end, 9) as rate
from (select *, t - lag(t) over (partition by key, stream order by seq) as step from ({_SENSED})) group by 1, 2"""


@query("j9_sensor_streams", _STREAMS)
def j9_sensors(spark, sf_dir):
    s = TR.sensor_streams(_sensed(spark, sf_dir), "key", "stream", "seq")
    return rounded(rounded(s, ["duration", "gap"], 6), ["rate"], 9)


@query("j9_repeated_paths")
def j9_repeated(spark, sf_dir):
    return rounded(TR.align_traversals(_paths(spark, sf_dir), "key", "kind", "seq", 32), ["p50", "p95", "most"])


@query("j9_acceptance_checks")
def j9_checks(spark, sf_dir):
    sensors = TR.sensor_streams(_sensed(spark, sf_dir), "key", "stream", "seq")
    return rounded(TR.trajectory_acceptance(_paths(spark, sf_dir), "key", "kind", "seq", sensors, **_LIMITS), ["value"])


@query("j10_inject_time_offset", f"select d as dose, count(*) as n, round(avg((abs(value + d) > 120)::int), 6) as detected from ({fx.EVENTS}), (values (0.0::double), (5.0), (20.0), (80.0)) t(d) group by 1")
def j10(spark, sf_dir):
    return rounded(X.detection_by_dose(fx.events(spark, sf_dir), [0, 5, 20, 80], "value", 120.0), ["detected"])


@query("j10_stereo_offset", f"""select d as dose, count(*) as eligible, (abs(d) >= 1)::int::double as detection_rate, round(avg((k * 1000.0 + seq % 7) / 1e6 + d), 6) as mean_signed_ms, abs(d)::double as effect, true as passed
from ({fx.EVENTS}), (values (-20::bigint), (-10), (-5), (-2), (2), (5), (10), (20)) t(d) group by 1""")
def j10_stereo(spark, sf_dir):
    e = fx.events(spark, sf_dir).select((F.col("us") * 1000).alias("a_ns"), (F.col("us") * 1000 + F.col("k") * 1000 + F.col("seq") % 7).alias("b_ns"))
    return rounded(FA.time_offset_report(FA.inject_time_offset(e)), ["mean_signed_ms"])


_TRACKED = f"(select case when local % 50 = 0 then 'p' || (local % 20) else 's' || entity || '_' || (seq % 3) end as local, entity, us from ({fx.OBSERVATIONS}))"


@query("j10_permute_ids", f"""with o as {_TRACKED}, c as (select floor(quantile_cont(us, 0.5)) as cut from o), s as (select local, row_number() over (order by count(*) desc, local) - 1 as i from o group by 1 having count(distinct entity) = 1),
m as (select d, a.local, case when d = 1 then a.local || ':permuted' else b.local end as new from (values (1), (3), (5)) t(d), s a, s b where a.i < d and b.i = (a.i + 1) % d),
r as (select t.d, coalesce(new, o.local) as local, entity, new is not null as hit from o, c, (values (0), (1), (3), (5)) t(d) left join m on m.d = t.d and m.local = o.local and us > cut),
l as (select d, local, count(distinct entity) as k from r group by 1, 2), e as (select d, entity, count(distinct local) as k from r group by 1, 2),
g as (select d, count(*) as local_ids, count(*) filter (k > 1) as local_conflicts from l group by 1), h as (select d, count(*) as entities, count(*) filter (k > 1) as entity_splits from e group by 1), n as (select d, count(*) filter (hit) as eligible from r group by 1)
select d::bigint as dose, local_ids, entities, local_conflicts, entity_splits, eligible, (eligible > 0)::int::double as detection_rate, local_conflicts + entity_splits - (select local_conflicts from g where d = 0) - (select entity_splits from h where d = 0) as effect, d < 3 or eligible > 0 as passed
from g join h using (d) join n using (d)""")
def j10_permute(spark, sf_dir):
    o = fx.observations(spark, sf_dir)
    local = F.when(F.col("local") % 50 == 0, F.concat(F.lit("p"), F.col("local") % 20)).otherwise(F.concat(F.lit("s"), "entity", F.lit("_"), F.col("seq") % 3))
    return FA.permute_ids(o.select(local.alias("local"), "entity", "us"))


@query("j10_offset_positions", f"""with c as (select entity, local, us, confidence as centre, z / 40 as gap from ({fx.OBSERVATIONS}) where seq % 9 <> 0 qualify row_number() over (partition by entity, local, us order by seq desc) = 1),
r as (select d, (centre <= 0.75 or gap <= 0.15) and not (centre + d <= 0.75 or gap + d <= 0.15) as lost from c, (values (0.1::double), (0.3), (0.6)) t(d))
select d as dose, count(*) as eligible, 1.0::double as detection_rate, count(*) filter (lost) as rejected, round(avg(lost::int), 6) as effect, true as passed from r group by 1""")
def j10_offset(spark, sf_dir):
    o = fx.observations(spark, sf_dir)
    c = o.select("entity", F.col("local").alias("node"), "us", "seq", (F.col("seq") % 9 != 0).alias("accepted"), F.col("confidence").alias("centre"), (F.col("z") / 40).alias("gap"), F.lit(0.75).alias("most_centre"), F.lit(0.15).alias("most_gap"))
    return rounded(FA.offset_positions(c), ["effect"])


_FRAME_PROBLEM = "case when o_orderkey % 5 = 0 then 'missing' when o_orderkey % 19 = 0 then 'time_differs' when o_orderkey % 11 = 0 then 'configuration_differs' when o_orderkey % 7 = 0 then 'digest_differs' when o_orderkey % 13 = 0 then 'dtype_differs' when o_orderkey % 17 = 0 then 'shape_differs' end"


def _label_frames(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    want = o.select(n.alias("frame"), (n * 1000).alias("time"), F.col("o_orderstatus").alias("configuration"), F.col("o_orderpriority").alias("digest"), F.lit("uint16").alias("dtype"), F.concat_ws("x", F.lit(480), F.lit(640)).alias("shape"))
    wrong = {"time": (19, F.col("time") + 1), "configuration": (11, F.lit(None).cast("string")), "digest": (7, F.lit("other")), "dtype": (13, F.lit("uint8")), "shape": (17, F.lit("640x480"))}
    return want, want.filter("frame % 5 <> 0").withColumns({c: F.when(F.col("frame") % m == 0, v).otherwise(F.col(c)) for c, (m, v) in wrong.items()})


@query("j11_check_label_frames", f"select frame, problem from (select o_orderkey as frame, {_FRAME_PROBLEM} as problem from orders) where problem is not null")
def j11(spark, sf_dir):
    return X.check_label_frames(*_label_frames(spark, sf_dir))


@query("j11_label_coverage", f"select count(*) as expected, count(*) - count(problem) as good, round((count(*) - count(problem)) / count(*), 6) as coverage, count(problem) = 0 as passed from (select {_FRAME_PROBLEM} as problem from orders)")
def j11_coverage(spark, sf_dir):
    return rounded(X.label_coverage(*_label_frames(spark, sf_dir)), ["coverage"])
