"""E and S: window operators and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from maploom.operators import sequences as Q
from maploom.plans import fixtures as fx
from maploom.plans import query
from maploom.plans.aggregates import rounded


@query("e1_gaps", f"select key, seq, us - lag(us) over (partition by key order by us) as gap from ({fx.EVENTS})")
def e1(spark, sf_dir):
    return Q.gaps(fx.events(spark, sf_dir), "key", "us").select("key", "seq", "gap")


_IN = f"(select key, t, x, y, x < 25 as inside from ({fx.TRAJECTORY}))"
_VIS = f"""s as (select *, lag(inside) over w as was, lead(t) over w as nx, sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) as st from {_IN} window w as (partition by key order by t)),
n as (select *, sum((inside and not coalesce(was, false))::int) over (partition by key order by t rows unbounded preceding)::bigint as visit, case when was then st else 0 end as step from s),
v as (select key, visit, min(t) as entered, arg_max(coalesce(nx, t), t) as "left", sum(step) as path from n where inside group by 1, 2)"""


def _visits(spark, sf_dir):
    return Q.region_visits(fx.trajectory(spark, sf_dir).select("key", "t", "x", "y", (F.col("x") < 25).alias("inside")))


@query("e2_region_visits", f'with {_VIS} select key, visit, entered, "left", round("left" - entered, 2) as duration, round(path, 2) as path from v')
def e2(spark, sf_dir):
    return _visits(spark, sf_dir)


@query("e3_adjust_visit_ends", f"""with {_VIS}, a as (select *, entered = min(entered) over (partition by key) as f, entered = max(entered) over (partition by key) as l from v)
select key, visit, case when f then 0.0 else entered end as entered, l as open, round(case when f then "left" else "left" - entered end, 2) as duration from a""")
def e3(spark, sf_dir):
    return Q.adjust_visit_ends(_visits(spark, sf_dir)).select("key", "visit", "entered", (F.col("left_at") == "did not leave.").alias("open"), "duration")


@query("e4_visit_timeline")
def e4(spark, sf_dir):
    v = _visits(spark, sf_dir).withColumn("region", F.concat(F.lit("R"), (F.col("visit") % 3).cast("string")))
    return Q.visit_timeline(v, "region")


@query("e5_rolling_median_depth", f"select key, seq, round(quantile_cont(case when k > 20 then value end, 0.5) over (partition by key order by seq rows between 9 preceding and current row), 6) as depth from ({fx.EVENTS})")
def e5(spark, sf_dir):
    e = fx.events(spark, sf_dir)
    m = Q.rolling_median(e, "key", "seq", F.when(F.col("k") > 20, F.col("value")), 10)
    return e.select("key", "seq", F.round(m, 6).alias("depth"))


@query("e6_observation_threshold", """with f as (select l_suppkey as entity, l_orderkey as frame, count(*) as c from lineitem group by 1, 2), r as (select *, sum(c) over (partition by entity order by frame) as run, min(frame) over (partition by entity) as first from f)
select entity, min(frame) as frame, min(frame - first) as delay from r where run >= 5 group by 1""")
def e6(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    return Q.observation_threshold(li.select(F.col("l_suppkey").alias("entity"), F.col("l_orderkey").alias("frame")), 5)


_ARC = f"a as (select *, sum(d) over (partition by key order by seq rows unbounded preceding) as s from (select *, coalesce(sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)), 0) as d from ({fx.TRAJECTORY}) window w as (partition by key order by seq)))"


@query("e7_path_length", f"with {_ARC} select key, seq, round(s, 5) as s from a")
def e7(spark, sf_dir):
    return Q.arc_length(fx.trajectory(spark, sf_dir), "key", "seq").select("key", "seq", F.round("s", 5).alias("s"))


@query("e8_resample_path", f"""with {_ARC}, g as (select key, max(s) / 15 as unit, max(s) as total from a group by 1), q as (select key, i, least(i * unit, total) as pos from g, range(16) t(i)),
n as (select *, lead(s) over w as s1, lead(x) over w as x1, lead(y) over w as y1 from a window w as (partition by key order by seq)),
j as (select q.key, i, pos, n.s, n.s1, n.x, n.x1, n.y, n.y1, row_number() over (partition by q.key, i order by n.s desc) as r from q join n on q.key = n.key and n.s1 > n.s + 1e-12 and n.s <= pos + 1e-6)
select key, i, round(x + (x1 - x) * (pos - s) / (s1 - s), 3) as x, round(y + (y1 - y) * (pos - s) / (s1 - s), 3) as y from j where r = 1""")
def e8(spark, sf_dir):
    r = Q.resample_path(fx.trajectory(spark, sf_dir), "key", "seq", 16)
    return rounded(r, ["x", "y"], 3)


@query("e9_trajectory_samples", f"""with q as (select key, i, 0.0::double + i * 2000000 / 9.0 as pos from (select distinct key from ({fx.EVENTS})), range(10) t(i)), r as (select q.*, t.seq, t.t, t.x, t.y, row_number() over (partition by q.key, i order by abs(t.t - pos), t.t, t.seq) as r from q join ({fx.TRAJECTORY}) t on q.key = t.key and t.t between 0 and 2000000)
select key, i, seq, round(t, 3) as t, round(x, 3) as x, round(y, 3) as y, (seq * 7 % 360)::double as yaw from r where r = 1""")
def e9(spark, sf_dir):
    t = fx.trajectory(spark, sf_dir).withColumn("yaw", (F.col("seq") * 7 % 360).cast("double"))
    return Q.trajectory_samples(t, "key", 0.0, 2000000.0)


@query("e10_frame_windows", "select floor(o_orderkey / 500)::bigint as \"window\", count(*) as pairs, round(sum(o_custkey % 7) / sum(10), 6) as rate from orders group by 1")
def e10(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame"), (F.col("o_custkey") % 7).alias("agree"), F.lit(10).alias("comparable"))
    return rounded(Q.frame_windows(o, "frame", 500), ["rate"])


@query("e11_annotation_windows", """with f as (select o_custkey % 90 as split, o_orderkey as frame, row_number() over (partition by o_custkey % 90 order by o_orderkey) - 1 as i, count(*) over (partition by o_custkey % 90) as n from orders),
w as (select split, frame, least(i // 25, ceil(n / 25) - 1 - (n % 25 > 0 and n % 25 < 12.5 and n > 25)::int)::bigint as "window" from f) select split, "window", min(frame) as first, max(frame) as last, count(*) as n, "window" = 0 as dual from w group by 1, 2""")
def e11(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 90).alias("split"), F.col("o_orderkey").alias("frame"))
    return Q.annotation_windows(o, "split", "frame", 25)


@query("e12_submap_ids", f"select seq, key, printf('submap-%06d', (row_number() over (partition by key order by us) - 1) // 30) as submap from ({fx.EVENTS})")
def e12(spark, sf_dir):
    return Q.submap_ids(fx.events(spark, sf_dir), "key", "us", 30).select("seq", "key", "submap")


_REV = f"(select entity, revision, arg_max(seq, {{'u': us, 's': seq}}) as value from ({fx.VERSIONS}) group by 1, 2)"


@query("e13_submap_transform_asof", f"select e.entity, r.revision, last_value(value ignore nulls) over (partition by e.entity order by r.revision rows unbounded preceding) as value from (select distinct entity from {_REV}) e cross join (select distinct revision from {_REV}) r left join {_REV} v on v.entity = e.entity and v.revision = r.revision")
def e13(spark, sf_dir):
    v = fx.versions(spark, sf_dir).groupBy("entity", "revision").agg(F.max_by("seq", F.struct("us", "seq")).alias("value"))
    return Q.carry_revisions(v, "entity", "revision", "value").select("entity", "revision", "value")


@query("e14_last_version_asof", f"select entity, revision, us, seq, status from ({fx.VERSIONS}) where revision <= 5 qualify row_number() over (partition by entity order by revision desc, us desc, seq desc) = 1")
def e14(spark, sf_dir):
    return Q.last_version_asof(fx.versions(spark, sf_dir), 5)


@query("e15_seg_schedule_gate", f"""with recursive o as (select key, seq, ns, row_number() over (partition by key order by ns, seq) as i from ({fx.CLOCK})),
r as (select key, seq, i, ns as last, true as keep from o where i = 1 union all select o.key, o.seq, o.i, case when o.ns - last >= 2000000 then o.ns else last end, o.ns - last >= 2000000 from r join o on o.key = r.key and o.i = r.i + 1)
select key, seq from r where keep""")
def e15(spark, sf_dir):
    c = fx.clock(spark, sf_dir).select("key", "seq", "ns")
    return Q.rate_gate(c, "key", "ns", 500.0).select("key", "seq")


@query("e16_ema_velocity", f"""with recursive s as (select *, (seq * 7 % 360)::double as yaw from ({fx.TRAJECTORY})), d as (select key, seq, (x - lag(x) over w) / (t - lag(t) over w) as rx, (y - lag(y) over w) / (t - lag(t) over w) as ry, ((yaw - lag(yaw) over w + 900) % 360 - 180) / (t - lag(t) over w) as rw, row_number() over w as i from s window w as (partition by key order by seq)),
r as (select key, i, rx as vx, ry as vy, rw as wz from d where i = 2 union all select d.key, d.i, 0.6 * d.rx + 0.4 * vx, 0.6 * d.ry + 0.4 * vy, 0.6 * d.rw + 0.4 * wz from r join d on d.key = r.key and d.i = r.i + 1) select key, round(arg_max(vx, i), 9) as vx, round(arg_max(vy, i), 9) as vy, round(arg_max(wz, i), 9) as wz, max(i)::int as samples from r group by 1""")
def e16(spark, sf_dir):
    t = fx.trajectory(spark, sf_dir).withColumn("yaw", (F.col("seq") * 7 % 360).cast("double"))
    return rounded(Q.ema_velocity(t, "key", "t", "seq"), ["vx", "vy", "wz"], 9)


@query("e17_size_batches")
def e17(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("size"))
    return Q.size_batches(o, "key", "id", "size", 500000.0)


@query("e18_fault_runs", f"with g as (select key, us, lead(us) over w - us as g, lead(us, 4) over w as after from ({fx.EVENTS}) window w as (partition by key order by us)), m as (select *, max(g) over (partition by key order by us rows between current row and 3 following) as most from g) select key, us, after - us as dropped_gap, most as largest from m where after is not null")
def e18(spark, sf_dir):
    return Q.fault_runs(fx.events(spark, sf_dir), "key", "us", 3)


@query("e19_stratified_anchors", "with b as (select o_custkey % 50 as split, o_orderkey as frame, ntile(8) over (partition by o_custkey % 50 order by o_orderkey)::int as bin from orders) select split, bin, arg_min(frame, sha256('9|' || frame)) as frame from b group by 1, 2")
def e19(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("split"), F.col("o_orderkey").alias("frame"))
    return Q.stratified_anchors(o, "split", "frame", 8, 9)


@query("s1_union_records", "select p_partkey as node, 'dsg' as source, p_name as description from part union all select s_suppkey + 1000000, 'sidecar', s_name from supplier")
def s1(spark, sf_dir):
    p, s = fx.table(spark, sf_dir, "part"), fx.table(spark, sf_dir, "supplier")
    a = p.select(F.col("p_partkey").alias("node"), F.lit("dsg").alias("source"), F.col("p_name").alias("description"))
    return a.unionByName(s.select((F.col("s_suppkey") + 1000000).alias("node"), F.lit("sidecar").alias("source"), F.col("s_name").alias("description")))


@query("s2_observation_times", "select l_suppkey as entity, epoch_us(l_shipdate) as us from lineitem union select o_custkey % 100, epoch_us(o_orderdate) from orders where o_orderstatus <> 'P'")
def s2(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select((F.col("o_custkey") % 100).alias("entity"), fx.micros("o_orderdate").alias("us"))
    return Q.observation_times(fx.observations(spark, sf_dir), o)


@query("s3_missing_ticks", "with t as (select distinct l_partkey * 7 + l_suppkey % 5 as tick from lineitem) select unnest(range(min(tick), max(tick))) as missing from t except select tick from t")
def s3(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    return Q.missing_ticks(li.select((F.col("l_partkey") * 7 + F.col("l_suppkey") % 5).alias("tick")), "tick")


@query("s4_shared_entities", "select l_partkey as item from lineitem group by 1 having count(distinct l_suppkey % 20) = (select count(distinct l_suppkey % 20) from lineitem)")
def s4(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    return Q.shared_by_all(li.select(F.col("l_partkey").alias("item"), (F.col("l_suppkey") % 20).alias("g")), "item", "g")


@query("s5_disjoint_check", "select l_partkey as frame from lineitem where l_orderkey % 2 = 0 intersect select l_partkey from lineitem where l_orderkey % 2 = 1 and l_linenumber = 7")
def s5(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    return li.filter("l_orderkey % 2 = 0").select(F.col("l_partkey").alias("frame")).intersect(li.filter("l_orderkey % 2 = 1 and l_linenumber = 7").select("l_partkey"))


_DEPTH = "select l_orderkey as frame, l_orderkey % 2 = 0 as train, l_quantity as measured, l_quantity * (1.05 + l_discount / 10) as reference from lineitem"


@query("s5_scale_acceptance", f"""with p as ({_DEPTH}), f as (select frame, quantile_cont(reference / measured, 0.5) as scale from p where train group by 1), t as (select quantile_cont(scale, 0.5) as s, (max(scale) - min(scale)) / quantile_cont(scale, 0.5) as span from f),
e as (select quantile_cont(abs(measured * s - reference) / reference, 0.5) as relative, quantile_cont(abs(measured - reference) / reference, 0.5) as raw, quantile_cont(measured * s - reference, 0.5) as signed from p, t where not train and reference > 0),
o as (select count(*)::double as n from (select frame from f intersect select frame from p where not train)) select 'span' as name, round(span, 6) as value, span <= 0.25 as passed from t union all select 'relative', round(relative, 6), relative <= 0.12 from e union all select 'signed', round(signed, 6), abs(signed) <= 0.1 from e
union all select 'improved', round(raw - relative, 6), raw > relative from e union all select 'disjoint', n, n = 0 from o""")
def s5_scale(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_quantity").alias("measured"), (F.col("l_quantity") * (1.05 + F.col("l_discount") / 10)).alias("reference"))
    train = li.filter("frame % 2 = 0").groupBy("frame").agg(F.percentile(F.col("reference") / F.col("measured"), 0.5).alias("scale"))
    return rounded(Q.scale_acceptance(train, li.filter("frame % 2 <> 0")), ["value"])


@query("s6_merge_semantic_records", """with r as (select doc_id % 300 as entity, doc_id as ord, case when doc_id % 3 <> 0 then (doc_id % 300 + 1) // 2 * 40 + doc_id // 300 % 2 * (doc_id % 2) end as label, case doc_id % 4 when 0 then null when 1 then '' else lang end as description, case when doc_id % 5 <> 0 then doc_id % 300 + doc_id // 600 % 2 * (doc_id % 7) end as embedding, source from documents),
d as (select * replace (nullif(description, '') as description) from r), o as (select distinct entity from d where label in (select label from d group by 1 having count(distinct entity) > 1)), g as (select entity, arg_min(label, ord) filter (label is not null) as label, arg_min(description, ord) filter (description is not null) as description,
arg_min(embedding, ord) filter (embedding is not null) as embedding, string_agg(distinct source, ',' order by source) as sources, concat_ws(',', case when count(distinct description) > 1 then 'description' end, case when count(distinct embedding) > 1 then 'embedding' end, case when count(distinct label) > 1 then 'label' end, case when entity in (select entity from o) then 'owner' end) as conflicts from d group by 1)
select *, conflicts <> '' as conflict from g""")
def s6(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    i, e = F.col("doc_id"), F.col("doc_id") % 300
    label = F.when(i % 3 != 0, F.expr("(doc_id % 300 + 1) div 2 * 40 + doc_id div 300 % 2 * (doc_id % 2)"))
    description = F.when(i % 4 == 1, "").when(i % 4 != 0, F.col("lang"))
    embedding = F.when(i % 5 != 0, F.expr("doc_id % 300 + doc_id div 600 % 2 * (doc_id % 7)"))
    return Q.merge_semantic_records(d.select(e.alias("entity"), i.alias("ord"), label.alias("label"), description.alias("description"), embedding.alias("embedding"), "source"))
