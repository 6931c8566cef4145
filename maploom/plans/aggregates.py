"""D: aggregations and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from maploom.operators import aggregates as A
from maploom.plans import fixtures as fx
from maploom.plans import query
from maploom.plans.joins import _SUP, support
from maploom.plans.scalars import K, r6


def rounded(df, names, places=6):
    return df.withColumns({n: F.round(F.col(n), places) for n in names})


def _q(v, names="p05 p25 p50 p75 p95"):
    return ", ".join(f"round(quantile_cont({v}, {int(n[1:]) / 100}), 6) as {n}" for n in names.split())


@query("d1_numeric_summary", f"select l_returnflag, count(*) as n, round(avg(l_quantity), 6) as mean, min(l_quantity) as min, {_q('l_quantity')}, max(l_quantity) as max from lineitem group by 1")
def d1(spark, sf_dir):
    return rounded(A.numeric_summary(fx.table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity"), ["mean", *A.PERCENTILES])


_TELE = f"(select kind as stage, case when k < 80 then 'done' when k < 90 then 'error' else 'drop' end as event, us, value - 5 as wait, value * 2 as service, value * 3 - 5 as whole, k % 7 as queue, 'r' || k % 3 as reason from ({fx.EVENTS}))"
_LAT = ", ".join(f"round(quantile_cont(greatest({c}, 0), {p}) filter (event = 'done'), 6) as {c}_p{str(p)[2:].ljust(2, '0')}" for c in ("wait", "service", "whole") for p in (0.5, 0.95, 0.99))
_LAT += ", " + ", ".join(f"round(max(greatest({c}, 0)) filter (event = 'done'), 6) as {c}_max" for c in ("wait", "service", "whole"))


def _telemetry(spark, sf_dir):
    event = F.when(F.col("k") < 80, "done").when(F.col("k") < 90, "error").otherwise("drop")
    v = F.col("value")
    return fx.events(spark, sf_dir).select(F.col("kind").alias("stage"), event.alias("event"), "us", (v - 5).alias("wait"), (v * 2).alias("service"), (v * 3 - 5).alias("whole"), (F.col("k") % 7).alias("queue_size"), F.concat(F.lit("r"), (F.col("k") % 3).cast("string")).alias("reason"))


@query("d2_stage_metrics", f"select stage, count(*) filter (event = 'done') as processed, count(*) filter (event = 'error') as errors, round(count(*) filter (event = 'done') / ((max(us) - min(us)) / 1e6), 9) as throughput, max(queue) as high_water, {_LAT} from {_TELE} group by 1")
def d2(spark, sf_dir):
    m = A.stage_metrics(_telemetry(spark, sf_dir), ["wait", "service", "whole"])
    return rounded(rounded(m, [f"{c}_{n}" for c in ("wait", "service", "whole") for n in ("p50", "p95", "p99", "max")]), ["throughput"], 9)


@query("d2_stage_totals", f"select count(distinct stage) as stages, count(*) filter (event = 'done') as processed, count(*) filter (event = 'error') as errors, count(*) filter (event = 'drop') as dropped from {_TELE}")
def d2_totals(spark, sf_dir):
    return A.stage_totals(_telemetry(spark, sf_dir))


@query("d2_drops_by_reason", f"select stage, reason, count(*) as n from {_TELE} where event = 'drop' group by 1, 2")
def d2_drops(spark, sf_dir):
    return A.drops_by_reason(_telemetry(spark, sf_dir))


@query("d3_operation_stats", f"select kind, count(*) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, min(value) as min, max(value) as max, round(sum(value), 4) as total, {_q('value', 'p50 p95 p99')} from ({fx.EVENTS}) group by 1")
def d3(spark, sf_dir):
    s = A.operation_stats(fx.events(spark, sf_dir), "kind", "value")
    return rounded(rounded(s, ["mean", "std", "p50", "p95", "p99"]), ["total"], 4)


@query("d4_status_counts", "select s as status, count(o_orderkey) as n from (values ('F'), ('O'), ('P'), ('lost')) t(s) left join orders on o_orderstatus = s group by 1")
def d4(spark, sf_dir):
    return A.status_counts(fx.table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status"), ["F", "O", "P", "lost"])


@query("d5_memory_summary", f"select name, count(*) filter (not deleted) as active, count(*) filter (deleted) as gone, count(distinct entity) as entities from ({fx.ENTITIES}) group by name order by active desc, name limit 30")
def d5(spark, sf_dir):
    return A.memory_summary(fx.entities(spark, sf_dir))


@query("d6_graph_summary", f"select coalesce(building, -1) as building, coalesce(room, -1) as room, count(*) as nodes from ({fx.PLACES}) group by rollup (building, room)")
def d6(spark, sf_dir):
    return A.graph_summary(fx.places(spark, sf_dir), ["building", "room"])


@query("d7_robust_entity_geometry", f"select entity, {', '.join(f'round(quantile_cont({c}, 0.5), 6) as {c}' for c in 'xyz')}, round(quantile_cont(x / 9, 0.5) filter (seq % 3 <> 0), 6) as dx, round(quantile_cont(y / 9, 0.5) filter (seq % 3 <> 0), 6) as dy, round(quantile_cont(z / 9, 0.5) filter (seq % 3 <> 0), 6) as dz, round(max(confidence), 6) as confidence from ({fx.OBSERVATIONS}) group by 1")
def d7(spark, sf_dir):
    o = fx.observations(spark, sf_dir).withColumns({f"d{c}": F.when(F.col("seq") % 3 != 0, F.col(c) / 9) for c in "xyz"})
    return rounded(A.robust_entity_geometry(o), ["x", "y", "z", "dx", "dy", "dz", "confidence"])


@query("d8_masked_geometry", f"""with p as (select *, row_number() over (partition by frame, label order by v, u) - 1 as i, count(*) over (partition by frame, label) as n from ({fx.PIXELS}) where depth > 0 and label <> 0),
s as (select * from p where n <= 100 or floor(ceil(i * 99 / greatest(n - 1, 1)) * (n - 1) / 99) = i), c as (select frame, label, (u - 32) * depth / 50 as x, (v - 24) * depth / 55 as y, depth as z from s)
select frame, label, count(*) as n, {", ".join(f"round(quantile_cont({c}, 0.5), 5) as {c}, round(greatest(quantile_cont({c}, 0.95) - quantile_cont({c}, 0.05), 0.05), 5) as d{c}" for c in "xyz")} from c group by 1, 2""")
def d8(spark, sf_dir):
    return rounded(A.masked_geometry(fx.pixels(spark, sf_dir), K, 100), ["x", "y", "z", "dx", "dy", "dz"], 5)


@query("d9_label_frame_summary", f"""with c as (select key as frame, k % 6 as label, count(*) as n from ({fx.EVENTS}) group by 1, 2), t as (select *, sum(n) filter (label <> 0) over (partition by frame) as t from c)
select frame, count(*) filter (label <> 0) as labels, round(coalesce(sum(n) filter (label <> 0), 0) / sum(n), 6) as ratio, round(coalesce(-sum(n / t * log2(n / t)) filter (label <> 0), 0), 6) as entropy from t group by 1""")
def d9(spark, sf_dir):
    e = fx.events(spark, sf_dir).select(F.col("key").alias("frame"), (F.col("k") % 6).alias("label"))
    return rounded(A.label_frame_summary(e), ["ratio", "entropy"])


@query("d9_top_labels", f"select k as label, count(*) as n, count(distinct key) as frames from ({fx.EVENTS}) where k <> 0 group by 1 order by n desc, label limit 31")
def d9_top(spark, sf_dir):
    return A.top_labels(fx.events(spark, sf_dir).select(F.col("key").alias("frame"), F.col("k").alias("label")))


_ERR = "(select l_returnflag, l_linenumber::bigint as frame, l_shipdate, l_extendedprice / 1000 as p, l_quantity as r, l_linestatus = 'O' as valid, l_discount from lineitem)"


def _err(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    return li.select("l_returnflag", F.col("l_linenumber").cast("bigint").alias("frame"), (F.col("l_extendedprice") / 1000).alias("p"), F.col("l_quantity").alias("r"), (F.col("l_linestatus") == "O").alias("valid"), "l_discount")


@query("d10_error_summary", f"""select l_returnflag, count(*) as n, round(avg(p - r), 6) as mean, round(quantile_cont(p - r, 0.5), 6) as median, round(avg(abs(p - r)), 6) as mae, round(quantile_cont(abs(p - r), 0.5), 6) as median_abs, round(quantile_cont(abs(p - r), 0.9), 6) as p90_abs, round(quantile_cont(abs(p - r) / greatest(r, 1e-6), 0.5), 6) as median_rel,
round(avg((abs(p - r) <= 1)::int), 6) as within_1, round(avg((abs(p - r) <= 5)::int), 6) as within_5, round(avg((abs(p - r) <= 20)::int), 6) as within_20 from {_ERR} group by 1""")
def d10(spark, sf_dir):
    e = A.error_summary(_err(spark, sf_dir), ["l_returnflag"], "p", "r")
    return rounded(e, ["mean", "median", "mae", "median_abs", "p90_abs", "median_rel", "within_1", "within_5", "within_20"])


@query("d11_range_bin_report", f"""with b as (select *, case when r < 10 then 0 when r < 25 then 1 when r < 40 then 2 else 3 end::bigint as bin from {_ERR} where r >= 1 and r < 60), s as (select 'all' as policy, * from b union all select 'strict', * from b where l_discount <= 0.05)
select policy, bin, count(*) as n, round(avg(valid::int), 6) as coverage, round(avg(abs(p - r)) filter (valid), 6) as mae, round(quantile_cont(abs(p - r), 0.5) filter (valid), 6) as median_abs from s group by 1, 2""")
def d11(spark, sf_dir):
    r = A.range_bin_report(_err(spark, sf_dir), [1, 10, 25, 40, 60], {"all": F.lit(True), "strict": F.col("l_discount") <= 0.05}, "p", "r")
    return rounded(r, ["coverage", "mae", "median_abs"])


@query("d12_scale_stability", f"with f as (select frame, quantile_cont(p / r, 0.5) as r from {_ERR} where p / r between 0.5 and 5 group by 1) select count(*) as frames, round(quantile_cont(r, 0.5), 6) as median, round(min(r), 6) as min, round(max(r), 6) as max, round((max(r) - min(r)) / quantile_cont(r, 0.5), 6) as span from f")
def d12(spark, sf_dir):
    return rounded(A.scale_stability(_err(spark, sf_dir), "frame", F.col("p") / F.col("r")), ["median", "min", "max", "span"])


@query("d13_dense_agreement", f"""with p as ({fx.PIXELS}), a as (select frame, u, v, depth as d from p where label < 4), b as (select frame, u, v, depth * 1.1 + conf - 0.5 as d from p where label > 0),
j as (select coalesce(a.frame, b.frame) as frame, a.d as da, b.d as db, coalesce(a.d > 0, false) as va, coalesce(b.d > 0, false) as vb from a full join b on a.frame = b.frame and a.u = b.u and a.v = b.v)
select frame, count(*) filter (va and vb) as common, round(count(*) filter (va and vb) / count(*) filter (va or vb), 6) as iou, round(count(*) filter (va and vb) / count(*) filter (va), 6) as cover_a, round(count(*) filter (va and vb) / count(*) filter (vb), 6) as cover_b,
round(avg(abs(da - db)) filter (va and vb), 6) as mae, round(sqrt(avg((da - db) * (da - db)) filter (va and vb)), 6) as rmse, round(avg(abs(da - db) / db) filter (va and vb), 6) as abs_rel, round(avg(da - db) filter (va and vb), 6) as signed, round(avg((greatest(da / db, db / da) < 1.25)::int) filter (va and vb), 6) as delta_125 from j group by 1""")
def d13(spark, sf_dir):
    p = fx.pixels(spark, sf_dir)
    b = p.filter("label > 0").withColumn("depth", F.col("depth") * 1.1 + F.col("conf") - 0.5)
    return rounded(A.dense_agreement(p.filter("label < 4"), b), ["iou", "cover_a", "cover_b", "mae", "rmse", "abs_rel", "signed", "delta_125"])


@query("d14_pair_rollup", f"""{_SUP}, s as (select frame, off, count(*) as comparable, sum((abs(depth - other) <= 0.04 + 0.1 * depth)::int) as agree from j group by 1, 2)
select abs(off)::bigint as gap, round(sum(agree) / sum(comparable), 6) as rate, round(quantile_cont(agree / comparable, 0.5), 6) as median, round(quantile_cont(agree / comparable, 0.05), 6) as p05, round(quantile_cont(frame, 0.5), 6) as dt_median, max(frame) as dt_max from s group by 1""")
def d14(spark, sf_dir):
    s = support(spark, sf_dir).filter("status >= 3")
    s = s.groupBy("frame", "offset").agg(F.count(F.lit(1)).alias("comparable"), F.count_if("agrees").alias("agree"))
    return rounded(A.pair_rollup(s.withColumn("dt", F.col("frame"))), ["rate", "median", "p05", "dt_median"])


@query("d15_radial_bins", f"""{_SUP}, r as (select case when h < 0.4 then 0 when h < 0.8 then 1 when h < 1.2 then 2 else 3 end::bigint as bin, abs(depth - other) <= 0.04 + 0.1 * depth as ok from (select *, sqrt(pow((u - 32) / 50, 2) + pow((v - 24) / 55, 2)) as h from j))
select bin, count(*) as comparable, round(avg(ok::int), 6) as agreement from r group by 1""")
def d15(spark, sf_dir):
    return rounded(A.radial_bins(support(spark, sf_dir).filter("status >= 3"), K), ["agreement"])


@query("d16_stream_stats", f"""with g as (select *, us - lag(us) over (partition by kind order by seq) as g from ({fx.EVENTS}))
select kind, count(*) as n, min(us) as first, max(us) as last, round((max(us) - min(us)) / 1e6, 6) as duration, round((count(*) - 1) / ((max(us) - min(us)) / 1e6), 9) as rate, max(g) as max_gap, coalesce(bool_and(g > 0), true) as monotonic, count(distinct k) as frames from g group by 1""")
def d16(spark, sf_dir):
    return rounded(rounded(A.stream_stats(fx.events(spark, sf_dir), "kind", "us", "seq", "k"), ["rate"], 9), ["duration"])


@query("d17_track_lifecycle", f"""with o as (select frame // 40000 as scene, track, frame % 40000 // 4 as frame, max(x) as x, max(area) as area, max(y) as y from ({fx.TRACKS}) group by 1, 2, 3), bx as (select *, x * 100 as x0, y * 100 as y0, x * 100 + area / 400 as x1, y * 100 + area / 400 as y1 from o),
g as (select *, frame - lag(frame) over w as g, abs(x - lag(x) over w) as j, greatest(least(x1, lag(x1) over w) - greatest(x0, lag(x0) over w), 0) * greatest(least(y1, lag(y1) over w) - greatest(y0, lag(y0) over w), 0) as both_, (x1 - x0) * (y1 - y0) + lag((x1 - x0) * (y1 - y0)) over w as sum_ from bx window w as (partition by scene, track order by frame)),
i as (select *, case when g = 1 and sum_ - both_ > 0 then both_ / (sum_ - both_) end as iou from g),
t as (select scene, track, min(frame) as first, max(frame) as last, count(*) as n, count(*) filter (g > 1) as gaps, max(g) as max_gap, round(max(j), 6) as max_jump, round(avg(iou), 6) as iou_mean, round(min(iou), 6) as iou_min, max(frame) - min(frame) + 1 as life, round(count(*) / (max(frame) - min(frame) + 1), 6) as fill, max(frame) - min(frame) + 1 - count(*) as missing, max(j) as mj from i group by 1, 2)
select scene, track, first, last, n, gaps, max_gap, max_jump, iou_mean, iou_min, life, fill, missing, array_to_string(list_filter([case when n <= 2 then 'short' end, case when life >= 5 and fill < 0.25 then 'sparse' end, case when gaps > 0 then 'gap' end, case when mj > 0.25 then 'jump' end, case when iou_min < 0.05 then 'overlap' end], lambda v: v is not null), ',') as flags from t""")
def d17(spark, sf_dir):
    t = fx.tracks(spark, sf_dir)
    o = t.groupBy(F.floor(F.col("frame") / 40000).cast("bigint").alias("scene"), "track", F.floor(F.col("frame") % 40000 / 4).cast("bigint").alias("frame")).agg(*[F.max(c).alias(c) for c in ("x", "y", "area")])
    side = F.col("area") / 400
    o = o.withColumns({"x0": F.col("x") * 100, "y0": F.col("y") * 100, "x1": F.col("x") * 100 + side, "y1": F.col("y") * 100 + side})
    return rounded(A.track_lifecycle(o), ["max_jump", "fill", "iou_mean", "iou_min"])


@query("d18_entity_membership", f"""with o as ({fx.OBSERVATIONS}), c as (select entity, avg(x) as cx, avg(y) as cy, avg(z) as cz from o group by 1), d as (select o.*, sqrt(pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2)) as d from o join c using (entity))
select entity, count(*) as n, count(distinct local) as locals, min(us) as first, max(us) as last, round(quantile_cont(d, 0.5), 5) as median, round(quantile_cont(d, 0.95), 5) as p95, round(max(d), 5) as most, max(d) > 24.5 as spread from d group by 1""")
def d18(spark, sf_dir):
    return rounded(A.entity_membership(fx.observations(spark, sf_dir), 24.5), ["median", "p95", "most"], 5)


@query("d19_association_conflicts", "with r as (select o_orderkey % 500 as local, o_custkey as entity from orders) select 'local' as side, local as id, count(distinct entity) as n from r group by local having count(distinct entity) > 1 union all select 'entity', entity, count(distinct local) from r group by entity having count(distinct local) > 1")
def d19(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    return A.association_conflicts(o.select((F.col("o_orderkey") % 500).alias("local"), F.col("o_custkey").alias("entity")))


@query("d20_track_entity_edges", "select l_partkey % 50 as track, l_suppkey as entity, count(*) as n from lineitem group by 1, 2")
def d20(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    return A.edge_counts(li.select((F.col("l_partkey") % 50).alias("track"), F.col("l_suppkey").alias("entity")), "track", "entity")


@query("d21_dominant_label", f"with w as (select id % 25 as region, name, sum(x) as w from ({fx.PARTS}) group by 1, 2) select region, arg_min(name, {{'w': -w, 'name': name}}) as name from w group by 1")
def d21(spark, sf_dir):
    p = fx.parts(spark, sf_dir).withColumn("region", F.col("id") % 25)
    return A.dominant_label(p, "region", "name", "x")


@query("d22_history_rollup", f"with s as (select distinct k as label, key as frame, us from ({fx.EVENTS})) select label, count(*)::int as n, min(us) as first, max(us) as last, arg_min(frame, {{'f': frame, 'u': us}}) as first_frame from s group by 1")
def d22(spark, sf_dir):
    e = fx.events(spark, sf_dir).select(F.col("k").alias("label"), F.col("key").alias("frame"), "us")
    return A.history_rollup(e, "label").select("label", F.size("seen").alias("n"), "first", "last", F.col("seen")[0]["frame"].alias("first_frame"))


@query("d24_cohen_kappa", """with c as (select quality as a, toxic as b, count(*)::double as n from labels group by 1, 2), t as (select sum(n) as t from c), ra as (select a, sum(n) as r from c group by 1), rb as (select b, sum(n) as r from c group by 1),
o as (select sum(n) filter (a = b) / (select t from t) as observed from c), e as (select sum(ra.r * rb.r) / pow((select t from t), 2) as expected from ra join rb on a = b)
select round(observed, 6) as observed, round(expected, 6) as expected, round(case when expected = 1 then 1 else (observed - expected) / (1 - expected) end, 6) as kappa from o, e""")
def d24(spark, sf_dir):
    return rounded(A.cohen_kappa(fx.table(spark, sf_dir, "labels"), "quality", "toxic"), ["observed", "expected", "kappa"])


@query("d24_review_consensus", """with v as (select case o_orderstatus when 'F' then 1 when 'O' then 2 when 'P' then 3 end as a, case o_orderkey % 4 when 0 then 1 when 1 then 2 when 2 then 3 end as b from orders), w as (select *, a is not null and b is not null as known from v)
select count(*) filter (known) as items, count(*) filter (not known) as unread, count(*) filter (a = b) as same, count(*) filter (known and greatest(a, b) = 1) as pass, count(*) filter (known and greatest(a, b) = 2) as minor, count(*) filter (known and greatest(a, b) = 3) as major, round(avg((greatest(a, b) = 1)::int) filter (known), 6) as strict, round(avg((least(a, b) = 1)::int) filter (known), 6) as lenient from w""")
def d24_consensus(spark, sf_dir):
    names = F.array(*map(F.lit, ("pass", "minor", "major")))
    o = fx.table(spark, sf_dir, "orders")
    a = F.when(F.col("o_orderstatus") == "F", "pass").when(F.col("o_orderstatus") == "O", "minor").otherwise("major")
    return rounded(A.review_consensus(o.select(a.alias("a"), F.get(names, (F.col("o_orderkey") % 4).cast("int")).alias("b")), ["pass", "minor", "major"]), ["strict", "lenient"])


@query("d25_label_consistency", """with t as (select distinct source, lang, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+')) as w from documents where source is not null and lang is not null),
n as (select source, lang, count(*) as n from t group by 1, 2), f as (select lang from n group by 1 having count(*) = (select count(distinct source) from t)),
x as (select a.lang, a.source as a, b.source as b, count(*) as c from t a join t b on a.lang = b.lang and a.w = b.w and a.source < b.source group by 1, 2, 3),
p as (select na.lang, coalesce(c, 0) / (na.n + nb.n - coalesce(c, 0)) as j from n na join n nb on na.lang = nb.lang and na.source < nb.source left join x on x.lang = na.lang and x.a = na.source and x.b = nb.source where na.lang in (select lang from f))
select lang, round(avg(j), 6) as mean, round(min(j), 6) as min, count(*) as pairs, avg((j = 1)::int) as exact from p group by 1""")
def d25(spark, sf_dir):
    from maploom.functions.text import token_set

    d = fx.table(spark, sf_dir, "documents").select("source", "lang", F.explode(token_set(F.col("text"))).alias("token"))
    return rounded(A.label_consistency(d, "lang", "source", "token"), ["mean", "min"])


@query("d26_run_summary", f"select experiment, variant, count(*) as runs, count(*) filter (seed % 7 <> 0) as complete, count(*) filter (repeat = 2) as diagnostic, round(avg((metric > 150000)::int) filter (seed % 5 <> 0), 6) as pass_rate, round(avg(metric) / 3, 6) as mean, round(quantile_cont(metric, 0.5) / 3, 6) as median, round(min(metric) / 3, 6) as min, round(max(metric) / 3, 6) as max from ({fx.RUNS}) group by 1, 2")
def d26(spark, sf_dir):
    r = fx.runs(spark, sf_dir).withColumns({"complete": F.col("seed") % 7 != 0, "diagnostic": F.col("repeat") == 2, "passed": F.when(F.col("seed") % 5 != 0, F.col("metric") > 150000), "metric": F.col("metric") / 3})
    return rounded(A.run_summary(r), ["pass_rate", "mean", "median", "min", "max"])


@query("d27_bootstrap_ci")
def d27(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("value"))
    return rounded(A.bootstrap_ci(li, "l_returnflag", 50, 3), ["low", "middle", "high"])


_B, _C = f"(select * from ({fx.RUNS}) where variant = 'F')", f"(select * from ({fx.RUNS}) where variant = 'O')"
_PD = f"(select experiment, seed, repeat, c.metric - b.metric as diff from {_B} b join {_C} c using (experiment, seed, repeat))"


def _variants(spark, sf_dir):
    r = fx.runs(spark, sf_dir)
    return r.filter("variant = 'F'"), r.filter("variant = 'O'")


@query("d29_paired_effect", f"select experiment, count(*) as n, round(avg(diff) / 3, 6) as mean, round(quantile_cont(diff, 0.5) / 3, 6) as median, count(*) filter (diff > 0) as better from {_PD} group by 1")
def d29(spark, sf_dir):
    e = A.paired_effect(*_variants(spark, sf_dir))
    return rounded(e.withColumns({c: F.col(c) / 3 for c in ("mean", "median")}), ["mean", "median"])


@query("d29_sign_flip")  # random above 20 pairs: tests/test_whole.py holds it against exact masks and other draws
def d29_flip(spark, sf_dir):
    d = A.paired_differences(*_variants(spark, sf_dir)).withColumnRenamed("experiment", "g")
    return rounded(A.sign_flip_p(d, "g"), ["p"])


_MESH = "v as (select p_partkey as vid, (p_partkey % 40) % 8 as x, (p_partkey % 40) // 8 as y, p_partkey // 40 as z from part), f as (select vid as a, vid + 1 as b, case when vid % 97 = 0 then -1 else vid + 8 end as c from v where x < 7 and vid % 40 < (case when z % 3 = 0 then 16 else 32 end))"


def _mesh(spark, sf_dir):
    p = fx.parts(spark, sf_dir)
    n = F.col("id") % 40
    v = p.select(F.col("id").alias("vid"), (n % 8).cast("double").alias("x"), F.floor(n / 8).cast("double").alias("y"), F.floor(F.col("id") / 40).cast("double").alias("z"))
    return v, p.filter((n % 8 < 7) & (n < F.when(F.floor(F.col("id") / 40) % 3 == 0, 16).otherwise(32))).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.when(F.col("id") % 97 == 0, -1).otherwise(F.col("id") + 8).alias("c"))


@query("d30_mesh_components")
def d30_components(spark, sf_dir):
    return rounded(A.mesh_components(*_mesh(spark, sf_dir)), ["area"])


# every face has half a square of area, so components differ in area by their number of faces
@query("d30_mesh_quality", f"""with recursive {_MESH}, g as (select * from f where b in (select vid from v) and c in (select vid from v)), e as (select a, b from g union select b, a from g union select b, c from g union select c, b from g),
r as (select a as node, a as seen from e union select r.node, e.b from r join e on e.a = r.seen), m as (select node, min(seen) as component from r group by 1), n as (select component, count(*) as nodes from m group by 1),
s as (select component, nodes, count(*) * 0.5::double as area from n join m using (component) join g on g.a = m.node group by 1, 2)
select (select count(*) from v) as vertices, (select count(*) from f) as faces, (select count(*) from v) as welded, count(*) as components, (select count(*) from v) - sum(nodes)::bigint as isolated, (select count(*) from f) - (select count(*) from g) as invalid_faces,
round(max(nodes) / sum(nodes), 6) as largest_ratio, round(sum(area), 6) as area, round(max(area) / sum(area), 6) as largest_area_ratio, count(*) filter (area >= 12) as significant, round(coalesce(sum(area) filter (area < 12), 0) / sum(area), 6) as tiny_area_ratio from s""")
def d30(spark, sf_dir):
    return rounded(A.mesh_quality(*_mesh(spark, sf_dir), significant=12.0), ["largest_ratio", "area", "largest_area_ratio", "tiny_area_ratio"])


@query("d31_connected_components", """with recursive e as (select distinct o_orderkey as a, o_orderkey - o_custkey % 2 as b from orders), s as (select a, b from e union select b, a from e),
r as (select a as node, a as seen from s union select r.node, s.b from r join s on s.a = r.seen) select node, min(seen) as component from r group by 1""")
def d31(spark, sf_dir):
    from maploom.operators.graphs import connected_components

    o = fx.table(spark, sf_dir, "orders")
    return connected_components(o.select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") - F.col("o_custkey") % 2).alias("b")))


@query("d33_voxel_downsample", f"select arg_min(id, id) as id from ({fx.POINTS}) group by floor(x / 0.8), floor(y / 0.8), floor(z / 0.8)")
def d33(spark, sf_dir):
    return A.voxel_downsample(fx.points(spark, sf_dir), 0.8, "id").select("id")


@query("d34_z_buffer", f"with p as (select id, round_even(20 * x / (z + 4) + 32, 0)::bigint as u, round_even(20 * y / (z + 4) + 24, 0)::bigint as v, z + 4 as z from ({fx.POINTS}) where z + 4 > 0) select u, v, arg_min(id, {{'z': z, 'id': id}}) as id, round(min(z), 6) as depth from p group by 1, 2")
def d34(spark, sf_dir):
    p = fx.points(spark, sf_dir).withColumn("z", F.col("z") + 4)
    return rounded(A.z_buffer(p, (20.0, 20.0, 32.0, 24.0)), ["depth"])


@query("d35_dbscan", f"""with recursive p as ({fx.POINTS}), n as (select a.id, b.id as other from p a join p b on sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) <= 0.5), core as (select id from n group by 1 having count(*) >= 6),
l as (select n.id as a, other as b from n join core using (id) where other in (select id from core)), r as (select a as node, b as seen from l union select r.node, l.b from r join l on l.a = r.seen), c as (select node, min(seen) as cluster from r group by 1),
b as (select id, min(other) as node from n where id not in (select id from core) and other in (select id from core) group by 1)
select node as id, cluster from c union all select id, cluster from b join c using (node)""")
def d35(spark, sf_dir):
    return A.dbscan(fx.points(spark, sf_dir), 0.5, 6)


@query("d35_cluster_geometry", f"""with recursive p as (select id, label as record, x, y, z, id % 7 + 1 as support from ({fx.POINTS})), n as (select a.id, b.id as other from p a join p b on a.record = b.record and sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) <= 0.7), core as (select id from n group by 1 having count(*) >= 4),
l as (select n.id as a, other as b from n join core using (id) where other in (select id from core)), r as (select a as node, b as seen from l union select r.node, l.b from r join l on l.a = r.seen), k as (select node, min(seen) as cluster from r group by 1),
b as (select id, min(other) as node from n where id not in (select id from core) and other in (select id from core) group by 1), c as (select node as id, cluster from k union all select id, cluster from b join k using (node)),
cam as (select record, min(x) + i as cx, min(y) - 1 as cy, min(z) as cz from p, range(4) t(i) group by record, i), d as (select p.*, cluster, (select min(sqrt(pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2))) from cam where cam.record = p.record) as camera from p join c using (id)),
g as (select record, cluster, count(*) as points, quantile_cont(camera, 0.5) as camera, quantile_cont(support, 0.5) as support, {', '.join(f'quantile_cont({a}, 0.05) as {a}0, quantile_cont({a}, 0.95) as {a}1' for a in 'xyz')} from d group by 1, 2),
s as (select * from g qualify points >= greatest(5, ceil(max(points) over (partition by record) * 0.03))) select record, cluster, count(*) over (partition by record) as candidates, points, round(camera, 6) as camera, round(support, 6) as support,
{', '.join(f'round(({a}0 + {a}1) / 2, 6) as {a}, round(greatest({a}1 - {a}0, 0.02), 6) as d{a}' for a in 'xyz')} from s qualify row_number() over (partition by record order by s.camera, s.support desc, points desc, cluster) = 1""")
def d35_geometry(spark, sf_dir):
    p = fx.points(spark, sf_dir).select("id", F.col("label").alias("record"), "x", "y", "z", (F.col("id") % 7 + 1).alias("support"))
    low = p.groupBy("record").agg(*[F.min(c).alias(f"c{c}") for c in "xyz"])
    cameras = low.select("record", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("cx") + i)).alias("cx"), (F.col("cy") - 1).alias("cy"), "cz")
    return rounded(A.cluster_geometry(p, cameras, 0.7, 4, 5), ["camera", "support", *"xyz", "dx", "dy", "dz"])


@query("d36_failure_cases", """with f as (select l_orderkey as frame, sum(l_quantity) as q, max(l_discount) as d, count(*) as n from lineitem group by 1)
select 'heavy-' || frame as case_id, 'depth' as stage, 'high' as severity from f where q > 250 union all select 'discount-' || frame, 'pose', 'low' from f where d >= 0.1 and n > 6
union all select * from (select 'most-' || frame, 'map', 'high' from f order by q desc, frame limit 25) union all select * from (select 'least-' || frame, 'map', 'low' from f order by q, frame limit 10)""")
def d36(spark, sf_dir):
    f = fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("frame")).agg(F.sum("l_quantity").alias("q"), F.max("l_discount").alias("d"), F.count(F.lit(1)).alias("n"))
    return A.failure_cases(f, [("heavy", "depth", "high", F.col("q") > 250), ("discount", "pose", "low", (F.col("d") >= 0.1) & (F.col("n") > 6))], [("most", "map", "high", "q", True, 25), ("least", "map", "low", "q", False, 10)])


@query("d37_merge_action_summary", "select l_linestatus as variant, l_returnflag as action, count(*) as n, round(count(*) / sum(count(*)) over (partition by l_linestatus), 6) as share from lineitem group by 1, 2")
def d37(spark, sf_dir):
    return rounded(A.merge_action_summary(fx.table(spark, sf_dir, "lineitem"), "l_linestatus", "l_returnflag"), ["share"])


@query("d37_top_collisions", "with c as (select l_linestatus as variant, l_suppkey as entity, count(distinct l_partkey) as others, count(*) as n from lineitem group by 1, 2) select variant, entity, others, n, (row_number() over (partition by variant order by others desc, entity))::int as place from c qualify place <= 8")
def d37_top(spark, sf_dir):
    return A.top_collisions(fx.table(spark, sf_dir, "lineitem"), "l_linestatus", "l_suppkey", "l_partkey")


@query("d38_pareto_frontier", f"with p as ({fx.PARTS}) select id from p a where not exists (select 1 from p b where b.x >= a.x and b.y <= a.y and b.z >= a.z and (b.x > a.x + 1e-12 or b.y < a.y - 1e-12 or b.z > a.z + 1e-12))")
def d38(spark, sf_dir):
    return A.pareto_frontier(fx.parts(spark, sf_dir), "id", ["x", "z"], ["y"]).select("id")


_OFFERS = "select l_orderkey * 8 + l_linenumber as id, cast(l_quantity as double) as quantity, cast(l_discount as double) as discount, cast(l_extendedprice as double) as price, cast(l_tax as double) as tax from lineitem"


@query("d38_pareto_offers", f"with p as ({_OFFERS}), b as (select quantity, discount, tax, min(price) as price from p group by 1, 2, 3) select id from p a where not exists (select 1 from b where b.quantity >= a.quantity and b.discount >= a.discount and b.price <= a.price and b.tax <= a.tax and (b.quantity > a.quantity + 1e-12 or b.discount > a.discount + 1e-12 or b.price < a.price - 1e-12 or b.tax < a.tax - 1e-12))")
def d38_offers(spark, sf_dir):
    o = fx.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), *[F.col(f"l_{c}").cast("double").alias(n) for n, c in (("quantity", "quantity"), ("discount", "discount"), ("price", "extendedprice"), ("tax", "tax"))])
    return A.pareto_frontier(o, "id", ["quantity", "discount"], ["price", "tax"]).select("id")


@query("d39_factor_effects", f"with c as (select id % 4 as f1, id % 3 as f2, round(avg(y), 6) as m from ({fx.PARTS}) group by 1, 2) select f2, round(arg_max(m, f1) - arg_min(m, f1), 6) as effect, count(distinct f1) as levels from c group by 1 having count(distinct f1) > 1")
def d39(spark, sf_dir):
    c = fx.parts(spark, sf_dir).groupBy((F.col("id") % 4).alias("f1"), (F.col("id") % 3).alias("f2")).agg(F.round(F.avg("y"), 6).alias("m"))
    return rounded(A.factor_effects(c, "f1", ["f2"], "m"), ["effect"])


@query("d40_ab_delta", f"""with s as (select avg(value) filter (k < 50) as a, avg(value) filter (k >= 50) as b, max(value) filter (k < 50) as ma, max(value) filter (k >= 50) as mb, count(*) filter (k < 50) as na, count(*) filter (k >= 50) as nb from ({fx.EVENTS}))
select path, round(delta, 6) as delta from (select unnest(['n', 'value.mean', 'value.extremes.max']) as path, unnest([nb::double - na, b - a, mb - ma]) as delta from s)""")
def d40(spark, sf_dir):
    e = fx.events(spark, sf_dir)
    nested = F.struct(F.avg("value").alias("mean"), F.struct(F.max("value").alias("max")).alias("extremes"), F.max("kind").alias("kind")).alias("value")
    a, b = (A.flat_numbers(e.filter(c).agg(F.count(F.lit(1)).alias("n"), nested)) for c in ("k < 50", "k >= 50"))
    return rounded(A.ab_delta(a, b), ["delta"])


@query("d41_dose_response", f"""with c as (select name as family, id % 4 as dose, avg((x > 10 + 5 * (id % 4))::int) as rate from ({fx.PARTS}) group by 1, 2), l as (select *, lag(rate) over (partition by family order by dose) as p from c)
select family, round(min(rate) filter (dose >= 1), 6) as worst, bool_and(p is null or rate >= p - 1e-12) as monotone, min(rate) filter (dose >= 1) >= 0.6 as passed from l group by 1""")
def d41(spark, sf_dir):
    c = fx.parts(spark, sf_dir).groupBy(F.col("name").alias("family"), (F.col("id") % 4).alias("dose")).agg(F.avg((F.col("x") > 10 + 5 * (F.col("id") % 4)).cast("double")).alias("rate"))
    return rounded(A.dose_response(c, 0.6), ["worst"])


@query("d42_pair_detection", f"""{_SUP}, s as (select frame, off, avg((abs(depth - other) <= 0.04 + 0.1 * depth)::int) as a, avg((abs(depth * 1.2 - other) <= 0.04 + 0.12 * depth)::int) as b from j where abs(off) = 1 group by 1, 2)
select frame, off::bigint as neighbour, a - b >= 0.01 as detected from s""")
def d42(spark, sf_dir):
    s = support(spark, sf_dir).filter("abs(offset) = 1 and status >= 3")
    worse = F.abs(F.col("predicted") * 1.2 - F.col("other")) <= 0.04 + 0.12 * F.col("predicted")
    g = s.groupBy("frame", F.col("offset").alias("neighbour")).agg(F.avg(F.col("agrees").cast("double")).alias("a"), F.avg(worse.cast("double")).alias("b"))
    return g.select("frame", "neighbour", (F.col("a") - F.col("b") >= 0.01).alias("detected"))


@query("d43_projection_displacement", f"with p as (select label, sqrt(pow(20 * x / (z + 20) - 20 * (x + 0.1) / (z + 20.2), 2) + pow(20 * y / (z + 20) - 20 * y / (z + 20.2), 2)) as d from ({fx.POINTS})) select label, count(*) as n, round(avg(d), 6) as mean, round(quantile_cont(d, 0.5), 6) as median, round(quantile_cont(d, 0.9), 6) as p90, round(max(d), 6) as max from p group by 1")
def d43(spark, sf_dir):
    from maploom.functions.geometry import project

    p = fx.points(spark, sf_dir)
    k = (20.0, 20.0, 0.0, 0.0)
    a = project([F.col("x"), F.col("y"), F.col("z") + 20], k)
    b = project([F.col("x") + 0.1, F.col("y"), F.col("z") + 20.2], k)
    d = p.select("label", F.hypot(a[0] - b[0], a[1] - b[1]).alias("d"))
    g = d.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.percentile("d", 0.5).alias("median"), F.percentile("d", 0.9).alias("p90"), F.max("d").alias("max"))
    return rounded(g, ["mean", "median", "p90", "max"])


@query("d45_label_raster", """with p as (select l_linenumber::bigint as frame, l_orderkey % 64 as u, l_partkey % 48 as v, l_suppkey % 5 as label, l_discount as conf, l_orderkey * 100000 + l_partkey * 10 + l_linenumber as ord from lineitem)
select frame, u, v, label, count(*) over (partition by frame, u, v) as claims from p qualify row_number() over (partition by frame, u, v order by conf desc, ord) = 1""")
def d45(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    p = li.select(F.col("l_linenumber").cast("bigint").alias("frame"), (F.col("l_orderkey") % 64).alias("u"), (F.col("l_partkey") % 48).alias("v"), (F.col("l_suppkey") % 5).alias("label"), F.col("l_discount").alias("conf"), (F.col("l_orderkey") * 100000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return A.label_raster(p)


@query("d46_temporal_reject", f"""{_SUP}, px as (select frame, u, v, count(*) filter (depth <= other + 0.04 + 0.1 * depth) as judged, count(*) filter (depth <= other + 0.04 + 0.1 * depth and abs(depth - other) <= 0.04 + 0.1 * depth) as supported from j group by 1, 2, 3)
select frame, count(*) as pixels, count(*) filter (judged >= 2 and supported / judged < 0.25) as rejected from px group by 1""")
def d46(spark, sf_dir):
    return A.temporal_reject(support(spark, sf_dir).filter("status >= 3"))


@query("d47_geometry_rollup", "with f as (select l_orderkey % 300 as frame, quantile_cont(l_discount, 0.5) as p50, quantile_cont(l_discount, 0.95) as p95, avg((l_tax > 0)::int) as positive, max(l_quantity) as delta from lineitem group by 1) select delta > 49 as skipped, count(*) as frames, round(quantile_cont(p50, 0.5), 6) as p50, round(quantile_cont(p95, 0.5), 6) as p95, count(*) filter (p50 < 0.05 and p95 < 0.098 and positive > 0.85) as passed from f group by 1")
def d47(spark, sf_dir):
    f = fx.table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 300).alias("frame")).agg(F.percentile("l_discount", 0.5).alias("p50"), F.percentile("l_discount", 0.95).alias("p95"), F.avg((F.col("l_tax") > 0).cast("double")).alias("positive"), F.max("l_quantity").alias("delta"))
    ok = (F.col("p50") < 0.05) & (F.col("p95") < 0.098) & (F.col("positive") > 0.85)
    g = f.groupBy((F.col("delta") > 49).alias("skipped")).agg(F.count(F.lit(1)).alias("frames"), F.percentile("p50", 0.5).alias("_a"), F.percentile("p95", 0.5).alias("_b"), F.count_if(ok).alias("passed"))
    return g.select("skipped", "frames", r6(F.col("_a"), "p50"), r6(F.col("_b"), "p95"), "passed")


@query("d28_block_bootstrap")
def d28(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("value"))
    m = A.block_bootstrap(o, "g", "i", 25, 40, 3).withColumn("stat", F.lit("mean"))
    return rounded(m.unionByName(A.block_bootstrap(o, "g", "i", 25, 40, 3, "median").withColumn("stat", F.lit("median"))), ["low", "middle", "high"], 4)


@query("d32_inventory_summary", """with f as (select page_id, coalesce(regexp_extract(url, '^https?://[^/]*/([a-z]+)/', 1), '') as root, case when contains(url, '.html') then 'html' else '' end as extension, length(url)::bigint as bytes from pages),
x as (select page_id, root, extension, bytes, case page_id % 4 when 0 then 'unknown' else 'stage' || page_id % 4 end as stage, 'kind' || page_id % 3 as kind, case when page_id % 5 = 0 then 'slow|empty' when page_id % 7 = 0 then 'slow' end as errors from f),
a as (select 'all' as axis, '*' as value, bytes from x union all select 'root', root, bytes from x union all select 'extension', extension, bytes from x union all select 'stage', stage, bytes from x union all select 'kind', kind, bytes from x union all select 'error', unnest(string_split(errors, '|')), bytes from x where errors is not null)
select axis, value, count(*) as files, sum(bytes)::bigint as bytes from a group by 1, 2""")
def d32(spark, sf_dir):
    p = fx.table(spark, sf_dir, "pages")
    i = F.col("page_id")
    kind = F.when(F.contains("url", F.lit(".html")), ".html").otherwise("")
    path = F.concat(F.regexp_extract("url", "^https?://[^/]*/([a-z]+)/", 1), F.lit("/page"), kind)
    stage = F.when(i % 4 > 0, F.concat(F.lit("stage"), (i % 4).cast("string")))
    errors = F.when(i % 5 == 0, "slow|empty|slow").when(i % 7 == 0, " slow ")
    return A.inventory_summary(p.select(path.alias("path"), F.length("url").cast("bigint").alias("bytes"), stage.alias("stage"), F.concat(F.lit("kind"), (i % 3).cast("string")).alias("kind"), errors.alias("errors")))


@query("d44_edge_errors", f"""with p as (select id, x, y, (id * 7) % 360 as yaw from ({fx.PARTS})), e as (select a.id, a.id % 3 as kind, a.x as ax, a.y as ay, a.yaw as ayaw, b.x as bx, b.y as by_, b.yaw as byaw from p a join p b on b.id = a.id + 1),
r as (select kind, sqrt(pow(cos(radians(ayaw)) * (bx - ax) + sin(radians(ayaw)) * (by_ - ay) - 1, 2) + pow(-sin(radians(ayaw)) * (bx - ax) + cos(radians(ayaw)) * (by_ - ay) - 0.5, 2)) as m, abs((((byaw - ayaw - 5 + 180) % 360) + 360) % 360 - 180)::double as t from e)
select kind, count(*) as n, round(quantile_cont(m, 0.5), 6) as move_p50, round(quantile_cont(m, 0.95), 6) as move_p95, round(quantile_cont(t, 0.5), 6) as turn_p50, round(quantile_cont(t, 0.95), 6) as turn_p95 from r group by 1""")
def d44(spark, sf_dir):
    p = fx.parts(spark, sf_dir)
    poses = p.select("id", "x", "y", ((F.col("id") * 7) % 360).cast("double").alias("yaw"))
    edges = p.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), (F.col("id") % 3).alias("kind"), F.lit(1.0).alias("dx"), F.lit(0.5).alias("dy"), F.lit(5.0).alias("dyaw"))
    return rounded(A.edge_errors(poses, edges), ["move_p50", "move_p95", "turn_p50", "turn_p95"])
