"""C: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from maploom.operators import joins as J
from maploom.plans import fixtures as fx
from maploom.plans import query
from maploom.plans.scalars import K, r6


@query("c1_current_mapping", f"select o_orderkey as local, entity, name from orders join ({fx.ENTITIES}) on o_custkey = entity where not deleted")
def c1(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("local"), F.col("o_custkey").alias("entity"))
    return J.current_mapping(o, fx.entities(spark, sf_dir)).select("local", "entity", "name")


@query("c2_deliverable", f"""select op, us, entity from (select seq as op, case status when 'F' then 'ready' when 'O' then 'retry' else 'done' end as status, us, entity from ({fx.VERSIONS})) join (select distinct entity from ({fx.ENTITIES})) using (entity)
where status in ('ready', 'retry') order by us, op limit 200""")
def c2(spark, sf_dir):
    v = fx.versions(spark, sf_dir)
    status = F.when(F.col("status") == "F", "ready").when(F.col("status") == "O", "retry").otherwise("done")
    d = v.select(F.col("seq").alias("op"), "us", status.alias("status"))
    o = v.select(F.col("seq").alias("op"), "entity").join(fx.entities(spark, sf_dir).select("entity"), "entity")
    return J.deliverable(d, o, 200).select("op", "us", "entity")  # the feature is a bounded queue read


@query("c3_frame_wide", """with f as (select l_orderkey as frame, count(*) as observed, sum(l_quantity) as area from lineitem group by 1)
select o_orderkey as frame, observed, area, c_mktsegment as segment, n_name as region, o_orderkey - lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as gap
from orders left join f on o_orderkey = frame left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey""")
def c3(spark, sf_dir):
    from pyspark.sql import Window as W

    t = {n: fx.table(spark, sf_dir, n) for n in ("orders", "lineitem", "customer", "nation")}
    f = t["lineitem"].groupBy(F.col("l_orderkey").alias("frame")).agg(F.count(F.lit(1)).alias("observed"), F.sum("l_quantity").alias("area"))
    o = t["orders"].select(F.col("o_orderkey").alias("frame"), F.col("o_custkey").alias("c_custkey"))
    o = o.withColumn("gap", F.col("frame") - F.lag("frame").over(W.partitionBy("c_custkey").orderBy("frame")))
    o = o.join(f, "frame", "left").join(t["customer"].select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("n_nationkey")), "c_custkey", "left")
    return o.join(t["nation"].select("n_nationkey", F.col("n_name").alias("region")), "n_nationkey", "left").select("frame", "observed", "area", "segment", "region", "gap")


_Q = f"(select key, us, seq from ({fx.EVENTS}) where kind = 'error')"
_T = f"(select key, us, seq, value from ({fx.EVENTS}) where kind <> 'error')"


@query("c4_nearest_in_time", f"""with j as (select q.key, q.us, q.seq, t.seq as near_seq, t.value as near_value, abs(q.us - t.us) as gap, row_number() over (partition by q.key, q.seq order by abs(q.us - t.us), t.us, t.seq) as r from {_Q} q join {_T} t using (key))
select key, seq, gap, near_seq, near_value from j where r = 1""")
def c4(spark, sf_dir):
    e = fx.events(spark, sf_dir)
    q, t = e.filter("kind = 'error'").select("key", "us", "seq"), e.filter("kind <> 'error'").select("key", "us", F.col("seq").alias("at"), "value")
    return J.nearest_in_time(q, t, ["key"], "us", ["value"], "at").filter("near_at is not null").select("key", "seq", "gap", F.col("near_at").alias("near_seq"), "near_value")


def _poses(spark, sf_dir):
    e = fx.clock(spark, sf_dir).filter("kind <> 'error'")
    a = F.radians((F.col("seq") % 180).cast("double")) / 2
    return e.select("key", "ns", F.col("seq").alias("at"), F.col("value").alias("x"), (F.col("seq") % 100).cast("double").alias("y"), F.lit(0.0).alias("z"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(a).alias("qz"), F.cos(a).alias("qw"))


_S = f"(select key, ns, max(seq) as seq, arg_max(value, seq) as x, cast(max(seq) % 100 as double) as y from ({fx.CLOCK}) where kind <> 'error' group by key, ns)"


@query("c5_interpolate_pose", f"""with q as (select key, ns, seq from ({fx.CLOCK}) where kind = 'error'),
p as (select q.*, s.ns as pns, s.x as px, s.y as py, s.seq % 180 as pa from q asof left join {_S} s on q.key = s.key and q.ns >= s.ns),
n as (select p.*, s.ns as nns, s.x as nx, s.y as ny, s.seq % 180 as na from p asof left join {_S} s on p.key = s.key and p.ns <= s.ns),
f as (select key, seq, coalesce(px, nx) as px, coalesce(nx, px) as nx, coalesce(py, ny) as py, coalesce(ny, py) as ny, coalesce(pa, na) as pa, coalesce(na, pa) as na, case when nns > pns then (ns - pns)::double / (nns - pns) else 0 end as f, pns is null or nns is null as clamped from n)
select key, seq, round(px + (nx - px) * f, 5) as x, round(py + (ny - py) * f, 5) as y, round(pa + (na - pa) * f, 3) as yaw, clamped from f""")
def c5(spark, sf_dir):
    from maploom.functions.geometry import yaw_deg

    q = fx.clock(spark, sf_dir).filter("kind = 'error'").select("key", "ns", "seq")
    j = J.interpolate_pose(_poses(spark, sf_dir), q, ["key"], "ns", "at")
    return j.select("key", "seq", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), F.round(yaw_deg([F.col(c) for c in ("qx", "qy", "qz", "qw")]), 3).alias("yaw"), "clamped")


@query("c6_compose_pose_chain", f"""with q as (select key, ns, seq from ({fx.CLOCK}) where kind = 'error'),
p as (select q.*, s.ns as pns, s.x as px, s.y as py, s.seq % 180 as pa from q asof left join {_S} s on q.key = s.key and q.ns >= s.ns),
n as (select p.*, s.ns as nns, s.x as nx, s.y as ny, s.seq % 180 as na from p asof left join {_S} s on p.key = s.key and p.ns <= s.ns),
f as (select key, seq, coalesce(px, nx) as px, coalesce(nx, px) as nx, coalesce(py, ny) as py, coalesce(ny, py) as ny, coalesce(pa, na) as pa, coalesce(na, pa) as na, case when nns > pns then (ns - pns)::double / (nns - pns) else 0 end as f from n)
select key, seq, round(px + (nx - px) * f + 0.1 * cos(radians(pa + (na - pa) * f)), 4) as x, round(py + (ny - py) * f + 0.1 * sin(radians(pa + (na - pa) * f)), 4) as y from f""")
def c6(spark, sf_dir):
    from maploom.functions.geometry import compose, quat_to_matrix

    q = fx.clock(spark, sf_dir).filter("kind = 'error'").select("key", "ns", "seq")
    j = J.interpolate_pose(_poses(spark, sf_dir), q, ["key"], "ns", "at")
    base = quat_to_matrix([F.col(c) for c in ("qx", "qy", "qz", "qw")], [F.col(c) for c in "xyz"])
    camera = F.array(*[F.lit(x) for x in (1.0, 0, 0, 0.1, 0, 1.0, 0, 0, 0, 0, 1.0, 0.2, 0, 0, 0, 1.0)]).cast("array<double>")
    j = j.withColumn("m", compose(base, camera))
    return j.select("key", "seq", F.round(F.col("m")[3], 4).alias("x"), F.round(F.col("m")[7], 4).alias("y"))


@query("c7_match_streams_monotonic")
def c7(spark, sf_dir):
    e = fx.clock(spark, sf_dir).select("key", F.col("ns").alias("t"), "seq", "kind")
    return J.match_streams(e.filter("kind = 'view'"), e.filter("kind = 'click'"), ["key"], 400_000)


@query("c8_pose_coverage", f"""with q as (select key, ns, seq from ({fx.CLOCK}) where kind = 'error'), s as (select key, ns from ({fx.CLOCK}) where kind <> 'error'),
b as (select q.*, p.ns as p from q asof left join s p on q.key = p.key and q.ns >= p.ns), c as (select b.*, n.ns as n from b asof left join s n on b.key = n.key and b.ns <= n.ns)
select key, seq, case when p = ns or n = ns then 0 else n - p end as gap, case when p = ns or n = ns then 'exact' when p is null or n is null then 'outside' when n - p > 2000000 then 'gap' else 'covered' end as status from c""")
def c8(spark, sf_dir):
    e = fx.clock(spark, sf_dir)
    q, p = e.filter("kind = 'error'").select("key", "ns", F.col("seq").alias("id")), e.filter("kind <> 'error'").select("key", "ns", "seq")
    return J.pose_coverage(q, p, ["key"], "ns", 2_000_000).select("key", F.col("id").alias("seq"), F.col("gap").cast("bigint").alias("gap"), "status")


_D3 = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"


@query("c9_knn_assign", f"""with b as (select place, case when place % 4 = 0 then null else room end as room, x, y, z from ({fx.PLACES})),
r as (select a.id, place, room, {_D3} as d, row_number() over (partition by a.id order by {_D3}, place) as r from ({fx.PARTS}) a, b),
p as (select id, min(r) filter (room is not null) as first from r where r <= 5 group by id)
select r.id, place, room, round(d, 6) as distance from r join p on r.id = p.id and r = coalesce(first, 1)""")
def c9(spark, sf_dir):
    p = fx.places(spark, sf_dir).withColumn("room", F.when(F.col("place") % 4 != 0, F.col("room")))
    return J.knn_assign(fx.parts(spark, sf_dir).select("id", "x", "y", "z"), p, 16.0).select("id", "place", "room", r6(F.col("distance"), "distance"))


@query("c10_place_room_map", "select 1000 + n_nationkey as place, n_regionkey + 1 as room from nation")
def c10(spark, sf_dir):
    n, r = fx.table(spark, sf_dir, "nation"), fx.table(spark, sf_dir, "region")
    nodes = n.select((1000 + F.col("n_nationkey")).alias("id"), F.lit(3).alias("layer")).union(r.select((F.col("r_regionkey") + 1).alias("id"), F.lit(4).alias("layer")))
    a, b = (1000 + F.col("n_nationkey")), (F.col("n_regionkey") + 1)
    flip = F.col("n_nationkey") % 2 == 0
    edges = n.select(F.when(flip, a).otherwise(b).alias("source"), F.when(flip, b).otherwise(a).alias("target"))
    return J.place_room_map(nodes, edges, 3, 4)


@query("c11_radius_join", f"select b.place, a.id, round({_D3}, 6) as distance from ({fx.PARTS}) a, ({fx.PLACES}) b where {_D3} <= 5")
def c11(spark, sf_dir):
    r = max(5.0, min(15.0, 3.0))  # a radius is kept within 5 to 15
    j = J.radius_join(fx.parts(spark, sf_dir).select("id", "x", "y", "z"), fx.places(spark, sf_dir).select("place", "x", "y", "z"), r)
    return j.select("place", "id", r6(F.col("distance"), "distance"))


@query("c12_pairwise_distances", f"select a.place as id1, b.place as id2, round({_D3}, 6) as distance from ({fx.PLACES}) a, ({fx.PLACES}) b where a.place < b.place and {_D3} <= 40")
def c12(spark, sf_dir):
    p = fx.places(spark, sf_dir).select("place", "x", "y", "z")
    j = J.radius_join(p.withColumnRenamed("place", "id1"), p.withColumnRenamed("place", "id2"), 40.0).filter("id1 < id2")
    return j.select("id1", "id2", r6(F.col("distance"), "distance"))


@query("c13_bind_entities")
def c13(spark, sf_dir):
    p = fx.parts(spark, sf_dir)
    dims = [(F.lit(1.0) + (F.col("x").cast("int") % 3)).alias("dx"), F.lit(1.0).alias("dy"), F.lit(0.5).alias("dz")]
    e = p.filter("id % 2 = 0").select(F.col("id").alias("entity"), (F.col("id") % 5).alias("semantic"), F.lit(None).cast("bigint").alias("bound"), "x", "y", "z", *dims)
    m = p.filter("id % 2 = 1").select(F.col("id").alias("node"), (F.col("id") % 5).alias("label"), "x", "y", "z", *dims, (F.col("id") % 7 != 0).alias("has_mesh"), F.when(F.col("id") % 11 == 0, F.col("id")).alias("owner"))
    return J.bind_entities(e, m, 0.75, 1.0)


@query("c14_attach_to_nearest_place", f"""with r as (select a.id, place, row_number() over (partition by a.id order by {_D3}, place) as r from ({fx.PARTS}) a, ({fx.PLACES}) b)
select id, case when id % 3 = 0 then id else place end as parent, case when id % 3 = 0 then 'kept' else 'nearest' end as how from r where r = 1""")
def c14(spark, sf_dir):
    p = fx.parts(spark, sf_dir).withColumn("parent", F.when(F.col("id") % 3 == 0, F.col("id")))
    return J.attach_to_nearest_place(p, fx.places(spark, sf_dir), 16.0)


@query("c15_visible_objects", f"""with v as (select key as view, arg_max(value, us) as x, list_distinct(list(k % 3)) as labels from ({fx.EVENTS}) where kind = 'error' group by key)
select view, id, label, round(sqrt(pow(p.x - v.x, 2) + pow(p.y, 2) + pow(p.z, 2)), 6) as distance from ({fx.POINTS}) p, v where list_contains(labels, label) and label <> 0""")
def c15(spark, sf_dir):
    v = fx.events(spark, sf_dir).filter("kind = 'error'")
    v = v.groupBy(F.col("key").alias("view")).agg(F.max_by("value", "us").alias("x"), F.collect_list(F.col("k") % 3).alias("labels")).withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    return J.visible_objects(v, fx.points(spark, sf_dir)).select("view", "id", "label", r6(F.col("distance"), "distance"))


@query("c16_unknown_refs", "select doc_id as ref, 'label differs' as problem from labels join documents using (doc_id) where quality <> case lang when 'en' then 1 else 0 end union all select doc_id + 1000000, 'unknown record' from labels where toxic = 1")
def c16(spark, sf_dir):
    lb, d = fx.table(spark, sf_dir, "labels"), fx.table(spark, sf_dir, "documents")
    e = lb.select(F.col("doc_id").alias("ref"), F.col("quality").alias("label")).union(lb.filter("toxic = 1").select(F.col("doc_id") + 1000000, "quality"))
    return J.unknown_refs(e, d.select(F.col("doc_id").alias("ref"), (F.col("lang") == "en").cast("int").alias("label")))


@query("c17_in_graph_flag", """with f as (select o_custkey as label, o_orderkey % 10 as frame, avg(o_totalprice) as x, arg_max(o_totalprice, o_orderkey) as value, max(o_orderkey) as seq from orders group by 1, 2)
select label, round(avg(x) / 3, 6) as x, arg_max(value, seq) as last_value, count(*) as frames, any_value(c_custkey) is not null as in_graph from f left join (select c_custkey from customer where c_acctbal >= 0) on label = c_custkey group by label""")
def c17(spark, sf_dir):
    o, c = fx.table(spark, sf_dir, "orders"), fx.table(spark, sf_dir, "customer")
    o = o.select(F.col("o_custkey").alias("label"), (F.col("o_orderkey") % 10).alias("frame"), F.col("o_totalprice").alias("x"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("seq"))
    return J.in_graph_flag(o, c.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("label"))).withColumn("x", F.round(F.col("x") / 3, 6))


SIZE, OFFSETS = (64, 48), [1, -1, 2]

#: comparable pixels ``j``: ``depth`` is the one predicted for the other frame; the point goes to the world by one pose and from there to the other camera
_SUP = f"""with p as ({fx.PIXELS}), t as ({fx.POSES}), c as (select *, (u - 32) * depth / 50 as x, (v - 24) * depth / 55 as y from p where depth between 0.1 and 10),
w as (select frame, u, v, cb * (ca * x + sa * depth) - sb * y + tx as x, sb * (ca * x + sa * depth) + cb * y + ty as y, ca * depth - sa * x + tz as z from c join t using (frame)),
b as (select w.frame, w.u, w.v, m.off, w.frame + m.off as f2, cb * (x - tx) + sb * (y - ty) as gx, cb * (y - ty) - sb * (x - tx) as gy, z - tz as gz, ca, sa from w, (values (1), (-1), (2)) m(off), t where t.frame = w.frame + m.off),
q as (select frame, u, v, off, f2, ca * gx - sa * gz as x, gy as y, sa * gx + ca * gz as z from b), pq as (select *, case when z > 0 then 50 * x / z + 32 end as pu, case when z > 0 then 55 * y / z + 24 end as pv from q),
l as (select r.frame, r.u, r.v, r.off, r.z as depth, r.f2, coalesce(pu between 0 and 63 and pv between 0 and 47, false) as inside, p.depth as other from pq r left join p on p.depth between 0.1 and 10 and p.frame = r.f2 and p.u = round_even(pu, 0) and p.v = round_even(pv, 0) and pu between 0 and 63 and pv between 0 and 47),
j as (select * from l where other is not null)"""


def support(spark, sf_dir):
    return J.reprojection_support(fx.pixels(spark, sf_dir), fx.poses(spark, sf_dir), OFFSETS, K, SIZE, 0.1)


@query("c18_reprojection_support", f"""{_SUP}, g as (select frame, off, f2, count(*) as valid, count(*) filter (inside) as in_bounds, count(other) as comparable, count(*) filter (abs(depth - other) <= 0.04 + 0.1 * depth) as agreeing, count(*) filter (depth <= other + 0.04 + 0.1 * depth) as judged,
quantile_cont(abs(depth - other), 0.5) as m, quantile_cont(abs(depth - other), 0.95) as h, quantile_cont(abs(depth - other) / greatest(depth, 1e-6), 0.5) as rm, quantile_cont(abs(depth - other) / greatest(depth, 1e-6), 0.95) as rh from l group by 1, 2, 3)
select g.frame, off::bigint as "offset", valid, in_bounds, comparable, agreeing, judged, round(m, 6) as median_error, round(h, 6) as p95_error, round(rm, 6) as median_relative, round(rh, 6) as p95_relative, case when comparable > 0 then round(agreeing / comparable, 6) end as rate,
round(sqrt(pow(a.tx - b.tx, 2) + pow(a.ty - b.ty, 2) + pow(a.tz - b.tz, 2)), 6) as translation,
round(degrees(acos((a.cb * a.ca * b.cb * b.ca + a.sb * b.sb + a.cb * a.sa * b.cb * b.sa + a.sb * a.ca * b.sb * b.ca + a.cb * b.cb + a.sb * a.sa * b.sb * b.sa + a.sa * b.sa + a.ca * b.ca - 1) / 2)), 6) as rotation_deg from g join t a on a.frame = g.frame join t b on b.frame = f2""")
def c18(spark, sf_dir):
    g = J.reprojection_pairs(support(spark, sf_dir), fx.poses(spark, sf_dir))
    return g.withColumns({c: F.round(c, 6) for c in ("median_error", "p95_error", "median_relative", "p95_relative", "rate", "translation", "rotation_deg")})


@query("c19_left_right_consistency", f"""with p as (select frame, u, v, depth * 1.5 as d from ({fx.PIXELS})), x as (select *, u - d as w from p),
j as (select x.frame, x.u, x.v, x.d, l.d + (h.d - l.d) * (w - floor(w)) as s from x join p l on l.frame = x.frame and l.v = x.v and l.u = floor(w) join p h on h.frame = x.frame and h.v = x.v and h.u = ceil(w))
select frame, u, v, round(abs(d - s), 5) as error, abs(d - s) <= 0.75 + 0.03 * d as consistent, round(exp(-pow(abs(d - s) / (0.75 + 0.03 * d), 2)), 5) as confidence from j""")
def c19(spark, sf_dir):
    p = fx.pixels(spark, sf_dir).select("frame", "u", "v", (F.col("depth") * 1.5).alias("d"))
    j = J.left_right_consistency(p, p)
    return j.select("frame", "u", "v", F.round("error", 5).alias("error"), "consistent", F.round("confidence", 5).alias("confidence"))


@query("c20_nearest_cloud_check", f"""with n as (select a.id % 40 as object, a.id, min({_D3}) as d from ({fx.PARTS}) a, ({fx.POINTS}) b group by 1, 2)
select object, round(quantile_cont(d, 0.5), 5) as median, round(quantile_cont(d, 0.9), 5) as p90, round(avg((d <= 5)::int), 6) as within_5, quantile_cont(d, 0.5) <= 50 and quantile_cont(d, 0.9) <= 90 as passed from n group by 1""")
def c20(spark, sf_dir):
    v = fx.parts(spark, sf_dir).select((F.col("id") % 40).alias("object"), F.col("id").alias("vertex"), "x", "y", "z")
    c = J.nearest_cloud_check(v, fx.points(spark, sf_dir), 8.0, 50.0, 90.0)
    return c.select("object", F.round("median", 5).alias("median"), F.round("p90", 5).alias("p90"), r6(F.col("within_5"), "within_5"), "passed")


@query("c21_nearest_box_check", f"""with b as (select *, 1.0 + (x::bigint % 3) as dx from ({fx.PARTS})), g as (select b.id as box, sqrt(pow(greatest(abs(b.x - p.x) - dx / 2, 0), 2) + pow(greatest(abs(b.y - p.y) - 0.5, 0), 2) + pow(greatest(abs(b.z - p.z) - 0.25, 0), 2)) as gap, sqrt(pow(b.x - p.x, 2) + pow(b.y - p.y, 2) + pow(b.z - p.z, 2)) as d from b, ({fx.POINTS}) p),
r as (select max(sqrt(dx * dx + 1 + 0.25)) / 2 + 3 as reach from b), m as (select box, min(gap) as gap from g, r where d <= reach group by box)
select id as box, round(gap, 5) as gap, coalesce(gap, 'inf'::double) <= 3 as passed from b left join m on id = box""")
def c21(spark, sf_dir):
    b = fx.parts(spark, sf_dir).select(F.col("id").alias("box"), "x", "y", "z", (1.0 + (F.col("x").cast("bigint") % 3)).alias("dx"), F.lit(1.0).alias("dy"), F.lit(0.5).alias("dz"))
    return J.nearest_box_check(b, fx.points(spark, sf_dir), 3.0).select("box", F.round("gap", 5).alias("gap"), "passed")


@query("c22_apply_validation", f"""with r as (select id, name as description, 0.5::double as confidence from ({fx.PARTS})), v as (select id, x <= 40 as passed, x / 10 as p90 from ({fx.PARTS}) where id % 3 <> 0)
select id, case when passed or passed is null then description end as description, round(case when not passed then 0 when passed then greatest(0, 1 - p90 / 5) else confidence end, 6) as confidence, case when not passed then 'failed_validation' end as excluded from r left join v using (id)""")
def c22(spark, sf_dir):
    p = fx.parts(spark, sf_dir)
    report = p.filter("id % 3 <> 0").select("id", (F.col("x") <= 40).alias("passed"), (F.col("x") / 10).alias("p90"))
    out = J.apply_validation(p.select("id", F.col("name").alias("description"), F.lit(0.5).alias("confidence")), report, 5.0)
    return out.withColumn("confidence", F.round("confidence", 6))


@query("c23_lift_labels", f"""with t as ({fx.POSES}), w as (select id as point, frame, cb * (x - tx) + sb * (y - ty) as gx, cb * (y - ty) - sb * (x - tx) as gy, z + 20 - tz as gz, ca, sa from ({fx.POINTS}), t where sqrt(pow(x - tx, 2) + pow(y - ty, 2)) <= 2),
c as (select point, frame, ca * gx - sa * gz as x, gy as y, sa * gx + ca * gz as z from w), r as (select *, round_even(200 * x / z + 32, 0)::bigint as u, round_even(200 * y / z + 24, 0)::bigint as v from c where z > 0.2),
q as (select frame, u, v, arg_min(point, {{'z': z, 'point': point}}) as point from r where u between 0 and 63 and v between 0 and 47 group by 1, 2, 3),
h as (select distinct q.frame, point, label as record from q join ({fx.PIXELS}) p on p.frame = q.frame and p.u = q.u and p.v = q.v where label <> 0),
f as (select record, count(distinct frame) as frames from h group by 1), s as (select record, point, count(*) as support from h group by 1, 2)
select record, point, support from s join f using (record) where support >= greatest(1, least(3, ceil(frames * 0.1)))""")
def c23(spark, sf_dir):
    pts = fx.points(spark, sf_dir).select(F.col("id").alias("point"), "x", "y", (F.col("z") + 20).alias("z"))
    return J.lift_labels(pts, fx.pixels(spark, sf_dir), fx.poses(spark, sf_dir), (200.0, 200.0, 32.0, 24.0), SIZE, 2.0)


@query("c24_carry_forward", f"""with f as (select key as scene, seq as frame, kind in ('view', 'click') as fresh, row_number() over (partition by key order by seq) as o from ({fx.EVENTS})),
s as (select *, max(case when fresh then o end) over (partition by scene order by o) as so from f), t as (select scene, frame, o, track, (track + frame) % 10 / 10.0::double as confidence from f, range(3) t(track) where fresh),
k as (select *, row_number() over (partition by scene, frame order by confidence desc, track) as r from t)
select s.scene, s.frame as shown, track, s.o - so as age, confidence, case when s.o = so then 'segmented' else 'carried' end as method from s join k on k.scene = s.scene and k.o = so where s.o - so <= 2 and r <= 2""")
def c24(spark, sf_dir):
    e = fx.events(spark, sf_dir).select(F.col("key").alias("scene"), F.col("seq").alias("frame"), F.col("kind").isin("view", "click").alias("fresh"))
    t = e.filter("fresh").select("scene", "frame", F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<bigint>")).alias("track"))
    t = t.withColumn("confidence", (F.col("track") + F.col("frame")) % 10 / 10.0)
    return J.carry_forward(t, e, 2, 2).withColumn("age", F.col("age").cast("bigint"))


@query("c25_annotate_regions", f"""with n as (select room as region from ({fx.PLACES}) where sqrt(pow(x - 52, 2) + pow(y - 10, 2)) < 8), c as (select min(region) as here from n),
e as (select n_nationkey as a, (n_nationkey + 1) % 25 as b from nation), b as (select b as region from e, c where a = here union select a from e, c where b = here)
select n_nationkey::bigint as region, case when n_nationkey % 2 = 0 then n_name when n_nationkey % 3 = 0 then 'region' else 'unknown' end as label, coalesce(n_nationkey = here, false) as current, n_nationkey in (select region from b) as neighbour from nation, c""")
def c25(spark, sf_dir):
    n = fx.table(spark, sf_dir, "nation").withColumn("region", F.col("n_nationkey").cast("bigint"))
    regions = n.select("region", F.col("region").alias("ordinal"), F.when(F.col("region") % 2 == 0, F.col("n_name")).alias("region_label"), F.when(F.col("region") % 3 == 0, F.lit("some text")).alias("description"), F.lit(None).cast("string").alias("dominant"))
    edges = n.select(F.col("region").alias("a"), ((F.col("region") + 1) % 25).alias("b"))
    return J.annotate_regions(regions, fx.places(spark, sf_dir), edges, (52.0, 10.0), 8.0)
