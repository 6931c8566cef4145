"""B: projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from maploom.functions import geometry as G
from maploom.functions import text as X
from maploom.functions import times as TM
from maploom.functions import vectors as V
from maploom.operators import joins as J
from maploom.operators import pixels as PX
from maploom.operators import retrieval as R
from maploom.plans import fixtures as fx
from maploom.plans import query


def r6(c, name):
    return F.round(c, 6).alias(name)


@query("b1_unit_vector", """select vec_id, round(embedding[1] / n, 6) as u1, round(embedding[64] / n, 6) as u64
from (select vec_id, embedding::double[] as embedding, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) as n from embeddings)""")
def b1(spark, sf_dir):
    e = fx.table(spark, sf_dir, "embeddings").withColumn("u", V.unit_vector(F.col("embedding")))
    return e.select("vec_id", r6(F.col("u")[0], "u1"), r6(F.col("u")[63], "u64"))


@query("b2_combine_embeddings", """with h as (select vec_id, case when vec_id % 5 = 0 then null else embedding[1:32]::double[] end as a, case when vec_id % 5 = 1 then null else embedding[33:64]::double[] end as b from embeddings),
v as (select vec_id, case when a is null then b when b is null then a else list_concat(list_transform(a, lambda x: x * sqrt(0.3)), list_transform(b, lambda x: x * sqrt(0.7))) end as c from h)
select vec_id, cast(len(c) as int) as n, round(c[1] / sqrt(list_sum(list_transform(c, lambda x: x * x))), 6) as first, round(c[-1] / sqrt(list_sum(list_transform(c, lambda x: x * x))), 6) as last from v""")
def b2(spark, sf_dir):
    e = fx.table(spark, sf_dir, "embeddings")
    a = F.when(F.col("vec_id") % 5 != 0, F.slice("embedding", 1, 32))
    b = F.when(F.col("vec_id") % 5 != 1, F.slice("embedding", 33, 32))
    e = e.withColumn("c", V.combine_embeddings(a, b, 0.3, 0.7))
    return e.select("vec_id", F.size("c").alias("n"), r6(F.col("c")[0], "first"), r6(F.element_at("c", -1), "last"))


@query("b3_cosine01", """select a.vec_id as q, b.vec_id as v, round((list_dot_product(a.embedding::double[], b.embedding::double[]) + 1) / 2, 6) as score
from embeddings a join embeddings b on a.vec_id % 20 = 0 and b.vec_id <> a.vec_id""")
def b3(spark, sf_dir):
    e = fx.table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("vec_id").alias("own"), "embedding")  # the query set
    s = R.scores(q, e.select(F.col("vec_id").alias("ord"), "embedding"))  # all rows; a query only doesn't meet itself
    score = F.coalesce(F.col("score"), F.raise_error(F.lit("vectors differ in length or lack entries")).cast("double"))
    return s.select(F.col("query").alias("q"), F.col("ord").alias("v"), r6((score + 1) / 2, "score"))


@query("b4_normalise_text", """select doc_id, length(t) as n, md5(t) as digest from (select doc_id, trim(regexp_replace(text, '[\\s\\x{85}\\p{Z}]+', ' ', 'g')) as t from documents)""")
def b4(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").withColumn("t", X.normalise_text(F.col("text")))
    return d.select("doc_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("digest"))


_SETS = "list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+'))"


@query("b5_token_jaccard", f"""with d as (select doc_id, {_SETS} as a from documents), b as (select item_id, {_SETS} as b from benchmark)
select doc_id, item_id, round(case when len(a) + len(b) = 0 then 1.0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end, 6) as score from d, b""")
def b5(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("doc_id", X.token_set(F.col("text")).alias("_set"))
    b = fx.table(spark, sf_dir, "benchmark").select("item_id", X.token_set(F.col("text")).alias("_set"))
    return J.set_jaccards(d, b).select("doc_id", "item_id", r6(F.col("score"), "score"))


@query("b6_operation_id", f"""select seq, sha256('map|' || seq || '|' || key || '|' || k || '|' || lower(kind)) as op from ({fx.EVENTS})""")
def b6(spark, sf_dir):
    e = fx.events(spark, sf_dir)
    return e.select("seq", X.operation_id(F.lit("map"), F.col("seq"), F.col("key"), F.col("k"), F.lower("kind")).alias("op"))


@query("b6_request_id", f"""select key, sha256(key || '|' || max(us) || '|' || string_agg(kind, '|' order by us, seq)) as request from ({fx.EVENTS}) group by key""")
def b6_request(spark, sf_dir):
    e = fx.events(spark, sf_dir)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("us", "seq", "kind"))), lambda s: s["kind"])
    g = e.groupBy("key").agg(F.max("us").alias("at"), F.array_join(ordered, "|").alias("parts"))
    return g.select("key", X.operation_id(F.col("key"), F.col("at"), F.col("parts")).alias("request"))


@query("b7_parse_props", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def b7(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("b8_rel_seconds", f"select seq, round((us * 1000 - {fx.ORIGIN_US}000) / 1e9, 6) as s from ({fx.EVENTS})")
def b8(spark, sf_dir):
    e = fx.events(spark, sf_dir)
    return e.select("seq", r6(TM.rel_seconds(F.col("us") * 1000, fx.ORIGIN_US * 1000), "s"))


@query("b9_euclid", f"select id, round(sqrt(pow(x - 25, 2) + pow(y - 50, 2) + pow(z - 3, 2)), 6) as d3, round(sqrt(pow(x - 25, 2) + pow(y - 50, 2)), 6) as d2 from ({fx.PARTS})")
def b9(spark, sf_dir):
    p = fx.parts(spark, sf_dir)
    at = [F.col(c) for c in "xyz"]
    to = [F.lit(25.0), F.lit(50.0), F.lit(3.0)]
    return p.select("id", r6(G.euclid(at, to), "d3"), r6(G.euclid(at[:2], to[:2]), "d2"))


def _pose(p):
    """A pose per part: a turn about z by its id, moved to its position."""
    a = F.radians((F.col("id") % 360).cast("double")) / 2
    return G.quat_to_matrix([F.lit(0.0), F.lit(0.0), F.sin(a), F.cos(a)], [F.col("x"), F.col("y"), F.col("z")])


@query("b10_transform", f"""select id, round(cos(a) * 1 - sin(a) * 2 + x, 6) as px, round(sin(a) * 1 + cos(a) * 2 + y, 6) as py, round(3 + z, 6) as pz, 1.0::double as back_x, 2.0::double as back_y, round(2 * z, 6) as twice_z
from (select *, radians(id % 360) as a from ({fx.PARTS}))""")
def b10(spark, sf_dir):
    p = fx.parts(spark, sf_dir).withColumn("m", _pose(None))
    one = [F.lit(1.0), F.lit(2.0), F.lit(3.0)]
    p = p.withColumn("p", F.array(*G.apply_transform(F.col("m"), one)))
    p = p.withColumn("b", F.array(*G.apply_transform(G.invert_rigid(F.col("m")), [F.col("p")[i] for i in range(3)])))
    return p.select("id", *[r6(F.col("p")[i], n) for i, n in enumerate(("px", "py", "pz"))], r6(F.col("b")[0], "back_x"), r6(F.col("b")[1], "back_y"), r6(G.compose(F.col("m"), F.col("m"))[11], "twice_z"))


def _turn():
    """Half of an angle between 0.5 and 178.5 degrees."""
    return F.radians(F.col("id") % 179 + 0.5) / 2


@query("b11_yaw", f"select id, round(id % 179 + 0.5::double, 4) as yaw from ({fx.PARTS})")
def b11(spark, sf_dir):
    a = _turn()
    return fx.parts(spark, sf_dir).select("id", F.round(G.yaw_deg([F.lit(0.0), F.lit(0.0), F.sin(a), F.cos(a)]), 4).alias("yaw"))


@query("b12_rotation_angle", f"select id, round(id % 179 + 0.5::double, 3) as angle from ({fx.PARTS})")
def b12(spark, sf_dir):
    a = _turn()
    turned = G.quat_to_matrix([F.lit(0.0), F.lit(0.0), F.sin(a), F.cos(a)], [F.col(c) for c in "xyz"])
    same = F.array(*[F.lit(float(r == c)) for r in range(4) for c in range(4)])
    return fx.parts(spark, sf_dir).select("id", F.round(G.rotation_angle_deg(same, turned), 3).alias("angle"))


@query("b13_box_gap_iou", f"""with b as (select *, 1.0 + (x::bigint % 3) as w from ({fx.PARTS})), g as (select id, w, greatest(abs(x - 25) - (w + 20) / 2, 0) as gx, greatest(abs(y - 50) - (1 + 60) / 2.0, 0) as gy, greatest(abs(z - 3) - (0.5 + 4) / 2, 0) as gz,
 greatest(least(x + w / 2, 35) - greatest(x - w / 2, 15), 0) * greatest(least(y + 0.5, 80) - greatest(y - 0.5, 20), 0) * greatest(least(z + 0.25, 5) - greatest(z - 0.25, 1), 0) as inter from b)
select id, round(sqrt(gx * gx + gy * gy + gz * gz), 6) as gap, round(inter / (w * 0.5 + 20 * 60 * 4 - inter), 6) as iou from g""")
def b13(spark, sf_dir):
    p = fx.parts(spark, sf_dir)
    c1, d1 = [F.col(c) for c in "xyz"], [1.0 + (F.col("x").cast("bigint") % 3), F.lit(1.0), F.lit(0.5)]
    c2, d2 = [F.lit(25.0), F.lit(50.0), F.lit(3.0)], [F.lit(20.0), F.lit(60.0), F.lit(4.0)]
    return p.select("id", r6(G.aabb_gap(c1, d1, c2, d2), "gap"), r6(G.aabb_iou(c1, d1, c2, d2), "iou"))


@query("b14_proximity_score", f"select id, round(1 / (1 + exp(x / 10 - 2)), 6) as score from ({fx.PARTS})")
def b14(spark, sf_dir):
    return fx.parts(spark, sf_dir).select("id", r6(G.proximity_score(F.col("x") / 10), "score"))


@query("b15_frame_reward", f"""with b as (select frame, track, area, (8 + track * 10) / 640.0::double as u, (6 + frame % 400) / 480.0::double as v from ({fx.TRACKS}))
select frame, track, round(0.5 * -(u * v * ln(u * v + 1e-8) + u * (1 - v) * ln(u * (1 - v) + 1e-8) + (1 - u) * v * ln((1 - u) * v + 1e-8) + (1 - u) * (1 - v) * ln((1 - u) * (1 - v) + 1e-8)) / ln(4) + 0.5 * tanh(area / 3000), 6) as reward from b""")
def b15(spark, sf_dir):
    t = fx.tracks(spark, sf_dir)
    x, y = (F.col("track") * 10).cast("double"), (F.col("frame") % 400).cast("double")
    return t.select("frame", "track", r6(G.frame_reward(x, y, x + 16, y + 12, F.col("area"), 480, 640), "reward"))


K = (50.0, 55.0, 32.0, 24.0)


@query("b16_backproject_project", f"select frame, u, v, round((u - 32) * depth / 50, 6) as x, round((v - 24) * depth / 55, 6) as y, round(u::double, 6) as u2, round(v::double, 6) as v2 from ({fx.PIXELS})")
def b16(spark, sf_dir):
    p = fx.pixels(spark, sf_dir)
    x = G.backproject(F.col("u"), F.col("v"), F.col("depth"), K)
    back = G.project(x, K)
    return p.select("frame", "u", "v", r6(x[0], "x"), r6(x[1], "y"), r6(back[0], "u2"), r6(back[1], "v2"))


@query("b16_project_fisheye", f"""with p as (select id, x, y, z + 20 as z, sqrt(x * x + y * y) as r, atan2(sqrt(x * x + y * y), z + 20) as a from ({fx.POINTS})),
s as (select *, case when r > 1e-12 then a * (1 + 0.1 * a * a - 0.02 * pow(a, 4) + 0.003 * pow(a, 6) - 0.0004 * pow(a, 8)) / r else 1 end as s from p)
select id, round(50 * s * x + 32, 6) as u, round(55 * s * y + 24, 6) as v from s""")
def b16_fisheye(spark, sf_dir):
    p = fx.points(spark, sf_dir)
    u, v = G.project_fisheye([F.col("x"), F.col("y"), F.col("z") + 20], K, (0.1, -0.02, 0.003, -0.0004))
    return p.select("id", r6(u, "u"), r6(v, "v"))


@query("b17_disparity_to_depth", f"select frame, u, v, round(case when depth - 1 > 0 and 8 / (depth - 1) <= 6 then 8 / (depth - 1) else 0 end, 6) as z from ({fx.PIXELS})")
def b17(spark, sf_dir):
    p = fx.pixels(spark, sf_dir)
    return p.select("frame", "u", "v", r6(G.disparity_to_depth(F.col("depth") - 1, 80.0, 0.1, 6.0), "z"))


@query("b18_round_floats", "select vec_id, round_even(embedding[1]::double, 4)::double as a, round_even(embedding[2]::double, 4)::double as b from embeddings")
def b18(spark, sf_dir):
    e = fx.table(spark, sf_dir, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    e = PX.round_floats(e.select("vec_id", "v"), 4)
    return e.select("vec_id", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"))


@query("b19_overlaps_interval", f"select key, min(us) as first, max(us) as last from ({fx.EVENTS}) group by key having max(us) >= {fx.ORIGIN_US + 2_500_000_000_000} and min(us) <= {fx.ORIGIN_US + 20_000_000_000}")
def b19(spark, sf_dir):
    s = fx.events(spark, sf_dir).groupBy("key").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    return s.filter(TM.overlaps_interval(F.col("first"), F.col("last"), fx.ORIGIN_US + 2_500_000_000_000, fx.ORIGIN_US + 20_000_000_000))


@query("b20_format_object", f"select case when id % 3 = 0 then 'o(' || id || ')' else id::varchar end as object_id, name as description, id % 3 = 0 as is_background from ({fx.PARTS})")
def b20(spark, sf_dir):
    return PX.format_object(fx.parts(spark, sf_dir).withColumn("is_background", F.col("id") % 3 == 0).withColumnRenamed("name", "description"))


@query("b21_static_depth_isolation", f"""with p as (select frame, label = 1 as dyn, label = 2 as unk, depth > 0 and depth <= 4 as ok, conf, label = 1 and depth > 3 as leak_in from ({fx.PIXELS})),
x as (select *, (dyn or unk or not ok or conf < 0.2) as ex from p)
select frame, count(*) as pixels, sum(dyn::int)::bigint as dynamic, sum(unk::int)::bigint as unknown, sum((not ok)::int)::bigint as invalid, sum(ex::int)::bigint as excluded, round(sum((dyn and ok)::int) / greatest(sum(ok::int), 1), 6) as contamination, 0::bigint as leaked from x group by frame""")
def b21(spark, sf_dir):
    p = fx.pixels(spark, sf_dir)
    p = p.select("frame", "u", "v", "depth", (F.col("label") == 1).alias("dynamic"), (F.col("label") == 2).alias("unknown"), ((F.col("depth") > 0) & (F.col("depth") <= 4)).alias("valid"), F.col("conf").alias("weight"))
    return PX.isolation_report(PX.static_depth_isolation(p, 0.2))


@query("b22_flow_classify", f"""with p as (select frame, u, v, depth, conf < 0.9 as valid, depth / 2 as fb, depth as res from ({fx.PIXELS})),
r as (select *, valid and fb <= 1.5 as reliable, valid and fb <= 1.5 and res > 2.5 as dyn from p), n as (select *, sum(dyn::int) over (partition by frame) as k from r)
select frame, count(*) as pixels, sum(reliable::int)::bigint as reliable, sum((dyn and k >= 24)::int)::bigint as dynamic, sum((not reliable or (dyn and k < 24))::int)::bigint as unknown, round(quantile_cont(res, 0.5) filter (reliable), 6) as median_residual from n group by frame""")
def b22(spark, sf_dir):
    p = fx.pixels(spark, sf_dir)
    p = p.select("frame", "u", "v", (F.col("conf") < 0.9).alias("valid"), (F.col("depth") / 2).alias("fb_error"), F.col("depth").alias("residual"))
    c = PX.flow_classify(p)
    return c.groupBy("frame").agg(F.count(F.lit(1)).alias("pixels"), F.sum(F.col("reliable").cast("bigint")).alias("reliable"), F.sum(F.col("dynamic").cast("bigint")).alias("dynamic"), F.sum(F.col("unknown").cast("bigint")).alias("unknown"), F.round(F.percentile(F.when(F.col("reliable"), F.col("residual")), 0.5), 6).alias("median_residual"))


@query("b23_scale_and_clip_depth", f"""with p as (select frame, (depth * 1000)::bigint as mm from ({fx.PIXELS})), s as (select *, round_even(mm * 1.05, 0)::bigint as m2 from p), c as (select *, case when m2 > 4500 then 0 else m2 end as m3 from s)
select frame, round(avg((mm > 0)::int), 6) as before, round(avg((m3 > 0)::int), 6) as after, sum((m2 > 4500)::int)::bigint as clipped, sum(m3)::bigint as total from c group by frame""")
def b23(spark, sf_dir):
    p = fx.pixels(spark, sf_dir).withColumn("mm", (F.col("depth") * 1000).cast("bigint"))
    s = PX.scale_and_clip(p, "mm", 1.05, 4500)
    return s.groupBy("frame").agg(F.round(F.avg((F.col("mm") > 0).cast("double")), 6).alias("before"), F.round(F.avg((F.col("scaled") > 0).cast("double")), 6).alias("after"), F.sum(F.col("clipped").cast("bigint")).alias("clipped"), F.sum("scaled").alias("total"))


@query("b24_rebase_questions", """select o_orderkey as id, epoch_us(o_orderdate) - (694224000000000 + n_nationkey * 86400000000) as start_us, n_name as sequence from orders join nation on o_custkey % 25 = n_nationkey""")
def b24(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 25).cast("int").alias("n"), fx.micros("o_orderdate").alias("us"))
    n = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("sequence"), (694224000000000 + F.col("n_nationkey").cast("bigint") * 86400000000).alias("origin"))
    return o.join(F.broadcast(n), "n").select("id", (F.col("us") - F.col("origin")).alias("start_us"), "sequence")  # 25 sequences
