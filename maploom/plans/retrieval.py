"""R and G: retrieval, top-k, selection and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from maploom.functions import geometry as G
from maploom.operators import retrieval as R
from maploom.plans import fixtures as fx
from maploom.plans import query
from maploom.plans.scalars import r6
from maploom.sources.tables import stored

_SC = "select a.vec_id as query, b.vec_id as ord, b.label, list_dot_product(a.embedding::double[], b.embedding::double[]) as score from embeddings a join embeddings b on a.vec_id % 20 = 0 and b.vec_id <> a.vec_id"
_RK = f"select *, row_number() over (partition by query order by score desc, ord) as rank from ({_SC})"


def _sides(spark, sf_dir):
    e = fx.table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("vec_id").alias("own"), "embedding")  # the query set
    return q, e.select(F.col("vec_id").alias("ord"), "label", "embedding")  # all rows; a query only doesn't find itself


def _decide(sim, margin=0.0):
    close = f"when m is not null and {margin} > 0 and m < {margin} then 'below_min_margin'"
    return f"""with r as ({_RK}), d as (select query, max(score) filter (rank = 1) as top, max(score) filter (rank = 1) - max(score) filter (rank = 2) as m from r group by query),
x as (select *, case when top < {sim} then 'below_min_similarity' {close} end as reason from d)
select x.query, round(top, 6) as top_score, round(m, 6) as margin, reason, reason is null as found, r.ord as match, round(r.score, 6) as score, r.rank::int as rank from x left join r on r.query = x.query and r.rank <= 5 and reason is null"""


def _rounded(d):
    return d.select("query", r6(F.col("top_score"), "top_score"), r6(F.col("margin"), "margin"), "reason", "found", "match", r6(F.col("score"), "score"), "rank")


@query("r1_retrieve", _decide(0.35))
def r1(spark, sf_dir):
    return _rounded(R.retrieve_with_decision(*_sides(spark, sf_dir), k=5, min_sim=0.35))


@query("r1_retrieve_default", _decide(0.55, 0.02))
def r1_default(spark, sf_dir):
    return _rounded(R.retrieve_with_decision(*_sides(spark, sf_dir), k=5, min_sim=0.55, min_margin=0.02))


@query("g1_top_k_matches", f"select query, ord, round(score, 6) as score, rank::int as rank from ({_RK}) where rank <= 5")
def g1(spark, sf_dir):
    return R.top_k(*_sides(spark, sf_dir), 5).select("query", "ord", r6(F.col("score"), "score"), "rank")


@query("g2_top_k_in_region", f"select query, label, ord, rank::int as rank from (select *, row_number() over (partition by query, label order by score desc, ord) as rank from ({_SC})) where rank <= 20")
def g2(spark, sf_dir):
    return R.top_k(*_sides(spark, sf_dir), 20, ["label"]).select("query", "label", "ord", "rank")


_OTSU = """o as (select *, row_number() over (partition by query order by score, ord) as i, count(*) over (partition by query) as n, sum(score) over (partition by query order by score, ord rows unbounded preceding) as s, sum(score) over (partition by query) as t, lead(score) over (partition by query order by score, ord) as nx from base),
v as (select *, round(i / n * (1 - i / n) * pow(s / i - (t - s) / nullif(n - i, 0), 2), 12) as var from o where i < n),
th as (select query, arg_min((score + nx) / 2, {'v': -var, 'i': i}) as threshold from v group by query)"""


@query("g3_otsu_threshold", f"with base as ({_SC}), {_OTSU} select query, round(threshold, 6) as threshold from th")
def g3(spark, sf_dir):
    return R.otsu_of_products(*_sides(spark, sf_dir)).select("query", r6(F.col("threshold"), "threshold"))


_CAND = f"""with sc as ({_RK}), p as (select query, quantile_cont(score, 0.85) as p from sc group by query), z as (select sc.*, greatest(5, count(*) filter (score >= p) over (partition by query)) as size from sc join p using (query)),
base as (select * from z where rank <= size), {_OTSU},
c as (select sc.*, score >= threshold as over_, count(*) filter (score >= threshold) over (partition by query) as many from sc join th using (query)),
cand as (select * from c where case when many < 5 then rank <= 5 else over_ end)"""


@query("g4_semantic_candidates", f"{_CAND} select query, ord, round(score, 6) as score from cand")
def g4(spark, sf_dir):
    return R.candidates_of_products(*_sides(spark, sf_dir), 5).select("query", "ord", r6(F.col("score"), "score"))


_NEAR = f"""{_CAND}, d as (select query, ord, sqrt(x * x + y * y + z * z) as distance from cand join ({fx.POINTS}) on id = ord), n as (select *, row_number() over (partition by query order by distance, ord) as place from d)
select query, ord, round(distance, 6) as distance, place::int as place from n where place <= 5"""


def _nearest(spark, sf_dir):
    p = fx.points(spark, sf_dir).select(F.col("id").alias("ord"), "x", "y", "z").withColumn("away", R.away((0.0, 0.0, 0.0)))
    c = R.candidates_of_products(*_sides(spark, sf_dir), 5, extra=p, nearest=("away", 5))
    return R.rank_by_distance(c, (0.0, 0.0, 0.0), 5).select("query", "ord", r6(F.col("distance"), "distance"), "place")


@query("g5_rank_by_distance", _NEAR)
def g5(spark, sf_dir):
    return _nearest(spark, sf_dir)


@query("r2_match_subjects", f"select query, ord, round(score, 6) as score, round(sqrt(x * x + y * y + z * z), 6) as distance from ({_RK}) join ({fx.POINTS}) on id = ord where rank <= 5")
def r2(spark, sf_dir):
    t = R.top_k(*_sides(spark, sf_dir), 5)
    p = fx.points(spark, sf_dir).select(F.col("id").alias("ord"), "x", "y", "z")
    d = G.euclid([F.col(c) for c in "xyz"], [F.lit(0.0)] * 3)
    return t.join(p, "ord").select("query", "ord", r6(F.col("score"), "score"), r6(d, "distance"))


@query("g6_best_evidence", f"""with c as (select l_partkey as label, l_orderkey * 10 + l_linenumber as frame, l_returnflag <> 'R' as has_depth, l_discount as depth_ratio, l_quantity * case when l_linestatus = 'O' then 0.4 else 1.0 end as score, l_extendedprice::bigint as pixels from lineitem)
select label, frame, has_depth, depth_ratio, score from c qualify row_number() over (partition by label order by has_depth desc, depth_ratio desc, score desc, pixels desc, frame) = 1""")
def g6(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    c = li.select(F.col("l_partkey").alias("label"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("frame"), (F.col("l_returnflag") != "R").alias("has_depth"), F.col("l_discount").alias("depth_ratio"), F.col("l_quantity").alias("area"), (F.col("l_linestatus") == "O").alias("border"), F.round("l_extendedprice").cast("bigint").alias("pixels"))
    return R.best_evidence(c).select("label", "frame", "has_depth", "depth_ratio", "score")


@query("g7_uniform_select", """with r as (select o_custkey as entity, o_orderkey as id, row_number() over (partition by o_custkey order by o_orderkey) - 1 as i, count(*) over (partition by o_custkey) as n, o_totalprice = max(o_totalprice) over (partition by o_custkey) as must from orders),
s as (select *, n <= 4 or list_contains([0, floor((n - 1) / 3), floor(2 * (n - 1) / 3), n - 1], i) as sel from r), m as (select *, bool_or(must and not sel) over w as miss, min(i) filter (must and not sel) over w as first, max(i) filter (sel) over w as last from s window w as (partition by entity))
select entity, id from m where case when miss then (sel and i <> last) or i = first else sel end""")
def g7(spark, sf_dir):
    from pyspark.sql import Window as W

    o = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("id"), "o_totalprice")
    o = o.withColumn("best", F.col("o_totalprice") == F.max("o_totalprice").over(W.partitionBy("entity")))
    return R.uniform_select(o, "entity", "id", 4, F.col("best")).select("entity", "id")


@query("g8_farthest_first")
def g8(spark, sf_dir):
    return R.farthest_first(fx.table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "ord"), "label", 5)


def _task_tracks(spark, sf_dir):
    t = fx.tracks(spark, sf_dir)
    return t.withColumn("task", F.floor(F.col("frame") / 200).cast("bigint")).withColumn("reward", 0.5 * F.tanh(F.col("area") / 3000) + F.col("x"))


@query("g9_greedy_frame_cover")
def g9(spark, sf_dir):
    return R.greedy_frame_cover(_task_tracks(spark, sf_dir), 2, 64)


@query("g10_best_frame_assignment")
def g10(spark, sf_dir):
    t = _task_tracks(spark, sf_dir)
    return R.best_frame_assignment(R.greedy_frame_cover(t, 2, 64), t).withColumn("reward", F.round("reward", 6))


_TOK = "(select doc_id as item, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as word from documents)"
_TFIDF = f"""tf as (select item, word, count(*) as tf from {_TOK} group by 1, 2), df as (select word, count(*) as df from tf group by 1), nn as (select count(distinct item) as n from {_TOK}),
raw as (select item, word, tf * (ln((n + 1.0::double) / (df + 1)) + 1) as raw from tf join df using (word), nn), vec as (select item, word, raw / sqrt(sum(raw * raw) over (partition by item)) as weight from raw)"""
_PAIRS = f"""with {_TFIDF}, s as (select a.item as a, b.item as b, sum(a.weight * b.weight) as score from vec a join vec b on a.word = b.word and b.item >= a.item + 5 group by 1, 2 having sum(a.weight * b.weight) >= 0.8),
both_ as (select a, b, score, a as me, b as o from s union all select a, b, score, b, a from s), r as (select *, row_number() over (partition by me order by round(score, 9) desc, o) as r from both_)
select a, b, round(max(score), 6) as score from r where r <= 3 group by a, b"""


def _bags(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("item"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("words"))


def _pairs(spark, sf_dir):
    return R.retrieve_pairs(R.word_vectors(_bags(spark, sf_dir)), 5, 3, 0.8)


@query("r6_visual_word_tfidf", f"with {_TFIDF} select item, word, round(weight, 6) as weight from vec")
def r6_tfidf(spark, sf_dir):
    return R.tfidf(_bags(spark, sf_dir).select("item", F.explode("words").alias("word"))).select("item", "word", r6(F.col("weight"), "weight"))


@query("r7_retrieve_pairs", _PAIRS)
def r7(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b", r6(F.col("score"), "score"))


@query("g11_select_nonoverlapping")
def g11(spark, sf_dir):
    p = _pairs(spark, sf_dir).select(F.floor(F.col("a") / 100).cast("bigint").alias("map"), "a", "b", F.round("score", 6).alias("quality"))
    return R.select_nonoverlapping(p, "map", 2, 10)


@query("g12_finite_sample", "select doc_id from documents order by sha256('5|' || doc_id) limit (select ceil(count(*) * 0.1)::bigint from documents)")
def g12(spark, sf_dir):
    return R.finite_sample(fx.table(spark, sf_dir, "documents"), "doc_id", 0.1, 5).select("doc_id")


@query("g13_split_ranges", "select case when event_id <= 4999 then 'train' when event_id <= 7999 then 'check' else 'test' end as split, count(*) as frames, min(event_id) as first, max(event_id) as last from events group by 1")
def g13(spark, sf_dir):
    e = R.split_ranges(fx.table(spark, sf_dir, "events"), [("train", 0, 4999), ("check", 5000, 7999), ("test", 8000, 1 << 60)], "event_id")
    return e.groupBy("split").agg(F.count(F.lit(1)).alias("frames"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("r3_attach_embeddings")
def r3(spark, sf_dir):
    p = fx.parts(spark, sf_dir).select("id", F.col("name").alias("description"))
    a = R.attach_embeddings(p, "hashing")
    return a.select("id", F.size("embedding").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 6).alias("length"))


@query("r5_evaluate_queries", f"""with r as ({_RK}), t as (select query, label, score >= 0.35 as found from r where rank = 1), e as (select *, query % 3 <> 0 as expected, list_contains([1, 2, 3, 4, 5], label) as term from t)
select count(*) as queries, round(avg((found = expected and (not expected or term))::int), 6) as pass_rate, round(avg(found::int) filter (expected), 6) as recall, round(avg((not found)::int) filter (not expected), 6) as rejection, round(avg((label % 4 <> 0)::int) filter (found), 6) as evidence_coverage, round(avg(query % 50 + 0.5), 6) as latency_mean, max(query % 50 + 0.5)::double as latency_max from e""")
def r5(spark, sf_dir):
    q, rec = _sides(spark, sf_dir)
    found = stored(R.top_k(q, rec, 5), "top")  # the products are made once
    d = R.decide(q, found, 5, 0.35)
    top = found.filter("rank = 1").select("query", F.concat(F.lit("<"), F.col("label").cast("string"), F.lit(">")).alias("text"), F.when(F.col("label") % 4 != 0, "frame").alias("evidence"), (F.col("query") % 50 + 0.5).alias("latency_ms"))
    x = q.select("query", (F.col("query") % 3 != 0).alias("expected_found"), F.array(*[F.lit(f"<{i}>") for i in range(1, 6)]).alias("expected_terms")).join(top, "query", "left")
    return R.evaluate_queries(d, x).select("queries", *[r6(F.col(c), c) for c in ("pass_rate", "recall", "rejection", "evidence_coverage", "latency_mean", "latency_max")])


@query("r8_alias_conflict", f"with r as ({_RK}) select query, round(max(score) filter (rank = 1) - max(score) filter (rank = 2), 6) as margin, (max(score) filter (rank = 1) - max(score) filter (rank = 1))::double as margin_after, round(max(score) filter (rank = 1) - max(score) filter (rank = 2), 6) as \"drop\" from r group by query")
def r8(spark, sf_dir):
    a = R.alias_conflict(stored(R.top_k(*_sides(spark, sf_dir), 2), "top"), 3)
    return a.select("query", *[r6(F.col(c), c) for c in ("margin", "margin_after", "drop")])


@query("r9_find_by_name", "select c_custkey as entity from customer where lower(c_mktsegment) = 'building' union select o_custkey from orders where lower(o_orderpriority || o_orderstatus) = '1-urgentf'")
def r9(spark, sf_dir):
    al = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.concat("o_orderpriority", "o_orderstatus").alias("alias"))
    b = R.find_by_name(fx.entities(spark, sf_dir), al, "Building")
    return b.union(R.find_by_name(fx.entities(spark, sf_dir), al, "1-URGENTF")).distinct()


@query("r10_current_position", f"select key, arg_max(x, t) as x, arg_max(y, t) as y, max(t) as t from ({fx.TRAJECTORY}) group by key")
def r10(spark, sf_dir):
    return R.current_position(fx.trajectory(spark, sf_dir), "key", "t")


@query("r4_rejected_to_sidecar", f"""with e as (select entity, case seq % 5 when 0 then 'rejected_no_mesh' when 1 then 'rejected_entity_conflict' else 'matched_real_mesh' end as status from ({fx.VERSIONS})), n as (select entity, count(distinct status) as n, min(status) as status from e where status like 'rejected%' group by 1),
s as (select entity, min(us) as first, max(us) as last from ({fx.VERSIONS}) where status <> 'P' group by 1)
select n.entity, name, first, last, case when first is not null then 'spatial_only' else 'image_only' end as geometry_status, n > 1 as conflict from n join ({fx.ENTITIES}) c on c.entity = n.entity and not deleted left join s on s.entity = n.entity where n.status = 'rejected_no_mesh' or n > 1""")
def r4(spark, sf_dir):
    v = fx.versions(spark, sf_dir)
    status = F.when(F.col("seq") % 5 == 0, "rejected_no_mesh").when(F.col("seq") % 5 == 1, "rejected_entity_conflict").otherwise("matched_real_mesh")
    obs = v.filter("status <> 'P'").select("entity", "us", F.lit(1.0).alias("x"))
    return R.rejected_to_sidecar(v.select("entity", status.alias("status")), fx.entities(spark, sf_dir), obs)
