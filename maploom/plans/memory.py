"""M: versioned map memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from maploom.operators import edits as E
from maploom.operators import memory as M
from maploom.operators import merging as ME
from maploom.plans import fixtures as fx
from maploom.plans import query


def _observed(spark, sf_dir):
    """Observations of many small maps: a map per supplier and part group."""
    o = fx.observations(spark, sf_dir)
    return o.select((F.col("entity") * 100 + F.col("local") % 10).alias("map"), "seq", "local", "us", "x", "y", "z", F.concat(F.lit("k"), (F.col("local") % 3).cast("string")).alias("label"))


STRAIGHT = (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)
TURNED = (0, -1, 0, 10, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)


@query("m1_merge_entities")
def m1(spark, sf_dir):
    """Replayed merging of observations that came in two sessions, one of them turned and moved against the map."""
    sessions = fx.table(spark, sf_dir, "nation").filter("n_nationkey < 3").select(F.col("n_nationkey").alias("session"), F.when(F.col("n_nationkey") < 2, "registered").otherwise("rejected").alias("status"), F.when(F.col("n_nationkey") == 1, F.array(*[F.lit(float(v)) for v in TURNED])).otherwise(F.array(*[F.lit(float(v)) for v in STRAIGHT])).alias("transform"))
    o = _observed(spark, sf_dir).withColumns({"session": F.col("seq") % 4, "type": F.when(F.col("seq") % 11 == 0, "place").otherwise("object"), "sx": 1 + F.col("x") / 10, "sy": F.lit(1.0), "sz": F.lit(2.0), "confidence": F.col("y") / 10})
    m = M.merge_entities(ME.canonical_observations(o, sessions).filter("refused is null"), 4.0)
    return m.withColumns({c: F.round(c, 6) for c in ("x", "y", "z", "sx", "moved")})


@query("m1_merge_audit")
def m1_audit(spark, sf_dir):
    log = ME.merge_audit(M.merge_entities(_observed(spark, sf_dir), 4.0))
    return log.withColumn("moved", F.round("moved", 6))


@query("m2_merge_entities_blocked")
def m2(spark, sf_dir):
    o = fx.observations(spark, sf_dir)
    return M.merge_entities_blocked(o.withColumn("label", F.concat(F.lit("k"), (F.col("local") % 30).cast("string"), F.lit("|"), F.col("entity").cast("string"))), 1.0)


@query("m3_merge_events")
def m3(spark, sf_dir):
    e = M.merge_events(M.merge_entities(_observed(spark, sf_dir), 4.0))
    return e.groupBy("map", "action").agg(F.count(F.lit(1)).alias("n"))


@query("m4_merge_sweep")
def m4(spark, sf_dir):
    return M.merge_sweep(_observed(spark, sf_dir), [2.0, 4.0, 6.0])


@query("m5_session_registration", "select s_suppkey as session, case when s_suppkey % 40 >= 20 and s_nationkey / 100 <= 0.2 and sqrt(greatest(s_suppkey % 9 / 20.0, 0.01)) <= 0.5 then 'registered' else 'rejected' end as status, case when s_suppkey % 40 < 20 then 'too_few_inliers' when s_nationkey / 100 > 0.2 then 'rms_too_large' when sqrt(greatest(s_suppkey % 9 / 20.0, 0.01)) > 0.5 then 'covariance_too_large' else 'verified' end as reason from supplier")
def m5(spark, sf_dir):
    s = fx.table(spark, sf_dir, "supplier")
    cov = F.transform(F.sequence(F.lit(0), F.lit(35)), lambda i: F.when(i == 0, F.col("s_suppkey") % 9 / 20.0).when(i % 7 == 0, 0.01).otherwise(0.0))
    return M.session_registration(s.select(F.col("s_suppkey").alias("session"), (F.col("s_suppkey") % 40).alias("inliers"), (F.col("s_nationkey") / 100).alias("rms"), cov.alias("covariance")))


_CO = f"co as (select *, row_number() over (partition by op order by seq) > 1 as dup from ({fx.CORRECTIONS})), st as (select *, case when dup then 'duplicate' when row_number() over (partition by entity, revision, dup order by us desc, confidence desc, seq desc) = 1 then 'pending' else 'superseded' end as state from co)"


@query("m6_coalesce_corrections", f"with {_CO} select op, entity, revision, seq, state from st")
def m6(spark, sf_dir):
    return M.coalesce_corrections(fx.corrections(spark, sf_dir)).select("op", "entity", "revision", "seq", "state")


_AP = f"""{_CO}, due as (select * from st where state = 'pending' and revision <= 1 order by us, op limit 1000), ap as (select op, due.entity, label, us, seq, name as old_name, case when revision < 1 then 'rejected' when name is null or deleted then 'rejected' when locked then 'applied_alias' else 'applied' end as outcome,
case when revision < 1 then 'stale_revision' when name is null or deleted then 'missing_entity' when locked then 'user_name_locked' else 'updated' end as reason from due left join ({fx.ENTITIES}) e on e.entity = due.entity)"""


def _applied(spark, sf_dir):
    return M.apply_corrections(M.coalesce_corrections(fx.corrections(spark, sf_dir)), fx.entities(spark, sf_dir), 1, 1000)


@query("m7_apply_corrections", f"with {_AP} select op, entity, outcome, reason from ap")
def m7(spark, sf_dir):
    return _applied(spark, sf_dir).select("op", "entity", "outcome", "reason")


@query("m7_applied_names", f"with {_AP} select entity, arg_max(label, us) filter (outcome = 'applied') as name, coalesce(string_agg(distinct case when outcome = 'applied_alias' then label when lower(old_name) <> lower(label) then old_name end, ',' order by case when outcome = 'applied_alias' then label when lower(old_name) <> lower(label) then old_name end), '') as aliases from ap where outcome <> 'rejected' group by 1")
def m7_names(spark, sf_dir):
    return M.applied_names(_applied(spark, sf_dir))


@query("m8_delivery_state", f"select key * 100 + k as op, count(*) as attempts, case when bool_or(kind = 'view') then 'delivered' when count(*) >= 3 then 'failed' else 'retry' end as status from ({fx.EVENTS}) group by 1")
def m8(spark, sf_dir):
    e = fx.events(spark, sf_dir).select((F.col("key") * 100 + F.col("k")).alias("op"), (F.col("kind") == "view").alias("success"))
    return M.delivery_state(e, 3)


@query("m9_entity_snapshot", f"""with a as (select o_custkey as entity, string_agg(distinct lower(o_orderpriority), ',' order by lower(o_orderpriority)) as aliases from orders group by 1), o as (select entity, count(*) as seen, min(us) as first, max(us) as last from ({fx.VERSIONS}) group by 1)
select e.*, aliases, coalesce(seen, 0) as seen, first, last from ({fx.ENTITIES}) e left join a using (entity) left join o using (entity)""")
def m9(spark, sf_dir):
    al = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("alias"))
    return M.entity_snapshot(fx.entities(spark, sf_dir), al, fx.versions(spark, sf_dir))


_TIME = f"(us - {fx.ORIGIN_US})"
_ED = f"""select key * 3 as entity, 1 + {_TIME} // 864000000000 as revision, us, seq, case when seq % 97 = 0 then 'delete' when seq % 3 = 0 then 'rename' when seq % 89 = 0 then 'recolour' else 'alias' end as verb,
trim(case when seq % 31 = 0 then '  ' else kind || case when seq % 7 = 0 then ' ' else (k % 4)::varchar end end) as value from ({fx.EVENTS})"""
_LOG = f"""j as (select d.*, name as n0, coalesce(locked, false) as l0, coalesce(e.deleted, false) as d0, (verb = 'delete' or (verb in ('rename', 'alias') and value <> '')) as sound from ({_ED}) d left join ({fx.ENTITIES}) e using (entity)),
g as (select *, case when not sound then 'invalid' when n0 is null or d0 or coalesce(bool_or(sound and verb = 'delete') over (partition by entity order by us, seq rows between unbounded preceding and 1 preceding), false) then 'unknown_or_deleted' end as error from j),
h as (select *, case when error is null and verb = 'rename' then value end as new from g),
i as (select *, coalesce(last_value(new ignore nulls) over (partition by entity order by us, seq rows between unbounded preceding and 1 preceding), n0) as old from h),
log as (select entity, revision, us, seq, case when error is null then case verb when 'rename' then 'user_name' when 'alias' then 'user_alias' else 'entity_deleted' end end as action, error, coalesce(last_value(new ignore nulls) over w, n0) as name,
l0 or bool_or(new is not null) over w as locked, d0 or bool_or(error is null and verb = 'delete') over w as deleted, case when lower(old) <> lower(new) then old when error is null and verb = 'alias' then value end as added_alias, case when verb = 'rename' then 'previous_name' else 'user' end as src
from i window w as (partition by entity order by us, seq rows between unbounded preceding and current row))"""


def _edits(spark, sf_dir):
    e = fx.events(spark, sf_dir)
    s = F.col("seq")
    verb = F.when(s % 97 == 0, "delete").when(s % 3 == 0, "rename").when(s % 89 == 0, "recolour").otherwise("alias")
    value = F.when(s % 31 == 0, "  ").otherwise(F.concat("kind", F.when(s % 7 == 0, " ").otherwise((F.col("k") % 4).cast("string"))))
    return e.select((F.col("key") * 3).alias("entity"), F.expr(f"1 + {_TIME} div 864000000000").alias("revision"), "us", "seq", verb.alias("verb"), value.alias("value"))


def _edit_log(spark, sf_dir):
    return E.edit_log(fx.entities(spark, sf_dir), _edits(spark, sf_dir))


def _no_aliases(spark):
    return spark.createDataFrame([], "entity long, alias string, source string, us long, seq long, epoch long")


@query("m10_apply_edits", f"with {_LOG} select entity, revision, us, seq, action, error, name, locked, deleted, added_alias, case when added_alias is not null then src end as alias_source from log")
def m10(spark, sf_dir):
    return _edit_log(spark, sf_dir).drop("epoch")


@query("m10_edited_entities", f"""with {_LOG}, s as (select * from log where error is null qualify row_number() over (partition by entity order by us desc, seq desc) = 1),
f as (select entity, added_alias || ':' || src as alias from log where added_alias is not null qualify row_number() over (partition by entity, lower(added_alias) order by us, seq) = 1), a as (select entity, string_agg(alias, ',' order by alias) as aliases from f group by 1)
select e.entity, coalesce(s.name, e.name) as name, coalesce(s.locked, e.locked) as locked, coalesce(s.deleted, e.deleted) as deleted, s.us as updated_us, aliases from ({fx.ENTITIES}) e left join s using (entity) left join a using (entity)""")
def m10_entities(spark, sf_dir):
    log = _edit_log(spark, sf_dir)
    a = E.edited_aliases(_no_aliases(spark), log)
    return E.edited_entities(fx.entities(spark, sf_dir), log).join(_alias_lists(a), "entity", "left")


def _alias_lists(a):
    return a.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "alias", "source"))), ",").alias("aliases"))


@query("m11_advance_revision", f"select distinct revision, revision - 1 as parent from ({fx.VERSIONS}) union all select max(revision) + 1, max(revision) from ({fx.VERSIONS})")
def m11(spark, sf_dir):
    r = fx.versions(spark, sf_dir).select("revision", (F.col("revision") - 1).alias("parent")).distinct()
    return M.advance_revision(r)


_BACK = f"""{_LOG}, v as (select entity, 0 as revision, 1 as us, 0 as seq, name, locked, deleted from ({fx.ENTITIES}) where entity % 10 <> 3 union all select entity, revision, us, seq, name, locked, deleted from log where error is null),
snap as (select * from v where revision <= 2 qualify row_number() over (partition by entity order by revision desc, us desc, seq desc) = 1), al as (select entity, added_alias as alias, src, us, seq from log where added_alias is not null qualify row_number() over (partition by entity, lower(added_alias) order by us, seq) = 1)"""


def _rollback(spark, sf_dir):
    """Back to revision 2 of 4; entities were created at revision 0, but for every tenth, which has only the versions of its edits."""
    e, log = fx.entities(spark, sf_dir), _edit_log(spark, sf_dir)
    zero = F.lit(0).cast("bigint")
    made = e.filter("entity % 10 <> 3").select("entity", zero.alias("revision"), F.lit(1).cast("bigint").alias("us"), zero.alias("seq"), F.lit("create").alias("action"), "name", "locked", "deleted", zero.alias("epoch"))
    revisions = spark.range(5).select(F.col("id").alias("revision"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), (F.col("id") + 1).alias("us"), F.lit("step").alias("reason"))
    return E.rollback(E.edited_entities(e, log), E.edited_aliases(_no_aliases(spark), log), made.unionByName(E.log_versions(log)), revisions, 2, 2 * fx.ORIGIN_US)


@query("m12_rollback_to", f"""with {_BACK}, s as (select * from log where error is null qualify row_number() over (partition by entity order by us desc, seq desc) = 1),
b as (select al.entity, alias || ':' || case when snap.entity is null then src else 'rollback' end as alias from al left join snap using (entity) where snap.entity is null or al.us < snap.us or (al.us = snap.us and al.seq <= snap.seq)), l as (select entity, string_agg(alias, ',' order by alias) as aliases from b group by 1)
select e.entity, snap.revision as from_revision, case when snap.entity is null then coalesce(s.name, e.name) else snap.name end as name, case when snap.entity is null then coalesce(s.locked, e.locked) else snap.locked end as locked, coalesce(snap.deleted, true) as deleted, {2 * fx.ORIGIN_US}::bigint as updated_us, aliases
from ({fx.ENTITIES}) e left join snap using (entity) left join s using (entity) left join l using (entity)""")
def m12(spark, sf_dir):
    r = _rollback(spark, sf_dir)
    return r["entities"].join(_alias_lists(r["aliases"]), "entity", "left")


@query("m12_rollback_log", f"""with {_BACK} select 'revision' as kind, 5::bigint as revision, 4::bigint as parent, null as entity, null as action, 'rollback_to_2' as reason union all select 'audit', 5, null, null, 'advance_revision', 'rollback_to_2'
union all select unnest(['audit', 'version']), 5, null, entity, 'rollback_restore', null from snap where entity in (select entity from ({fx.ENTITIES}))""")
def m12_log(spark, sf_dir):
    r = _rollback(spark, sf_dir)
    parts = [r["revisions"].withColumn("kind", F.lit("revision")), r["audit"].withColumn("kind", F.lit("audit")), r["versions"].withColumn("kind", F.lit("version"))]
    kinds = {"kind": "string", "revision": "bigint", "parent": "bigint", "entity": "bigint", "action": "string", "reason": "string"}
    parts = [p.select(*[p[c] if c in p.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()]) for p in parts]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("m13_time_origin", f"select key, {fx.ORIGIN_US + 86400000000} as origin, count(*) filter (us < {fx.ORIGIN_US + 86400000000}) as early from ({fx.EVENTS}) group by 1")
def m13(spark, sf_dir):
    return M.time_origin(fx.events(spark, sf_dir), "key", "us", fx.ORIGIN_US + 86400000000)


@query("m14_standard_history", f"select seq as id, case when k < 50 then us * 1000 else (us // 1000000) * 1000000000 end as first_ns, case when k < 70 then us * 1000 - 500 else us * 1000 + 7 end as last_ns, coalesce(case when k > 90 then k end, 1) as count, case when (case when k < 50 then us * 1000 else (us // 1000000) * 1000000000 end) > (case when k < 70 then us * 1000 - 500 else us * 1000 + 7 end) then 'first_after_last' end as error from ({fx.EVENTS})")
def m14(spark, sf_dir):
    e = fx.events(spark, sf_dir)
    r = e.select(F.col("seq").alias("id"), F.when(F.col("k") < 50, F.col("us") * 1000).alias("first_ns"), F.expr("us div 1000000 - 1704067200").alias("first_s"), F.when(F.col("k") < 70, F.col("us") * 1000 - 500).alias("last_ns"), F.lit(None).cast("bigint").alias("last_s"), (F.col("us") * 1000 + 7).alias("sensor_ns"), F.when(F.col("k") > 90, F.col("k")).alias("count"))
    return M.standard_history(r, fx.ORIGIN_US * 1000)


@query("m15_rebase_times", f"select seq as id, us - s as first, us + k - s as last from ({fx.EVENTS}) join (select key, min(us) as s from ({fx.EVENTS}) group by 1) using (key) where k >= 10")
def m15(spark, sf_dir):
    e = fx.events(spark, sf_dir)
    n = e.select("key", F.col("seq").alias("id"), F.when(F.col("k") >= 10, F.col("us")).alias("first"), (F.col("us") + F.col("k")).alias("last"))
    return M.rebase_times(n, e.groupBy("key").agg(F.min("us").alias("start")), "key")


@query("m16_canonical_semantic_id", f"""with f as (select key % 10 as map, key as entity, arg_min(k, seq) as semantic, min(seq) as seq from ({fx.EVENTS}) group by 1, 2), t as (select *, row_number() over (partition by map, semantic order by seq) > 1 as taken, max(semantic) over (partition by map) as top from f)
select map, entity, case when taken then top + sum(taken::int) over (partition by map order by seq rows unbounded preceding) else semantic end::bigint as semantic, taken as reassigned from t""")
def m16(spark, sf_dir):
    e = fx.events(spark, sf_dir).select((F.col("key") % 10).alias("map"), F.col("key").alias("entity"), F.col("k").alias("semantic"), "seq")
    return M.canonical_semantic_id(e)


@query("m17_label_updates", f"select entity, arg_max(case label when 'error' then 'unknown' else label end, us) as label, max(us) as us, arg_max(label, us) = 'error' as reopened from ({fx.CORRECTIONS}) group by 1")
def m17(spark, sf_dir):
    c = fx.corrections(spark, sf_dir).withColumn("label", F.when(F.col("label") == "error", "unknown").otherwise(F.col("label")))
    return M.label_updates(c, "entity")


@query("m18_snapshot_incremental", f"select distinct k as label, key as frame from ({fx.EVENTS}) except select k, key from ({fx.EVENTS}) where seq < 5000")
def m18(spark, sf_dir):
    e = fx.events(spark, sf_dir).select("seq", F.col("k").alias("label"), F.col("key").alias("frame"))
    return M.snapshot_incremental(e, e.filter("seq < 5000"), ["label", "frame"])
