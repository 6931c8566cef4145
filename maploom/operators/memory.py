"""Versioned map memory: entity merging, corrections, deliveries, versions and rollback as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from maploom.functions.geometry import euclid
from maploom.operators.graphs import connected_components
from maploom.operators.merging import merge_entities, replayed_actions
from maploom.sources.tables import bounded, stored


#: Most places of a label that are compared with each other without a grid.
FEW = 256


def merge_entities_blocked(observations: DataFrame, distance: float) -> DataFrame:
    """Order-free form for maps too large for one task: observations of a label that chains of short steps connect.

    Observations at one place are linked to the first of them and take no further part.  The places of a label with few are compared directly;
    those of others over grid cells, each pair from one side, so few copies of a row travel.
    """
    finite = reduce(lambda a, b: a & b, [F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) for c in "xyz"])  # not a number ranks above infinity
    o = observations.select("seq", "label", "x", "y", "z").filter(finite & F.col("label").isNotNull())
    places = stored(o.groupBy("label", "x", "y", "z").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("_n")), "places")
    shared = places.filter("_n > 1").drop("_n")
    members = o.join(shared, ["label", "x", "y", "z"]).filter("seq <> first").select(F.col("seq").alias("a"), F.col("first").alias("b"))
    p = places.drop("_n")
    many = stored(p.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > FEW).select("label"), "many")
    few, rest = p.join(bounded(many), "label", "left_anti"), p.join(bounded(many), "label", "left_semi")
    other = lambda d: d.select("label", F.col("first").alias("other"), *[F.col(c).alias(f"_{c}") for c in "xyz"])
    width = 2 * distance
    cells = rest.withColumns({f"_c{c}": F.floor(F.col(c) / width) for c in "xyz"})
    around = other(rest)
    for c in "xyz":
        around = around.withColumn(f"_c{c}", F.explode(F.sequence(F.floor((F.col(f"_{c}") - distance) / width), F.floor((F.col(f"_{c}") + distance) / width))))
    pairs = [few.join(other(few), "label"), cells.join(around, ["label", *[f"_c{c}" for c in "xyz"]])]
    near = F.col("first") < F.col("other"), euclid([F.col(c) for c in "xyz"], [F.col(f"_{c}") for c in "xyz"]) <= distance
    links = [j.filter(near[0] & near[1]).select(F.col("first").alias("a"), F.col("other").alias("b")) for j in pairs]
    found = connected_components(links[0].unionByName(links[1]).unionByName(members)).withColumnRenamed("node", "seq")
    return o.select("seq").distinct().join(found, "seq", "left").select("seq", F.coalesce("component", "seq").alias("entity"))


def merge_events(merged: DataFrame) -> DataFrame:
    """Adds ``action``: what happened to each observation."""
    same = F.col("prior") == F.col("entity")
    action = F.when(F.col("created") & F.col("prior").isNull(), "create").when(F.col("created"), "split").when(F.col("prior").isNull(), "merge").when(same, "reuse").otherwise("reassociate")
    return merged.withColumn("action", action)


def merge_sweep(observations: DataFrame, distances: list[float]) -> DataFrame:
    """Entities and actions at each merge distance."""
    found = replayed_actions(observations, [float(d) for d in distances]).groupBy("action", "distance")
    return found.agg(F.sum("n").alias("n"), F.sum("entities").alias("entities")).select("action", "n", "entities", "distance")


def session_registration(regs: DataFrame, inliers: int = 20, rms: float = 0.2, std: float = 0.5) -> DataFrame:
    """``session, status, reason``: the first check that fails, in order, else verified."""
    worst = F.sqrt(F.array_max(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.get("covariance", i * 7))))
    reason = F.when(F.col("inliers") < inliers, "too_few_inliers").when(F.col("rms") > rms, "rms_too_large").when(worst > std, "covariance_too_large").otherwise("verified")
    return regs.select("session", F.when(reason == "verified", "registered").otherwise("rejected").alias("status"), reason.alias("reason"))


def coalesce_corrections(ops: DataFrame) -> DataFrame:
    """``op, entity, revision, seq, state``: duplicate, pending or superseded.

    The first of equal operation ids counts.  Among the pending ones of an entity and
    revision the last arrival with the highest (time, confidence) stays.
    """
    first = F.row_number().over(W.partitionBy("op").orderBy("seq"))
    o = ops.withColumn("_dup", first > 1)
    rank = F.struct("us", "confidence")
    w = W.partitionBy("entity", "revision", "_dup").orderBy(rank.desc(), F.desc("seq"))
    o = o.withColumn("_r", F.row_number().over(w))
    state = F.when(F.col("_dup"), "duplicate").when(F.col("_r") == 1, "pending").otherwise("superseded")
    return o.select("op", "entity", "revision", "seq", state.alias("state"), "label", "confidence", "us")


def apply_corrections(pending: DataFrame, entities: DataFrame, revision: int, limit: int) -> DataFrame:
    """Outcome of the next ``limit`` pending operations up to ``revision``: ``op, entity, outcome, reason``."""
    due = pending.filter((F.col("state") == "pending") & (F.col("revision") <= revision)).orderBy("us", "op").limit(limit)
    j = due.join(entities, "entity", "left")
    gone = F.col("name").isNull() | F.col("deleted")
    outcome = F.when(F.col("revision") < revision, "rejected").when(gone, "rejected").when(F.col("locked"), "applied_alias").otherwise("applied")
    reason = F.when(F.col("revision") < revision, "stale_revision").when(gone, "missing_entity").when(F.col("locked"), "user_name_locked").otherwise("updated")
    return j.select("op", "entity", "label", "us", "seq", outcome.alias("outcome"), reason.alias("reason"), F.col("name").alias("old_name"))


def applied_names(applied: DataFrame) -> DataFrame:
    """Per entity the new name (of its last applied operation) and the names that became aliases."""
    last = F.max_by("label", F.when(F.col("outcome") == "applied", F.struct("us", "seq")))
    alias = F.when(F.col("outcome") == "applied_alias", F.col("label")).when(F.lower("old_name") != F.lower("label"), F.col("old_name"))
    return applied.filter("outcome <> 'rejected'").groupBy("entity").agg(last.alias("name"), F.array_join(F.array_sort(F.collect_set(alias)), ",").alias("aliases"))


def delivery_state(attempts: DataFrame, most: int = 3) -> DataFrame:
    """Per operation: delivered if any attempt succeeded, failed after ``most`` attempts, else retry."""
    a = attempts.groupBy("op").agg(F.bool_or("success").alias("_ok"), F.count(F.lit(1)).alias("attempts"))
    return a.select("op", "attempts", F.when(F.col("_ok"), "delivered").when(F.col("attempts") >= most, "failed").otherwise("retry").alias("status"))


def entity_snapshot(entities: DataFrame, aliases: DataFrame, obs: DataFrame) -> DataFrame:
    al = aliases.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set(F.lower("alias"))), ",").alias("aliases"))
    ob = obs.groupBy("entity").agg(F.count(F.lit(1)).alias("seen"), F.min("us").alias("first"), F.max("us").alias("last"))
    return entities.join(al, "entity", "left").join(ob, "entity", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))


def advance_revision(revisions: DataFrame) -> DataFrame:
    """One more row: the next revision, with its parent."""
    top = revisions.agg(F.max("revision").alias("parent"))
    return revisions.unionByName(top.select((F.col("parent") + 1).alias("revision"), "parent"))


def time_origin(obs: DataFrame, key: str, us: str, contract: int | None = None) -> DataFrame:
    """``origin`` (the contract's, else the first observation) and ``early``, the observations before it."""
    origin = F.min(us) if contract is None else F.lit(contract)
    early = F.count_if(F.lit(False)) if contract is None else F.count_if(F.col(us) < contract)
    return obs.groupBy(key).agg(origin.alias("origin"), early.alias("early"))


def standard_history(rows: DataFrame, origin_ns: int) -> DataFrame:
    """Nanoseconds from seconds and back, defaults to the sensor time, and an error if first is after last."""
    ns = lambda c: F.round(F.col(c) * 1e9).cast("bigint") + origin_ns  # noqa: E731  whole nanoseconds stay bigint
    first = F.coalesce("first_ns", ns("first_s"), "sensor_ns")
    last = F.coalesce("last_ns", ns("last_s"), "sensor_ns")
    r = rows.select("id", first.alias("first_ns"), last.alias("last_ns"), F.coalesce("count", F.lit(1)).alias("count"))
    return r.withColumn("error", F.when(F.col("first_ns") > F.col("last_ns"), "first_after_last"))


def rebase_times(nodes: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """Times less their sequence's start, once; rows without history are skipped."""
    j = nodes.join(starts, key).filter("first is not null")
    return j.select("id", (F.col("first") - F.col("start")).alias("first"), (F.col("last") - F.col("start")).alias("last"))


def canonical_semantic_id(obs: DataFrame) -> DataFrame:
    """``map, entity, semantic``: the first id an entity showed; one that another entity holds is replaced by a new one."""
    first = obs.groupBy("map", "entity").agg(F.min_by("semantic", "seq").alias("semantic"), F.min("seq").alias("seq"))
    w = W.partitionBy("map", "semantic").orderBy("seq")
    f = first.withColumn("_taken", F.row_number().over(w) > 1).withColumn("_top", F.max("semantic").over(W.partitionBy("map")))
    fresh = F.sum(F.col("_taken").cast("int")).over(W.partitionBy("map").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    return f.select("map", "entity", F.when(F.col("_taken"), F.col("_top") + fresh).otherwise(F.col("semantic")).alias("semantic"), F.col("_taken").alias("reassigned"))


def label_updates(corrections: DataFrame, key: str) -> DataFrame:
    """The last correction of each id; ``unknown`` re-opens it."""
    c = corrections.groupBy(key).agg(F.max_by("label", F.struct("us", "seq")).alias("label"), F.max("us").alias("us"))
    return c.withColumn("reopened", F.col("label") == "unknown")


def snapshot_incremental(obs: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return obs.select(*keys).distinct().join(seen.select(*keys), keys, "left_anti")
