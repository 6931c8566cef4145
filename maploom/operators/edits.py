"""Edits and rollbacks of the entity store, as append-only version, alias, revision and audit rows.

``entities``: ``entity, name, locked, deleted``; ``edits``: ``entity, revision, us, seq, verb, value`` with the verbs rename, alias and delete;
``aliases``: ``entity, alias, source, us, seq, epoch``; ``versions``: ``entity, revision, us, seq, action, name, locked, deleted, epoch``.
The epoch is the revision of the last rollback (0 before any): a rollback starts a new set of aliases and old ones stay as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from maploom.operators.sequences import last_version_asof

#: fixed values: names of actions and of alias sources
ACTIONS = {"rename": "user_name", "alias": "user_alias", "delete": "entity_deleted"}
PREVIOUS, USER, ROLLBACK, RESTORE, ADVANCE = "previous_name", "user", "rollback", "rollback_restore", "advance_revision"


def edit_log(entities: DataFrame, edits: DataFrame, epoch: int = 0) -> DataFrame:
    """Every edit with its outcome, folded in order of ``us, seq``: the entity's state after it, the alias it added, or its error.

    Errors: ``invalid`` (no positive time, an unknown verb, or an empty name or alias) and ``unknown_or_deleted`` (also by an earlier edit).
    A rename locks the name and keeps the old one as an alias unless they differ in case only; an edit in error changes nothing.
    """
    w = W.partitionBy("entity").orderBy("us", "seq")
    before, upto = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(W.unboundedPreceding, 0)
    e = entities.select("entity", F.col("name").alias("_name"), F.col("locked").alias("_locked"), F.col("deleted").alias("_deleted"))
    j = edits.select("entity", "revision", "us", "seq", "verb", F.btrim("value", F.lit(" \t\n\r\f\v")).alias("value")).join(e, "entity", "left")
    verb, value = F.col("verb"), F.col("value")
    sound = F.coalesce((F.col("us") > 0) & ((verb == "delete") | (verb.isin("rename", "alias") & (value != ""))), F.lit(False))
    no = lambda c: F.coalesce(c, F.lit(False))
    gone = F.col("_name").isNull() | no(F.col("_deleted")) | no(F.bool_or(sound & (verb == "delete")).over(before))
    error = F.when(~sound, "invalid").when(gone, "unknown_or_deleted")
    j = j.withColumn("error", error).withColumn("_ok", F.col("error").isNull()).withColumn("_new", F.when(F.col("_ok") & (verb == "rename"), value))
    old = F.coalesce(F.last("_new", True).over(before), F.col("_name"))
    added = F.when(F.col("_new").isNotNull() & (F.lower(old) != F.lower("_new")), old).when(F.col("_ok") & (verb == "alias"), value)
    action = F.coalesce(*[F.when(F.col("_ok") & (verb == v), a) for v, a in ACTIONS.items()])
    return j.select(
        "entity", "revision", "us", "seq", action.alias("action"), "error", F.coalesce(F.last("_new", True).over(upto), F.col("_name")).alias("name"),
        (no(F.col("_locked")) | F.bool_or(F.col("_new").isNotNull()).over(upto)).alias("locked"), (no(F.col("_deleted")) | F.bool_or(F.col("_ok") & (verb == "delete")).over(upto)).alias("deleted"),
        added.alias("added_alias"), F.when(added.isNotNull(), F.when(verb == "rename", PREVIOUS).otherwise(USER)).alias("alias_source"), F.lit(epoch).cast("bigint").alias("epoch"),
    )


def log_versions(log: DataFrame) -> DataFrame:
    """The version rows of an edit log; its audit rows are the same."""
    return log.filter("error is null").select("entity", "revision", "us", "seq", "action", "name", "locked", "deleted", "epoch")


def edited_entities(entities: DataFrame, log: DataFrame) -> DataFrame:
    """State of every entity after its last good edit, with that edit's time."""
    last = log.filter("error is null").groupBy("entity").agg(F.max_by(F.struct("name", "locked", "deleted", "us"), F.struct("us", "seq")).alias("_s"))
    now = lambda c: F.when(F.col("_s").isNull(), F.col(c)).otherwise(F.col(f"_s.{c}")).alias(c)
    return entities.select("entity", "name", "locked", "deleted").join(last, "entity", "left").select("entity", now("name"), now("locked"), now("deleted"), F.col("_s.us").alias("updated_us"))


def edited_aliases(aliases: DataFrame, log: DataFrame) -> DataFrame:
    """Alias rows with those of an edit log; the first of an entity's equal aliases (in any case) of an epoch stays."""
    new = log.filter("added_alias is not null").select("entity", F.col("added_alias").alias("alias"), F.col("alias_source").alias("source"), "us", "seq", "epoch")
    both = aliases.select("entity", "alias", "source", "us", "seq", "epoch").unionByName(new)
    first = both.groupBy("entity", "epoch", F.lower("alias").alias("_k")).agg(F.min(F.struct("us", "seq", "alias", "source")).alias("_s"))
    return first.select("entity", "_s.alias", "_s.source", "_s.us", "_s.seq", "epoch")


def rollback(entities: DataFrame, aliases: DataFrame, versions: DataFrame, revisions: DataFrame, target: int, us: int) -> dict[str, DataFrame]:
    """Back to ``target`` as a new revision: ``entities`` (the new state) and the rows to append to ``aliases, versions, revisions, audit``.

    Each entity takes its last version up to the target and the aliases it had then, with source rollback; one without such a version
    becomes a tombstone with its name and aliases, and has no version row.  ``revisions``: ``revision, parent, us, reason``.
    """
    undone = F.col("reason").startswith("rollback_to_")
    top, epoch = revisions.agg(F.max("revision"), F.max(F.when(undone, F.col("revision")))).first()
    if top is None or not 0 <= target <= top or us <= 0:
        raise ValueError(f"can't roll back to revision {target} at {us}: the last one is {top}")
    long = lambda x: F.lit(x).cast("bigint")
    new, reason = top + 1, f"rollback_to_{target}"
    snap = last_version_asof(versions, target).select("entity", F.col("revision").alias("from_revision"), F.struct("us", "seq").alias("_at"), F.col("epoch").alias("_e"), *[F.col(c).alias(f"_{c}") for c in ("name", "locked", "deleted")])
    j = entities.select("entity", "name", "locked", "deleted").join(snap, "entity", "left")
    kept: Column = F.col("from_revision").isNotNull()
    pick = lambda c, other: F.when(kept, F.col(f"_{c}")).otherwise(other).alias(c)
    state = j.select("entity", "from_revision", pick("name", F.col("name")), pick("locked", F.col("locked")), pick("deleted", F.lit(True)), long(us).alias("updated_us"))
    a = aliases.join(j.select("entity", "from_revision", "_at", "_e"), "entity")
    a = a.filter((kept & (F.col("epoch") == F.col("_e")) & (F.struct("us", "seq") <= F.col("_at"))) | (~kept & (F.col("epoch") == long(epoch or 0))))
    a = a.select("entity", "alias", F.when(kept, ROLLBACK).otherwise(F.col("source")).alias("source"), F.when(kept, long(us)).otherwise(F.col("us")).alias("us"), F.when(kept, long(0)).otherwise(F.col("seq")).alias("seq"), long(new).alias("epoch"))
    restored = state.filter(kept).select("entity", long(new).alias("revision"), long(us).alias("us"), long(0).alias("seq"), F.lit(RESTORE).alias("action"), "name", "locked", "deleted", long(new).alias("epoch"))
    row = revisions.sparkSession.range(1).select(long(new).alias("revision"), long(top).alias("parent"), long(us).alias("us"), F.lit(reason).alias("reason"))
    audit = row.select("revision", "us", F.lit(ADVANCE).alias("action"), F.lit(None).cast(entities.schema["entity"].dataType).alias("entity"), "reason")
    audit = audit.unionByName(restored.select("revision", "us", "action", "entity", F.lit(None).cast("string").alias("reason")))
    return {"entities": state, "aliases": a, "versions": restored, "revisions": row, "audit": audit}
