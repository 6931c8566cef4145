"""Doses of metadata faults put into good tables, and what the rules catch of each dose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maploom.operators.aggregates import positions
from maploom.sources.tables import stored

#: fixed values: doses, and the least dose that counts as medium, of which nine tenths must be caught
TIME_DOSES, TIME_MEDIUM, TIME_ALARM = (-20, -10, -5, -2, 2, 5, 10, 20), 5, 1.0
TRACK_DOSES, TRACK_MEDIUM = (1, 3, 5), 3
OFFSET_DOSES, OFFSET_MEDIUM, OFFSET_ALARM = (0.1, 0.3, 0.6), 0.3, 0.08
LEAST_CAUGHT = 0.9


def _passed(medium: Column) -> Column:
    return (~medium | (F.col("detection_rate") >= LEAST_CAUGHT)).alias("passed")


def _doses(doses: tuple, kind: str) -> Column:
    return F.explode(F.array(*[F.lit(d).cast(kind) for d in doses]))


def inject_time_offset(pairs: DataFrame, doses: tuple[int, ...] = TIME_DOSES) -> DataFrame:
    """Pairs of sensor times (``a_ns, b_ns``) with ``b_ns`` late by each ``dose`` (ms): ``signed_ms``, ``residual_ms`` against the pair as it was, and ``alarm``."""
    d = pairs.withColumn("dose", _doses(doses, "bigint"))
    d = d.withColumn("signed_ms", (F.col("b_ns") - F.col("a_ns")) / 1e6 + F.col("dose")).withColumn("b_ns", F.col("b_ns") + F.col("dose") * 1_000_000)
    return d.withColumn("residual_ms", F.col("dose").cast("double")).withColumn("alarm", F.abs("dose") >= TIME_ALARM)


def time_offset_report(injected: DataFrame) -> DataFrame:
    """A row a dose: pairs, share with an alarm, mean offset, and whether a medium dose is caught."""
    g = injected.groupBy("dose").agg(F.count(F.lit(1)).alias("eligible"), F.avg(F.col("alarm").cast("double")).alias("detection_rate"), F.avg("signed_ms").alias("mean_signed_ms"), F.max(F.abs("residual_ms")).alias("effect"))
    return g.select("*", _passed(F.abs("dose") >= TIME_MEDIUM))


def permute_ids(observations: DataFrame, doses: tuple[int, ...] = TRACK_DOSES) -> DataFrame:
    """A row a dose and one for dose 0: conflicts between local ids and entities after the ids of ``dose`` tracks are passed round.

    ``observations``: ``local`` (text), ``entity, us``.  The tracks are those with one entity and most observations (equal ones by id); each takes the next
    one's id, a single one a new id, from after the median time on.  Fewer such tracks than the largest dose are an error.  Only counts of
    (local, entity, side of the cut) are taken a dose, never the observations again.
    """
    obs = observations.select("local", "entity", "us")
    at = positions(obs.select(F.lit(0).alias("g"), F.col("us").alias("o"), F.col("us").alias("value")), "g", "o")
    cut = at.filter(F.col("_i").between(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2))).agg(F.floor(F.avg("value"))).first()[0]
    if cut is None:
        raise ValueError("no observations")
    pairs = stored(obs.groupBy("local", "entity", (F.col("us") > cut).alias("late")).agg(F.count(F.lit(1)).alias("n")), "pairs")
    steady = pairs.groupBy("local").agg(F.countDistinct("entity").alias("e"), F.sum("n").alias("n")).filter("e = 1")
    order = [r.local for r in steady.orderBy(F.desc("n"), "local").limit(max(doses)).collect()]  # as many as the largest dose
    if len(order) < max(doses):
        raise ValueError(f"{len(order)} tracks have one entity, {max(doses)} are needed")
    moves = [(d, a, order[(i + 1) % d] if d > 1 else f"{a}:permuted") for d in doses for i, a in enumerate(order[:d])]
    moves = observations.sparkSession.createDataFrame(moves, "dose long, local string, new string").withColumn("late", F.lit(True))
    p = pairs.withColumn("dose", _doses((0, *doses), "bigint")).join(F.broadcast(moves), ["dose", "local", "late"], "left")  # a row a dose and track
    p = p.groupBy("dose", F.coalesce("new", "local").alias("local"), "entity").agg(F.coalesce(F.sum(F.when(F.col("new").isNotNull(), F.col("n"))), F.lit(0)).alias("eligible"))
    a = p.groupBy("dose", "local").agg(F.count(F.lit(1)).alias("k"), F.sum("eligible").alias("eligible")).groupBy("dose").agg(F.count(F.lit(1)).alias("local_ids"), F.count_if(F.col("k") > 1).alias("local_conflicts"), F.sum("eligible").alias("eligible"))
    b = p.groupBy("dose", "entity").agg(F.count(F.lit(1)).alias("k")).groupBy("dose").agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("k") > 1).alias("entity_splits"))
    j = a.join(b, "dose")
    base = j.filter("dose = 0").select(F.col("local_conflicts").alias("_l"), F.col("entity_splits").alias("_s"))
    j = j.join(F.broadcast(base), F.lit(True))  # one row
    j = j.withColumn("detection_rate", F.when(F.col("eligible") > 0, 1.0).otherwise(0.0))  # no track keeps its id, so each of its rows differs
    j = j.withColumn("effect", F.col("local_conflicts") - F.col("_l") + F.col("entity_splits") - F.col("_s"))
    return j.select("dose", "local_ids", "entities", "local_conflicts", "entity_splits", "eligible", "detection_rate", "effect", _passed(F.col("dose") >= TRACK_MEDIUM))


def offset_positions(candidates: DataFrame, doses: tuple[float, ...] = OFFSET_DOSES) -> DataFrame:
    """A row a dose: accepted bindings judged again with the entity moved away from the mesh by ``dose`` metres.

    ``candidates``: ``entity, node, us, seq, accepted, centre, gap, most_centre, most_gap``; the last accepted one with both distances counts for an entity,
    node and time.  Centre distance and gap both grow by the dose; a binding holds while either is within its limit.
    """
    c = candidates.filter("accepted and centre is not null and gap is not null and node is not null")
    c = c.groupBy("entity", "node", "us").agg(F.max_by(F.struct("centre", "gap", "most_centre", "most_gap"), "seq").alias("s")).select("s.*")
    c = c.withColumn("dose", _doses(doses, "double"))
    holds = lambda more: (F.col("centre") + more <= F.col("most_centre")) | (F.col("gap") + more <= F.col("most_gap"))
    lost = holds(F.lit(0.0)) & ~holds(F.col("dose"))
    g = c.groupBy("dose").agg(F.count(F.lit(1)).alias("eligible"), F.avg((F.col("dose") >= OFFSET_ALARM).cast("double")).alias("detection_rate"), F.count_if(lost).alias("rejected"), F.avg(lost.cast("double")).alias("effect"))
    return g.select("*", _passed(F.col("dose") >= OFFSET_MEDIUM))
