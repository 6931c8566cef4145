"""Window operators: gaps, visits, paths, schedules, ordered folds; and set operations."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from maploom.sources.tables import dealt


def gaps(df: DataFrame, key: str, t: str) -> DataFrame:
    return df.withColumn("gap", F.col(t) - F.lag(t).over(W.partitionBy(key).orderBy(t)))


def region_visits(samples: DataFrame) -> DataFrame:
    """``key, t, x, y, inside`` -> one row per stay: entry at its first inside sample, exit at the first outside sample after.

    A stay that is open at the end closes at its last sample.  The path counts inside
    samples only; durations and lengths are rounded to 2 places.
    """
    w = W.partitionBy("key").orderBy("t")
    s = samples.withColumn("_was", F.lag("inside").over(w)).withColumn("_next", F.lead("t").over(w))
    s = s.withColumn("_start", (F.col("inside") & ~F.coalesce("_was", F.lit(False))).cast("int"))
    step = F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2)
    s = s.withColumn("_step", F.when(F.col("_was"), step).otherwise(0.0))
    s = s.withColumn("visit", F.sum("_start").over(w.rowsBetween(W.unboundedPreceding, 0))).filter("inside")
    v = s.groupBy("key", "visit").agg(F.min("t").alias("entered"), F.max_by(F.coalesce("_next", "t"), "t").alias("left"), F.sum("_step").alias("path"))
    return v.select("key", "visit", "entered", "left", F.round(F.col("left") - F.col("entered"), 2).alias("duration"), F.round("path", 2).alias("path"))


def adjust_visit_ends(visits: DataFrame) -> DataFrame:
    """The first entry of all becomes 0.0 (with its duration), the last exit says ``did not leave.``"""
    w = W.partitionBy("key")
    first = F.col("entered") == F.min("entered").over(w)
    last = F.col("entered") == F.max("entered").over(w)
    v = visits.withColumn("_f", first).withColumn("_l", last)
    entered = F.when(F.col("_f"), 0.0).otherwise(F.col("entered"))
    return v.select("key", "visit", entered.alias("entered"), F.when(F.col("_l"), F.lit("did not leave.")).otherwise(F.format_number("left", 2)).alias("left_at"), F.when(F.col("_f"), F.round("left", 2)).otherwise(F.col("duration")).alias("duration"))


def visit_timeline(visits: DataFrame, name: str) -> DataFrame:
    """One sentence a key on where it started, went and ended."""
    step = F.transform(F.array_sort(F.collect_list(F.struct("entered", name))), lambda s: F.concat(s[name], F.lit("("), F.format_number(s["entered"], 1), F.lit(")")))
    v = visits.groupBy("key").agg(step.alias("s"))
    n, s = F.size("s"), F.col("s")
    middle = F.array_join(F.transform(F.slice(s, 2, F.greatest(n - 2, F.lit(0))), lambda x: F.concat(F.lit(", then went to "), x)), "")
    many = F.concat(F.lit("You started in "), s[0], middle, F.lit(", and finally ended in "), F.element_at(s, -1), F.lit("."))
    text = F.when(n == 0, "No region was visited.").when(n == 1, F.concat(F.lit("You were in "), F.element_at(s, 1), F.lit("."))).otherwise(many)
    return v.select("key", text.alias("timeline"))


def rolling_median(df: DataFrame, key: str, order: str, value: Column, rows: int) -> Column:
    return F.percentile(value, 0.5).over(W.partitionBy(key).orderBy(order).rowsBetween(-(rows - 1), 0))


def observation_threshold(events: DataFrame, n: int) -> DataFrame:
    """First frame at which an entity has been seen ``n`` times, with the delay since its first frame."""
    f = events.groupBy("entity", "frame").agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy("entity").orderBy("frame")
    f = f.withColumn("_run", F.sum("c").over(w)).withColumn("_first", F.min("frame").over(W.partitionBy("entity")))
    return f.filter(F.col("_run") >= n).groupBy("entity").agg(F.min("frame").alias("frame"), F.min(F.col("frame") - F.col("_first")).alias("delay"))


def arc_length(df: DataFrame, key: str | list[str], order: str, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Adds ``s``, the path length up to each point."""
    w = W.partitionBy(key).orderBy(order)
    step = F.coalesce(F.sqrt(sum(((F.col(a) - F.lag(a).over(w)) ** 2 for a in axes[1:]), (F.col(axes[0]) - F.lag(axes[0]).over(w)) ** 2)), F.lit(0.0))
    return df.withColumn("_d", step).withColumn("s", F.sum("_d").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_d")


def resample_path(df: DataFrame, key: str | list[str], order: str, n: int, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """``n`` points at equal arc length; a path without length repeats its first point."""
    keys = [key] if isinstance(key, str) else key
    a = arc_length(df, keys, order, axes)
    w = W.partitionBy(keys).orderBy(order)
    total = F.max("s").over(W.partitionBy(keys))
    a = a.withColumns({"_t": total, "_s1": F.lead("s").over(w), "_first": F.row_number().over(w)} | {f"_{c}1": F.lead(c).over(w) for c in axes})
    unit = F.col("_t") / (n - 1)
    # segment [s, s1) serves the targets i * unit that fall into it; the last target sits on the last segment's end
    lo = F.ceil(F.col("s") / unit - 1e-9)
    hi = F.least(F.ceil(F.col("_s1") / unit - 1e-9) - F.when(F.abs(F.col("_s1") - F.col("_t")) < 1e-12, 0).otherwise(1), F.lit(n - 1))
    seg = a.filter((F.col("_t") > 0) & (F.col("_s1") - F.col("s") > 1e-12)).withColumn("i", F.explode(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))))
    f = (F.col("i") * unit - F.col("s")) / (F.col("_s1") - F.col("s"))
    out = seg.select(*keys, "i", *[(F.col(c) + (F.col(f"_{c}1") - F.col(c)) * f).alias(c) for c in axes])  # a target has one segment: each ends where the next begins
    still = a.filter((F.col("_t") == 0) & (F.col("_first") == 1)).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))).select(*keys, "i", *axes)
    return out.unionByName(still)


def frame_windows(df: DataFrame, frame: str, size: int) -> DataFrame:
    """Tumbling windows on a frame index: weighted agreement of each; empty ones don't appear."""
    return df.groupBy(F.floor(F.col(frame) / size).alias("window")).agg(F.count(F.lit(1)).alias("pairs"), (F.sum("agree") / F.sum("comparable")).alias("rate"))


def annotation_windows(frames: DataFrame, split: str, frame: str, size: int = 25) -> DataFrame:
    """Chunks of each split; a tail shorter than ``max(8, size / 2)`` joins the chunk before.  The first chunk is reviewed twice."""
    w = W.partitionBy(split)
    f = frames.withColumn("_i", F.row_number().over(w.orderBy(frame)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    tail = F.col("_n") % size
    last = F.ceil(F.col("_n") / size) - 1 - ((tail > 0) & (tail < max(8, size / 2)) & (F.col("_n") > size)).cast("int")
    f = f.withColumn("window", F.least(F.floor(F.col("_i") / size), last))
    return f.groupBy(split, "window").agg(F.min(frame).alias("first"), F.max(frame).alias("last"), F.count(F.lit(1)).alias("n")).withColumn("dual", F.col("window") == 0)


def submap_ids(frames: DataFrame, key: str, order: str, most: int = 30) -> DataFrame:
    n = F.floor((F.row_number().over(W.partitionBy(key).orderBy(order)) - 1) / most)
    return frames.withColumn("submap", F.format_string("submap-%06d", n))


def carry_revisions(given: DataFrame, key: str, revision: str, value: str) -> DataFrame:
    """Every revision has every key: its own value or the one before it; null before the first."""
    grid = given.select(key).distinct().join(F.broadcast(given.select(revision).distinct()), F.lit(True))  # few revisions
    g = grid.join(given, [key, revision], "left")
    return g.withColumn(value, F.last(value, ignorenulls=True).over(W.partitionBy(key).orderBy(revision).rowsBetween(W.unboundedPreceding, 0)))


def last_version_asof(versions: DataFrame, revision: int) -> DataFrame:
    w = W.partitionBy("entity").orderBy(F.desc("revision"), F.desc("us"), F.desc("seq"))
    return versions.filter(F.col("revision") <= revision).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def ordered_fold(df: DataFrame, key: str, order: list[str], schema: str, start: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """Run a stateful function over each key's rows in order: for results that hang on what was kept before.

    ``start()`` gives a fresh function of one key's sorted rows.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return start()(pdf.sort_values(order))

    return df.groupBy(key).applyInPandas(run, schema)


def rate_gate(times: DataFrame, key: str, t: str, rate: float) -> DataFrame:
    """Rows that a schedule keeps: the first, then each at least ``1e9 / rate`` ns after the last kept one."""
    step = round(1e9 / rate)
    schema = times.schema.simpleString()[7:-1]

    def start():
        def go(pdf: pd.DataFrame) -> pd.DataFrame:
            keep, last = [], None
            for x in pdf[t]:
                ok = last is None or x - last >= step
                keep.append(ok)
                last = x if ok else last
            return pdf[keep]

        return go

    return ordered_fold(times, key, [t, "seq"], ", ".join(schema.replace(":", " ").split(",")), start)


def ema_velocity(df: DataFrame, key: str, t: str, order: str, a: float = 0.6) -> DataFrame:
    """Smoothed ``vx, vy`` and turning rate ``wz``, each ``v = a x + (1 - a) v``, of the rows whose time rises.

    Others are left out and don't move the state.  ``yaw`` is in degrees, its steps go the short way round; ``wz`` is in degrees
    per unit of time.
    """
    w = W.partitionBy(key).orderBy(order)
    best = F.max(t).over(w.rowsBetween(W.unboundedPreceding, -1))
    d = df.withColumn("_b", best).filter(F.col("_b").isNull() | (F.col(t) > F.col("_b")))
    step = lambda c: F.col(c) - F.lag(c).over(w)
    turn = F.pmod(step("yaw") + 180, F.lit(360.0)) - 180
    d = d.withColumn("_dt", step(t)).withColumns({f"_{n}": c / F.col("_dt") for n, c in (("vx", step("x")), ("vy", step("y")), ("wz", turn))})
    packed = d.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "_vx", "_vy", "_wz"))).alias("r"))
    fold = lambda n: F.aggregate(F.filter("r", lambda x: x[n].isNotNull()), F.lit(None).cast("double"), lambda v, x: F.when(v.isNull(), x[n]).otherwise(a * x[n] + (1 - a) * v))
    return packed.select(key, *[fold(f"_{n}").alias(n) for n in ("vx", "vy", "wz")], F.size("r").alias("samples"))


def trajectory_samples(traj: DataFrame, key: str, start: float, end: float, n: int = 10) -> DataFrame:
    """At ``n`` evenly spaced times of ``[start, end]`` the nearest row of each path inside it (of a tie the earlier).

    ``traj``: key, ``t, seq, x, y, yaw``.  Returns key, ``i, seq, t, x, y, yaw``, numbers to three places.  A path with no row
    in the range has no samples.
    """
    from maploom.operators.joins import nearest_in_time

    inside = traj.filter(F.col("t").between(start, end)).select(key, "t", F.col("seq").alias("at"), F.col("t").alias("when"), "x", "y", "yaw")
    grid = F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    q = inside.select(key).distinct().withColumn("i", grid).withColumn("t", F.lit(start) + F.col("i") * (end - start) / max(n - 1, 1))
    near = nearest_in_time(q, inside, [key], "t", ["when", "x", "y", "yaw"], "at")
    return near.select(key, "i", F.col("near_at").alias("seq"), F.round("near_when", 3).alias("t"), *[F.round(f"near_{c}", 3).alias(c) for c in ("x", "y", "yaw")])


def size_batches(records: DataFrame, key: str, order: str, size: str, least: float) -> DataFrame:
    """Adds ``batch``: rows gather until their sizes reach ``least``, then a new batch starts.

    Keys follow each other through a task, so a key costs its rows and none is held whole.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, n = object(), 0.0, 0
        for batch in batches:
            out = []
            for k, s in zip(batch.column(key).to_pylist(), batch.column("_s").to_pylist()):
                if k != now:
                    now, total, n = k, 0.0, 0
                out.append(n)
                total += math.nan if s is None else s
                if total >= least:
                    total, n = 0.0, n + 1
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(order), pa.array(out, pa.int64())], names=[key, order, "batch"])

    r = dealt(records.select(F.col(key).cast("long").alias(key), F.col(order).cast("long").alias(order), F.col(size).cast("double").alias("_s")), key)
    return r.sortWithinPartitions(key, order).mapInArrow(fill, f"{key} long, {order} long, batch long")


def fault_runs(frames: DataFrame, key: str, t: str, k: int) -> DataFrame:
    """For each start: the gap that dropping the next ``k`` frames makes, over the largest gap inside it."""
    w = W.partitionBy(key).orderBy(t)
    f = frames.withColumn("_g", F.lead(t).over(w) - F.col(t))
    f = f.withColumn("_after", F.lead(t, k + 1).over(w)).withColumn("_most", F.max("_g").over(w.rowsBetween(0, k)))
    return f.filter("_after is not null").select(key, t, (F.col("_after") - F.col(t)).alias("dropped_gap"), F.col("_most").alias("largest"))


def stratified_anchors(frames: DataFrame, split: str, frame: str, n: int, seed: int) -> DataFrame:
    """One frame of each of ``n`` time bins a split, by a seeded hash."""
    f = frames.withColumn("bin", F.ntile(n).over(W.partitionBy(split).orderBy(frame)))
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(frame).cast("string")), 256)
    return f.groupBy(split, "bin").agg(F.min_by(frame, h).alias(frame))


def observation_times(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("entity", "us").union(b.select("entity", "us")).distinct()


def missing_ticks(df: DataFrame, tick: str) -> DataFrame:
    """Integers between the least and largest tick that don't occur."""
    w = W.partitionBy(F.floor(F.col(tick) / 1_000_000)).orderBy(tick)
    d = df.select(tick).distinct()
    d = d.withColumn("_n", F.lead(tick).over(w))
    edge = d.groupBy(F.floor(F.col(tick) / 1_000_000).alias("_p")).agg(F.min(tick).alias("lo"), F.max(tick).alias("hi"))
    between = edge.withColumn("_n", F.lead("lo").over(W.orderBy("_p"))).select(F.col("hi").alias(tick), "_n")  # one row a million ticks
    holes = d.filter("_n is not null").unionByName(between.filter("_n is not null")).filter(F.col("_n") - F.col(tick) > 1)
    return holes.select(F.explode(F.sequence(F.col(tick) + 1, F.col("_n") - 1)).alias("missing"))


def shared_by_all(df: DataFrame, item: str, group: str) -> DataFrame:
    """Items that every group has."""
    n = df.agg(F.countDistinct(group).alias("_all"))
    c = df.groupBy(item).agg(F.countDistinct(group).alias("_n"))
    return c.join(F.broadcast(n), F.col("_n") == F.col("_all")).select(item)  # one row


def merge_semantic_records(records: DataFrame) -> DataFrame:
    """One record per entity: the first given value of each field by ``ord``, all sources sorted, and what conflicts.

    ``records``: ``entity, ord, label, description, embedding, source``; null and an empty description are not given.
    ``conflicts`` lists ``description``, ``embedding`` and ``label`` where an entity has different values, and ``owner``
    where one of its labels belongs to another entity too; ``conflict`` is whether it lists any.
    """
    r = records.withColumn("description", F.nullif("description", F.lit("")))
    owned = r.filter("label is not null").groupBy("label", "entity").agg(F.count(F.lit(1)).alias("_c"))  # one row an owner
    owners = owned.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("label")
    shared = owned.join(owners, "label", "left_semi").select("entity").distinct().withColumn("_o", F.lit(True))
    fields = ("description", "embedding", "label")
    g = r.groupBy("entity").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c) for c in fields], *[F.countDistinct(c).alias(f"_{c}") for c in fields], F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    g = g.join(shared, "entity", "left")
    found = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_{c}") > 1, c) for c in fields], F.when(F.col("_o"), "owner"))), ",")
    return g.select("entity", *fields, "sources", found.alias("conflicts"), (found != "").alias("conflict"))


def scale_acceptance(train: DataFrame, holdout: DataFrame, span: float = 0.25, relative: float = 0.12, signed: float = 0.10) -> DataFrame:
    """``name, value, passed``: whether a depth scale learned from ``train`` (``frame, scale``) holds on ``holdout`` (``frame, measured, reference``).

    The scale is the median over training frames.  Rules: its relative span, the scaled median relative and signed errors,
    that scaling lowers the relative error, and that no frame is on both sides.  A rule without data fails.
    """
    t = train.agg(F.percentile("scale", 0.5).alias("_s"), ((F.max("scale") - F.min("scale")) / F.percentile("scale", 0.5)).alias("span"))
    h = holdout.filter("reference > 0").join(F.broadcast(t), F.lit(True))  # one row
    error = lambda m: F.abs(m - F.col("reference")) / F.col("reference")
    scaled = F.col("measured") * F.col("_s")
    e = h.agg(F.percentile(error(scaled), 0.5).alias("relative"), F.percentile(error(F.col("measured")), 0.5).alias("raw"), F.percentile(scaled - F.col("reference"), 0.5).alias("signed"))
    both = train.select("frame").intersect(holdout.select("frame")).agg(F.count(F.lit(1)).cast("double").alias("overlap"))
    one = t.join(e, F.lit(True)).join(both, F.lit(True))
    gain = F.col("raw") - F.col("relative")
    rules = [("span", F.col("span"), F.col("span") <= span), ("relative", F.col("relative"), F.col("relative") <= relative), ("signed", F.col("signed"), F.abs("signed") <= signed), ("improved", gain, gain > 0), ("disjoint", F.col("overlap"), F.col("overlap") == 0)]
    rows = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value"), F.coalesce(ok, F.lit(False)).alias("passed")) for n, v, ok in rules])
    return one.select(F.explode(rows).alias("r")).select("r.*")
