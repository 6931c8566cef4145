"""Aggregations and reports."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from maploom.functions.geometry import euclid
from maploom.operators.graphs import connected_components
from maploom.sources.tables import bounded, stored

PERCENTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def _finite(c: str) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))


def numeric_summary(df: DataFrame, keys: list[str], col: str, exact: bool = True) -> DataFrame:
    """Count, mean, extremes and linear percentiles of the finite values; ``exact=False`` takes sketches for very large groups."""
    d = df.withColumn("_v", _finite(col))
    pct = (lambda p: F.percentile("_v", p)) if exact else (lambda p: F.approx_percentile("_v", p, 10000))
    return d.groupBy(*keys).agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.min("_v").alias("min"), *[pct(p).alias(n) for n, p in PERCENTILES.items()], F.max("_v").alias("max"))


def stage_metrics(telemetry: DataFrame, latencies: list[str]) -> DataFrame:
    """Per stage: processed, errors, throughput, high water, and percentiles of latencies (negative ones count as 0)."""
    done = F.col("event") == "done"
    span = (F.max("us") - F.min("us")) / 1e6
    cols = [F.count_if(done).alias("processed"), F.count_if(F.col("event") == "error").alias("errors"), (F.count_if(done) / F.greatest(span, F.lit(1e-9))).alias("throughput"), F.max("queue_size").alias("high_water")]
    for c in latencies:
        v = F.when(done, F.greatest(F.col(c), F.lit(0.0)))
        cols += [F.percentile(v, p).alias(f"{c}_{n}") for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))] + [F.max(v).alias(f"{c}_max")]
    return telemetry.groupBy("stage").agg(*cols)


def stage_totals(telemetry: DataFrame) -> DataFrame:
    """One row over all stages: stages, processed, errors, dropped."""
    return telemetry.agg(F.countDistinct("stage").alias("stages"), *[F.count_if(F.col("event") == e).alias(n) for e, n in (("done", "processed"), ("error", "errors"), ("drop", "dropped"))])


def drops_by_reason(telemetry: DataFrame) -> DataFrame:
    return telemetry.filter("event = 'drop'").groupBy("stage", "reason").agg(F.count(F.lit(1)).alias("n"))


def operation_stats(df: DataFrame, key: str, col: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max"), F.sum(col).alias("total"), *[F.percentile(col, p).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])


def status_counts(df: DataFrame, statuses: list[str]) -> DataFrame:
    """Rows per declared status, 0 where there are none."""
    declared = df.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return F.broadcast(declared).join(df.groupBy("status").agg(F.count(F.lit(1)).alias("_n")), "status", "left").select("status", F.coalesce("_n", F.lit(0)).alias("n"))


def robust_entity_geometry(obs: DataFrame) -> DataFrame:
    """Component-wise median position, median of the known dimensions (``dx, dy, dz``, where the columns exist) and the largest confidence of each entity."""
    cols = [*"xyz", *[c for c in ("dx", "dy", "dz") if c in obs.columns]]
    return obs.groupBy("entity").agg(*[F.percentile(c, 0.5).alias(c) for c in cols], F.max("confidence").alias("confidence"))


def masked_geometry(px: DataFrame, k: tuple[float, float, float, float], most: int) -> DataFrame:
    """Per frame and label: median centre and 5-95 % extent (0.05 at least) of at most ``most`` evenly spaced pixels' points."""
    fx, fy, cx, cy = k
    w = W.partitionBy("frame", "label").orderBy("v", "u")
    p = px.filter("depth > 0 and label <> 0").withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("frame", "label")))
    # row i is one of floor(j (n - 1) / (most - 1)) for some j
    j = F.ceil(F.col("_i") * (most - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    p = p.filter((F.col("_n") <= most) | (F.floor(j * (F.col("_n") - 1) / (most - 1)) == F.col("_i")))
    p = p.select("frame", "label", ((F.col("u") - cx) * F.col("depth") / fx).alias("x"), ((F.col("v") - cy) * F.col("depth") / fy).alias("y"), F.col("depth").alias("z"))
    dims = [F.greatest(F.percentile(c, 0.95) - F.percentile(c, 0.05), F.lit(0.05)).alias(f"d{c}") for c in "xyz"]
    return p.groupBy("frame", "label").agg(F.count(F.lit(1)).alias("n"), *[F.percentile(c, 0.5).alias(c) for c in "xyz"], *dims)


def label_frame_summary(px: DataFrame) -> DataFrame:
    """Per frame: distinct labels, share of labelled rows, entropy (bits) of the labels other than 0."""
    c = px.groupBy("frame", "label").agg(F.count(F.lit(1)).alias("n"))
    lab = F.when(F.col("label") != 0, F.col("n"))
    c = c.withColumn("_t", F.sum(lab).over(W.partitionBy("frame")))
    p = lab / F.col("_t")
    return c.groupBy("frame").agg(F.count(lab).alias("labels"), (F.coalesce(F.sum(lab), F.lit(0)) / F.sum("n")).alias("ratio"), F.coalesce(-F.sum(p * F.log2(p)), F.lit(0.0)).alias("entropy"))


def top_labels(px: DataFrame, most: int = 31) -> DataFrame:
    """The ``most`` labels with most rows over all frames, label 0 left out: ``label, n, frames``."""
    c = px.filter("label <> 0").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("frame").alias("frames"))
    return c.orderBy(F.desc("n"), "label").limit(most)


#: Ranks on either side of a percentile that are looked at one by one, as a share of a group: five times the error of the sketch that finds them.
#: In a group of up to ``WHOLE`` values that may be less than a rank, so all are looked at.
AROUND, WHOLE = 5e-4, 20_000


def spread_percentiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]], *others: Column) -> DataFrame:
    """``keys``, exact interpolated percentiles and other aggregates; no task holds a group's values.

    A first pass takes two values around each percentile from sketches, a second one counts the values below them and lists the few between.
    """
    ends = [F.percentile_approx(c, [max(q - AROUND, 0.0), min(q + AROUND, 1.0)], 10_000).alias(f"_e{i}") for i, (c, q) in enumerate(wanted.values())]
    marks = stored(df.groupBy(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)]).agg(*ends, *[F.count(c).alias(f"_m{i}") for i, (c, _) in enumerate(wanted.values())]), "percentile-ends")
    same = lambda: reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(keys)], F.lit(True))
    named = lambda d: d.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], *[c for c in d.columns if c not in keys])
    d = df.join(bounded(marks), same())
    small = [F.col(f"_m{i}") <= WHOLE for i in range(len(wanted))]
    low = [F.lit(float("-inf")) if q <= AROUND else F.when(small[i], float("-inf")).otherwise(F.col(f"_e{i}")[0]) for i, (_, q) in enumerate(wanted.values())]
    high = [F.lit(float("nan")) if q >= 1 - AROUND else F.when(small[i], float("nan")).otherwise(F.col(f"_e{i}")[1]) for i, (_, q) in enumerate(wanted.values())]  # not a number ranks above all
    each = [(i, c.cast("double"), q) for i, (c, q) in enumerate(wanted.values())]
    sums = stored(d.groupBy(*keys).agg(*others, *[F.count_if(c < low[i]).alias(f"_b{i}") for i, c, _ in each], *[F.count(c).alias(f"_n{i}") for i, c, _ in each]), "percentile-sums")
    inside = d.select(*keys, F.explode(F.array(*[F.when((c >= low[i]) & (c <= high[i]), F.struct(F.lit(i).alias("i"), c.alias("x"))) for i, c, _ in each])).alias("_s"))
    inside = inside.filter("_s is not null").groupBy(*keys, F.col("_s.i").alias("_i"), F.col("_s.x").alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    before = sums.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_b{i}").alias("b"), ((F.col(f"_n{i}") - 1) * q).alias("at")) for i, _, q in each])).alias("_s"))
    r = inside.join(bounded(before), same() & (F.col("_i") == F.col("_s.i")))
    r = r.withColumn("_u", F.col("_s.b") + F.sum("_c").over(W.partitionBy(*keys, "_i").orderBy("_x")))
    at, first = F.col("_s.at"), lambda rank: F.min(F.when(F.col("_u") > rank, F.col("_x")))
    r = r.groupBy(*keys, "_i").agg(F.max(at).alias("_at"), first(F.floor(at)).alias("_l"), first(F.ceil(at)).alias("_h"))
    value = F.when(F.col("_l") == F.col("_h"), F.col("_l")).otherwise((F.ceil("_at") - F.col("_at")) * F.col("_l") + (F.col("_at") - F.floor("_at")) * F.col("_h"))
    found = r.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, value)).alias(n) for i, n in enumerate(wanted)])
    out = sums.join(bounded(named(found)), same(), "left")
    return out.select(*keys, *[c for c in out.columns if c not in keys and not c.startswith("_")])


def error_summary(df: DataFrame, keys: list[str], prediction: str, reference: str) -> DataFrame:
    e = F.col(prediction) - F.col(reference)
    rel = F.abs(e) / F.greatest(F.col(reference), F.lit(1e-6))
    within = [F.avg((F.abs(e) <= d).cast("double")).alias(n) for d, n in ((1.0, "within_1"), (5.0, "within_5"), (20.0, "within_20"))]
    wanted = {"median": (e, 0.5), "median_abs": (F.abs(e), 0.5), "p90_abs": (F.abs(e), 0.9), "median_rel": (rel, 0.5)}
    out = spread_percentiles(df, keys, wanted, F.count(F.lit(1)).alias("n"), F.avg(e).alias("mean"), F.avg(F.abs(e)).alias("mae"), *within)
    return out.select(*keys, "n", "mean", "median", "mae", "median_abs", "p90_abs", "median_rel", "within_1", "within_5", "within_20")


def range_bin_report(df: DataFrame, bins: list[float], policies: dict[str, Column], prediction: str, reference: str) -> DataFrame:
    """Errors per policy (rows it selects) and half-open reference range, with the share of rows that are valid."""
    i = reduce(lambda a, b: a + b, [(F.col(reference) >= b).cast("int") for b in bins]) - 1
    d = df.withColumn("bin", i.cast("bigint")).filter((F.col("bin") >= 0) & (F.col("bin") < len(bins) - 1))
    d = d.withColumn("policy", F.explode(F.array(*[F.when(c, F.lit(n)) for n, c in policies.items()]))).filter("policy is not null")
    ok = F.col("valid")
    e = F.when(ok, F.abs(F.col(prediction) - F.col(reference)))
    return d.groupBy("policy", "bin").agg(F.count(F.lit(1)).alias("n"), (F.count_if(ok) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("coverage"), F.avg(e).alias("mae"), F.percentile(e, 0.5).alias("median_abs"))


def scale_stability(df: DataFrame, frame: str, ratio: Column) -> DataFrame:
    """Median, extremes and relative span of the frames' median ratios."""
    f = df.filter(ratio.between(0.5, 5.0)).groupBy(frame).agg(F.percentile(ratio, 0.5).alias("r"))
    return f.agg(F.count(F.lit(1)).alias("frames"), F.percentile("r", 0.5).alias("median"), F.min("r").alias("min"), F.max("r").alias("max"), ((F.max("r") - F.min("r")) / F.percentile("r", 0.5)).alias("span"))


def dense_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per frame: overlap, coverage both ways and errors of two depth maps over the pixels both have."""
    j = a.select("frame", "u", "v", F.col("depth").alias("da")).join(b.select("frame", "u", "v", F.col("depth").alias("db")), ["frame", "u", "v"], "full")
    va, vb = F.coalesce(F.col("da") > 0, F.lit(False)), F.coalesce(F.col("db") > 0, F.lit(False))
    both = va & vb
    e = F.when(both, F.col("da") - F.col("db"))
    ratio = F.when(both, F.greatest(F.col("da") / F.col("db"), F.col("db") / F.col("da")))
    n = F.count_if(both)
    return j.groupBy("frame").agg(n.alias("common"), (n / F.count_if(va | vb)).alias("iou"), (n / F.count_if(va)).alias("cover_a"), (n / F.count_if(vb)).alias("cover_b"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e) / F.when(both, F.col("db"))).alias("abs_rel"), F.avg(e).alias("signed"), F.avg((ratio < 1.25).cast("double")).alias("delta_125"))


def pair_rollup(pairs: DataFrame) -> DataFrame:
    p = pairs.withColumn("gap", F.abs("offset"))
    return p.groupBy("gap").agg((F.sum("agree") / F.sum("comparable")).alias("rate"), F.percentile(F.col("agree") / F.col("comparable"), 0.5).alias("median"), F.percentile(F.col("agree") / F.col("comparable"), 0.05).alias("p05"), F.percentile("dt", 0.5).alias("dt_median"), F.max("dt").alias("dt_max"))


def radial_bins(px: DataFrame, k: tuple[float, float, float, float]) -> DataFrame:
    fx, fy, cx, cy = k
    r = F.hypot((F.col("u") - cx) / fx, (F.col("v") - cy) / fy)
    b = F.when(r < 0.4, 0).when(r < 0.8, 1).when(r < 1.2, 2).otherwise(3).cast("bigint")
    return px.withColumn("bin", b).groupBy("bin").agg(F.count(F.lit(1)).alias("comparable"), F.avg(F.col("agrees").cast("double")).alias("agreement"))


def stream_stats(events: DataFrame, stream: str, us: str, order: str, frame: str | None = None) -> DataFrame:
    """Per stream: count, first and last, duration (s), rate, largest gap, whether time always rises and, with ``frame``, how many frames it names."""
    w = W.partitionBy(stream).orderBy(order)
    e = events.withColumn("_g", F.col(us) - F.lag(us).over(w))
    span = (F.max(us) - F.min(us)) / 1e6
    frames = [F.countDistinct(frame).alias("frames")] if frame else []
    return e.groupBy(stream).agg(F.count(F.lit(1)).alias("n"), F.min(us).alias("first"), F.max(us).alias("last"), span.alias("duration"), F.when(span > 0, (F.count(F.lit(1)) - 1) / span).alias("rate"), F.max("_g").alias("max_gap"), F.coalesce(F.bool_and(F.col("_g") > 0), F.lit(True)).alias("monotonic"), *frames)


def track_lifecycle(obs: DataFrame) -> DataFrame:
    """``scene, track, frame, x`` and a box ``x0, y0, x1, y1`` -> life span, gaps, jump and overlap of consecutive boxes per track, with flags."""
    w = W.partitionBy("scene", "track").orderBy("frame")
    o = obs.withColumn("_g", F.col("frame") - F.lag("frame").over(w)).withColumn("_j", F.abs(F.col("x") - F.lag("x").over(w)))
    side = [F.greatest(F.least(f"{c}1", F.lag(f"{c}1").over(w)) - F.greatest(f"{c}0", F.lag(f"{c}0").over(w)), F.lit(0.0)) for c in "xy"]
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    o = o.withColumn("_both", side[0] * side[1]).withColumn("_area", area)
    union = F.col("_area") + F.lag("_area").over(w) - F.col("_both")
    o = o.withColumn("_iou", F.when((F.col("_g") == 1) & (union > 0), F.col("_both") / union))
    t = o.groupBy("scene", "track").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("_g") > 1).alias("gaps"), F.max("_g").alias("max_gap"), F.max("_j").alias("max_jump"), F.avg("_iou").alias("iou_mean"), F.min("_iou").alias("iou_min"))
    life = F.col("last") - F.col("first") + 1
    t = t.withColumn("life", life).withColumn("fill", F.col("n") / F.col("life")).withColumn("missing", F.col("life") - F.col("n"))
    flags = F.array_compact(F.array(F.when(F.col("n") <= 2, "short"), F.when((F.col("life") >= 5) & (F.col("fill") < 0.25), "sparse"), F.when(F.col("gaps") > 0, "gap"), F.when(F.col("max_jump") > 0.25, "jump"), F.when(F.col("iou_min") < 0.05, "overlap")))
    return t.withColumn("flags", F.array_join(flags, ","))


def entity_membership(obs: DataFrame, most_spread: float) -> DataFrame:
    """Per entity: observations, local ids, span, distances to its centre, and a spread flag."""
    c = obs.groupBy("entity").agg(*[F.avg(a).alias(f"c{a}") for a in "xyz"])
    d = obs.join(c, "entity").withColumn("_d", F.sqrt(sum(((F.col(a) - F.col(f"c{a}")) ** 2 for a in "yz"), (F.col("x") - F.col("cx")) ** 2)))
    return d.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("local").alias("locals"), F.min("us").alias("first"), F.max("us").alias("last"), F.percentile("_d", 0.5).alias("median"), F.percentile("_d", 0.95).alias("p95"), F.max("_d").alias("most")).withColumn("spread", F.col("most") > most_spread)


def association_conflicts(rows: DataFrame) -> DataFrame:
    """Local ids with several entities, and entities with several local ids."""
    a = rows.groupBy("local").agg(F.countDistinct("entity").alias("n")).filter("n > 1").select(F.lit("local").alias("side"), F.col("local").alias("id"), "n")
    b = rows.groupBy("entity").agg(F.countDistinct("local").alias("n")).filter("n > 1").select(F.lit("entity").alias("side"), F.col("entity").alias("id"), "n")
    return a.union(b)


def edge_counts(events: DataFrame, a: str, b: str) -> DataFrame:
    return events.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def dominant_label(weights: DataFrame, region: str, label: str, weight: str) -> DataFrame:
    """The label with most weight in each region, the lower label of equals."""
    s = weights.groupBy(region, label).agg(F.sum(weight).alias("w"))
    return s.groupBy(region).agg(F.min(F.struct((-F.col("w")).alias("w"), label)).alias("s")).select(region, F.col(f"s.{label}").alias(label))


def history_rollup(obs: DataFrame, key: str) -> DataFrame:
    return obs.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("frame", "us"))).alias("seen"), F.min("us").alias("first"), F.max("us").alias("last"))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    c = df.groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).cast("double").alias("n")).withColumn("_t", F.sum("n").over(W.partitionBy()))  # one row a label pair
    c = c.withColumn("_ra", F.sum("n").over(W.partitionBy("_a"))).withColumn("_rb", F.sum("n").over(W.partitionBy("_b")))
    ra = c.select("_a", "_ra", "_t").distinct().join(c.select(F.col("_b").alias("_a"), "_rb").distinct(), "_a").agg(F.sum(F.col("_ra") / F.col("_t") * F.col("_rb") / F.col("_t")).alias("expected"))
    ob = c.agg((F.sum(F.when(F.col("_a") == F.col("_b"), F.col("n")).otherwise(0)) / F.max("_t")).alias("observed"))
    j = ob.join(F.broadcast(ra), F.lit(True)).withColumn("expected", F.coalesce("expected", F.lit(0.0)))
    return j.withColumn("kappa", F.when(F.col("expected") == 1, 1.0).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))


def review_consensus(reviews: DataFrame, severity: list[str]) -> DataFrame:
    """One row over items with two verdicts ``a, b``: how often the worse of each pair is in each class, and the strict and lenient rates.

    ``severity`` names the verdicts from best to worst.  Strict: the worse verdict is the best class; lenient: the better one is.
    Items with an unknown or missing verdict are counted apart.
    """
    place = lambda c: F.nullif(F.array_position(F.array(*map(F.lit, severity)), F.col(c)), F.lit(0))
    r = reviews.select(place("a").alias("_a"), place("b").alias("_b"))
    known = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    worse, better = F.when(known, F.greatest("_a", "_b")), F.when(known, F.least("_a", "_b"))
    rate = lambda c: F.avg(F.when(known, (c == 1).cast("double")))
    counts = [F.count_if(worse == k + 1).alias(n) for k, n in enumerate(severity)]
    return r.agg(F.count_if(known).alias("items"), F.count_if(~known).alias("unread"), F.count_if(F.col("_a") == F.col("_b")).alias("same"), *counts, rate(worse).alias("strict"), rate(better).alias("lenient"))


def run_summary(runs: DataFrame) -> DataFrame:
    """Per experiment and variant: runs, complete and diagnostic ones, pass rate of the judged, and the metric's spread."""
    state = [F.count_if(c).alias(c) for c in ("complete", "diagnostic") if c in runs.columns] + ([F.avg(F.col("passed").cast("double")).alias("pass_rate")] if "passed" in runs.columns else [])
    return runs.groupBy("experiment", "variant").agg(F.count(F.lit(1)).alias("runs"), *state, F.avg("metric").alias("mean"), F.percentile("metric", 0.5).alias("median"), F.min("metric").alias("min"), F.max("metric").alias("max"))


def bootstrap_ci(values: DataFrame, group: str, replicates: int, seed: int) -> DataFrame:
    """95 % interval of resampled means: each row gets a Poisson(1) weight in each replicate, which resamples without moving rows."""
    r = values.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = (F.pmod(F.xxhash64(F.lit(seed), "replicate", "id"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    edges = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712]
    weight = reduce(lambda a, b: a + b, [(u >= e).cast("int") for e in edges])
    m = r.withColumn("_w", weight).groupBy(group, "replicate").agg((F.sum(F.col("_w") * F.col("value")) / F.sum("_w")).alias("m"))
    return m.groupBy(group).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.5).alias("middle"), F.percentile("m", 0.975).alias("high"))


def paired_differences(base: DataFrame, cand: DataFrame) -> DataFrame:
    j = base.select("experiment", "seed", "repeat", F.col("metric").alias("b")).join(cand.select("experiment", "seed", "repeat", F.col("metric").alias("c")), ["experiment", "seed", "repeat"])
    return j.withColumn("diff", F.col("c") - F.col("b"))


def paired_effect(base: DataFrame, cand: DataFrame) -> DataFrame:
    d = paired_differences(base, cand)
    return d.groupBy("experiment").agg(F.count(F.lit(1)).alias("n"), F.avg("diff").alias("mean"), F.percentile("diff", 0.5).alias("median"), F.count_if(F.col("diff") > 0).alias("better"))


def sign_flip_p(diffs: DataFrame, group: str, most: int = 20, flips: int = 100_000, seed: int = 0) -> DataFrame:
    """Two-sided sign-flip p-value of every group: exact over all sign patterns of up to ``most`` differences, else over ``flips`` random ones.

    A pattern and its opposite give the same size of sum, so the last sign stays in the exact form.
    """
    w, whole = W.partitionBy(group).orderBy("seed", "repeat"), W.partitionBy(group)
    d = diffs.filter("diff is not null").withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(whole))
    # sums in another order differ by rounding, which must not break a tie
    d = d.withColumn("_o", F.abs(F.sum("diff").over(whole)) - 1e-9 - 1e-12 * F.sum(F.abs("diff")).over(whole))
    exact = F.col("_n") <= most
    d = d.withColumn("_last", F.when(exact, F.pow(F.lit(2), F.col("_n") - 1)).otherwise(flips).cast("bigint") - 1)
    d = d.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_last") / 1024)))).repartition(64, group, "_block")
    d = d.withColumn("_flip", F.explode(F.sequence(F.col("_block") * 1024, F.least(F.col("_block") * 1024 + 1023, F.col("_last")))))
    bit = F.when(exact, F.expr("shiftright(_flip, _i) & 1")).otherwise(F.pmod(F.xxhash64(F.lit(seed), "_flip", "_i"), F.lit(2)))
    s = d.groupBy(group, "_block", "_flip").agg(F.abs(F.sum(F.when(bit == 1, -F.col("diff")).otherwise(F.col("diff")))).alias("s"), F.first("_o").alias("o"))
    return s.groupBy(group).agg(F.avg((F.col("s") >= F.col("o")).cast("double")).alias("p"))


def _welded(vertices: DataFrame, faces: DataFrame, grid: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices with ``weld``, faces whose three vertices exist with ``area, component``, and ``node, component`` of the welded vertices in faces."""
    key = F.struct(*[F.rint(F.col(c) / grid).cast("bigint").alias(c) for c in "xyz"])
    v = vertices.withColumn("weld", F.min("vid").over(W.partitionBy(key)))
    side = lambda n: v.select(F.col("vid").alias(n), F.col("weld").alias(f"w{n}"), *[F.col(c).alias(f"{n}{c}") for c in "xyz"])
    f = faces.join(side("a"), "a").join(side("b"), "b").join(side("c"), "c")
    e = f.select(F.col("wa").alias("a"), F.col("wb").alias("b")).union(f.select("wb", "wc"))
    comp = connected_components(e.select("a", "b"))
    p, q = [[F.col(f"{n}{c}") - F.col(f"a{c}") for c in "xyz"] for n in "bc"]
    cross = [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    area = F.sqrt(cross[0] ** 2 + cross[1] ** 2 + cross[2] ** 2) / 2
    return v, f.withColumn("area", area).join(comp.withColumnRenamed("node", "wa"), "wa"), comp


def mesh_components(vertices: DataFrame, faces: DataFrame, grid: float = 1e-4) -> DataFrame:
    """``component, faces, area`` of triangles whose vertices are welded to a grid."""
    _, f, _ = _welded(vertices, faces, grid)
    return f.groupBy("component").agg(F.count(F.lit(1)).alias("faces"), F.sum("area").alias("area"))


def mesh_quality(vertices: DataFrame, faces: DataFrame, grid: float = 1e-4, significant: float = 5e-3) -> DataFrame:
    """One row over a triangle mesh (``vid, x, y, z`` and ``a, b, c``), welded to a grid.

    The largest component's share of the vertices in faces and of the area, components of at least ``significant`` area and
    the share of area in the others, welded vertices in no face, and faces with a vertex that does not exist.
    A mesh without faces has ratios of 0.
    """
    v, f, comp = _welded(vertices, faces, grid)
    areas = f.groupBy("component").agg(F.count(F.lit(1)).alias("faces"), F.sum("area").alias("area"))
    parts = comp.groupBy("component").agg(F.count(F.lit(1)).alias("nodes")).join(areas, "component")
    large = F.col("area") >= significant
    zero = lambda c: F.coalesce(c, F.lit(0))
    p = parts.agg(F.count(F.lit(1)).alias("components"), zero(F.sum("nodes")).alias("used"), zero(F.max("nodes")).alias("largest"), zero(F.sum("area")).alias("area"), zero(F.max("area")).alias("largest_area"), zero(F.sum("faces")).alias("valid"), F.count_if(large).alias("significant"), zero(F.sum(F.when(~large, F.col("area")))).alias("tiny"))
    n = v.agg(F.count(F.lit(1)).alias("vertices"), F.countDistinct("weld").alias("welded"))
    one = p.join(n, F.lit(True)).join(faces.agg(F.count(F.lit(1)).alias("faces")), F.lit(True))  # three rows of one row each
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return one.select("vertices", "faces", "welded", "components", (F.col("welded") - F.col("used")).alias("isolated"), (F.col("faces") - F.col("valid")).alias("invalid_faces"), ratio("largest", "used").alias("largest_ratio"), "area", ratio("largest_area", "area").alias("largest_area_ratio"), "significant", ratio("tiny", "area").alias("tiny_area_ratio"))


def voxel_downsample(points: DataFrame, size: float, order: str) -> DataFrame:
    """The first point by ``order`` of each grid cell."""
    cell = [F.floor(F.col(c) / size).alias(f"c{c}") for c in "xyz"]
    return points.groupBy(*cell).agg(F.min_by(F.struct(*points.columns), order).alias("p")).select("p.*")


def z_buffer(points: DataFrame, k: tuple[float, float, float, float]) -> DataFrame:
    """The nearest point of each pixel."""
    fx, fy, cx, cy = k
    p = points.filter("z > 0").withColumns({"u": F.rint(fx * F.col("x") / F.col("z") + cx).cast("bigint"), "v": F.rint(fy * F.col("y") / F.col("z") + cy).cast("bigint")})
    return p.groupBy("u", "v").agg(F.min(F.struct("z", "id")).alias("s")).select("u", "v", "s.id", F.col("s.z").alias("depth"))


def dbscan(points: DataFrame, eps: float, least: int, by: str | None = None) -> DataFrame:
    """``id, cluster``: components of core points; a border point joins its core neighbour with the lowest id.

    With ``by``, only points that share its value are neighbours; ids are unique over all of them.  Places that aren't finite have no neighbours.

    Cells are so small that all points of one are neighbours: a cell of ``least`` points has core points only, and only the few points of others count theirs.
    Copies are one place.  Cells are linked, not points: by outermost core points first, and those still apart by all that can be near enough.
    """
    from maploom.operators.joins import radius_join

    same, axes = [by] if by else [], ["x", "y", "z"]
    key = [*same, "_kx", "_ky", "_kz"]
    width = eps / math.sqrt(3) * 0.999  # a cell's diagonal stays below eps after rounding
    finite = reduce(lambda p, q: p & q, [F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) for c in axes])
    spot = points.filter(finite).groupBy(*same, *axes).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("_n")).withColumns({f"_k{c}": F.floor(F.col(c) / width) for c in axes})
    spot = stored(spot, "places")
    spot = stored(spot.join(spot.groupBy(*key).agg(F.sum("_n").alias("_all")), key), "cells")

    few = spot.filter(F.col("_all") < least).select(F.col("id").alias("_few"), *same, *axes)
    counted = radius_join(spot.select("_n", *same, *axes), few, eps, on=tuple(same)).groupBy("_few").agg(F.sum("_n").alias("_near")).filter(F.col("_near") >= least)
    spot = spot.join(counted.select(F.col("_few").alias("id"), F.lit(True).alias("_met")), "id", "left")
    spot = stored(spot.withColumn("_core", (F.col("_all") >= least) | F.col("_met").isNotNull()).drop("_met", "_all"), "cores")
    core = spot.filter("_core")

    at = F.struct(*axes)
    ends = F.array_distinct(F.array(*[f(at, c) for c in axes for f in (F.min_by, F.max_by)])).alias("_ends")
    cells = core.groupBy(*key).agg(F.min("id").alias("_node"), ends, *[f(c).alias(f"_{n}{c}") for c in axes for n, f in (("lo", F.min), ("hi", F.max))])
    cells = stored(cells, "core-cells")
    step = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3) if (i, j, k) > (0, 0, 0)]  # a pair meets once
    other = cells.withColumn("_step", F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(s, axes)]) for s in step])))
    other = other.withColumns({f"_k{c}": F.col(f"_k{c}") + F.col(f"_step.{c}") for c in axes}).drop("_step")
    other = other.withColumnsRenamed({c: f"_o{c}" for c in cells.columns if c not in key})
    met = cells.hint("merge").join(other, key)
    gap = F.sqrt(sum((F.greatest(F.lit(0.0), F.col(f"_o_lo{c}") - F.col(f"_hi{c}"), F.col(f"_lo{c}") - F.col(f"_o_hi{c}")) ** 2 for c in axes), F.lit(0.0)))
    far = lambda p, q: euclid([p[c] for c in axes], [q[c] for c in axes])
    sure = F.exists("_ends", lambda p: F.exists("_o_ends", lambda q: far(p, q) <= eps))
    met = stored(met.filter(gap <= eps * (1 + 1e-9)).withColumn("_sure", sure).drop("_ends", "_o_ends"), "cell-pairs")
    loops = cells.select(F.col("_node").alias("a"), F.col("_node").alias("b"))
    comp = stored(connected_components(loops.unionByName(met.filter("_sure").select(F.col("_node").alias("a"), F.col("_o_node").alias("b")))), "cell-components")

    # cells that outermost points left apart
    name = lambda n, c: comp.select(F.col("node").alias(n), F.col("component").alias(c))
    apart = met.filter("not _sure").join(name("_node", "_c"), "_node").join(name("_o_node", "_d"), "_o_node").filter("_c <> _d")
    within = lambda side: reduce(lambda p, q: p & q, [F.col(c).between(F.col(f"{side}_lo{c}") - eps * (1 + 1e-9), F.col(f"{side}_hi{c}") + eps * (1 + 1e-9)) for c in axes])
    member = core.join(cells.select(*key, "_node"), key).select("_node", *axes)
    left = apart.join(member, "_node").filter(within("_o")).withColumnsRenamed({c: f"_{c}" for c in axes})
    pair = left.join(member.withColumnRenamed("_node", "_o_node"), "_o_node").filter(within(""))
    pair = pair.filter(euclid([F.col(f"_{c}") for c in axes], [F.col(c) for c in axes]) <= eps).select(F.col("_c").alias("a"), F.col("_d").alias("b")).distinct()
    roots = connected_components(stored(pair, "late-links"))
    comp = comp.join(roots.select(F.col("node").alias("component"), F.col("component").alias("_root")), "component", "left").select("node", F.coalesce("_root", "component").alias("cluster"))

    core = core.join(cells.select(*key, "_node"), key).join(comp.withColumnRenamed("node", "_node"), "_node").select("id", "cluster", *same, *axes)
    core = stored(core, "clustered")
    rest = spot.filter("not _core").select(F.col("id").alias("_rest"), *same, *axes)
    border = radius_join(core, rest, eps, on=tuple(same)).groupBy("_rest").agg(F.min_by("cluster", "id").alias("cluster"))
    border = border.join(rest, "_rest").select("cluster", *same, *axes)
    found = core.select("cluster", *same, *axes).unionByName(border)
    return points.select("id", *same, *axes).join(found, [*same, *axes]).select("id", "cluster")


def cluster_geometry(points: DataFrame, cameras: DataFrame, eps: float, least: int, least_points: int, share: float = 0.03) -> DataFrame:
    """The chosen DBSCAN cluster of each record, with its bounds.

    ``points``: ``record, id, x, y, z, support``; ``cameras``: ``record, cx, cy, cz``, the few positions a record was seen from.
    A cluster counts from ``least_points`` points and ``share`` of the record's largest one; of those, the one with the
    least median distance to its nearest camera is chosen, then the larger median support, then more points, then the lower id.
    Bounds go from the 5 % to the 95 % quantile, sides of less than 2 cm are widened, and the centre is the middle of the bounds.
    Records with fewer points, without a cluster that counts or without a camera have no row.
    """
    enough = points.groupBy("record").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least_points).select("record")
    p = points.join(enough, "record")
    c = p.join(dbscan(p, eps, least, "record"), "id")
    away = F.sqrt(sum(((F.col(a) - F.col(f"c{a}")) ** 2 for a in "yz"), (F.col("x") - F.col("cx")) ** 2))
    near = c.join(cameras, "record").groupBy("record", "id").agg(F.min(away).alias("camera"))
    c = c.join(near, ["record", "id"])
    bounds = [F.percentile(a, q).alias(f"{a}{k}") for a in "xyz" for k, q in ((0, 0.05), (1, 0.95))]
    g = c.groupBy("record", "cluster").agg(F.count(F.lit(1)).alias("points"), F.percentile("camera", 0.5).alias("camera"), F.percentile("support", 0.5).alias("support"), *bounds)
    g = g.withColumn("_least", F.greatest(F.lit(least_points), F.ceil(F.max("points").over(W.partitionBy("record")) * share))).filter("points >= _least")
    w = W.partitionBy("record").orderBy("camera", F.desc("support"), F.desc("points"), "cluster")
    g = g.withColumn("candidates", F.count(F.lit(1)).over(W.partitionBy("record"))).withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    centre = [((F.col(f"{a}0") + F.col(f"{a}1")) / 2).alias(a) for a in "xyz"]
    side = [F.greatest(F.col(f"{a}1") - F.col(f"{a}0"), F.lit(0.02)).alias(f"d{a}") for a in "xyz"]
    return g.select("record", "cluster", "candidates", "points", "camera", "support", *centre, *side)


def failure_cases(frames: DataFrame, rules: list[tuple[str, str, str, Column]], extremes: list[tuple[str, str, str, str, bool, int]] = ()) -> DataFrame:
    """``case_id, stage, severity``, each case once: a row per frame and rule that holds, and the worst frames by a metric.

    ``extremes``: (name, stage, severity, column, whether the largest, how many); equals go to the lower frame.
    """
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("rule"), F.lit(st).alias("stage"), F.lit(sev).alias("severity"))) for n, st, sev, c in rules]))
    case = F.concat_ws("-", "rule", F.col("frame").cast("string")).alias("case_id")
    found = frames.select("frame", F.explode(hits).alias("h")).select("frame", "h.*").select(case, "stage", "severity")
    for name, stage, severity, col, largest, most in extremes:
        worst = frames.filter(F.col(col).isNotNull()).orderBy(F.desc(col) if largest else F.asc(col), "frame").limit(most)  # the list is the feature
        found = found.unionByName(worst.select("frame", F.lit(name).alias("rule"), F.lit(stage).alias("stage"), F.lit(severity).alias("severity")).select(case, "stage", "severity"))
    return found.dropDuplicates(["case_id"])


def merge_action_summary(events: DataFrame, variant: str, action: str) -> DataFrame:
    """Count and share of each action per variant."""
    c = events.groupBy(F.col(variant).alias("variant"), F.col(action).alias("action")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("variant")))


def top_collisions(events: DataFrame, variant: str, entity: str, other: str, most: int = 8) -> DataFrame:
    """Per variant the ``most`` entities that met most different others, with ``place``; equals by entity."""
    c = events.groupBy(F.col(variant).alias("variant"), F.col(entity).alias("entity")).agg(F.countDistinct(other).alias("others"), F.count(F.lit(1)).alias("n"))
    return c.withColumn("place", F.row_number().over(W.partitionBy("variant").orderBy(F.desc("others"), "entity"))).filter(F.col("place") <= most)


def memory_summary(entities: DataFrame, most: int = 30) -> DataFrame:
    """The ``most`` names with most active entities: active and deleted ones, and how many entities bear the name."""
    c = entities.groupBy("name").agg(F.count_if(~F.col("deleted")).alias("active"), F.count_if("deleted").alias("gone"), F.countDistinct("entity").alias("entities"))
    return c.orderBy(F.desc("active"), "name").limit(most)


def graph_summary(nodes: DataFrame, layers: list[str]) -> DataFrame:
    """Nodes of each layer down the hierarchy, and over all (-1)."""
    c = nodes.rollup(*layers).agg(F.count(F.lit(1)).alias("nodes"))
    return c.select(*[F.coalesce(k, F.lit(-1).cast("bigint")).alias(k) for k in layers], "nodes")


def flat_numbers(summary: DataFrame) -> DataFrame:
    """``path, value`` of every number in the columns of a summary, nested structs by dotted path; null numbers are left out."""
    from pyspark.sql import types as T

    def walk(schema, at: str) -> list[str]:
        out = []
        for f in schema:
            here = f"{at}{f.name}"
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, f"{here}.")
            elif isinstance(f.dataType, T.NumericType):
                out.append(here)
        return out

    each = F.array(*[F.struct(F.lit(n).alias("path"), F.col(n).cast("double").alias("value")) for n in walk(summary.schema, "")])
    return summary.select(F.explode(each).alias("x")).select("x.*").filter("value is not null")


def ab_delta(base: DataFrame, cand: DataFrame) -> DataFrame:
    """``path, delta``: candidate less base for each path that both summaries (``path, value``) have."""
    return base.select("path", F.col("value").alias("_b")).join(cand.select("path", F.col("value").alias("_c")), "path").select("path", (F.col("_c") - F.col("_b")).alias("delta"))


#: Skyline candidates of one tile; two tiles meet in a task.
SKYLINE_TILE = 20_000


def _beaten(points: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which ``points`` some row of ``by`` beats: at least as good in all columns, and better in one by more than 1e-12."""
    out = np.zeros(len(points), dtype=bool)
    for lo in range(0, len(by), 256):
        left = np.flatnonzero(~out)
        for cut in range(0, len(left), 2048):
            at = left[cut : cut + 2048]
            a, b = points[at, None, :], by[None, lo : lo + 256, :]
            out[at] = ((b >= a).all(2) & (b > a + 1e-12).any(2)).any(1)
    return out


def _skyline(points: np.ndarray) -> np.ndarray:
    """Places of the rows that no other row beats; what beats a row comes before it in falling order of the columns."""
    order = np.lexsort(-points.T[::-1])
    kept = order[:0]
    for lo in range(0, len(order), 1024):
        at = order[lo : lo + 1024]
        at = at[~_beaten(points[at], points[kept])]
        kept = np.concatenate([kept, at[~_beaten(points[at], points[at])]])
    return kept


def _local_skyline(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = None
    for pdf in batches:
        new = pdf.iloc[_skyline(pdf.to_numpy())]
        if held is not None:
            new = new[~_beaten(new.to_numpy(), held.to_numpy())]
            new = pd.concat([held[~_beaten(held.to_numpy(), new.to_numpy())], new], ignore_index=True)
        held = new
    if held is not None:
        yield held


def _tile_beaten(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The points of the first tile that a point of the other beats."""
    names = [c for c in pdf.columns if c.startswith("_m")]
    mine = pdf[pdf["home"] == key[0]] if key[0] != key[1] else pdf
    other = pdf[pdf["home"] == key[1]] if key[0] != key[1] else pdf
    return mine.loc[_beaten(mine[names].to_numpy(), other[names].to_numpy()), names]


def pareto_frontier(rows: DataFrame, id_: str, maximise: list[str], minimise: list[str]) -> DataFrame:
    """Rows that no other row beats: at least as good in all and better in one (by more than 1e-12).  Rows with nulls or NaN are left out.

    Equal points count once.  Each task keeps the skyline of its own points; these are dealt anew, a tile a task,
    while that takes out a half of them, and what is left meets tile by tile, so only the candidates are compared
    with one another and no task holds more than two tiles of them (a task's own skyline aside).
    """
    values = [*[F.col(c).cast("double") for c in maximise], *[-F.col(c).cast("double") for c in minimise]]
    names = [f"_m{i}" for i in range(len(values))]
    d = rows.withColumns(dict(zip(names, values)))
    d = d.filter(reduce(lambda a, b: a & b, [F.col(n).isNotNull() & ~F.isnan(n) for n in names]))
    points = d.select(*[(F.col(n) + 0.0).alias(n) for n in names]).distinct()
    schema = ", ".join(f"{n} double" for n in names)
    best = stored(points.mapInPandas(_local_skyline, schema), "skyline")
    n = best.count()
    while n > SKYLINE_TILE:
        best = stored(best.repartition(-(-n // SKYLINE_TILE), *names).mapInPandas(_local_skyline, schema), "skyline")
        before, n = n, best.count()
        if 2 * n > before:
            break
    tiles = -(-n // SKYLINE_TILE) or 1
    tiled = best.withColumn("home", F.pmod(F.xxhash64(*names), F.lit(tiles)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    # a point goes to (its tile, each other tile) to be judged, and to (each other tile, its tile) to judge
    sides = tiled.withColumn("g", F.explode(F.array_distinct(F.array(F.struct(F.col("home").alias("a"), F.col("other").alias("b")), F.struct(F.col("other").alias("a"), F.col("home").alias("b"))))))
    beaten = sides.select("g.a", "g.b", "home", *names).groupBy("a", "b").applyInPandas(_tile_beaten, schema)
    keep = best.join(beaten.distinct(), names, "left_anti")
    return d.join(keep, names, "left_semi").select(*rows.columns)


def dose_response(cells: DataFrame, least: float = 0.9) -> DataFrame:
    """Per fault family: worst detection of doses 1 and up, and whether detection never falls as the dose rises."""
    w = W.partitionBy("family").orderBy("dose")
    c = cells.withColumn("_p", F.lag("rate").over(w))
    return c.groupBy("family").agg(F.min(F.when(F.col("dose") >= 1, F.col("rate"))).alias("worst"), F.bool_and(F.col("_p").isNull() | (F.col("rate") >= F.col("_p") - 1e-12)).alias("monotone")).withColumn("passed", F.col("worst") >= least)


def factor_effects(cells: DataFrame, factor: str, fixed: list[str], metric: str) -> DataFrame:
    """Metric at the factor's highest level less that at its lowest, with the other factors fixed."""
    return cells.groupBy(*fixed).agg((F.max_by(metric, factor) - F.min_by(metric, factor)).alias("effect"), F.countDistinct(factor).alias("levels")).filter("levels > 1")


def label_raster(px: DataFrame) -> DataFrame:
    """One label per pixel: the most confident, the first of equals; and how many competed."""
    w = W.partitionBy("frame", "u", "v").orderBy(F.desc("conf"), "ord")
    p = px.withColumn("_r", F.row_number().over(w)).withColumn("claims", F.count(F.lit(1)).over(W.partitionBy("frame", "u", "v")))
    return p.filter("_r = 1").select("frame", "u", "v", "label", "claims")


def temporal_reject(support: DataFrame, least: int = 2, share: float = 0.25) -> DataFrame:
    """Per frame: pixels judged in at least ``least`` neighbours of which fewer than ``share`` support them."""
    px = support.groupBy("frame", "u", "v").agg(F.count_if("judged").alias("judged"), F.count_if(F.col("judged") & F.col("agrees")).alias("supported"))
    bad = (F.col("judged") >= least) & (F.col("supported") / F.col("judged") < share)
    return px.groupBy("frame").agg(F.count(F.lit(1)).alias("pixels"), F.count_if(bad).alias("rejected"))


def positions(values: DataFrame, group: str, order: str) -> DataFrame:
    """``group, _i, _n, value``: places by ``order`` in each group, counted over ranges, so that no task holds a group."""
    v = values.filter("value is not null").select(group, order, "value")
    v = stored(v.repartitionByRange(group, order, "value").withColumn("_p", F.spark_partition_id()), "ranges")
    before = F.sum("_c").over(W.partitionBy(group).orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    parts = v.groupBy(group, "_p").agg(F.count(F.lit(1)).alias("_c"))
    parts = parts.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("_n", F.sum("_c").over(W.partitionBy(group))).drop("_c")
    v = v.join(bounded(parts), [group, "_p"])
    return stored(v.select(group, (F.row_number().over(W.partitionBy(group, "_p").orderBy(order, "value")) - 1 + F.col("_before")).alias("_i"), "_n", "value"), "places")


def _replicate_sums(v: DataFrame, draws: DataFrame, group: str, length: int, cols: list[str]) -> DataFrame:
    """Sums of ``cols`` over the drawn blocks of each replicate.

    Whole blocks are summed once for each start and joined by it; only the last block of a replicate, cut to the group's size, is joined value by value.
    """
    span = max(length, 1 << 16)
    ring = v.unionByName(v.filter(F.col("_i") < length - 1).withColumn("_i", F.col("_i") + F.col("_n")))
    # a stretch of starts also needs the places that its last blocks run into
    near = F.array_distinct(F.array(F.floor(F.col("_i") / span), F.greatest(F.floor((F.col("_i") - length + 1) / span), F.lit(0))))
    w = W.partitionBy(group, "_k").orderBy("_i")
    r = ring.withColumn("_k", F.explode(near))
    r = r.select(group, "_k", "_i", "_n", *cols, *[F.sum(c).over(w.rowsBetween(W.unboundedPreceding, 0)).alias(f"_c{c}") for c in cols])
    r = r.select(group, "_k", "_i", "_n", *[(F.lead(f"_c{c}", length - 1).over(w) - F.col(f"_c{c}") + F.col(c)).alias(c) for c in cols])
    blocks = r.filter((F.col("_i") < F.col("_n")) & (F.floor(F.col("_i") / span) == F.col("_k"))).select(group, F.col("_i").alias("start"), *cols)
    # draws are exploded from a row a group, so their size is underrated: they are shuffled, never sent through the driver
    whole = draws.hint("merge").filter(F.col("len") == length).join(blocks, [group, "start"]).select(group, "replicate", *cols)
    cut = draws.filter(F.col("len") < length).select(group, "replicate", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("_at"), "_n")
    cut = cut.select(group, "replicate", F.pmod("_at", "_n").alias("_i")).hint("merge").join(v.select(group, "_i", *cols), [group, "_i"]).select(group, "replicate", *cols)
    return whole.unionByName(cut).groupBy(group, "replicate").agg(*[F.sum(c).alias(c) for c in cols])


def _replicate_medians(v: DataFrame, draws: DataFrame, group: str, length: int, pivots: int = 16) -> DataFrame:
    """Median of each replicate by narrowing common pivots, then exactly within the last interval: ``group, replicate, m``.

    ``_lt``/``_le`` count a replicate's values under and up to a pivot.  The value of rank k lies above the pivots with a count of at most k, so
    a second round sets its pivots where the first left any replicate's median; only values between two of these are drawn one by one.
    """
    steps = F.array(*[F.lit((j + 1) / (pivots + 1)) for j in range(pivots)])

    def ranked(cuts: DataFrame, size: int) -> DataFrame:
        marked = v.join(bounded(cuts), group)
        marks = {f"_{n}{j}": (F.col("value") < F.col("_cuts")[j] if n == "lt" else F.col("value") <= F.col("_cuts")[j]).cast("bigint") for j in range(size) for n in ("lt", "le")}
        c = _replicate_sums(marked.withColumns(marks).drop("_cuts", "value"), draws, group, length, list(marks))
        sizes = draws.groupBy(group).agg(F.max("_n").alias("_n"))
        c = c.join(bounded(sizes), group).join(bounded(cuts), group)
        c = c.withColumn("k", F.explode(F.array_distinct(F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)))))
        under, upto = ([F.col(f"_{n}{j}") for j in range(size)] for n in ("lt", "le"))
        known = F.coalesce(*[F.when((a <= F.col("k")) & (F.col("k") < b), F.col("_cuts")[j]) for j, (a, b) in enumerate(zip(under, upto))])
        low = F.greatest(F.lit(float("-inf")), *[F.when(b <= F.col("k"), F.col("_cuts")[j]) for j, b in enumerate(upto)])
        high = F.least(F.lit(float("inf")), *[F.when(a > F.col("k"), F.col("_cuts")[j]) for j, a in enumerate(under)])
        place = reduce(lambda a, b: a + b, [(c <= F.col("k")).cast("int") for c in under + upto])
        base = F.greatest(F.lit(0), *[F.when(c <= F.col("k"), c) for c in under + upto])
        return c.select(group, "replicate", "k", known.alias("known"), low.alias("low"), high.alias("high"), place.alias("bin"), (F.col("k") - base).alias("rank"))

    first = ranked(v.groupBy(group).agg(F.percentile_approx("value", steps, 10_000).alias("_cuts")), pivots)
    range_ = stored(first.groupBy(group).agg(F.min(F.coalesce("known", "low")).alias("_low"), F.max(F.coalesce("known", "high")).alias("_high")), "medianrange")
    inside = v.join(bounded(range_), group).filter((F.col("value") >= F.col("_low")) & (F.col("value") <= F.col("_high")))
    cuts = inside.groupBy(group, "_low", "_high").agg(F.percentile_approx("value", steps, 10_000).alias("_q"))
    cuts = stored(cuts.select(group, F.concat(F.array("_low"), "_q", F.array("_high")).alias("_cuts")), "cuts")
    second = stored(ranked(cuts, pivots + 2), "ranks")
    open_ = second.filter("known is null").select(group, "replicate", "k", "bin", "rank")
    bin_ = F.aggregate("_cuts", F.lit(0), lambda n, c: n + (c < F.col("value")).cast("int") + (c <= F.col("value")).cast("int"))
    found = v.join(bounded(cuts), group).select(group, "_i", "_n", "value", bin_.alias("bin")).join(bounded(open_.select(group, "bin").distinct()), [group, "bin"], "left_semi")
    found = found.withColumn("_d", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(length), F.col("_n")) - 1))).withColumn("start", F.pmod(F.col("_i") - F.col("_d"), F.col("_n")))
    picks = draws.select(group, "replicate", "start", "len").join(bounded(open_), [group, "replicate"])
    hit = picks.hint("merge").join(found.select(group, "bin", "start", "_d", "value"), [group, "bin", "start"]).filter(F.col("_d") < F.col("len"))
    hit = hit.groupBy(group, "replicate", "k", "rank", "value").agg(F.count(F.lit(1)).alias("_w"))
    upto = F.sum("_w").over(W.partitionBy(group, "replicate", "k").orderBy("value"))
    exact = hit.withColumn("_u", upto).filter(F.col("_u") > F.col("rank")).groupBy(group, "replicate", "k").agg(F.min("value").alias("known"))
    both = exact.unionByName(second.filter("known is not null").select(group, "replicate", "k", "known"))
    return both.groupBy(group, "replicate").agg(F.avg("known").alias("m"))


def block_bootstrap(values: DataFrame, group: str, order: str, length: int, replicates: int, seed: int, stat: str = "mean") -> DataFrame:
    """95 % interval of the mean or median under circular moving blocks: ``group, low, middle, high``.

    Each replicate draws block starts by a seeded hash until the group's size is reached; the last block is cut to it.  Nulls are left out; equal
    ``order`` goes by value; a ``length`` over a group's size draws the whole group.
    """
    if length < 1 or stat not in ("mean", "median"):
        raise ValueError("length must be positive, stat mean or median")
    v = positions(values, group, order)
    draws = v.groupBy(group).agg(F.max("_n").alias("_n")).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    draws = draws.withColumn("draw", F.explode(F.sequence(F.lit(1).cast("bigint"), F.ceil(F.col("_n") / length))))
    draws = draws.withColumn("start", F.pmod(F.xxhash64(F.lit(seed), group, "replicate", "draw"), F.col("_n")))
    draws = draws.withColumn("len", F.least(F.lit(length), F.col("_n") - (F.col("draw") - 1) * length))
    if stat == "mean":
        m = _replicate_sums(v, draws, group, length, ["value"]).join(bounded(v.groupBy(group).agg(F.max("_n").alias("_n"))), group)
        m = m.select(group, "replicate", (F.col("value") / F.col("_n")).alias("m"))
    else:
        m = _replicate_medians(v, draws, group, length)
    return m.groupBy(group).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.5).alias("middle"), F.percentile("m", 0.975).alias("high"))


def edge_errors(poses: DataFrame, edges: DataFrame) -> DataFrame:
    """Per kind of edge: median and 95 % translation and heading error of measured against actual relative poses.

    ``poses``: ``id, x, y, yaw`` (degrees); ``edges``: ``a, b, kind, dx, dy, dyaw`` in the frame of ``a``.
    """
    side = lambda n: poses.select(F.col("id").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("x", "y", "yaw")])
    j = edges.join(side("a"), "a").join(side("b"), "b")
    c, s = F.cos(F.radians("a_yaw")), F.sin(F.radians("a_yaw"))
    mx, my = F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y")
    move = F.hypot(c * mx + s * my - F.col("dx"), -s * mx + c * my - F.col("dy"))
    turn = F.abs(F.pmod(F.col("b_yaw") - F.col("a_yaw") - F.col("dyaw") + 180, F.lit(360.0)) - 180)
    pct = [F.percentile(v, p).alias(f"{n}_{q}") for v, n in ((move, "move"), (turn, "turn")) for p, q in ((0.5, "p50"), (0.95, "p95"))]
    return j.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), *pct)


def inventory_summary(files: DataFrame) -> DataFrame:
    """``axis, value, files, bytes`` of a listing (``path, bytes, stage, kind, errors``), and over all (``all``, ``*``).

    Axes: root folder, extension, stage, kind, and each error of the bar-separated ``errors`` (a file counts once per different
    error).  A missing stage or kind is ``unknown``; files without errors are in no row of that axis.
    """
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    one = lambda axis, value: F.struct(F.lit(axis).alias("axis"), value.alias("value"))
    known = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    fixed = F.array(one("all", F.lit("*")), one("root", F.regexp_extract("path", r"^([^/]*)", 1)), one("extension", ext), one("stage", known("stage")), one("kind", known("kind")))
    errors = F.array_distinct(F.filter(F.transform(F.split(F.coalesce("errors", F.lit("")), r"\|"), lambda e: F.trim(e)), lambda e: e != ""))
    f = files.select("bytes", F.explode(F.concat(fixed, F.transform(errors, lambda e: one("error", e)))).alias("a"))
    return f.groupBy("a.axis", "a.value").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def label_consistency(tokens: DataFrame, entity: str, by: str, token: str) -> DataFrame:
    """``entity, mean, min, pairs, exact``: how alike the tokens are that the runs (``by``) give an entity, over all pairs of runs.

    ``tokens``: one row a token (repeats count once).  Only entities that every run has; nulls belong to none.  ``exact``: share of pairs with equal sets.
    """
    t = tokens.select(F.col(entity).alias("_e"), F.col(by).alias("_b"), F.col(token).alias("_t")).dropna().distinct()
    size = t.groupBy("_e", "_b").agg(F.count(F.lit(1)).alias("_n"))
    runs = t.agg(F.countDistinct("_b").alias("_all"))
    full = size.groupBy("_e").agg(F.count(F.lit(1)).alias("_k")).join(F.broadcast(runs), F.col("_k") == F.col("_all")).select("_e")
    size = size.join(full, "_e")
    # a token's runs are as few as the runs are
    held = t.join(full, "_e").groupBy("_e", "_t").agg(F.sort_array(F.collect_list("_b")).alias("_bs"))
    met = held.select("_e", F.explode("_bs").alias("_a"), "_bs").select("_e", "_a", F.explode("_bs").alias("_b")).filter("_a < _b").groupBy("_e", "_a", "_b").agg(F.count(F.lit(1)).alias("_both"))
    a, b = (size.select("_e", F.col("_b").alias(f"_{c}"), F.col("_n").alias(f"_n{c}")) for c in "ab")
    pairs = a.join(b, "_e").filter("_a < _b").join(met, ["_e", "_a", "_b"], "left")
    both = F.coalesce("_both", F.lit(0))
    j = pairs.select(F.col("_e").alias(entity), (both / (F.col("_na") + F.col("_nb") - both)).alias("_j"))
    return j.groupBy(entity).agg(F.avg("_j").alias("mean"), F.min("_j").alias("min"), F.count(F.lit(1)).alias("pairs"), F.avg((F.col("_j") == 1).cast("double")).alias("exact"))
