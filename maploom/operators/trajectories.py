"""Acceptance of trajectories without ground truth: rate, loop closure, repeated paths and sensor streams.

A trajectory has rows ``key, t`` (seconds), ``x, y, z`` and a row-major 4x4 pose ``m``; its traversals are named by a column.
Every step is a group, a window or a join on ``key``; Python only fits the samples of a pair of paths, many pairs at a time.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.functions import pandas_udf

from maploom.functions.geometry import euclid, rotation_angle_deg
from maploom.operators.sequences import resample_path
from maploom.sources.tables import stored

AXES = ("x", "y", "z")

# The limits of acceptance and the codes of its checks.
LEAST_DURATION = 1800.0
LEAST_RATE = 20.0
MOST_LOOP = 0.50
MOST_LOOP_DEG = 10.0
MOST_ALIGNED_P95 = 0.30
SAMPLES = 128
TIE = 1e-9  # rounding differs by more than nothing between the two directions of a path
SENSORS = ("imu", "stereo_left", "stereo_right")
CODES = ("vio.duration", "vio.rate", "vio.loop_translation", "vio.loop_rotation", "vio.repeated_path", "vio.sensor_evidence")


def loop_closure(traj: DataFrame, key: str, order: str) -> DataFrame:
    """``key, n, duration, rate, loop, loop_deg``: how far the last pose is from the first, moved and turned.

    ``rate`` is 0 where the path lasts no time.  ``order`` has no ties in a key.
    """
    pose = F.struct("t", *AXES, "m")
    a = traj.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min_by(pose, order).alias("a"), F.max_by(pose, order).alias("b"))
    duration = F.col("b.t") - F.col("a.t")
    return a.select(
        key, "n", duration.alias("duration"), F.when(duration > 0, (F.col("n") - 1) / duration).otherwise(0.0).alias("rate"),
        euclid([F.col(f"a.{c}") for c in AXES], [F.col(f"b.{c}") for c in AXES]).alias("loop"),
        rotation_angle_deg(F.col("a.m"), F.col("b.m")).alias("loop_deg"),
    )


def _rotations(covariance: np.ndarray) -> np.ndarray:
    """Rotations that turn centred first points onto the second, from the 3 x 3 sums of their products."""
    u, _, vt = np.linalg.svd(covariance)
    flip = np.ones((len(u), 3))
    flip[:, 2] = np.sign(np.linalg.det(u) * np.linalg.det(vt))  # no mirror images
    return np.einsum("nji,nj,nkj->nik", vt, flip, u)


def _fitted(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """50th and 95th percentile and most of the distances of paths ``p`` (path, sample, axis), moved and turned, from ``q``; samples that one of the two lacks are NaN."""
    both = ~np.isnan(p[:, :, 0] + q[:, :, 0])
    n = np.maximum(both.sum(axis=1), 1)[:, None, None]
    # sums about a point of each path, not about the origin: positions may be large
    a, b = (np.where(both[:, :, None], x, 0.0) for x in (p, q))
    a, b = (np.where(both[:, :, None], x - x.sum(axis=1, keepdims=True) / n, 0.0) for x in (a, b))
    away = np.linalg.norm(np.einsum("nij,nkj->nki", _rotations(np.einsum("nki,nkj->nij", a, b)), a) - b, axis=2)
    out = np.full((len(p), 3), np.nan)
    whole = both.all(axis=1)
    if whole.any():
        out[whole] = np.percentile(away[whole], [50, 95, 100], axis=1).T
    for k in np.flatnonzero(~whole & both.any(axis=1)):
        out[k] = np.percentile(away[k][both[k]], [50, 95, 100])
    return out


def _fit(samples: int):
    """Column function of two packed paths: how the first lies on the second, in the better direction; null if no sample is in both."""

    def placed(path: pd.Series) -> np.ndarray:
        at = np.full((len(path), samples, 3), np.nan)
        rows = np.repeat(np.arange(len(path)), [len(s) for s in path])
        flat = np.concatenate([np.asarray(s, dtype=np.float64) for s in path]).reshape(-1, 4) if len(rows) else np.empty((0, 4))
        at[rows[::4], flat[:, 0].astype(np.int64)] = flat[:, 1:]
        return at

    @pandas_udf("reversed boolean, p50 double, p95 double, most double")
    def fit(path: pd.Series, reference: pd.Series) -> pd.DataFrame:
        parts = []
        for k in range(0, len(path), 1024):
            p, q = placed(path.iloc[k : k + 1024]), placed(reference.iloc[k : k + 1024])
            there, back = _fitted(p, q), _fitted(p[:, ::-1], q)
            turned = there[:, 1] - back[:, 1] > TIE * np.maximum(there[:, 1], 1.0)
            best = pd.DataFrame(np.where(turned[:, None], back, there), columns=["p50", "p95", "most"]).astype(object)
            best.insert(0, "reversed", pd.Series(turned, dtype=object))
            parts.append(best.mask(np.isnan(there[:, 1])[:, None] & np.ones((1, 4), bool), None))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["reversed", "p50", "p95", "most"])

    return fit


def traversals(traj: DataFrame, key: str, traversal: str, order: str) -> DataFrame:
    """``key, traversal, points, finite, length, first``: what makes a traversal usable; ``first`` marks a key's reference, the traversal it starts with."""
    w = W.partitionBy(key, traversal).orderBy(order)
    step = euclid([F.col(c) for c in AXES], [F.lag(c).over(w) for c in AXES])
    # null, NaN and infinite entries are no points; NaN isn't below infinity in Spark
    finite = reduce(lambda p, q: p & q, [F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) for c in AXES])
    each = traj.withColumn("_d", step).groupBy(key, traversal).agg(
        F.count(F.lit(1)).alias("points"), F.bool_and(finite).alias("finite"), F.coalesce(F.sum("_d"), F.lit(0.0)).alias("length"), F.min(order).alias("_o"))
    return each.withColumn("first", F.col("_o") == F.min("_o").over(W.partitionBy(key))).drop("_o")


def align_traversals(traj: DataFrame, key: str, traversal: str, order: str, samples: int = SAMPLES) -> DataFrame:
    """Each traversal of a key against the key's first, by the rigid transform (no scale) that fits best.

    Both are sampled at equal arc length; the candidate is taken forward and reversed, and the direction with the smaller
    95th percentile of the errors wins (a tie, to 1e-9: forward).  ``key, traversal, reference, reversed, p50, p95, most``; the last
    four are null, and ``error`` says why, where one of the two has fewer than two points, a point that isn't finite or no length.
    """
    known = traversals(traj, key, traversal, order)
    error = F.when(F.col("points") < 2, "fewer than two points").when(~F.col("finite"), "points that are not finite").when(F.col("length") <= 1e-9, "no length")
    known = stored(known.select(key, traversal, "first", error.alias("error")), "traversals")
    fine = traj.join(known.filter("error is null"), [key, traversal], "left_semi").select(key, traversal, order, *AXES)
    # a path is one row from here on: its samples' numbers and coordinates one after another
    sample = F.array(F.col("i").cast("double"), *AXES)
    points = resample_path(fine, [key, traversal], order, samples, AXES).groupBy(key, traversal).agg(F.flatten(F.collect_list(sample)).alias("_path"))
    points = stored(points, "samples")  # read as candidate and as reference
    reference = known.filter("first").select(key, F.col(traversal).alias("reference"), F.col("error").alias("_why"))
    pairs = known.filter("not first").select(key, traversal, "error").join(reference, key)
    target = points.select(key, F.col(traversal).alias("reference"), F.col("_path").alias("_onto"))
    met = points.join(pairs.filter("error is null and _why is null").select(key, traversal, "reference"), [key, traversal]).join(target, [key, "reference"])
    best = met.select(key, traversal, _fit(samples)("_path", "_onto").alias("b"))
    out = pairs.join(best, [key, traversal], "left")
    return out.select(key, traversal, "reference", "b.reversed", "b.p50", "b.p95", "b.most", F.coalesce("error", F.concat(F.lit("reference: "), "_why")).alias("error"))


def sensor_streams(events: DataFrame, key: str, stream: str, order: str, t: str = "t") -> DataFrame:
    """``key, stream, n, duration, rate, gap, monotonic`` of each sensor stream in its order of arrival; ``gap`` (the longest) is null for one event."""
    w = W.partitionBy(key, stream).orderBy(order)
    e = events.withColumn("_step", F.col(t) - F.lag(t).over(w))
    a = e.groupBy(key, stream).agg(
        F.count(F.lit(1)).alias("n"), (F.max_by(t, order) - F.min_by(t, order)).alias("duration"), F.max("_step").alias("gap"), F.coalesce(F.bool_and(F.col("_step") > 0), F.lit(True)).alias("monotonic"))
    return a.withColumn("rate", F.when(F.col("duration") > 0, (F.col("n") - 1) / F.col("duration")).otherwise(0.0))


def trajectory_acceptance(
    traj: DataFrame, key: str, traversal: str, order: str, sensors: DataFrame | None = None, required: tuple[str, ...] = SENSORS,
    least_duration: float = LEAST_DURATION, least_rate: float = LEAST_RATE, most_loop: float = MOST_LOOP, most_loop_deg: float = MOST_LOOP_DEG,
    most_p95: float = MOST_ALIGNED_P95, samples: int = SAMPLES,
) -> DataFrame:
    """``key, code, value, passed``: one row a check of each trajectory; ``key`` is accepted if all its rows pass.

    Repeated paths pass only if there is one, all could be aligned and the worst 95th percentile (``value``) is within the limit.
    ``sensors`` (``key, stream, n, duration, rate, gap, monotonic``) is judged where given: each required stream must be there,
    rise, and last long enough; ``value`` is the number of those that do.
    """
    a = loop_closure(traj, key, order)
    fits = align_traversals(traj, key, traversal, order, samples).groupBy(key).agg(F.count(F.lit(1)).alias("_pairs"), F.count("p95").alias("_fits"), F.max("p95").alias("_p95"))
    a = a.join(fits, key, "left")
    repeated = F.coalesce((F.col("_pairs") == F.col("_fits")) & (F.col("_p95") <= most_p95), F.lit(False))
    found: list[tuple[Column, Column]] = [
        (F.col("duration"), F.col("duration") >= least_duration), (F.col("rate"), F.col("rate") >= least_rate),
        (F.col("loop"), F.col("loop") <= most_loop), (F.col("loop_deg"), F.col("loop_deg") <= most_loop_deg), (F.col("_p95"), repeated),
    ]
    if sensors is not None:
        good = F.col("stream").isin(*required) & F.col("monotonic") & (F.col("duration") >= least_duration)
        a = a.join(sensors.groupBy(key).agg(F.count_if(good).alias("_good")), key, "left")
        n = F.coalesce("_good", F.lit(0))
        found.append((n.cast("double"), n == len(set(required))))
    checks = [F.struct(F.lit(code).alias("code"), v.alias("value"), ok.alias("passed")) for code, (v, ok) in zip(CODES, found)]
    return a.select(key, F.explode(F.array(*checks)).alias("c")).select(key, "c.*")
