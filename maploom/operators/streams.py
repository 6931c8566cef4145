"""Ordered stream operators: each is a small state machine a key, run over a batch here and as a stream in ``streaming``."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from maploom.sources.tables import dealt

POSE_SCHEMA = "key long, seq long, accepted boolean, reason string"
KEYFRAME_SCHEMA = "key long, seq long, reason string, hard boolean"


class PoseGate:
    """Accepts poses whose time rises and that are sure enough; the last time moves on acceptance only."""

    schema = POSE_SCHEMA

    def __init__(self, key: Any = None, clock_jump: float = 2.0, gap: float = 0.5, std: float = 1.0):
        self.key, self.jump, self.gap, self.std = key, clock_jump * 1e9, gap * 1e9, std
        self.last: int | None = None
        self.revision: int | None = None

    def step(self, r) -> tuple:
        dt = None if self.last is None else r.ns - self.last
        if r.revision < 0:
            reason = "calibration_invalid"
        elif self.revision is not None and r.revision != self.revision:
            reason = "calibration_changed"
        elif dt is not None and dt <= 0:
            reason = "non_monotonic"
        elif dt is not None and dt > self.jump:
            reason = "clock_jump"
        elif r.std > self.std:
            reason = "position_uncertain"
        else:
            self.last, self.revision = r.ns, r.revision
            return (self.key, r.seq, True, "pose_gap" if dt is not None and dt > self.gap else None)
        return (self.key, r.seq, False, reason)


class KeyframeGate:
    """Keeps frames that moved, show something new, or are overdue, against the last kept frame."""

    schema = KEYFRAME_SCHEMA

    def __init__(self, key: Any = None, move: float = 0.06, turn: float = 5.0, hard_move: float = 0.15, hard_turn: float = 12.0, overdue: float = 1.5):
        self.key, self.move, self.turn, self.hard_move, self.hard_turn, self.overdue = key, move, turn, hard_move, hard_turn, overdue
        self.last: tuple | None = None

    def step(self, r) -> tuple:
        if self.last is None:
            reason, hard = "first", True
        else:
            ns, x, y, yaw = self.last
            d, a = float(np.hypot(r.x - x, r.y - y)), abs((r.yaw - yaw + 180) % 360 - 180)
            hard = d >= self.hard_move or a >= self.hard_turn
            reason = "pose_motion" if d >= self.move or a >= self.turn else "image_event" if r.content else "watchdog" if r.ns - ns >= self.overdue * 1e9 else "strict_duplicate"
        if reason != "strict_duplicate":
            self.last = (r.ns, r.x, r.y, r.yaw)
        return (self.key, r.seq, reason, bool(hard))


def replay(df: DataFrame, machine: type, **options: Any) -> DataFrame:
    """Run a state machine over each key's rows by time and sequence; the key is the parallel unit."""
    names = [c.split(" ")[0] for c in machine.schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = machine(int(pdf["key"].iloc[0]), **options)
        return pd.DataFrame([m.step(r) for r in pdf.sort_values(["ns", "seq"]).itertuples()], columns=names)

    return dealt(df, "key").groupBy("key").applyInPandas(run, machine.schema)


def admission_filter(df: DataFrame, revision: int, now: str, capacity: int, tick: str) -> DataFrame:
    """``seq, decision``: stale and expired rows go, then each tick keeps its ``capacity`` most valuable rows."""
    stale, late = F.col("revision") < revision, F.col("deadline") < F.col(now)
    d = df.withColumn("_why", F.when(stale, "stale_revision").when(late, "deadline_expired"))
    w = W.partitionBy(tick, F.col("_why").isNull()).orderBy(F.desc("value"), "us", "seq")
    d = d.withColumn("_r", F.row_number().over(w))
    low = F.when(F.col("value") == 0, "strict_duplicate").otherwise("lower_content_value")
    return d.select("seq", F.coalesce("_why", F.when(F.col("_r") > capacity, low), F.lit("admitted")).alias("decision"))


def best_pending(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by("seq", F.struct("revision", "area", "us", "seq")).alias("seq"), (F.count(F.lit(1)) - 1).alias("replaced"))


def merge_paths(points: DataFrame, near: float, overlap: float, ratio: float) -> DataFrame:
    """``map, path, merged, reversed``: each resampled path (``map, path, i, x, y``) joins the first it lies on, else starts its own.

    The paths of a map pass by in order, a row each; its task holds only those that others may join.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, n = (), 0
        kept = sizes = lengths = None
        names: list[int] = []
        for pdf in frames:
            out = []
            for m, path, xs, ys in pdf.itertuples(index=False):
                m = None if pd.isna(m) else int(m)
                p = np.column_stack([xs, ys])
                if at != (m,):
                    at, n, names = (m,), 0, []
                    kept, sizes, lengths = np.empty((64, *p.shape)), np.empty(64, dtype=np.int64), np.empty(64)
                length = np.linalg.norm(np.diff(p, axis=0), axis=1).sum()
                best = None
                for lo in range(0, n, 4096):
                    ql = lengths[lo : min(lo + 4096, n)]
                    some = lo + np.flatnonzero(np.minimum(length, ql) >= ratio * np.maximum(length, ql))
                    for flip, cand in ((False, p), (True, p[::-1])):
                        d = np.linalg.norm(cand - kept[some], axis=2)
                        mid = np.median(d, axis=1)
                        ok = np.flatnonzero(((d <= near).mean(axis=1) >= overlap) & (mid <= near))
                        if len(ok):
                            k = ok[np.argmin(mid[ok])]
                            best = min(best or (np.inf,), (mid[k], some[k], flip))  # of equals the older, then forward
                if best is None:
                    if n == len(kept):
                        kept, sizes, lengths = (np.concatenate([a, np.empty_like(a)]) for a in (kept, sizes, lengths))
                    kept[n], sizes[n], lengths[n] = p, 1, length
                    names.append(path)
                    n += 1
                    out.append((m, path, path, False))
                else:
                    _, k, flip = best
                    kept[k] += ((p[::-1] if flip else p) - kept[k]) / (sizes[k] + 1)
                    sizes[k] += 1
                    out.append((m, path, names[k], flip))
            yield pd.DataFrame(out, columns=["map", "path", "merged", "reversed"])

    at = F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("_p")
    packed = points.groupBy("map", "path").agg(at).select("map", "path", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))
    return dealt(packed, "map").sortWithinPartitions("map", "path").mapInPandas(run, "map long, path long, merged long, reversed boolean")


def telemetry_clean(df: DataFrame, numbers: list[str], required: list[str]) -> DataFrame:
    """NaN and infinite numbers become null; rows without an envelope field are marked."""
    for c in numbers:
        df = df.withColumn(c, F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)))
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    return df.withColumn("missing", F.array_join(missing, ","))
