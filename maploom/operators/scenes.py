"""Moving objects of a scene: six-state filters with a life cycle driven by sightings and by silence.

An object is a constant-velocity filter (position and velocity), box sizes and label shares.  Errors are alike on all axes, so the
filter's 6 x 6 covariance is three numbers (of position, of both, of velocity) times the unit matrix.
Its state changes with each sighting, and without one when it has been silent for a
while: occluded, then expired.  Those deadlines fire in time order between the sightings,
from the rows of a batch or from event-time timers of a stream, so both give the same rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maploom.sources.tables import dealt

#: ``seq``, ``track``: null where silence changed the state; ``reason``: why a sighting was refused.
SCENE_SCHEMA = (
    "key long, seq long, ns long, track long, object long, state string, observed boolean, x double, y double, z double, vx double, vy double, vz double, "
    "sx double, sy double, sz double, label string, share double, seen long, reason string"
)
COLUMNS = [c.strip().split(" ")[0] for c in SCENE_SCHEMA.split(",")]
DIGITS = 9


@dataclass(frozen=True)
class SceneRules:
    # fixed values: the defaults of the object layer
    acceleration: float = 1.0
    position: float = 0.15
    velocity: float = 2.0
    reach: float = 1.0
    moving_score: float = 0.55
    moving_speed: float = 0.20
    stable_speed: float = 0.08
    stable_s: float = 2.0
    stable_seen: int = 5
    occluded_s: float = 0.5
    expired_s: float = 5.0

    def __post_init__(self):
        if min(self.acceleration, self.position, self.velocity, self.reach, self.stable_s, self.occluded_s, self.expired_s) <= 0:
            raise ValueError("distances and durations must be positive")
        if self.stable_seen < 2 or self.expired_s <= self.occluded_s:
            raise ValueError("at least two stable sightings, and expiry after occlusion")


@dataclass
class Thing:
    number: int
    mean: list[float]  # position, velocity
    spread: tuple[float, float, float]  # of position, of position and velocity, of velocity, on each axis
    size: list[float]
    labels: dict[str, float]
    state: str
    seen_ns: int
    at_ns: int
    tracks: set[int] = field(default_factory=set)
    seen: int = 1
    stable_ns: int | None = None
    stable: int = 0


class Scene:
    """State machine of one scene; ``step`` takes a sighting, ``silence`` the passing of time."""

    schema = SCENE_SCHEMA

    def __init__(self, key: Any = None, **rules: Any):
        self.key, self.rules = key, SceneRules(**rules)
        self.things: dict[int, Thing] = {}
        self.of_track: dict[int, int] = {}
        self.made = 0
        self.due: list[tuple[int, int, str]] = []  # (ns, object, state), some of them out of date

    # -- time

    def _wait(self, t: Thing) -> None:
        for state, s in (("occluded", self.rules.occluded_s), ("expired", self.rules.expired_s)):
            heapq.heappush(self.due, (t.seen_ns + round(s * 1e9), t.number, state))

    def _live(self, ns: int, number: int, state: str) -> bool:
        t = self.things.get(number)
        return t is not None and ns == t.seen_ns + round((self.rules.occluded_s if state == "occluded" else self.rules.expired_s) * 1e9)

    def next_deadline(self) -> int | None:
        while self.due and not self._live(*self.due[0]):
            heapq.heappop(self.due)
        return self.due[0][0] if self.due else None

    def silence(self, until: int | None) -> list[tuple]:
        """What has come due up to ``until`` (all that is due, if None)."""
        out = []
        while (ns := self.next_deadline()) is not None and (until is None or ns <= until):
            _, number, state = heapq.heappop(self.due)
            t = self.things[number]
            self._predict(t, ns)
            t.state = state
            out.append(self._row(t, None, ns, None))
            if state == "expired":
                del self.things[number]
                for track in t.tracks:
                    if self.of_track.get(track) == number:
                        del self.of_track[track]
        return out

    def _predict(self, t: Thing, ns: int) -> None:
        dt = (ns - t.at_ns) / 1e9
        if dt <= 0:
            return
        m, (p, c, v), q = t.mean, t.spread, self.rules.acceleration**2
        t.mean = [m[0] + dt * m[3], m[1] + dt * m[4], m[2] + dt * m[5], *m[3:]]
        half = dt * dt / 2  # of an acceleration on each axis
        t.spread = (p + 2 * dt * c + dt * dt * v + half * half * q, c + dt * v + half * dt * q, v + dt * dt * q)
        t.at_ns = ns

    # -- sightings

    def step(self, r) -> list[tuple]:
        out = self.silence(r.ns)
        at, size = ([math.nan if v is None else float(v) for v in vs] for vs in ((r.x, r.y, r.z), (r.sx, r.sy, r.sz)))
        labels = {} if r.labels is None else {k: float(v) for k, v in (r.labels.items() if isinstance(r.labels, dict) else r.labels)}
        if not (all(map(math.isfinite, (*at, *size, r.std))) and r.std >= 0):
            return [*out, self._refuse(r, "not_finite")]
        error = float(r.std) * float(r.std)
        t = self._find(r, at, labels)
        if t is None:
            spread = (error + 1e-9, 0.0, self.rules.velocity**2)
            state = "dynamic" if r.motion >= self.rules.moving_score else "tentative"
            t = self.things[self.made] = Thing(self.made, [*at, 0.0, 0.0, 0.0], spread, size, labels, state, r.ns, r.ns)
            self.made += 1
        elif r.ns <= t.seen_ns:
            return [*out, self._refuse(r, "not_chronological")]
        else:
            self._update(t, r, at, size, labels, error)
        t.tracks.add(r.track)
        self.of_track[r.track] = t.number
        self._wait(t)
        return [*out, self._row(t, r.seq, r.ns, r.track)]

    def _find(self, r, at: list[float], labels: dict[str, float]) -> Thing | None:
        """The object of the sighting's track, else the nearest predicted one that can be the same."""
        if r.track in self.of_track:
            return self.things[self.of_track[r.track]]
        best, least = None, math.inf
        for t in self.things.values():
            if r.ns < t.seen_ns or (labels and t.labels and labels.keys().isdisjoint(t.labels)):
                continue
            m, dt = t.mean, max(0, r.ns - t.at_ns) / 1e9
            d = math.dist((m[0] + m[3] * dt, m[1] + m[4] * dt, m[2] + m[5] * dt), at)
            if d < least:  # the first of equals
                best, least = t, d
        return best if least <= self.rules.reach else None

    def _update(self, t: Thing, r, at: list[float], size: list[float], labels: dict[str, float], error: float) -> None:
        before, dt = t.mean[:3], (r.ns - t.seen_ns) / 1e9
        self._predict(t, r.ns)
        m, (p, c, v) = t.mean, t.spread
        gp, gv = p / (p + error + 1e-9), c / (p + error + 1e-9)  # gains of position and velocity
        away = [a - x for a, x in zip(at, m)]
        t.mean = [*[x + gp * d for x, d in zip(m, away)], *[x + gv * d for x, d in zip(m[3:], away)]]
        keep = 1 - gp
        t.spread = (keep * keep * p + gp * gp * error, keep * (c - gv * p) + gp * gv * error, v - 2 * gv * c + gv * gv * p + gv * gv * error)  # Joseph form
        if t.seen == 1 and dt > 0:  # a second sighting gives the first velocity
            t.mean[3:] = [(a - x) / dt for a, x in zip(at, before)]
            t.spread = (*t.spread[:2], (error + self.rules.position**2) / dt**2)
        t.size = [0.8 * a + 0.2 * b for a, b in zip(t.size, size)]
        mixed = {k: 0.8 * t.labels.get(k, 0.0) + 0.2 * labels.get(k, 0.0) for k in sorted(t.labels.keys() | labels.keys())}
        total = sum(mixed.values())
        t.labels = {k: v / total for k, v in mixed.items()} if total > 0 else mixed
        t.seen_ns, t.seen = r.ns, t.seen + 1
        speed = math.hypot(*t.mean[3:])
        if r.motion >= self.rules.moving_score or speed >= self.rules.moving_speed:
            t.state, t.stable_ns, t.stable = "dynamic", None, 0
        elif speed <= self.rules.stable_speed:
            t.stable_ns, t.stable = (r.ns, 1) if t.stable_ns is None else (t.stable_ns, t.stable + 1)
            long = (r.ns - t.stable_ns) / 1e9 >= self.rules.stable_s and t.stable >= self.rules.stable_seen
            t.state = "promoted_static" if long else "stationary_candidate"
        else:
            t.state = "tentative"

    # -- rows

    def _row(self, t: Thing, seq: int | None, ns: int, track: int | None) -> tuple:
        top = max(t.labels, key=lambda k: (t.labels[k], k), default=None)
        numbers = [round(v, DIGITS) for v in (*t.mean, *t.size)]
        return (self.key, seq, ns, track, t.number, t.state, seq is not None, *numbers, top, None if top is None else round(t.labels[top], DIGITS), t.seen, None)

    def _refuse(self, r, reason: str) -> tuple:
        return (self.key, r.seq, r.ns, r.track, None, None, True, *[None] * 9, None, None, None, reason)


def frame(rows: list[tuple]) -> pd.DataFrame:
    """Rows of a scene as a frame with nullable numbers."""
    out = pd.DataFrame(rows, columns=COLUMNS)
    return out.astype({c: "Int64" for c in ("seq", "track", "object", "seen")})


def replay_scenes(sightings: DataFrame, **rules: Any) -> DataFrame:
    """The rows of every scene (``key``) over its whole past, silence after the last sighting included.

    ``sightings``: ``key, seq, ns, track, x, y, z, std, sx, sy, sz, motion, labels`` (a map or null).  Scenes are independent, and one
    scene's sightings run in order (by ``ns``, then ``seq``).
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scene = None
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                if scene is None or scene.key != r.key:
                    out += scene.silence(None) if scene else []
                    scene = Scene(r.key, **rules)
                out += scene.step(r)
            yield frame(out)
        if scene is not None:
            yield frame(scene.silence(None))

    return dealt(sightings.filter("key is not null"), "key").sortWithinPartitions("key", "ns", "seq").mapInPandas(run, SCENE_SCHEMA)


def object_histories(rows: DataFrame) -> DataFrame:
    """One row an object: its life, from the rows of :func:`replay_scenes`."""
    by = F.struct("ns", F.coalesce("seq", F.lit(-1)))
    o = rows.filter("object is not null").groupBy("key", "object")
    seen = F.col("observed")
    return o.agg(
        F.min(F.when(seen, F.col("ns"))).alias("first_ns"), F.max(F.when(seen, F.col("ns"))).alias("last_ns"), F.count_if(seen).alias("seen"), F.countDistinct("track").alias("tracks"),
        F.count_if(F.col("state") == "occluded").alias("occlusions"), F.max(F.when(F.col("state") == "expired", F.col("ns"))).alias("expired_ns"),
        F.max_by(F.when(seen, F.col("state")), F.when(seen, by)).alias("last_seen_state"), F.max_by("state", by).alias("state"), F.max_by("label", by).alias("label"),
    )
