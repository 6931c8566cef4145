"""Entities of a map from ordered observations, in time linear in the observations.

Entities lie in a grid of cells as wide as the merge distance, so an observation is
compared with those of 27 cells only.  An entity's place is the median of its
observations, kept by two heaps an axis.  All state lives in three mappings: plain dictionaries
in a batch, keyed state of a stream otherwise.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
from collections.abc import Iterator, MutableMapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from maploom.functions.geometry import apply_transform
from maploom.sources.tables import bounded, dealt

MERGE_SCHEMA = (
    "map long, seq long, session long, local long, us long, prior string, entity string, created boolean, x double, y double, z double, "
    "sx double, sy double, sz double, confidence double, name string, type string, label string, moved double"
)
COLUMNS = [c.strip().split(" ")[0] for c in MERGE_SCHEMA.split(",")]
#: Order of a map's observations; ties of ``seq`` are settled by what was seen.
ORDER = ["seq", "us", "session", "local", "x", "y", "z"]
#: Cells of a tile along an axis, as a power of two.
TILE = 3
NEIGHBOURS = list(itertools.product((-1, 0, 1), repeat=3))


class Median:
    """Running median: the lower half as a heap of negatives, the upper half as a heap."""

    def __init__(self):
        self.low: list[float] = []
        self.high: list[float] = []

    def add(self, x: float) -> None:
        heapq.heappush(self.high, -heapq.heappushpop(self.low, -x))
        if len(self.high) > len(self.low):
            heapq.heappush(self.low, -heapq.heappop(self.high))

    @property
    def value(self) -> float | None:
        if not self.low:
            return None
        return -self.low[0] if len(self.low) > len(self.high) else (self.high[0] - self.low[0]) / 2


class Entity:
    """One entity: names, place and size as medians, greatest confidence."""

    def __init__(self, number: int, id_: str, type_: str, name: str):
        self.number, self.id, self.type, self.name = number, id_, type_, name
        self.names = {name.casefold()}
        self.place = [Median() for _ in range(3)]
        self.size: list[Median] = []  # of those observations that have one
        self.at: tuple[float, float, float] | None = None
        self.confidence = 0.0


class EntityMap:
    """Replays one map's observations.

    Its state is three mappings: ``entities`` by number, ``tiles`` (blocks of cells, each a dictionary of the entities' numbers a cell) and
    ``locals``: a local id's entity and the times it was seen; ``locals["made"]`` counts the entities.
    """

    def __init__(self, map_id: int, distance: float, entities: MutableMapping | None = None, tiles: MutableMapping | None = None, locals_: MutableMapping | None = None):
        self.map_id, self.distance = map_id, distance
        self.entities, self.tiles, self.locals = (({} if m is None else m) for m in (entities, tiles, locals_))

    def _cell(self, at: tuple[float, float, float]) -> tuple[int, int, int]:
        return (math.floor(at[0] / self.distance), math.floor(at[1] / self.distance), math.floor(at[2] / self.distance))

    def _nearest(self, at: tuple[float, float, float], label: str, type_: str) -> int | None:
        best, found = self.distance, None
        x, y, z = self._cell(at)
        low, high = (x - 1 >> TILE, y - 1 >> TILE, z - 1 >> TILE), (x + 1 >> TILE, y + 1 >> TILE, z + 1 >> TILE)
        if low == high:
            tiles = [(self.tiles.get(low), NEIGHBOURS)]
        else:
            parts: dict[tuple, list] = {}
            for i, j, k in NEIGHBOURS:
                parts.setdefault((x + i >> TILE, y + j >> TILE, z + k >> TILE), []).append((i, j, k))
            tiles = [(self.tiles.get(where), steps) for where, steps in parts.items()]
        entities, dist = self.entities, math.dist
        for tile, steps in tiles:
            if not tile:
                continue
            get = tile.get
            for i, j, k in steps:
                for number in get((x + i, y + j, z + k), ()):
                    e = entities[number]
                    if e.type == type_ and (not label or label in e.names):
                        d = dist(e.at, at)
                        if d < best or (d == best and (found is None or number < found)):  # of equals the older
                            best, found = d, number
        return found

    def _place(self, e: Entity, at: tuple[float, float, float]) -> None:
        """Put an entity at the median of its observations; one that has none of its own lies at ``at``, where it was made."""
        if e.place[0].low:
            at = (e.place[0].value, e.place[1].value, e.place[2].value)
        elif e.at is not None:
            return
        if at == e.at:
            return
        old, new = None if e.at is None else self._cell(e.at), self._cell(at)
        e.at = at
        if old == new:
            return
        for cell in (old, new):
            if cell is None:
                continue
            where = (cell[0] >> TILE, cell[1] >> TILE, cell[2] >> TILE)
            tile = self.tiles.get(where) or {}
            numbers = tile.get(cell, ())
            tile[cell] = (*numbers, e.number) if cell is new else tuple(k for k in numbers if k != e.number)
            self.tiles[where] = tile

    def observe(self, r: Any) -> tuple:
        """The row of an observation."""
        before, e, created, label, switched = self.settle(r)
        size = [m.value for m in e.size] if e.size else (None, None, None)
        return (self.map_id, r.seq, r.session, r.local, r.us, before, e.id, created, *e.at, *size, e.confidence, e.name, e.type, label or None, switched)

    def settle(self, r: Any) -> tuple[str | None, Entity, bool, str, float | None]:
        """(the entity that the local id had, the entity it has now, whether that is new, the label, how far the local id switched)."""
        at = (float(r.x), float(r.y), float(r.z))
        label = (r.label or "").strip()
        local = (r.session, r.local)
        prior, times = self.locals.get(local) or (None, set())
        found, moved, mine = prior, None, None
        if prior is not None:
            mine = self.entities[prior]
            away = math.dist(mine.at, at)
            if away > self.distance:  # the local id switched to another thing
                found, moved = None, away
        if found is None:
            found = self._nearest(at, label.casefold(), r.type)
        created = found is None
        if created:
            found = self.locals.get("made") or 0
            self.locals["made"] = found + 1
            e = Entity(found, hashlib.sha256(f"{self.map_id}|{found}".encode()).hexdigest()[:16], r.type, label or "unknown")
        else:
            e = self.entities[found]
            if label:
                e.names.add(label.casefold())
        if r.us not in times:
            times.add(r.us)
            for m, c in zip(e.place, at):
                m.add(c)
            if r.sx == r.sx and r.sy == r.sy and r.sz == r.sz and None not in (r.sx, r.sy, r.sz):
                e.size = e.size or [Median() for _ in range(3)]
                for m, c in zip(e.size, (r.sx, r.sy, r.sz)):
                    m.add(float(c))
            e.confidence = max(e.confidence, float(r.confidence))
        elif created:
            e.confidence = float(r.confidence)
        self.locals[local] = (found, times)
        self._place(e, at)
        self.entities[found] = e
        before = None if mine is None else mine.id
        switched = moved if before is not None and before != e.id else None
        return before, e, created, label, switched


def completed(observations: DataFrame) -> DataFrame:
    """Observations with the columns that a replay reads; what a table leaves out has one session, one type, no size and confidence 1."""
    given = set(observations.columns)
    other = {"session": F.lit(0).cast("long"), "type": F.lit("object"), "sx": F.lit(None).cast("double"), "sy": F.lit(None).cast("double"), "sz": F.lit(None).cast("double"), "confidence": F.lit(1.0)}
    for c, v in other.items():
        observations = observations.withColumn(c, F.coalesce(F.col(c), v) if c in given and c not in ("sx", "sy", "sz") else F.col(c) if c in given else v)
    return observations.select("map", "seq", "session", "local", "us", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "sx", "sy", "sz", "confidence")], "label", "type")


def canonical_observations(observations: DataFrame, sessions: DataFrame) -> DataFrame:
    """Observations moved by their session's transform, with ``refused``: why one can't be merged.

    ``sessions``: ``session, status, transform`` (16 numbers by row).  Refused: an unknown or unregistered session, a
    place that isn't finite, a confidence outside 0 to 1, a size that isn't positive, no local id or time.
    """
    o = completed(observations).join(bounded(sessions.select("session", "status", "transform")), "session", "left")
    finite = lambda *cs: F.forall(F.array(*cs), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    sized = F.col("sx").isNull() & F.col("sy").isNull() & F.col("sz").isNull()
    why = (
        F.when(F.col("status").isNull(), "unknown_session").when(F.col("status") != "registered", "session_not_registered")
        .when(F.col("local").isNull() | F.coalesce(F.col("us") <= 0, F.lit(True)), "no_local_id_or_time").when(~finite("x", "y", "z"), "position_not_finite")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence_out_of_range").when(~sized & ~F.coalesce((F.col("sx") > 0) & (F.col("sy") > 0) & (F.col("sz") > 0), F.lit(False)), "size_not_positive")
    )
    moved = apply_transform(F.col("transform"), [F.col(c) for c in "xyz"])
    out = o.withColumn("refused", why)
    return out.select("map", "seq", "session", "local", "us", *[F.when(F.col("refused").isNull(), m).alias(c) for m, c in zip(moved, "xyz")], "sx", "sy", "sz", "confidence", "label", "type", "refused")


def merge_entities(observations: DataFrame, distance: float = 0.5) -> DataFrame:
    """Replay observations (``map, seq, local, us, x, y, z, label``; ``session, type, sx, sy, sz, confidence`` if given) in arrival order.

    An observation goes to the entity its local id has, if that is near; else to the
    nearest entity of its type with its label (any, if it has none); else it makes a new one.  ``x, y, z`` and ``sx, sy, sz`` are the entity's after it;
    ``moved`` is the distance at which a local id left its entity.  Maps run side by side, each in one task; see
    :func:`merge_entities_blocked` for one very large map.
    """

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = None
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                if m is None or m.map_id != r.map:
                    m = EntityMap(r.map, distance)
                out.append(m.observe(r))
            yield pd.DataFrame(out, columns=COLUMNS)

    o = dealt(completed(observations).filter("map is not null"), "map").sortWithinPartitions("map", *ORDER)
    return o.mapInPandas(replay, MERGE_SCHEMA)


SWEEP_SCHEMA = "distance double, action string, n long, entities long"


def replayed_actions(observations: DataFrame, distances: list[float]) -> DataFrame:
    """``distance, action, n, entities`` of each map: all distances are replayed while its observations pass by once."""

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, maps, seen = None, [], []
        total: dict[tuple[float, str], list[int]] = {}

        def close() -> None:
            for m, actions in zip(maps, seen):
                for action, (n, entities) in actions.items():
                    t = total.setdefault((m.distance, action), [0, 0])
                    t[0] += n
                    t[1] += len(entities)

        for pdf in frames:
            for r in pdf.itertuples():
                if not maps or at != r.map:
                    close()
                    at, maps, seen = r.map, [EntityMap(r.map, d) for d in distances], [{} for _ in distances]
                for m, actions in zip(maps, seen):
                    before, e, created, _, _ = m.settle(r)
                    action = ("create" if before is None else "split") if created else "merge" if before is None else "reuse" if before == e.id else "reassociate"
                    a = actions.get(action)
                    if a is None:
                        a = actions[action] = [0, set()]
                    a[0] += 1
                    a[1].add(e.number)
        close()
        yield pd.DataFrame([(*k, *v) for k, v in total.items()], columns=["distance", "action", "n", "entities"])

    o = dealt(completed(observations).filter("map is not null"), "map").sortWithinPartitions("map", *ORDER)
    return o.mapInPandas(replay, SWEEP_SCHEMA)


def merged_entities(merged: DataFrame) -> DataFrame:
    """One row an entity as it stands after all observations: names, place, size, confidence, and when it was made and last seen."""
    last = lambda c: F.max_by(c, "seq").alias(c)
    e = merged.groupBy("map", "entity").agg(
        F.min_by("name", "seq").alias("name"), F.min("type").alias("type"), *[last(c) for c in ("x", "y", "z", "sx", "sy", "sz", "confidence")], F.count(F.lit(1)).alias("n"),
        F.countDistinct("session", "local").alias("locals"), F.min("us").alias("created_us"), F.max_by("us", "seq").alias("updated_us"), F.sort_array(F.collect_set("label")).alias("_labels"),
    )
    return e.withColumn("aliases", F.array_join(F.filter("_labels", lambda x: x != F.col("name")), ",")).drop("_labels")


def merge_audit(merged: DataFrame) -> DataFrame:
    """The log of a replay: ``map, seq, us, entity, action, previous, moved``; created and observed versions, and switched local ids beside them."""
    version = F.when(F.col("created"), "entity_created").otherwise("entity_observed")
    entry = lambda action, previous, moved: F.struct(action.alias("action"), previous.alias("previous"), moved.alias("moved"))
    switched = entry(F.lit("local_track_reassociated"), F.col("prior"), F.col("moved"))
    entries = F.array(entry(version, F.lit(None).cast("string"), F.lit(None).cast("double")), F.when(F.col("moved").isNotNull(), switched))
    log = merged.select("map", "seq", "us", "entity", F.explode(F.array_compact(entries)).alias("e")).select("map", "seq", "us", "entity", "e.*")  # the replay runs once
    return log.withColumn("version", F.when(F.col("action") != "local_track_reassociated", F.row_number().over(W.partitionBy("map", "entity", F.col("action") == "local_track_reassociated").orderBy("seq"))))
