"""Streaming twins: the same state machines and rules over ``readStream`` tables.

Rows are put in event-time order inside a trigger; rows that come later than their key's
last processed time are for the machine to refuse (``non_monotonic``), as in the batch.
State lives in the RocksDB store; checkpoints make restarts exact.
"""

from __future__ import annotations

import ast
import pickle
from collections import namedtuple
from collections.abc import Callable, Iterator, MutableMapping
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from maploom.operators.merging import COLUMNS, MERGE_SCHEMA, ORDER, EntityMap, completed
from maploom.operators.scenes import SCENE_SCHEMA, Scene, frame

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class MachineProcessor(StatefulProcessor):
    """Keeps one state machine a key as bytes."""

    def __init__(self, machine: type, options: dict[str, Any]):
        self.machine, self.options = machine, options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("machine", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        m = pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else self.machine(int(key[0]), **self.options)
        pdf = pd.concat(list(rows)).sort_values(["ns", "seq"])
        out = [m.step(r) for r in pdf.itertuples()]
        self.state.update((pickle.dumps(m),))
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in self.machine.schema.split(", ")])

    def close(self) -> None:
        pass


def run_machine(stream: DataFrame, machine: type, **options: Any) -> DataFrame:
    """A state machine over a stream keyed by ``key``."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream.groupBy("key").transformWithStateInPandas(MachineProcessor(machine, options), machine.schema, "Update", "None")


class SceneProcessor(StatefulProcessor):
    """A scene a key; one event-time timer waits for its next deadline, so objects fall silent without a new row."""

    def __init__(self, rules: dict[str, Any]):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("scene", "data binary")

    def _scene(self, key) -> Scene:
        return pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else Scene(int(key[0]), **self.rules)

    def _keep(self, scene: Scene) -> None:
        self.state.update((pickle.dumps(scene),))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if (ns := scene.next_deadline()) is not None:
            self.handle.registerTimer(-(-ns // 1_000_000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        scene = self._scene(key)
        pdf = pd.concat(list(rows)).sort_values(["ns", "seq"])
        out = [row for r in pdf.itertuples() for row in scene.step(r)]
        self._keep(scene)
        yield frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        scene = self._scene(key)
        out = scene.silence(timerValues.getCurrentWatermarkInMs() * 1_000_000)  # what comes due after this timer, too
        self._keep(scene)
        yield frame(out)

    def close(self) -> None:
        pass


def scene_stream(stream: DataFrame, t: str, delay: str = "10 seconds", **rules: Any) -> DataFrame:
    """The rows of every scene over a stream of sightings; ``t``: their time (of ``ns``) as a timestamp.

    Rows are as in the batch (``replay_scenes``); those that silence makes come once the watermark passes their deadline.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream.withWatermark(t, delay).groupBy("key").transformWithStateInPandas(SceneProcessor(rules), SCENE_SCHEMA, "Append", "EventTime")


class Kept(MutableMapping):
    """Keyed map state as a mapping, in blocks of keys: a batch reads the blocks it asks for once, and writes back those it changed.

    ``block`` names a key's block; ``fresh``: nothing was kept so far, so nothing is looked up.
    """

    def __init__(self, state, block: Callable[[Any], Any], fresh: bool):
        self.state, self.block, self.fresh = state, block, fresh
        self.known: dict[Any, dict] = {}
        self.dirty: set = set()
        self.added = 0

    def _load(self, name: Any) -> dict:
        if name not in self.known:
            key = (repr(name),)
            self.known[name] = pickle.loads(bytes(self.state.getValue(key)[0])) if not self.fresh and self.state.containsKey(key) else {}
        return self.known[name]

    def get(self, key: Any, default: Any = None) -> Any:
        return self._load(self.block(key)).get(key, default)

    def __getitem__(self, key: Any) -> Any:
        found = self.get(key)
        if found is None:
            raise KeyError(key)
        return found

    def __setitem__(self, key: Any, value: Any) -> None:
        name = self.block(key)
        block = self._load(name)
        self.added += key not in block
        block[key] = value
        self.dirty.add(name)

    def deal(self, block: Callable[[Any], Any]) -> None:
        """Put all that is kept into other blocks; their names hold the old ones."""
        if not self.fresh:
            for (name,), (data,) in self.state.iterator():
                self.known.setdefault(ast.literal_eval(name), pickle.loads(bytes(data)))
        held, self.block, self.known = self.known, block, {}
        for part in held.values():
            for key, value in part.items():
                self.known.setdefault(block(key), {})[key] = value
        self.known |= {name: {} for name in held if name not in self.known}
        self.dirty = set(self.known)

    def flush(self) -> None:
        for name in self.dirty:
            self.state.updateValue((repr(name),), (pickle.dumps(self.known[name]),))
        self.known, self.dirty = {}, set()

    def __delitem__(self, key: Any) -> None:
        raise TypeError("entities are not taken back")

    def __iter__(self):
        raise TypeError("state is looked up by key")

    __len__ = __iter__


#: A row of `completed` observations; one class for all maps, as making one takes longer than a map's rows.
OBSERVED = namedtuple("OBSERVED", "map seq session local us x y z sx sy sz confidence label type")


class MergeProcessor(StatefulProcessor):
    """A map of entities a key; a batch reads and writes only the blocks of entities, tiles and local ids that its rows touch.

    Every block read or written is a round trip to the store, so a small map has few: blocks of local ids double as these become more.
    """

    #: Numbers of entities side by side in a block, and most local ids a block on average.
    ENTITIES = 64
    LOCALS = 64

    def __init__(self, distance: float):
        self.distance = distance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = [handle.getMapState(name, "name string", "data binary") for name in ("entities", "tiles", "locals")]
        self.size = handle.getValueState("size", "locals long, blocks long")

    @staticmethod
    def dealt(blocks: int) -> Callable[[Any], int]:
        return lambda local: 0 if local == "made" else (local[0] + local[1]) % blocks

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        size = self.size.get()
        fresh = size is None
        known, blocks = size or (0, 1)
        kept = [Kept(p, block, fresh) for p, block in zip(self.parts, (lambda number: number // self.ENTITIES, lambda tile: tile, self.dealt(blocks)))]
        m = EntityMap(int(key[0]), self.distance, *kept)
        frames = list(rows)
        pdf = pd.concat(frames) if len(frames) > 1 else frames[0]
        columns = {c: pdf[c].to_numpy() for c in OBSERVED._fields}
        order = np.lexsort([columns[c] for c in reversed(ORDER)])
        out = [m.observe(r) for r in map(OBSERVED._make, zip(*[v[order].tolist() for v in columns.values()]))]
        added, most = kept[2].added, blocks
        total = known + added
        while total > self.LOCALS * most:
            most *= 2
        if most > blocks:
            kept[2].deal(self.dealt(most))
        for k in kept:
            k.flush()
        if fresh or added:
            self.size.update((total, most))
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def merge_stream(stream: DataFrame, distance: float = 0.5) -> DataFrame:
    """``merge_entities`` over a stream of observations that arrive in order; rows of a trigger are put in order first."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return completed(stream).groupBy("map").transformWithStateInPandas(MergeProcessor(distance), MERGE_SCHEMA, "Append", "None")


def dedupe_operations(stream: DataFrame, op: str, t: str, delay: str = "10 seconds") -> DataFrame:
    """The first row of each operation id within the watermark."""
    return stream.withWatermark(t, delay).dropDuplicatesWithinWatermark([op])


def stage_metrics_stream(stream: DataFrame, t: str, size: str, delay: str = "10 seconds") -> DataFrame:
    """Counts and latency percentiles of each stage and tumbling window."""
    w = stream.withWatermark(t, delay).groupBy(F.window(t, size), "stage")
    return w.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("value", 0.5).alias("p50"), F.max("value").alias("max")).select("window.start", "stage", "n", "p50", "max")


def activity_sessions(df: DataFrame, key: str, t: str, gap: str, delay: str | None = None) -> DataFrame:
    """Sessions that close after a silent ``gap``; with ``delay`` for streams."""
    d = df.withWatermark(t, delay) if delay else df
    s = d.groupBy(F.session_window(t, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, "w.start", "w.end", "n")


def deliver(stream: DataFrame, consume: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand every micro-batch to a consumer; what fails is tried again on restart."""
    return stream.writeStream.foreachBatch(consume).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
