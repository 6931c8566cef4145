"""The merge stream's state: few blocks for a small map, and blocks of local ids that double."""

import random

import pandas as pd

from maploom.operators.merging import COLUMNS, EntityMap
from maploom.streaming.machines import MergeProcessor


class Map:
    def __init__(self):
        self.held, self.trips = {}, 0

    def getValue(self, key):
        self.trips += 1
        return self.held[key]

    def containsKey(self, key):
        self.trips += 1
        return key in self.held

    def updateValue(self, key, value):
        self.trips += 1
        self.held[key] = value

    def iterator(self):
        return iter(list(self.held.items()))


class Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class Handle:
    def __init__(self):
        self.maps, self.values = {}, {}

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, Map())

    def getValueState(self, name, *_):
        return self.values.setdefault(name, Value())


def rows(n, seed):
    r = random.Random(seed)
    d = [(1, k, 0, r.randrange(n), k, r.uniform(0, 40), r.uniform(0, 10), r.uniform(0, 8), None, None, None, 1.0, f"k{k % 3}", "object") for k in range(n)]
    return pd.DataFrame(d, columns="map seq session local us x y z sx sy sz confidence label type".split())


def run(batches):
    handle, out = Handle(), []
    for b in batches:
        p = MergeProcessor(4.0)
        p.init(handle)
        out += [tuple(r) for f in p.handleInputRows((1,), iter([b]), None) for r in f[COLUMNS].itertuples(index=False)]
    return out, handle


def same(a, b):
    return [tuple(None if x != x else x for x in r) for r in a] == [tuple(None if x != x else x for x in r) for r in pd.DataFrame(b, columns=COLUMNS).itertuples(index=False)]


def test_a_small_map_has_few_blocks():
    d = rows(60, 1)
    out, handle = run([d])
    m = EntityMap(1, 4.0)
    assert same(out, [m.observe(r) for r in d.itertuples()])
    assert sum(s.trips for s in handle.maps.values()) <= 12


def test_blocks_of_local_ids_double_and_lose_nothing():
    d = rows(3000, 2)
    out, handle = run([d[k : k + 150] for k in range(0, 3000, 150)])
    m = EntityMap(1, 4.0)
    assert same(out, [m.observe(r) for r in d.itertuples()])
    assert 16 <= len(handle.maps["locals"].held) <= 64


def test_no_row_class_a_map(monkeypatch):
    d, handle = rows(20, 3), Handle()
    monkeypatch.setattr(pd.DataFrame, "itertuples", lambda *a, **b: (_ for _ in ()).throw(AssertionError("a row class is made for each map")))
    p = MergeProcessor(4.0)
    p.init(handle)
    assert sum(len(f) for f in p.handleInputRows((1,), iter([d[10:], d[:10]]), None)) == 20
