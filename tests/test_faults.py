"""Doses of faults against plain loops over the rows."""

import random
import statistics

import pytest

from maploom.operators import faults as FA


def _conflicts(rows):
    by_local, by_entity = {}, {}
    for local, entity in rows:
        by_local.setdefault(local, set()).add(entity)
        by_entity.setdefault(entity, set()).add(local)
    return len(by_local), len(by_entity), sum(len(s) > 1 for s in by_local.values()), sum(len(s) > 1 for s in by_entity.values())


@pytest.mark.parametrize("n", [300, 301])
def test_permuted_ids(spark, n):
    rng = random.Random(n)
    obs = []
    for _ in range(n):
        t = rng.randint(0, 11)
        obs.append((f"t{t}", f"e{t // 2}" if t < 8 else f"e{rng.randint(0, 3)}", rng.randint(1, 1000)))
    got = {r.dose: r for r in FA.permute_ids(spark.createDataFrame(obs, "local string, entity string, us long")).collect()}
    cut = int(statistics.median(o[2] for o in obs))
    entities = {}
    for local, entity, _ in obs:
        entities.setdefault(local, set()).add(entity)
    steady = sorted((x for x, e in entities.items() if len(e) == 1), key=lambda x: (-sum(o[0] == x for o in obs), x))
    base = _conflicts([o[:2] for o in obs])
    assert (got[0].local_ids, got[0].entities, got[0].local_conflicts, got[0].entity_splits, got[0].eligible, got[0].effect) == (*base, 0, 0)
    for dose in (1, 3, 5):
        new = {steady[0]: steady[0] + ":permuted"} if dose == 1 else {x: steady[(i + 1) % dose] for i, x in enumerate(steady[:dose])}
        hit = [o[2] > cut and o[0] in new for o in obs]
        c = _conflicts([(new[o[0]] if h else o[0], o[1]) for o, h in zip(obs, hit)])
        r = got[dose]
        assert (r.local_ids, r.entities, r.local_conflicts, r.entity_splits, r.eligible) == (*c, sum(hit))
        assert r.effect == c[2] + c[3] - base[2] - base[3] and r.detection_rate == 1.0 and r.passed


def test_too_few_tracks(spark):
    with pytest.raises(ValueError, match="no observations"):
        FA.permute_ids(spark.createDataFrame([], "local string, entity string, us long"))
    with pytest.raises(ValueError, match="5 are needed"):
        FA.permute_ids(spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], "local string, entity string, us long"))


def test_offsets_of_positions(spark):
    c = [("e", "n", 1, 1, True, 0.2, 0.3, 0.75, 0.15), ("e", "n", 1, 2, True, 0.7, 0.3, 0.75, 0.15), ("e", "m", 1, 3, True, 0.9, 0.0, 0.75, 0.15), ("f", "n", 2, 4, True, 0.3, 0.0, 0.75, 0.15),
         ("f", "k", 2, 5, False, 0.3, 0.0, 0.75, 0.15), ("f", None, 2, 6, True, 0.3, 0.0, 0.75, 0.15), ("g", "n", 3, 7, True, None, 0.0, 0.75, 0.15)]
    df = spark.createDataFrame(c, "entity string, node string, us long, seq long, accepted boolean, centre double, gap double, most_centre double, most_gap double")
    got = {r.dose: (r.eligible, r.rejected, r.detection_rate, r.passed) for r in FA.offset_positions(df, (0.05, 0.1, 0.3, 0.6)).collect()}
    # at 0.05 the centre 0.7 comes to just 0.75; a gap of 0 holds to a dose of 0.15, a centre of 0.3 to one of 0.45
    assert got == {0.05: (3, 0, 0.0, True), 0.1: (3, 1, 1.0, True), 0.3: (3, 2, 1.0, True), 0.6: (3, 3, 1.0, True)}


def test_offsets_of_times(spark):
    df = spark.createDataFrame([(10_000_000, 10_500_000), (20_000_000, 19_500_000)], "a_ns long, b_ns long")
    rows = FA.inject_time_offset(df, (0, 5)).collect()
    assert sorted((r.dose, r.b_ns, r.signed_ms, r.alarm) for r in rows) == [(0, 10_500_000, 0.5, False), (0, 19_500_000, -0.5, False), (5, 15_500_000, 5.5, True), (5, 24_500_000, 4.5, True)]
    assert [(r.dose, r.detection_rate, r.passed) for r in FA.time_offset_report(FA.inject_time_offset(df, (0, 5))).orderBy("dose").collect()] == [(0, 0.0, True), (5, 1.0, True)]
