"""Pairs of near copies: vectors travel as lists, and of a crowd only the best of each end go on."""

import math
from collections import Counter

import numpy as np

from maploom.operators import retrieval as R


def _bags(rng, crowd, single):
    base = [f"w{i}" for i in range(60)]
    rows = [(7 * i, [w if rng.random() > 0.08 else f"x{rng.integers(40)}" for w in base]) for i in range(crowd)]
    rows += [(100_000 + i, [f"y{w}" for w in rng.integers(0, 400, 30)]) for i in range(single)]
    rows += [(200_000 + i, rows[i][1]) for i in range(12)]  # copies
    return rows + [(300_000, []), (300_001, None), (0, ["w1", "again"])]  # the last: an item in two rows


def _brute(rows, apart, k, least):
    bags = {}
    for i, words in rows:
        if words:
            bags.setdefault(i, Counter()).update(words)
    df = Counter(w for b in bags.values() for w in b)
    vec = {i: {w: n * (math.log((len(bags) + 1) / (df[w] + 1)) + 1) for w, n in b.items()} for i, b in bags.items()}
    length = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vec.items()}
    near, score = {}, {}
    for a in bags:
        for b in bags:
            if b >= a + apart:
                s = sum(x * vec[b].get(w, 0.0) for w, x in vec[a].items()) / length[a] / length[b]
                if s >= least:
                    score[a, b] = s
                    near.setdefault(a, []).append((-round(s, 9), b))
                    near.setdefault(b, []).append((-round(s, 9), a))
    return {(min(i, o), max(i, o)): score[min(i, o), max(i, o)] for i, v in near.items() for _, o in sorted(v)[:k]}


def test_crowd_of_near_copies_leaves_few_pairs(spark, monkeypatch):
    rows = _bags(np.random.default_rng(5), 240, 60)
    kept, plain = {}, R.stored

    def seen(df, label):
        out = plain(df, label)
        kept[label] = out.count()
        return out

    monkeypatch.setattr(R, "stored", seen)
    bags = spark.createDataFrame(rows, "item long, words array<string>")
    got = {(r.a, r.b): r.score for r in R.retrieve_pairs(R.word_vectors(bags), 5, 3, 0.6).collect()}
    want = _brute(rows, 5, 3, 0.6)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    assert 0 < kept["similar"] < 10_000  # 28 680 pairs of the crowd


def test_best_of_ends_holds_the_best_with_ties(spark):
    rng = np.random.default_rng(6)
    a, b = np.triu_indices(60, 1)
    score = rng.choice([0.8, 0.9, 0.9 + 2e-10, 0.9000000005, 0.95], len(a))
    kept = set(zip(a[k := R._best_of_ends(a, b, score, 4)], b[k]))
    for i in range(60):
        mine = sorted((-round(s, 9), y if x == i else x, x, y) for x, y, s in zip(a, b, score) if i in (x, y))
        assert {m[2:] for m in mine[:4]} <= kept
    assert len(kept) < len(a)


def test_word_vectors_are_those_of_tfidf(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = _bags(np.random.default_rng(7), 30, 30)
    bags = spark.createDataFrame(rows, "item long, words array<string>")
    want = {(r.item, r.h): r.weight for r in R.tfidf(bags.select("item", F.explode("words").alias("word"))).withColumn("h", F.xxhash64("word")).collect()}
    got = [(r.item, w, x) for r in R.word_vectors(bags).collect() for w, x in zip(r.words, r.weights)]
    assert {g[:2] for g in got} == want.keys() and len(got) == len(want)
    assert all(abs(x - want[i, w]) < 1e-12 for i, w, x in got)
