"""The corpus operators against brute force, round trips and held-out accuracy, and their edge cases."""

import hashlib
import random
import re
import struct
import tracemalloc
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from maploom.llm import decontaminate, jaccard, langid, media, mixing, quality, substring, tokencount, tokenids, urls
from maploom.llm import queries as q
from maploom.llm.tables import components, read

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, tail string, hash long"
UP = {c: c + 32 for c in range(65, 91)}


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, text or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, extra columns with clashing names."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)] + ["É", "中文", "a,b", "ẞ"]
    line = " ".join(rng.choice(vocab) for _ in range(40))
    texts = [None, "", " \t\n", "one", line, line, line + " end", "x " * 5000, line.upper(), " ".join(rng.choice(vocab) for _ in range(300)), "\x1c  y", "<s> </s> <|endoftext|>  ", "😀 " * 30]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "s1", "s2", ""][i % 4], None, "t", 1) for i, t in enumerate(texts)]
    rows += [rows[4], (4, "other " * 20, None, None, None, None, None), (None, line, "en", None, 3, "t", 2), (-7, line + " tail", "en", "s1", 3, "t", 2)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return read(spark, DIR, "documents")


def brute_substring(rows, size=13):
    first, out = {}, []
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - size + 1):
            if i is not None:
                key = tuple(w[k : k + size])
                first[key] = min(first.get(key, i), i)
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


def brute_sets(rows, size):
    out = []
    for _, t in rows:
        w = words((t or "").translate(UP))
        out.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    return out


def brute_components(rows, size, percent):
    sets = brute_sets(rows, size)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x = len(sets[a] & sets[b])
            if rows[a][0] is not None and rows[b][0] is not None and x and 100 * x >= percent * (len(sets[a]) + len(sets[b]) - x):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, len(sets[k]), low.get(find(k)) if i is not None else None) for k, (i, _) in enumerate(rows)), key=repr)


def brute_contamination(rows, items, size=13):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = {}
    for i, t in items:
        w = words((t or "").translate(UP), pattern)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in rows:
        w = words((t or "").translate(UP), pattern)
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if m := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= m
        out.append((i, len(w), len(hit), len(found), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_substring_dedup(docs, odd, empty):
    for df in (docs, odd):
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in substring.remove_repeated(df).collect()), key=repr)
        assert got == brute_substring(pairs(df))
    assert substring.remove_repeated(empty).count() == 0


@pytest.mark.parametrize("percent", [30, 50, 60, 70, 100])
def test_sizes_that_may_be_linked_share_a_class(percent):
    plan = jaccard.SegmentPlan(percent)
    n = np.arange(1, 400)
    row, level = plan.levels(n)
    classes = [set(level[row == k]) for k in range(len(n))]
    own = [min(c) for c in classes]
    assert all(own[b] in classes[a] for a in range(len(n)) for b in range(a, len(n)) if n[b] * percent <= 100 * n[a])


@pytest.mark.parametrize("percent", [50, 60, 70])
def test_jaccard_of_sets_of_unlike_sizes(spark, percent):
    rng = random.Random(percent)
    rows = []
    for i in range(60):
        base = [f"g{i}_{k}" for k in range(rng.randrange(3, 90))]
        more = [f"m{i}_{k}" for k in range(rng.randrange(0, len(base)))]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + more))]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, percent).collect()), key=repr)
    assert got == brute_components(rows, 3, percent)


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80)])
def test_jaccard(docs, odd, empty, size, percent):
    for df in (docs, odd):
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, size, percent).collect()), key=repr)
        assert got == brute_components(pairs(df), size, percent)
    assert jaccard.jaccard_components(empty, size, percent).count() == 0


def test_jaccard_of_many_near_copies(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(700):  # more than one tile
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()), key=repr)
    assert got == brute_components(rows, 3, 90)


def meet(profiles, n_shingles):
    """Edges, and the most memory taken, of sets that all share one segment."""
    n = len(profiles)
    zero = pa.array(np.zeros(n, dtype=np.int32))
    batch = pa.RecordBatch.from_arrays([pa.array(np.full(n, 7)), zero, zero, zero, pa.array(np.arange(n)), pa.array(np.full(n, n_shingles)), pa.array(profiles, pa.binary())], names=["segment", "i", "j", "tile", "set_id", "n_shingles", "profile"])
    tracemalloc.start()
    edges = next(jaccard._meet(80)((0,), iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return sorted(zip(*(c.to_pylist() for c in edges.columns))), most


@pytest.mark.parametrize("n, width", [(3000, 16), (80, 1 << 15)])
def test_jaccard_memory_where_many_or_long_sets_meet(n, width):
    edges, most = meet([bytes([8]) * width] * n, 8 * width)
    assert edges == [(k, 0) for k in range(1, n)]
    assert most < 64 << 20


def test_jaccard_tiles_of_a_segment(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MEET_TILE", 32)
    sizes = spark.sparkContext.accumulator(0)

    def spy(percent, run=jaccard._meet(90)):
        def counted(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            batches = list(batches)
            meetings = Counter(x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("segment", "i", "j"))))
            sizes.add(sum(n > 3 * 64 for n in meetings.values()))
            return run(key, iter(batches))

        return counted

    monkeypatch.setattr(jaccard, "_meet", spy)
    rng = random.Random(6)
    rows = []
    for i in range(400):
        w = [f"c{i % 2}_{k}" for k in range(120)]
        w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()), key=repr)
    assert got == brute_components(rows, 3, 90)
    assert sizes.value == 0


def test_components_of_a_chain(spark):
    e = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components(e).collect()} == {0}


def test_decontamination(spark, docs, odd, empty):
    bench = read(spark, DIR, "benchmark")
    line = next(t for i, t in pairs(odd) if i == 5)
    more = spark.createDataFrame([(1, line[3:]), (2, "one"), (3, None), (4, ""), (5, line[3:]), (10, "É 中文")], "item_id long, text string")
    for df, items in ((docs, bench), (odd, more)):
        got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.item_ids, r.contaminated) for r in decontaminate.contamination(df, items).collect()]
        want = [(r.item_id, r.text) for r in items.collect()]
        seen = [r for r in pairs(df) if df is docs or r[0] not in (4, None)]  # repeated ids share hits
        assert sorted((g for g in got if df is docs or g[0] not in (4, None)), key=repr) == brute_contamination(seen, want)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_proximity(spark, odd):
    bench = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w4 w5 w6 w7 w8"), (3, "É one"), (4, "one"), (5, "absent w1"), (6, None)], "item_id long, text string")
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    for size, within in ((3, 5), (2, 2), (4, 9)):
        want = {}
        for i, t in {p for p in pairs(odd) if p[0] is not None}:
            w = words((t or "").translate(UP), pattern)
            spans = [set(w[k : k + within]) for k in range(max(len(w) - within + 1, 1))]
            for item, text in pairs(bench.withColumnRenamed("item_id", "doc_id")):
                x = words((text or "").translate(UP), pattern)
                n = min(size, len(x))
                found = {k for k in range(len(x) - n + 1 if n else 0) if any(set(x[k : k + n]) <= s for s in spans)}
                if found:
                    want.setdefault((i, str(item)), set()).update(found)
        got = {(r.doc_id, i): r.n_windows for r in decontaminate.near_items(odd, bench, size, within).collect() for i in r.item_ids}
        assert got == {k: len(v) for k, v in want.items()} and got


def test_token_counts(spark, docs, odd, empty):
    spm = pytest.importorskip("sentencepiece")
    path = q.tokenizer_path("piece_bpe_32k.model")
    lib = spm.SentencePieceProcessor(model_file=path)
    for df in (docs, odd):
        got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.token_counts(df, path).collect()), key=repr)
        want = [(i, len((t or "").encode()), n := len(lib.encode(t or "")), n > 4096) for i, t in pairs(df)]
        assert got == sorted(want, key=repr)
    assert tokencount.token_counts(empty, path).count() == 0


def test_transducer_scans_words_longer_than_a_chunk():
    spm = pytest.importorskip("sentencepiece")
    path = q.tokenizer_path("piece_bpe_32k.model")
    lib = spm.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    texts = ["".join(rng.choice("aabcdehinost é中<>_▁0123\n\t😀") for _ in range(rng.randrange(900))) for _ in range(80)] + ["ab" * 3000, "é" * 900, " " * 900, "a", "", "a" * 5000, "the" * 2000]
    machine = tokencount.Transducer(tokencount.PieceBpe(path), limit=2000)
    assert machine.count(texts).tolist() == [len(x) for x in lib.encode(texts)]
    assert machine.count(texts[:9]).tolist() == [len(x) for x in lib.encode(texts[:9])]  # after the table was emptied


def test_transducer_of_a_megabyte_without_a_word_start():
    spm = pytest.importorskip("sentencepiece")
    path = q.tokenizer_path("piece_bpe_32k.model")
    lib = spm.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    machine = tokencount.Transducer(tokencount.PieceBpe(path))
    for text in ("".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/", k=1 << 20)), "".join(rng.choices("中文字的一是不了人我", k=200_000)), "a" * (1 << 20)):
        assert machine.count([text]).tolist() == [len(lib.encode(text))]


def test_token_ids(spark, docs, odd, empty):
    from tokenizers import Tokenizer

    path = q.tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    for df in (docs, odd):
        blocks = tokenids.write_token_ids(df, path, 2)
        got = sorted(tokenids.verified_token_ids(blocks).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == sorted([i for i, _ in pairs(df)], key=lambda i: (i is not None, i or 0))
        ids = [[*lib.encode(t or "", add_special_tokens=False).ids, 2] for _, t in pairs(df)]
        want = sorted(((i, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for (i, _), x in zip(pairs(df), ids)), key=repr)
        assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == want
        assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert tokenids.verified_token_ids(tokenids.write_token_ids(empty, path, 2)).count() == 0


def test_token_ids_are_found_by_id(spark, odd, monkeypatch):
    from tokenizers import Tokenizer

    path = q.tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    monkeypatch.setattr(tokenids, "BLOCK_IDS", 40)
    blocks = tokenids.write_token_ids(odd, path, 2)
    whole = sorted((r.doc_id, r.start, bytes(r.ids)) for r in tokenids.read_token_ids(blocks).collect() if r.doc_id is not None)
    ids = sorted({i for i, _, _ in whole})
    got = sorted((r.doc_id, r.start, bytes(r.ids)) for r in tokenids.look_up(blocks, [*ids, 99, -8]).collect())
    assert got == whole
    assert sorted(x for _, _, x in got) == sorted(struct.pack(f"<{len(x)}I", *x) for i, t in pairs(odd) if i is not None for x in [[*lib.encode(t or "", add_special_tokens=False).ids, 2]])


def test_encoder_of_any_text():
    path = q.tokenizer_path("byte_bpe_50k.json")
    encoder = tokenids.Encoder(path)
    rng = random.Random(1)
    parts = ["a", "b", "the", "Ne", "1", "22", "'s", "'t", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\u2003", "\u3000", "\x1c", "\x85", "é", "中", "😀", ".", ",", "<|endoftext|>", "_", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(4000)]
    texts += [" ".join(rng.choice(["foo", "bar", "x.", "\nq", "été,"]) for _ in range(rng.randrange(30))) for _ in range(1000)] + ["\nfoo", "foo\n", "\n", "", " a", "a ", "x" * 5000, " \n "]
    for k in range(0, len(texts), 700):  # later slices meet known pieces
        ids, counts = encoder.encode(pa.array(texts[k : k + 700]), 2)
        want = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts[k : k + 700]]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, step in ((1, 1), (1000, 2), (1000, 5000), (5, 10**6), (3000, 1)):
        v = np.cumsum(rng.integers(0, step + 1, n))
        ef = tokenids.EliasFano.of(v)
        assert ef.values().tolist() == v.tolist()
        assert [ef.select(i) for i in range(n)] == v.tolist()
        at = rng.integers(0, n, 50)
        assert ef.select_many(at).tolist() == v[at].tolist()
        assert all(ef.first_at_least(int(x)) == np.searchsorted(v, x) for x in v[at])
        assert sum(map(len, ef.parts()[1:])) <= n * (np.log2(max(v[-1] / n, 1)) + 4) / 8 + 40


def test_mixing(docs, odd, empty):
    for df in (docs, odd):
        rows = mixing.mix(df).collect()
        size, target, taken = {}, {}, {}
        for r in rows:
            size[r.source] = size.get(r.source, 0) + r.size
            taken[r.source] = taken.get(r.source, 0) + r.taken
            target[r.source] = r.target
            assert 0 <= r.taken <= 2 * r.size
        assert sorted((r.doc_id, r.size) for r in rows if r.doc_id is not None) == sorted((i, len(words(t))) for i, t in pairs(df) if i is not None)
        names = sorted(size, key=lambda s: (s is None, s or ""))
        w = dict(zip(names, [3, 1, 2] * len(names)))
        full, total = set(), 1.5 * sum(size.values())
        while True:
            level = (total - sum(2 * size[s] for s in full)) / max(sum(w[s] for s in names if s not in full), 1e-9)
            over = {s for s in names if s not in full and level * w[s] > 2 * size[s]}
            if not over:
                break
            full |= over
        for s in names:
            want = 2 * size[s] if s in full else level * w[s]
            assert target[s] == pytest.approx(want) and abs(taken[s] - want) <= mixing.BLOCK
        assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(df).collect()))
    assert mixing.mix(empty).count() == 0


def test_mixing_of_many_shards(spark, docs, monkeypatch):
    """Sources of many shards, in groups of a few, come near their targets too."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", 2000)
    monkeypatch.setattr(mixing, "FAN", 4)
    taken, target = {}, {}
    for r in mixing.mix(docs).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - target[s]) <= mixing.BLOCK + 0.01 * target[s] for s in target)


def test_sainte_lague_against_one_seat_at_a_time(spark):
    rng = random.Random(8)
    votes = [rng.randrange(0, 1000) for _ in range(23)]
    df = spark.createDataFrame([("g", i, float(v), 157) for i, v in enumerate(votes)], "g string, k long, v double, seats long")
    got = {r.k: r.won for r in mixing.sainte_lague(df, ["g"], "k", "v", "seats").collect()}
    won = [0] * len(votes)
    for _ in range(157):
        won[max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))] += 1
    assert got == dict(enumerate(won))


def test_media(docs, odd, empty):
    for df in (docs, odd):
        got = sorted(((r.doc_id, *r[1:]) for r in media.media_columns(df).collect()), key=repr)
        want = []
        for i, t in pairs(df):
            p = media.payload(t)
            want.append((i, *media.describe_media(len((t or "").encode()), media.wav_header(len(p)), p)))
        assert got == sorted(want, key=repr)
        assert all(r[3] == hashlib.sha256(media.payload(t)).hexdigest() for r, t in [(next(g for g in got if g[0] == i), t) for i, t in pairs(df) if i == 9])
    assert media.media_columns(empty).count() == 0


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    a, b = passage, rng.integers(0, 256, 777, dtype=np.uint8).tobytes() + passage
    parts = [{media.digest(p[x:y]) for x, y in zip([0, *e[:-1]], e)} for p, e in zip((a, b), media.cuts([a, b]))]
    assert len(parts[0] & parts[1]) >= 0.7 * len(parts[0])
    assert [e[-1] for e in media.cuts([a, b, b"x" * 64])] == [len(a), len(b), 64]


def test_urls(spark):
    rules = q.URL_RULES
    cases = ["http://a.com/en/1", "http://www.example.com/en/7x", "HTTP://EXAMPLE.COM/en/7", "https://x.net/de/1", "https://b.example.net/de/81?x=1", "http://o.org/es/#z", "http://ocom/en/", "no scheme", "", None, "http://", "http://h?p=1", "x\nhttp://q.org/es/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)] * 2, "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judge(pages, rules).collect()}
    assert [got[i].rule for i in range(13)] == ["com/en/", "example.com/en/7", "example.com/en/7", "net/de/", "example.net/de/8", "org/es/", None, None, None, None, None, None, "org/es/"]
    assert [got[i].verdict for i in range(6)] == ["block", "allow", "allow", "allow", "block", "block"]
    assert (got[2].host, got[2].path, got[9].host, got[11].host, got[11].path) == ("example.com", "/en/7", "", "h", "")
    assert urls.judge(pages.limit(0), rules).count() == 0
    seen = urls.judge(read(spark, "/root/testdata/sf0.01", "pages"), rules).filter("rule is null")
    rate = {r["s"]: r["b"] for r in seen.groupBy(F.regexp_extract("host", r"[^.]*\z", 0).alias("s")).agg(F.avg((F.col("verdict") == "block").cast("double")).alias("b")).collect()}
    assert rate["net"] < min(rate["com"], 1.0)


def test_quality(spark, docs, odd, empty):
    labels = read(spark, "/root/testdata/sf0.01", "labels")
    big = read(spark, "/root/testdata/sf0.01", "documents")
    got = quality.quality_scores(big, labels).join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").collect()
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.97
    rows = quality.quality_scores(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality_scores(empty, labels).count() == 0
    assert {r.score for r in quality.quality_scores(odd, labels.limit(0)).collect()} == {0.5}


def test_language(spark, odd, empty):
    big = read(spark, "/root/testdata/sf0.01", "documents")
    got = langid.identify(big).join(big.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.97
    rows = {r.doc_id: r for r in langid.identify(odd).collect()}
    assert [rows[i].lang_pred for i in (0, 1, 2, 12)] == ["und"] * 4 and all(0 <= r.score <= 1 for r in rows.values())
    assert langid.identify(empty).count() == 0


def slow_bayes(learned, text, smoothing=0.5):
    """(best language, its posterior), from n-gram counts kept in dictionaries."""
    def grams(t):
        code = np.array([ord(c) for c in t.lower()], dtype=np.uint32)
        return Counter(np.flatnonzero(langid.ngram_counts(code, np.zeros(len(code), dtype=np.int64), 1)[0]).tolist()), langid.ngram_counts(code, np.zeros(len(code), dtype=np.int64), 1)[0]

    margins = {}
    for lang in sorted({x for _, x in learned}):
        total = sum(grams(t)[1] for t, x in learned if x == lang) + smoothing
        rows = sum(x == lang for _, x in learned)
        margins[lang] = np.log(rows / len(learned)) + float(grams(text)[1] @ np.log(total / total.sum()))
    best = max(sorted(margins), key=margins.get)
    return best, 1 / sum(np.exp(m - margins[best]) for m in margins.values())


@pytest.mark.parametrize("page", [500, 2])
def test_language_against_a_slow_form(spark, monkeypatch, page):
    monkeypatch.setattr(langid, "PAGE", page)
    texts = ["the house ΟΔΟΣ", "das Haus", "la maison", "the of and", "der die das", "le la les", "ΟΔΟΣ", "½ ² ①", "a house", "et la"]
    rows = [(i, t, ["en", "de", "fr", "el", None][i % 5]) for i, t in enumerate(texts * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learned = [(t, x) for i, t, x in rows if x is not None and zlib.crc32(str(i).encode()) % 5 != 0]
    for r in langid.identify(df).collect():
        text = texts[r.doc_id % 10]
        want = slow_bayes(learned, text) if any(map(str.isalpha, text)) else ("und", 0.0)
        assert r.lang_pred == want[0] and r.score == pytest.approx(want[1])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_pipeline(spark):
    docs, before = read(spark, DIR, "documents"), None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, DIR)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if k in (0, 1, 2):
            assert before is None or docs.count() <= before
        before = docs.count()
    assert sorted(r.start for r in docs.collect())[0] == 0
    assert corpus_pipeline.run(spark, DIR).count() == before


def test_pipeline_stages_of_odd_rows(spark, odd, empty):
    for df in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, df, DIR).count() <= 2 * df.count()


@pytest.fixture(scope="module")
def unlike(spark, odd):
    """Repeated and null ids with unlike texts, near copies under the same id, and rows that repeat whole."""
    base = [f"u{k}" for k in range(80)]
    texts = [" ".join(base), " ".join([*base[:-1], "x"]), "a text of its own that is nobody's copy " * 3, " ".join(reversed(base)), None]
    rows = [(i, t, "en", "s1", 1, "t", 2) for i, t in [(3, texts[0]), (4, texts[0]), (4, texts[2]), (4, texts[1]), (None, texts[3]), (None, texts[3]), (None, texts[0]), (9, texts[3]), (9, None), (9, None)]]
    return spark.createDataFrame(rows, DOCS).unionByName(odd)


def bag(rows):
    return Counter((r.doc_id, r.text) for r in rows)


def test_stages_against_brute_force(spark, unlike):
    stages = dict(corpus_pipeline.STAGES)
    rows = unlike.collect()
    # quality: the ensemble's own weights, row by row
    model = quality.fit_quality(unlike, read(spark, DIR, "labels"))
    rules = [r for r, _ in model.weighted]
    margin = model.base + quality.holds(rules, quality.statistics([r.text for r in rows])) @ np.array([w for _, w in model.weighted])
    assert bag(stages["quality classifier"](spark, unlike, DIR).collect()) == bag(r for r, m in zip(rows, margin) if m >= 0)
    # near duplicates: the smallest id of each group of rows
    plain = sorted({(r.doc_id, r.text) for r in rows}, key=repr)
    group = {k: c for k, _, c in brute_components([(k, t) for k, (_, t) in enumerate(plain)], 5, 80)}
    groups = {}
    for k, (i, t) in enumerate(plain):
        groups.setdefault(group[k], []).append((i is None, i or 0, t))
    kept = bag(stages["n-gram jaccard join"](spark, unlike, DIR).collect())
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    for members in groups.values():
        mine = [(i is None, i or 0, t) for i, t in kept if (i is None, i or 0, t) in members]
        assert len(mine) == 1 and mine[0][:2] == min(m[:2] for m in members)
    # decontamination: by each row's own text
    items = [(r.item_id, r.text) for r in read(spark, DIR, "benchmark").collect()]
    more = spark.createDataFrame([(4, items[0][1], "en", "s1", 1, "t", 2), (None, items[1][1], "en", "s1", 1, "t", 2)], DOCS)
    both = unlike.unionByName(more)
    judged = [(r, brute_contamination([(0, r.text)], items)[0][-1]) for r in both.collect()]
    assert sum(c for _, c in judged) >= 2
    assert bag(stages["benchmark decontamination"](spark, both, DIR).collect()) == bag(r for r, c in judged if not c)
    # mixing: each row as often as the mix takes it, up or down to a whole number
    taken = {}
    for r in mixing.mix(corpus_pipeline._keyed(unlike)).collect():
        taken.setdefault(r.doc_id, []).append(r.taken / r.size if r.size else 1)
    keyed = unlike.withColumn("key", corpus_pipeline._key()).collect()
    drawn = bag(stages["source mixing"](spark, unlike, DIR).collect())
    for r in keyed:
        same = sum((x.doc_id, x.text) == (r.doc_id, r.text) for x in keyed)
        assert np.floor(np.mean(taken[r.key])) <= drawn[r.doc_id, r.text] / same <= np.ceil(np.mean(taken[r.key]))
    # token ids: the library's
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(q.tokenizer_path("byte_bpe_50k.json"))
    got = Counter((r.doc_id, r.n_tokens) for r in stages["token id output"](spark, unlike, DIR).collect())
    assert got == Counter((r.doc_id, len(lib.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in rows)


def test_rule_ensemble_as_a_column(spark):
    docs = read(spark, DIR, "documents")
    model = quality.fit_quality(docs, read(spark, DIR, "labels"))
    rows = docs.select("doc_id", "text").collect()
    margin = model.base + quality.holds([r for r, _ in model.weighted], quality.statistics([r.text for r in rows])) @ np.array([w for _, w in model.weighted])
    want = {r.doc_id: 1 / (1 + np.exp(-m)) for r, m in zip(rows, margin)}
    assert model.weighted and {r.doc_id: r.score for r in quality.score(docs, model).collect()} == pytest.approx(want)


def test_urls_against_a_slow_matcher(spark):
    pages = read(spark, DIR, "pages").select("page_id", "url", F.lit("x").alias("rule"), F.lit("y").alias("verdict"), F.lit(2.0).alias("block_score"))
    long = spark.createDataFrame([(-1, "http://a.net/de/" + "x?" * 500_000, "x", "y", 2.0), (None, None, None, None, None)], "page_id long, url string, rule string, verdict string, block_score double")
    for r in urls.judge(pages.unionByName(long), q.URL_RULES).collect():
        host = path = ""
        if "://" in (r.url or ""):
            rest = r.url.split("://", 1)[1]
            host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
            host = host.translate(UP)
        fits = [(len(h + p), h + p, v) for v, h, p in q.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict == (best[2] if best else ("block" if r.block_score >= 0.5 else "allow")) and 0 <= r.block_score <= 1


def test_compiled_trees_against_the_learners(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    df = spark.range(400).select("id", *[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(50)) / 7.0).alias(f) for k, f in enumerate(urls.FEATURES)])
    df = df.withColumn("label", (F.col("depth") + F.col("entropy") > 7).cast("double"))
    rows = VectorAssembler(inputCols=urls.FEATURES, outputCol="features").transform(df)
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(rows)
    got = urls.tree_score(model.transform(rows), model).select("block_score", vector_to_array("probability")[1].alias("p")).collect()
    assert [r.block_score for r in got] == pytest.approx([r.p for r in got])


def test_joins_of_hot_keys(spark, monkeypatch):
    from maploom.llm import tables

    monkeypatch.setattr(tables, "LEAST_DEGREE", 10)
    big = spark.range(500).select(F.when(F.col("id") < 300, 1).when(F.col("id") < 400, 2).otherwise(F.col("id")).alias("k"), "id")
    side = spark.range(450).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = sorted(big.join(side, "k").collect())
    assert sorted(tables.join_hot(big, side, "k", 500, 20).select("k", "id", "v").collect()) == want
    assert sorted(tables.join_salted(big, side, "k", "inner").select("k", "id", "v").collect()) == want
    star = spark.range(1, 200).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).union(spark.range(300, 400).select(F.col("id").alias("a"), F.lit(250).cast("long").alias("b")))
    assert {(r.node, r.component) for r in components(star).collect()} == {(k, 0) for k in range(200)} | {(k, 250) for k in [250, *range(300, 400)]}
