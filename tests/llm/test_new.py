"""Whitening, prefix trie and the piece codec against plain versions."""

import hashlib
import json
import random
import zlib

import numpy as np
import pandas as pd
import pytest
import sentencepiece

from maploom.llm import jaccard, pieces, prefix_trie, queries, whitening

DIR = "/root/testdata/sf0.001"
EMPTY = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- trie


def slow_trie(rows):
    """rows: (conv_id, turn, role, text)"""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = own.get(c - int(np.fmod(c, 100)), [])
        built[c] = tuple(head[:h]) + tuple(turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for n in members:
        if n:
            children.setdefault(n[:-1], []).append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        below = children.get(n, [])
        leaves[n] = sum(leaves[m] for m in below) if below else 1
        saved[n] = (len(members[n]) - 1) * (len(n[-1][1]) if n else 0) + sum(saved[m] for m in below)
    out = []
    for n, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(n)))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children.get(n, [])), leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def trie(spark, rows):
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string, a int"))
    return sorted((tuple(r) for r in got.collect()), key=lambda r: (r[1], r[0]))


def test_trie_of_the_tables(spark):
    rows = pd.read_parquet(f"{DIR}/conversations.parquet")[["conv_id", "turn", "role", "text"]].values.tolist()
    got = queries.QUERIES["op12_conversation_prefix_trie"](spark, DIR)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: (r[1], r[0])) == slow_trie(rows)


def test_trie_of_odd_conversations(spark):
    rng = random.Random(4)
    rows = []
    for c in [*range(-130, 340), 10**12, 10**12 + 7]:
        if c in (0, 200):  # no head
            continue
        for t in range(rng.choice([0, 1, 2, 3, 7, 9, 20])):
            rows.append((c, rng.choice([None, t, t, 3]), rng.choice(["user", "assistant", None]), rng.choice(["", None, "hi", "hi", "long \U0001f600 text", "é"])))
    rows += [(100, t, "user", "same") for t in range(300)] + [(150, t, "user", "same") for t in range(280)]  # deeper than two levels of bands
    rows += [(None, 1, "user", "nowhere")] * 3 + rows[:40]
    rng.shuffle(rows)
    assert trie(spark, [(*r, "clash", 5) for r in rows]) == slow_trie(rows)


def test_trie_of_nothing(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "a", "b", "", 1)]) == []


def test_one_long_conversation_is_spread(spark):
    rows = [(5, t, "user", str(t % 7)) for t in range(4000)] + [(c, 0, "user", "x") for c in range(200, 260)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert trie(spark, [(*r, "", 0) for r in rows]) == slow_trie(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_subtree_sums_make_few_rows(spark):
    """A chain explodes to its band only."""
    n = 600
    paths = spark.range(n).selectExpr("1L as conv_id", "id as depth", "id as a", "-id as b")
    sums = prefix_trie.subtree_sums(paths, paths.selectExpr("*", "1L as v"), ["v"], n - 1)
    assert {r.a: r.v for r in sums.collect()} == {k: n - k for k in range(n)}


# ---------------------------------------------------------------- whitening


def slow_white(vectors, wanted=8):
    x = np.floor(np.array([v for _, v in vectors], dtype=np.float64) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    d = x - s / n
    v = d.T @ d / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:wanted], w[:, ::-1][:, :wanted].T
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return n, deviation, d @ w.T / np.sqrt(e), e / np.trace(v), w


def check_white(rows, vectors):
    n, deviation, white, share, _ = slow_white(vectors)
    k = white.shape[1]
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert got.keys() == {i for i, _ in vectors} and len(rows) == k * len(vectors)
    y = np.array([[got[i][c + 1].whitened for c in range(k)] for i, _ in vectors])
    sign = np.sign((y * white).sum(axis=0))
    assert np.abs(y - white * sign).max() < 1e-8
    for (i, _), dev in zip(vectors, deviation):
        for c in range(k):
            r = got[i][c + 1]
            assert (r.n, r.deviation) == (n, dev) and r.explained == pytest.approx(share[c], rel=1e-9)
            assert 0 <= r.identity_error < 1e-9


def test_whitening_of_the_tables(spark):
    e = pd.read_parquet(f"{DIR}/embeddings.parquet")
    got = queries.QUERIES["op11_embedding_whitening"](spark, DIR)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check_white(got.collect(), list(zip(e["vec_id"], e["embedding"])))


def whiten(spark, rows):
    return whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string, white int")).collect()


def test_whitening_leaves_out_what_it_cant_use(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(np.float32(x)) for x in rng.normal(size=3) * [1, 5, 0.1]]) for i in range(60)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 1.0, 1.0]), (103, [float("inf"), 1.0, 1.0]), (104, [1.0, 2.0]), (105, [])]
    check_white(whiten(spark, [(*r, "", 0) for r in good + bad]), good)


def test_whitening_without_variance_and_of_nothing(spark):
    assert whiten(spark, []) == [] and whiten(spark, [(1, None, "", 0)]) == []
    got = whiten(spark, [(i, [1.5, 2.0], "", 0) for i in range(4)])
    assert {(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(c, 4, 0, 0.0, 0.0, 0.0) for c in (1, 2)}
    got = whiten(spark, [(i, [float(i), 2.0], "", 0) for i in range(4)])
    assert {r.whitened for r in got if r.component == 2} == {0.0} and all(r.identity_error < 1e-12 for r in got)
    got = whiten(spark, [(1, [3e38, 1.0], "", 0), (2, [-3e38, 1.0], "", 0)])
    assert {r.deviation for r in got} == {None} and {int(r.deviation_exact) for r in got} == {(2 << 40) ** 2}


@pytest.mark.parametrize("eigenvalues", [np.arange(9.0), np.repeat([4.0, 1.0], 5), 2.0 ** -np.arange(30), np.zeros(4), [3.0], np.r_[5.0, np.zeros(7)], 1 + 1e-13 * np.arange(6)])
def test_components_are_eigenvectors(eigenvalues):
    e = np.array(eigenvalues)
    q = np.linalg.qr(np.random.default_rng(2).normal(size=(len(e), len(e))))[0]
    v = (q * e) @ q.T
    got, w = whitening.top_components((v + v.T) / 2, min(8, len(e)))
    assert np.abs(got - np.sort(e)[::-1][: len(got)]).max() <= 1e-14 * max(1, e.max()) and np.abs(w @ w.T - np.eye(len(w))).max() < 1e-13
    assert np.abs(v @ w.T - w.T * got).max() <= 2e-14 * max(1, e.max())


# ---------------------------------------------------------------- pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))


def coded(spark, texts):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids int, decoded string")
    return {r.doc_id: (r.ids, r.decoded) for r in pieces.decode_pieces(pieces.encode_pieces(df, path), path).collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_pieces_of_the_tables(spark, library):
    docs = pd.read_parquet(f"{DIR}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op13_sentencepiece_codec"](spark, DIR).collect()}
    want = {}
    for i, t in zip(docs["doc_id"], docs["text"]):
        ids = library.encode(t or "")
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    assert got == want


def test_pieces_of_odd_texts(spark, library):
    rng = random.Random(3)
    texts = [None, "", " ", "  ", " a", "a ", "a  b", "▁", "▁▁ a▁b", "\n\t x", "<s></s><unk><0x41>", "日本語", "ＡＢ", "é", "\x00", "\U0010ffff\U0001f600", " " * 1000, " " * 300 + "x", "-" * 900, "ab" * 700, "0 " * 50, "a b"]
    texts += ["".join(rng.choice(["a", "e", "h", "t", " ", "é", "▁", "the", "ing", "\n", "1", "日"]) for _ in range(rng.randint(0, 900))) for _ in range(300)]
    texts += ["".join(rng.choice("aething") for _ in range(rng.randint(250, 2000))) for _ in range(60)]
    texts += ["".join(rng.choice("abcxyzABC0189+/=") for _ in range(3000)) for _ in range(20)]
    got = coded(spark, texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "")
        assert got[i] == (ids, library.decode(ids)), repr(t)[:60]
    assert coded(spark, []) == {}


def test_pieces_of_long_texts(library):
    codec = pieces.PieceCodec(queries.tokenizer_path("piece_bpe_32k.model"))
    import pyarrow as pa

    rng = random.Random(5)
    for t in ("".join(rng.choices(["the", "cat", "on", "ther"], k=100_000)), "the cat sat " * 500_000, "".join(rng.choices("abcdefXYZ0123+/", k=6_000_000))):
        ids, n = codec.encode(pa.array([t]))
        assert codec.decode(ids, n) == [t]
        assert len(t) > 1_000_000 or ids.tolist() == library.encode(t)


def test_decoding_any_ids(spark, library):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    rng = random.Random(6)
    rows = [[rng.choice([rng.randrange(260), rng.randrange(32000)]) for _ in range(rng.randint(0, 12))] for _ in range(400)]
    df = spark.createDataFrame([(i, r, "x") for i, r in enumerate(rows)] + [(-1, None, "x"), (-2, [300, None], "x")], "doc_id long, ids array<int>, decoded string")
    got = {r.doc_id: r.decoded for r in pieces.decode_pieces(df, path).collect()}
    assert got.pop(-1) == "" and got.pop(-2) == library.decode([300])
    assert got == {i: library.decode(r) for i, r in enumerate(rows)}


def test_a_pair_that_opens_a_better_one(tmp_path):
    """A vocabulary whose later joins have better ranks than those that make them."""
    from sentencepiece import sentencepiece_model_pb2

    with open(queries.tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    keep = [p for p in proto.pieces if p.type != 1 or len(p.piece) == 1]
    del proto.pieces[:]
    proto.pieces.extend(keep)
    for k, p in enumerate(["aba", "ab", "abab", "bab", "ba", "aab", "▁a", "abb", "bb", "aa", "aabb"]):
        proto.pieces.add(piece=p, score=-float([3, 9, 1, 2, 8, 4, 7, 5, 6, 9, 0][k]), type=1)
    path = str(tmp_path / "own.model")
    with open(path, "wb") as f:
        f.write(proto.SerializeToString())
    library, codec = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceCodec(path)
    import pyarrow as pa

    rng = random.Random(7)
    texts = ["".join(rng.choice("ab" * 8 + " ") for _ in range(rng.randint(1, 40))) for _ in range(3000)] + ["".join(rng.choice("ab") for _ in range(rng.randint(300, 900))) for _ in range(60)]
    ids, n = codec.encode(pa.array(texts))
    got = np.split(ids, np.cumsum(n)[:-1])
    assert json.dumps([g.tolist() for g in got]) == json.dumps([library.encode(t) for t in texts])


# ---------------------------------------------------------------- decontamination


def test_repetitive_items_in_long_repetitive_texts(spark):
    import time

    from maploom.llm import decontaminate

    item = spark.createDataFrame([("z", "0 " * 20), ("y", "0 " * 13), ("x", "1 0 " * 9)], "item_id string, text string")
    took = []
    for n in (50_000, 200_000):
        docs = spark.createDataFrame([(1, "0 " * n), (2, "a " * n + "0 " * 12), (None, "0 " * 30), (4, "a " * 100 + "0 " * 13), (4, "1 0 " * 10), (5, None)], "doc_id long, text string")
        began = time.time()
        got = sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in decontaminate.contamination(docs, item).collect()), key=repr)
        took.append(time.time() - began)
        assert got == sorted([(1, n, n, ["y", "z"], True), (2, n + 12, 0, [], False), (None, 30, 0, [], False), (4, 113, 33, ["x", "y", "z"], True), (4, 20, 33, ["x", "y", "z"], True), (5, 0, 0, [], False)], key=repr)
    assert took[1] < 4 * took[0] + 10


# ---------------------------------------------------------------- urls


def test_no_url_sees_its_own_label(spark):
    """Where labels follow neither suffix nor form the fit is no better than the larger class; where they follow the form the trees find it."""
    from maploom.llm import urls

    mixed = [(k, f"https://x{k}.com/{'en' if k % 10 else 'de'}/{k}") for k in range(2000)]
    got = urls.judge(spark.createDataFrame(mixed, "page_id long, url string"), [("block", "com", "/en/"), ("allow", "com", "/de/")]).toPandas()
    fit = ((got["block_score"] >= 0.5) == (got["verdict"] == "block")).mean()
    assert 0.85 < fit < 1 and set(got["verdict"]) == {"block", "allow"}
    by_length = [(k, f"https://x{k % 7}.org/p/{'q' * (40 if k % 2 else 3)}") for k in range(1500)]
    rules = [("block", "org", "/p/" + "q" * 40), ("allow", "org", "/p/qqq")]
    judged = urls.judge(spark.createDataFrame([*by_length, (5000, "https://y.org/z/" + "q" * 40), (5001, "https://y.org/z/qqq")], "page_id long, url string"), rules)
    assert {r.page_id: r.verdict for r in judged.filter("rule is null").collect()} == {5000: "block", 5001: "allow"}


# ---------------------------------------------------------------- segments


def test_segments_of_the_same_sets_meet_once(spark, monkeypatch):
    rows = [(s, a, 8, 1, 2) for s in range(500) for a in (1, 2)]  # 500 segments of the sets 1 and 2
    rows += [(1000, a, 8, 1, 3) for a in (1, 2, 3)] + [(1001, a, 8, 1, 3) for a in (1, 2, 3)]  # other lists stay apart
    rows += [(2000, 1, 8, 1, 4), (2000, 1, 8, 1, 4), (2000, 2, 8, 1, 4)]  # a repeated entry is no other list
    shared = spark.createDataFrame(rows, "segment long, set_id long, bytes long, n_tiles int, sets long")
    got = jaccard._once(shared).toPandas()
    lists = sorted(tuple(sorted(g["set_id"])) for _, g in got.groupby("segment"))
    assert lists == [(1, 2), (1, 2, 3)]
    monkeypatch.setattr(jaccard, "LEAST_DEGREE", 1)  # all segments are long: none is left out
    assert jaccard._once(shared).select("segment").distinct().count() == 503


def test_two_long_near_copies_give_entries_that_dont_grow(spark, monkeypatch):
    seen = []
    once = jaccard._once
    monkeypatch.setattr(jaccard, "_once", lambda df: seen.append(once(df)) or seen[-1])
    for n in (2_000, 20_000):
        words = [str(i * 7919) for i in range(n)]
        other = [w + "x" if i % 400 == 0 else w for i, w in enumerate(words)]
        docs = spark.createDataFrame([(5, " ".join(words)), (9, " ".join(other)), (11, "a b c")], "doc_id long, text string")
        got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs, 3, 90).collect()}
        assert got == {5: 5, 9: 5, 11: 11}
    assert [df.count() for df in seen] == [2, 2]
