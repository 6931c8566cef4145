"""N-gram Jaccard join: groups of documents whose shingle sets nearly agree.

Method: a sparse matrix product of the document by n-gram incidence matrix,
done only inside blocks that can hold a linked pair.

1. Each text becomes a set of hashed shingles.  Equal sets collapse to the
   document with the smallest id, so a group of copies costs one row.
2. Blocks.  If two sets are similar enough, few elements differ: at most
   ``(|A| + |B|) (1 - t) / (1 + t)``.  Sets of about one size are cut into more
   segments than that by shingle hash, so at least one segment is equal in both.
   Sets that share the hash of a segment meet, tile by tile where they are many, and of segments with the same
   sets only one is used (so two long near copies meet once, not at each segment); those whose profiles (shingle counts
   by hash region) differ by more than the bound part again, the others fall into
   one block.  No linked pair is lost.
3. Inside a block, rows are taken in tiles of ``TILE`` sets.  For each pair of
   tiles the incidence matrices are multiplied over blocks of columns and the
   overlap counts added up; pairs whose overlap is under the bound that their
   sizes demand are discarded.  Only a spanning forest of the links leaves the
   task, never the pairs.
4. Connected components of the links give the classes.

Null or empty text: empty set, never linked.  Null ``doc_id``: the row is kept,
counted and never linked (``component_id`` null).  Repeated ids: rows are kept, each
is judged by its own text.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from maploom.llm import sketch
from maploom.llm import wordhash as wh
from maploom.llm.tables import LEAST_DEGREE, components, join_small, stored

#: Sets of one side of a block product.
TILE = 512
#: Columns of the incidence matrix multiplied at once.
COLUMNS = 4096
#: Rows (some 40 bytes each) up to which a side is broadcast.
BROADCAST_ROWS = 500_000
#: Entries, and bytes of their profiles, whose sets meet in one group of a task.
MEET_ROWS = 60_000
MEET_BYTES = 64 << 20
#: Entries, and bytes of their profiles, of one tile of a segment.
MEET_TILE = 2048
MEET_TILE_BYTES = 8 << 20
#: Segments of very many sets, whose rows are joined by broadcast.
HOT_SEGMENTS = 100_000
#: Segments gathered in a task before their sketch is sent on.
SKETCH_SEGMENTS = 1_500_000
#: Segments looked up at once.
SEGMENTS = 300_000
#: Differences of profiles held at once.
CELLS = 1 << 21
_STEP = 1.35


class SegmentPlan:
    """Into how many segments the sets of a size class are cut.

    ``spare`` segments more than the most elements that may differ, plus one:
    so more than ``spare`` segments agree, and sets with at most ``spare`` thin
    segments (too few elements to tell documents apart) need not emit those.
    """

    def __init__(self, percent: int):
        if not 1 <= percent <= 100:
            raise ValueError("percent must be from 1 to 100")
        self.percent = percent
        lows = [1]
        first = -(-(100 + percent) // (2 * (100 - percent))) if percent < 100 else 1 << 40  # smallest size at which an element may differ
        low = max(first, 2)
        while low < 1 << 40:
            lows.append(low)
            low = max(low + 1, int(np.ceil(low * _STEP)))
        self.low = np.array(lows, dtype=np.int64)
        high = np.append(self.low[1:] - 1, 1 << 40)
        differ = 2 * high * (100 - percent) // (100 + percent)
        self.thin = 1 if percent >= 88 else 0
        self.spare = np.zeros(len(differ), dtype=np.int64)
        for i, (n, k) in enumerate(zip(self.low, differ)):
            if k:
                m = k + 3
                for _ in range(3):
                    lam = n / m
                    mean = m * np.exp(-lam) * (1 + lam * self.thin)
                    m = k + 3 + int(np.ceil(mean + 2 * np.sqrt(mean)))
                self.spare[i] = m - k - 1
        self.segments = differ + 1 + self.spare

    def levels(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, class) for the class of each size, and each further class where a similar larger set may lie."""
        own = np.searchsorted(self.low, n, side="right") - 1
        reach = np.searchsorted(self.low, n * 100 // self.percent, side="right") - 1
        many = np.where(n > 0, np.maximum(reach, own) - own + 1, 0)
        rows = np.repeat(np.arange(len(n)), many)
        return rows, own[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)


def shingle_sets(words: wh.Words, size: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash) pairs sorted by document, then hash; each pair once."""
    hashes = wh.word_hashes(words, seed)
    counts = words.counts()
    docs, values = [], []
    for k in range(1, size + 1):
        if k < size and not (counts == k).any():
            continue
        first, value = wh.window_hashes(words, hashes, k, seed + k)
        doc = words.doc[first]
        if k < size:  # short texts: the whole sequence is one shingle
            keep = counts[doc] == k
            doc, value = doc[keep], value[keep]
        docs.append(doc)
        values.append(value)
    doc, value = np.concatenate(docs), np.concatenate(values)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[fresh], value[fresh]


def _sums(key: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """Sum of uint64 values by key, modulo 2**64."""
    low = np.bincount(key, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=size)
    high = np.bincount(key, weights=(value >> np.uint64(32)).astype(np.float64), minlength=size)
    return low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))


def set_ids(doc: np.ndarray, value: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One int64 per document that depends on its set alone."""
    total = _sums(doc, wh.mix64(value ^ np.uint64(0xD6E8FEB86659FD93)), len(n))
    return wh.mix64(total + n.astype(np.uint64)).view(np.int64)


def segment_hashes(plan: SegmentPlan, doc: np.ndarray, value: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the segments that a document emits, sorted by document."""
    rows, level = plan.levels(n)
    order = np.argsort(rows, kind="stable")
    rows, level = rows[order], level[order]
    segments = plan.segments[level]
    base = np.concatenate([[0], np.cumsum(segments)])
    starts = np.concatenate([[0], np.cumsum(n)])[:-1]
    take = np.repeat(starts[rows] - np.concatenate([[0], np.cumsum(n[rows])[:-1]]), n[rows]) + np.arange(n[rows].sum())
    picked = wh.mix64(value[take] + np.uint64(0x9E3779B97F4A7C15))
    owner = np.repeat(np.arange(len(rows)), n[rows])
    key = base[owner] + ((picked >> np.uint64(33)) % segments[owner].astype(np.uint64)).astype(np.int64)
    count = np.bincount(key, minlength=base[-1])
    total = _sums(key, wh.mix64(picked ^ np.uint64(0x5851F42D4C957F2D)), base[-1])
    owner = np.repeat(np.arange(len(rows)), segments)
    number = np.arange(base[-1]) - base[owner]
    out = wh.mix64(total + wh.mix64((level[owner].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64)))
    thin = count <= plan.thin
    many = np.bincount(owner, weights=thin, minlength=len(rows)) > plan.spare[level]
    keep = ~thin | many[owner] | (plan.segments[level] == 1)[owner]
    return rows[owner[keep]], out[keep]


def profiles(doc: np.ndarray, value: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Per document, how many of its shingles fall into each region of the hash space (one byte a region, 255 at most).

    There are some eight shingles a region.  The summed differences of two profiles are
    never more than the number of elements in which the sets differ.
    """
    power = np.maximum(3, np.ceil(np.log2(np.maximum(n, 1) / 8)).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(1 << power)])
    region = wh.mix64(value ^ np.uint64(0xA0761D6478BD642F)) >> (np.uint64(64) - power[doc].astype(np.uint64))
    count = np.minimum(np.bincount(base[doc] + region.astype(np.int64), minlength=base[-1]), 255).astype(np.uint8)
    return [count[a:b].tobytes() for a, b in zip(base[:-1], base[1:])]


def _fold(rows: list[bytes], width: int) -> np.ndarray:
    return np.array([np.frombuffer(r, dtype=np.uint8).reshape(width, -1).sum(axis=1, dtype=np.int32) for r in rows])


def alike(rows: list[bytes], n: np.ndarray, percent: int, cut: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that the profiles don't rule out, block by block; with ``cut``, only pairs of a row before it and one from it on."""
    width = min(map(len, rows))
    p = _fold(rows, width)
    end = len(rows) if cut is None else cut
    for i in range(0, end, 64):
        x = slice(i, min(i + 64, end))
        for j in range(i if cut is None else cut, len(rows), 512):
            y = slice(j, j + 512)
            apart = np.zeros((len(p[x]), len(p[y])), dtype=np.int64)
            step = max(1, CELLS // apart.size)
            for k in range(0, width, step):
                part = p[x, None, k : k + step] - p[None, y, k : k + step]
                apart += np.abs(part, out=part).sum(axis=2)
            a, b = np.nonzero(apart * (100 + percent) <= (n[x, None] + n[None, y]) * (100 - percent))
            a, b = a + i, b + j
            yield a[a < b], b[a < b]


def _meet(percent: int):
    """Entries of some segments, or of tiles of them -> edges that connect what pairs with like profiles connect."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        segment, i, j, tile, ids, n = (t.column(c).to_numpy() for c in ("segment", "i", "j", "tile", "set_id", "n_shingles"))
        rows = t.column("profile").to_pylist()
        order = np.lexsort((tile, j, i, segment))
        other = [np.diff(c[order]) != 0 for c in (segment, i, j)]
        edges: list[np.ndarray] = []
        done: set[tuple[int, int]] = set()
        for group in np.split(order, np.flatnonzero(other[0] | other[1] | other[2]) + 1):
            if len(group) == 2:
                x, y = sorted(ids[group].tolist())
                if (x, y) in done:
                    continue
                done.add((x, y))
            cut = int((tile[group] == i[group]).sum()) if i[group[0]] < j[group[0]] else None
            # a forest of each block of pairs, and then of the group: the pairs are never held together
            found = [np.column_stack(forest(ids[group[a]], ids[group[b]])) for a, b in alike([rows[k] for k in group], n[group], percent, cut) if len(a)]
            if len(found) > 1:
                found = [np.column_stack(forest(*np.concatenate(found).T))]
            edges += found
        both = np.unique(np.concatenate(edges), axis=0) if edges else np.zeros((0, 2), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return run


_DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.LongType()),
    T.StructField("profile", T.BinaryType()), T.StructField("segments", T.ArrayType(T.LongType(), False)),
])


def _describe(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = SegmentPlan(percent)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for words in wh.slices(texts, "space", lower=True):
                doc, value = shingle_sets(words, size)
                n = np.bincount(doc, minlength=words.n_docs).astype(np.int64)
                whole = set_ids(doc, value, n)
                owner, segment = segment_hashes(plan, doc, value, n)
                # copies within the slice: only the first emits
                _, first = np.unique(whole, return_index=True)
                once = np.zeros(words.n_docs, dtype=bool)
                once[first] = True
                segment, owner = segment[once[owner]], owner[once[owner]]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=words.n_docs))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(words.first_doc, words.n_docs), pa.array(n),
                    pa.array(whole, mask=n == 0), pa.array(profiles(doc, value, n), pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(segment.view(np.int64))),
                ], names=_DOC_SCHEMA.names)

    return run


def _segments(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[np.ndarray, ...]]:
    """(segment hashes, and each one's values of the named columns), some ``SEGMENTS`` at a time."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values, cut = lists.values.to_numpy(), 0
        while cut < len(lists):
            to = max(cut + 1, int(np.searchsorted(offsets, offsets[cut] + SEGMENTS, side="right")) - 1)
            owner = np.repeat(np.arange(cut, to), np.diff(offsets[cut : to + 1]))
            yield values[offsets[cut] : offsets[to]].view(np.uint64), *(batch.column(c).to_numpy()[owner] for c in names)
            cut = to


def _sketch(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for (h,) in _segments(batches):
            held.append(h.copy())
            if sum(map(len, held)) >= SKETCH_SEGMENTS:
                yield from sketch.emit(np.concatenate(held), bits)
                held = []
        if held:
            yield from sketch.emit(np.concatenate(held), bits)

    return run


def _suspects(bits: int, table):
    """set_id, bytes, segments -> the segments that may occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, set_id, size in _segments(batches, "set_id", "bytes"):
            keep = sketch.suspects(h, table.value, bits)
            yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(set_id[keep]), pa.array(size[keep])], names=["segment", "set_id", "bytes"])

    return run


def _pack(size: int):
    """doc_id, text, ... -> the packed shingle set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for words in wh.slices(texts, "space", lower=True):
                doc, value = shingle_sets(words, size)
                n = np.bincount(doc, minlength=words.n_docs)
                parts = np.split(value, np.cumsum(n)[:-1])
                part = batch.slice(words.first_doc, words.n_docs)
                packed = pa.array([p.tobytes() for p in parts], pa.binary())
                out = pa.RecordBatch.from_arrays([part.column("set_id"), part.column("block"), part.column("n_tiles"), packed], names=["set_id", "block", "n_tiles", "shingles"])
                # a repeated id may bring another text along
                yield out.filter(pa.array(set_ids(doc, value, n) == part.column("set_id").to_numpy()))

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with ``100 |A ∩ B| >= percent |A ∪ B|``, by blocked products of the incidence matrices."""
    sets = left + right
    n = np.array([len(s) for s in sets], dtype=np.int64)
    column, inverse, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    shared = seen[inverse] > 1
    live = np.bincount(row[shared], minlength=len(sets)) * 100 >= percent * n  # else no partner can overlap enough
    keep = shared & live[row]
    row, inverse = row[keep], inverse[keep]
    used, inverse = np.unique(inverse, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    row, inverse = row[order], inverse[order]
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    at_left, at_right = np.flatnonzero(live[: len(left)]), np.flatnonzero(live[len(left) :])
    if len(at_left) and len(at_right):
        place = np.full(len(sets), -1)
        place[at_left] = np.arange(len(at_left))
        place[at_right + len(left)] = np.arange(len(at_right))
        part = np.zeros((len(at_left), len(at_right)), dtype=np.float32)
        for begin in range(0, len(used), COLUMNS):
            lo, hi = np.searchsorted(inverse, [begin, begin + COLUMNS])
            r, c = row[lo:hi], inverse[lo:hi] - begin
            is_left = r < len(left)
            a = np.zeros((len(at_left), COLUMNS), dtype=np.float32)
            b = np.zeros((len(at_right), COLUMNS), dtype=np.float32)
            a[place[r[is_left]], c[is_left]] = 1
            b[place[r[~is_left]], c[~is_left]] = 1
            part += a @ b.T
        total[np.ix_(at_left, at_right)] = part
    both = total.astype(np.int64)
    union = n[: len(left), None] + n[None, len(left) :] - both
    return np.nonzero((both > 0) & (100 * both >= percent * union))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its tree) that connect what the edges a-b connect."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _multiply(percent: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("set_id")
        sets = [np.frombuffer(x, dtype=np.uint64) for x in pdf["shingles"]]
        ids, tile = pdf["set_id"].to_numpy(), pdf["tile"].to_numpy()
        at_left, at_right = np.flatnonzero(tile == key[1]), np.flatnonzero(tile == key[2])
        if not len(at_left) or not len(at_right):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        i, j = overlaps([sets[k] for k in at_left], [sets[k] for k in at_right], percent)
        a, b = ids[at_left[i]], ids[at_right[j]]
        a, b = forest(a[a != b], b[a != b])
        return pd.DataFrame({"a": a, "b": b})

    return run


def _once(shared: DataFrame) -> DataFrame:
    """``segment, set_id, bytes, n_tiles``: of the segments that have the same sets, one.

    Two long texts that nearly agree share a segment for each few words; their sets need to meet once.  Segments
    of more than ``LEAST_DEGREE`` entries are all kept, so no row holds more sets than that.
    """
    long = F.col("sets") > LEAST_DEGREE
    each = shared.groupBy("segment", F.when(long, F.col("set_id")).alias("one"))
    lists = each.agg(F.sort_array(F.collect_set(F.struct("set_id", "bytes"))).alias("sets_of"), F.max("n_tiles").alias("n_tiles"))
    alone = F.when(F.col("one").isNotNull(), F.col("segment"))
    same = lists.groupBy(F.xxhash64(alone, "sets_of").alias("h1"), F.xxhash64(F.lit(7), alone, "sets_of").alias("h2"))
    kept = same.agg(F.min("segment").alias("segment"), F.first("sets_of").alias("sets_of"), F.max("n_tiles").alias("n_tiles"))
    return kept.select("segment", F.explode("sets_of").alias("s"), "n_tiles").select("segment", "s.set_id", "s.bytes", "n_tiles")


def jaccard_links(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(documents with ``doc_id, n_shingles, set_id``, links ``a, b`` between set ids).

    The links connect exactly the sets that chains of pairs with
    ``100 |A ∩ B| >= percent |A ∪ B|`` connect.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = stored(docs.mapInArrow(_describe(size, percent), _DOC_SCHEMA), "shingles")
    members = described.select("doc_id", "n_shingles", "set_id")

    # segments that two or more different sets share; their sets meet by segment, and profiles rule out most
    # (a segment of many sets, or of long ones, is cut into tiles and these meet two by two).  A sketch first drops
    # what can't occur twice; what is left is counted with partial sums, so a segment of very many sets is no hot key
    total = described.agg(F.coalesce(F.sum(F.size("segments").cast("long")), F.lit(0))).first()[0]
    bits = sketch.bits_for(total)
    lists = described.select("set_id", F.octet_length("profile").cast("long").alias("bytes"), "segments").filter("set_id is not null")
    table = docs.sparkSession.sparkContext.broadcast(sketch.repeated_cells(lists.select("segments").mapInArrow(_sketch(bits), sketch.COLUMNS), bits))
    suspect = stored(lists.mapInArrow(_suspects(bits, table), "segment long, set_id long, bytes long"), "suspects")
    met = suspect.groupBy("segment").agg(F.min("set_id").alias("least"), F.max("set_id").alias("most"), F.count(F.lit(1)).alias("sets"), F.sum("bytes").alias("all")).filter("least < most")
    n_tiles = F.ceil(F.greatest(F.col("sets") / MEET_TILE, F.col("all") / MEET_TILE_BYTES)).cast("int")
    met = stored(met.select("segment", "sets", n_tiles.alias("n_tiles")), "segments")
    # segments of very many sets (at most HOT_SEGMENTS of them) come to the sets' rows, all others meet by shuffle
    often = F.col("sets") > F.lit(max(LEAST_DEGREE, total // HOT_SEGMENTS))
    hot, cold = met.filter(often).select("segment", "n_tiles"), met.filter(~often).hint("merge")
    shared = _once(suspect.join(F.broadcast(hot.select("segment")), "segment", "left_anti").join(cold, "segment"))
    entries = stored(shared.unionByName(suspect.join(F.broadcast(hot), "segment").distinct()), "entries")
    rows, held = entries.agg(F.coalesce(F.sum("n_tiles"), F.lit(0)), F.coalesce(F.sum(F.col("n_tiles") * F.col("bytes")), F.lit(0))).first()
    parts = max(16, rows // MEET_ROWS, held // MEET_BYTES)
    sets = described.select("set_id", "n_shingles", "profile").filter("set_id is not null").join(entries.select("set_id").distinct(), "set_id", "left_semi").dropDuplicates(["set_id"])
    met = entries.join(sets, "set_id").withColumn("tile", F.pmod(F.xxhash64("set_id", "segment"), F.col("n_tiles")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)))
    met = met.select("segment", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "set_id", "n_shingles", "profile")
    met = met.withColumn("part", F.pmod(F.xxhash64("segment", "i", "j"), F.lit(parts)))
    stars = stored(met.groupBy("part").applyInArrow(_meet(percent), "a long, b long").distinct(), "stars")
    block = components(stars)

    # the document that stands for each set of a block, with the tiles of its block
    blocks = stored(block.select(F.col("node").alias("set_id"), F.col("component").alias("block")), "blocks")
    sized = blocks.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("n_tiles"))
    blocks = blocks.join(sized, "block")
    stands = join_small(members.filter("doc_id is not null"), blocks, "set_id", "inner", BROADCAST_ROWS)
    stands = stored(stands.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("block").alias("block"), F.first("n_tiles").alias("n_tiles")), "stands")
    with_text = join_small(docs, stands, "doc_id", "inner", BROADCAST_ROWS).select("set_id", "block", "n_tiles", "text")
    packed = with_text.mapInArrow(_pack(size), "set_id long, block long, n_tiles int, shingles binary")
    tiled = packed.withColumn("tile", F.pmod(F.xxhash64("set_id"), F.col("n_tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)))
    tiled = tiled.select("block", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "set_id", "tile", "shingles")
    links = tiled.groupBy("block", "i", "j").applyInPandas(_multiply(percent), "a long, b long")
    return members, stored(links, "links")


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id``: the smallest doc_id reachable over links, itself included."""
    members, links = jaccard_links(docs, size, percent)
    classes = components(links)
    low = members.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("low"))
    named = join_small(low, classes.select(F.col("node").alias("set_id"), "component"), "set_id", "left", BROADCAST_ROWS)
    named = named.withColumn("class", F.coalesce("component", "set_id"))
    lowest = named.groupBy("class").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("sets"))
    # only sets of several documents, or linked ones, need a lookup: all others are their own class
    many = members.filter("set_id is not null").groupBy("set_id").agg(F.count(F.lit(1)).alias("copies"))
    lookup = named.join(lowest, "class").join(many, "set_id").filter("sets > 1 or copies > 1").select("set_id", "component_id")
    lookup = stored(lookup, "classes")
    out = join_small(members, lookup, "set_id", "left", BROADCAST_ROWS)
    mine = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), mine).alias("component_id"))
