"""Substring dedup: remove words of passages that an earlier document already has.

A window is ``size`` consecutive words of one document.  A word goes if some
window that covers it also starts in a document with a smaller ``doc_id``.

Two passes over the windows:

1. *Count-min prefilter* (:mod:`maploom.llm.sketch`).  Each task sums its windows
   into a sketch; the sketches merge cell by cell.  A window with a cell below two
   occurs once and is done.
2. *Exact grouping.*  Only windows estimated repeated are grouped by a 96-bit
   hash, with the smallest document kept.  A task first reduces its own windows,
   so a passage that very many documents share sends one entry a task, not one
   a document.

Null text has no words.  Rows with a null ``doc_id`` keep all their words and are
not compared.  Rows with the same id count as one document.  Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maploom.llm import sketch
from maploom.llm import wordhash as wh

#: Windows gathered in a task before their sketch is sent on, and suspects before their entries are.
SKETCH_WINDOWS = 3_000_000
SUSPECTS = 750_000
#: Windows a bucket of the exact pass is planned for.
BUCKET_WINDOWS = 2_000_000
#: Twice the windows of a group of documents whose texts and flags meet in one task.
GROUP_WINDOWS = 3_000_000


def _windows(batches: Iterator[pa.RecordBatch], size: int, limit: int, suspect=None) -> Iterator[tuple[np.ndarray, ...]]:
    """(doc_id, hash, second hash) of windows, about ``limit`` at a time; with ``suspect`` only of those it flags.

    Without ``suspect`` only the hashes are filled.
    """
    kept: list[tuple[np.ndarray, ...]] = []
    total = 0
    for batch in batches:
        ids = batch.column(0)
        known = ~np.asarray(ids.is_null())
        number = ids.fill_null(0).to_numpy()
        for words in wh.slices(batch.column(1).to_pylist(), "space"):
            hashes = wh.word_hashes(words, 21)
            first, h = wh.window_hashes(words, hashes, size, 22)
            doc = words.first_doc + words.doc[first]
            use = known[doc]
            if suspect is None:
                kept.append((doc[:0], h[use], doc[:0]))
            else:
                use &= suspect(h)
                other = wh.window_hashes(words, hashes, size, 23)[1][use]
                kept.append((number[doc[use]], h[use], (other >> np.uint64(32)).astype(np.uint32)))
            total += len(kept[-1][1])
            if total >= limit:
                yield tuple(np.concatenate(x) for x in zip(*kept))
                kept, total = [], 0
    if kept:
        yield tuple(np.concatenate(x) for x in zip(*kept))


def _sketch(size: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, _ in _windows(batches, size, SKETCH_WINDOWS):
            yield from sketch.emit(h, bits)

    return run


_PART = pa.schema([("bucket", pa.int32()), ("doc_group", pa.int32()), ("base", pa.int64()), ("hash", pa.binary()), ("tail", pa.binary()), ("doc", pa.binary())])


def _by_group(doc: np.ndarray, h: np.ndarray, groups: int) -> list[tuple[int, bytes, bytes]]:
    """(group, documents, hashes) of flagged windows."""
    group = (wh.mix64(doc.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    at = np.searchsorted(group[order], np.arange(groups + 1))
    parts = ((g, order[at[g] : at[g + 1]]) for g in range(groups) if at[g + 1] > at[g])
    return [(g, doc[p].tobytes(), h[p].tobytes()) for g, p in parts]


def _group_low(doc: np.ndarray, h: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted by hash: arrays, start of each hash's run, smallest document per row, first row per (hash, document)."""
    order = np.lexsort((doc, t, h))
    doc, h, t = doc[order], h[order], t[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    single = fresh.copy()
    single[1:] |= doc[1:] != doc[:-1]
    return doc, h, t, fresh, doc[np.flatnonzero(fresh)][np.cumsum(fresh) - 1], single


def _suspects(size: int, bits: int, buckets: int, groups: int, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = table.value
        for doc, h, t in _windows(batches, size, SUSPECTS, lambda h: sketch.suspects(h, flags, bits)):
            doc, h, t, fresh, low, single = _group_low(doc, h, t)
            later = single & (doc > low)  # repeated within this task already
            rows = [(g % buckets, g, None, x, None, d) for g, d, x in _by_group(doc[later], h[later], groups)]
            doc, h, t = doc[fresh], h[fresh], t[fresh]
            bucket = (h >> np.uint64(33)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[order], np.arange(buckets + 1).astype(np.uint64))
            for b in range(buckets):
                part = order[at[b] : at[b + 1]]
                if len(part):
                    base = int(doc[part].min())
                    gap = doc[part] - base
                    rows.append((b, None, base, h[part].tobytes(), t[part].tobytes(), gap.astype(np.uint32 if gap.max() < 1 << 32 else np.uint64).tobytes()))
            yield pa.RecordBatch.from_pylist([dict(zip(_PART.names, r)) for r in rows], schema=_PART)

    return run


def _resolve(groups: int):
    """Of one bucket: the (document, hash) pairs that a smaller document has too, by document group."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, h, t = [], [], []
        for batch in batches:
            passed = []
            for _, group, base, hashes, tail, gap in zip(*(c.to_pylist() for c in batch.columns)):
                if tail is None:  # settled in the task that read the texts
                    passed.append((group, gap, hashes))
                    continue
                h.append(np.frombuffer(hashes, dtype=np.uint64))
                t.append(np.frombuffer(tail, dtype=np.uint32))
                wide = np.uint32 if len(gap) == 4 * len(h[-1]) else np.uint64
                doc.append(np.frombuffer(gap, dtype=wide).astype(np.int64) + base)
            if passed:
                yield pa.RecordBatch.from_pylist([dict(zip(_FLAGS.names, r)) for r in passed], schema=_FLAGS)
        if doc:
            d, x, _, _, low, single = _group_low(*(np.concatenate(v) for v in (doc, h, t)))
            later = single & (d > low)
            yield pa.RecordBatch.from_pylist([dict(zip(_FLAGS.names, r)) for r in _by_group(d[later], x[later], groups)], schema=_FLAGS)

    return run


_RESULT = "doc_id long, n_words long, n_removed long, text string"
_FLAGS = pa.schema([("doc_group", pa.int32()), ("docs", pa.binary()), ("hashes", pa.binary())])


def _cut(size: int):
    """Texts of one document group and its flagged windows -> what stays of the texts."""

    def run(key: tuple, docs: pa.Table, flags: pa.Table) -> pa.Table:
        flagged = [np.frombuffer(b"".join(flags.column(c).to_pylist()), dtype=t) for c, t in (("docs", np.uint64), ("hashes", np.uint64))] if flags.num_rows else [np.zeros(0, dtype=np.uint64)] * 2
        wanted = np.unique(wh.mix64(flagged[1] + wh.mix64(flagged[0])))
        texts, ids = docs.column("text").to_pylist(), docs.column("doc_id")
        known = ~np.asarray(ids.is_null())
        number = ids.fill_null(0).to_numpy().astype(np.uint64)
        totals, removals, out = [], [], []
        for words in wh.slices(texts, "space"):
            counts = words.counts()
            ends = np.cumsum(counts)
            covered = np.zeros(len(words.start) + 1, dtype=np.int32)
            if len(wanted):
                first, h = wh.window_hashes(words, wh.word_hashes(words, 21), size, 22)
                owner = words.first_doc + words.doc[first]
                salted = wh.mix64(h + wh.mix64(number[owner]))
                place = np.minimum(np.searchsorted(wanted, salted), len(wanted) - 1)
                hit = first[(wanted[place] == salted) & known[owner]]
                covered[hit] += 1
                np.subtract.at(covered, hit + size, 1)
            gone = np.cumsum(covered[:-1]) > 0
            removed = np.bincount(words.doc[gone], minlength=words.n_docs)
            for i in range(words.n_docs):
                parts = (texts[words.first_doc + i] or "").encode().split()
                if removed[i]:
                    parts = compress(parts, (~gone[ends[i] - counts[i] : ends[i]]).tolist())
                out.append(b" ".join(parts))
            totals.append(counts)
            removals.append(removed)
        whole = [pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)) for x in (totals, removals)]
        return pa.Table.from_arrays([ids, *whole, pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    return run


def _whole(size: int):
    """doc_id, text -> all words of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = pa.table({"docs": pa.array([], pa.binary()), "hashes": pa.array([], pa.binary())})
        for batch in batches:
            yield from _cut(size)((), pa.Table.from_batches([batch]), none).to_batches()

    return run


def _grouped(groups: int):
    """doc_id, text -> doc_group, doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = wh.mix64(batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)) % np.uint64(groups)
            yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), *batch.columns], names=["doc_group", "doc_id", "text"])

    return run


def remove_repeated(docs: DataFrame, size: int = 13) -> DataFrame:
    """``doc_id, n_words, n_removed, text``: the words that stay, joined by one space."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    windows = max(total // 6, 1)
    bits = sketch.bits_for(windows)
    buckets = int(max(16, windows // BUCKET_WINDOWS))
    table = spark.sparkContext.broadcast(sketch.repeated_cells(docs.mapInArrow(_sketch(size, bits), sketch.COLUMNS), bits))
    groups = int(windows // GROUP_WINDOWS) * 2 + 17
    schema = "bucket int, doc_group int, base long, hash binary, tail binary, doc binary"
    parts = docs.mapInArrow(_suspects(size, bits, buckets, groups, table), schema)
    flagged = parts.groupBy("bucket").applyInArrow(_resolve(groups), "doc_group int, docs binary, hashes binary")
    grouped = docs.filter("doc_id is not null").mapInArrow(_grouped(groups), "doc_group int, doc_id long, text string")
    kept = grouped.groupBy("doc_group").cogroup(flagged.groupBy("doc_group")).applyInArrow(_cut(size), _RESULT)
    nameless = docs.filter("doc_id is null").mapInArrow(_whole(size), _RESULT)  # nothing of these goes, so they stay where they are
    return kept.unionByName(nameless)
