"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed 1- to 3-grams of code points per language over all labelled rows
outside the held-out fold; tasks send one count vector a language and partition, and
groups of them are added up before the last sum.  The matrix of smoothed log
probabilities (languages x ``BUCKETS``) is broadcast in pages of at most ``PAGE``
languages, so its size is bounded; with more languages each page scores all texts and
hands on the best so far and the sum of the likelihoods.  Scoring counts each text's
n-grams per bucket and multiplies the sparse counts with the matrix.

The score is the posterior probability of the predicted language; of equally likely ones
the first by code point is predicted.  Each text is lower-cased by itself, so equal texts
score the same.  Null texts and texts without a letter (``str.isalpha``) get ``und`` and
score 0.  With nothing to learn from every text gets ``und``.  Null ids count as in no fold: they are learned from and not held out.
Repeated rows are kept.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maploom.llm.tables import stored

BUCKETS = 1 << 14
#: Languages whose log probabilities (128 KB each) are held at once.
PAGE = 500
ORDERS = (1, 2, 3)
#: Code points whose n-grams are hashed at once.
SLICE_CHARS = 1 << 20
_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def _groups(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, code points, text of each) of runs of texts; long texts stand alone."""
    at = 0
    while at < len(texts):
        begin, total = at, 0
        while at < len(texts) and (at == begin or total < SLICE_CHARS and at - begin < 256):
            total += len(texts[at])
            at += 1
        low = [t.lower() for t in texts[begin:at]]  # one by one: a final sigma looks at its neighbours
        code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.array([len(t) for t in low])
        yield begin, at, code, np.repeat(np.arange(at - begin, dtype=np.int64), sizes)


def ngram_counts(code: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Counts (texts x buckets) of the hashed n-grams that lie within one text."""
    out = np.zeros(n * BUCKETS, dtype=np.int64)
    for order in ORDERS:
        if len(code) < order:
            continue
        h = np.zeros(len(code) - order + 1, dtype=np.uint32)
        for j in range(order):
            h = (h ^ code[j : j + len(h)]) * _PRIMES[j]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D + 2 * order)
        within = owner[: len(h)] == owner[order - 1 :]
        out += np.bincount((owner[: len(h)] * BUCKETS + (h >> np.uint32(18)))[within], minlength=len(out))
    return out.reshape(n, BUCKETS)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, lang -> one count vector a language."""
    total: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in batches:
        texts, langs = ([x or "" for x in c.to_pylist()] for c in batch.columns)
        for begin, end, code, owner in _groups(texts):
            counts = ngram_counts(code, owner, end - begin)
            for lang in sorted(set(langs[begin:end])):
                mine = np.array([x == lang for x in langs[begin:end]])
                total[lang] = total.get(lang, 0) + counts[mine].sum(axis=0)
                rows[lang] = rows.get(lang, 0) + int(mine.sum())
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(rows.values()), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["lang", "n", "counts"])


def _add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(BUCKETS, dtype=np.int64), 0
    for batch in batches:
        for raw, k in zip(batch.column("counts").to_pylist(), batch.column("n").to_pylist()):
            total += np.frombuffer(raw, dtype=np.int64)
            n += k
    yield pa.RecordBatch.from_arrays([pa.array([key[-1].as_py()]), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["lang", "n", "counts"])


Model = tuple[list[str], np.ndarray, np.ndarray]


def count_languages(labelled: DataFrame) -> DataFrame:
    """``lang, n, counts``: rows and n-gram counts of each language in ``text, lang``."""
    learned = labelled.select(F.col("text").cast("string"), F.col("lang").cast("string")).filter("lang is not null and text is not null")
    counts = learned.mapInArrow(_learn, "lang string, n long, counts binary")
    part = counts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    part = part.groupBy("part", "lang").applyInArrow(_add, "lang string, n long, counts binary")
    return stored(part.groupBy("lang").applyInArrow(_add, "lang string, n long, counts binary"), "languages")


def pages(counted: DataFrame, smoothing: float = 0.5) -> Iterator[Model]:
    """(languages, log priors, log probabilities) of all languages, at most ``PAGE`` at a time, by code point."""
    total = counted.agg(F.sum("n")).first()[0]
    last = None
    while total:
        left = counted if last is None else counted.filter(F.col("lang") > last)
        rows = left.orderBy("lang").limit(PAGE).collect()
        if not rows:
            return
        table = np.array([np.frombuffer(r["counts"], dtype=np.int64) for r in rows]) + smoothing
        prior = np.array([r["n"] for r in rows], dtype=float)
        yield [r["lang"] for r in rows], np.log(prior / total), np.log(table / table.sum(axis=1, keepdims=True))
        last = rows[-1]["lang"]


def _score(model):
    """doc_id, lang_pred, top, rest, text: the best margin so far, and the likelihoods of all languages relative to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prior, table = model.value
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            best = batch.column("lang_pred").to_pylist()
            top, rest = (batch.column(c).to_numpy().copy() for c in ("top", "rest"))
            for begin, end, code, owner in _groups(texts):
                counts = ngram_counts(code, owner, end - begin)
                row, bucket = np.nonzero(counts)
                value = counts[row, bucket]
                starts = np.append(np.searchsorted(row, np.arange(end - begin)), len(row))
                for k in range(begin, end):
                    if not any(map(str.isalpha, texts[k])):
                        continue
                    at = slice(starts[k - begin], starts[k - begin + 1])
                    margin = prior + table[:, bucket[at]] @ value[at]
                    first = int(margin.argmax())
                    peak = max(top[k], margin[first])
                    if margin[first] > top[k]:
                        best[k] = langs[first]
                    rest[k] = rest[k] * np.exp(top[k] - peak) + np.exp(margin - peak).sum()
                    top[k] = peak
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(best, pa.string()), pa.array(top), pa.array(rest), batch.column("text")], names=["doc_id", "lang_pred", "top", "rest", "text"])

    return run


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document, learned outside the held-out fold."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counted = count_languages(docs.filter(~in_fold(F.col("doc_id"), folds, held_out)))
    schema = "doc_id long, lang_pred string, top double, rest double, text string"
    out = docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("rest"), "text")
    many = counted.count() > PAGE
    for model in pages(counted):
        out = out.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), schema)
        if many:
            out = stored(out, "scored")
    score = F.when(F.col("rest") > 0, 1 / F.col("rest")).otherwise(0.0)
    return out.select("doc_id", in_fold(F.col("doc_id"), folds, held_out).alias("held_out"), "lang_pred", score.alias("score"))
