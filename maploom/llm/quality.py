"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of each text are counted over its whole bytes.  Small regression trees are
boosted on a bounded sample of labelled rows; every path of every tree becomes a rule, a
conjunction of comparisons.  A lasso logistic regression weighs the rules and drops most
of them.  What is left is compiled into one Spark column over the statistics, so scoring
is plain column arithmetic.

Null text is empty; it gets the score its statistics (all 0) give.  Labels that are null
or belong to no document are ignored; if a document has several labels each counts.  With
no labelled rows of both classes the score is the share of label 1 (0.5 with none).
Null and repeated ids are kept.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maploom.llm import wordhash as wh
from maploom.llm.tables import stored

#: Labelled rows that the rules are fitted on, those with the smallest hash of their id.
TRAIN_ROWS = 20_000

#: Byte classes of the statistics: name -> bytes.
_CLASSES = {
    "upper": range(0x41, 0x5B), "lower": range(0x61, 0x7B), "digit": range(0x30, 0x3A), "space": (0x20, 0x09), "line": (0x0A, 0x0D),
    "stop": b".,;:?", "bang": b"!", "bar": b"|", "symbol": b"#$%&*@^~=+<>{}[]\\_/", "quote": b"\"'()-`", "high": range(0x80, 0x100),
}
_NAMES = list(_CLASSES)
_CLASS_OF = np.zeros(256, dtype=np.int64)
for _i, _bytes in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_bytes)] = _i + 1
FEATURES = [*_NAMES, "log_bytes", "log_words", "word_bytes", "long_words", "distinct_words", "upper_words", "line_words", "distinct_lines"]


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for words in wh.slices(texts, "space"):
        n, at = words.n_docs, words.first_doc
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts[at : at + n]]
        size = np.array([len(r) for r in raw])
        doc = np.repeat(np.arange(n), size + 1)
        per = np.bincount(doc * (len(_NAMES) + 1) + _CLASS_OF[words.buf], minlength=n * (len(_NAMES) + 1)).reshape(n, -1)[:, 1:].astype(float)
        per[:, _NAMES.index("space")] -= 1  # the separator behind each text
        count = words.counts()
        some = np.maximum(count, 1)
        length = words.end - words.start
        hashes = wh.word_hashes(words, 31)
        pair = np.unique(wh.mix64(hashes + wh.mix64(words.doc.astype(np.uint64))), return_index=True)[1]
        capital = (words.buf[words.start] >= 0x41) & (words.buf[words.start] <= 0x5A)
        capital &= (length > 1) & (words.buf[np.minimum(words.start + 1, len(words.buf) - 1)] <= 0x5A)
        lines = [[x for x in r.split(b"\n") if x.strip()] for r in raw]
        by_doc = lambda x: np.bincount(words.doc, weights=x, minlength=n)
        out[at : at + n] = np.column_stack([
            per / np.maximum(size, 1)[:, None], np.log1p(size), np.log1p(count), by_doc(length) / some, by_doc(length > 12) / some,
            np.bincount(words.doc[pair], minlength=n) / some, by_doc(capital) / some,
            count / np.maximum([len(x) for x in lines], 1), [len(set(x)) / max(len(x), 1) for x in lines],
        ])
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = statistics(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(values[:, k]) for k in range(len(FEATURES)))], names=["doc_id", *FEATURES])


def text_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of every text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_describe, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


Rule = tuple[tuple[int, bool, float], ...]  # (feature, at most, threshold) of each comparison


def _split(x: np.ndarray, edges: list[np.ndarray], target: np.ndarray, rows: np.ndarray, least: int):
    """(gain, feature, bin) of the best split of the rows by squared error."""
    best = (1e-9, -1, -1)
    total, n = target[rows].sum(), len(rows)
    for f, e in enumerate(edges):
        if not len(e):
            continue
        b = x[rows, f]
        k = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
        s = np.cumsum(np.bincount(b, weights=target[rows], minlength=len(e) + 1))[:-1]
        fit = (k >= least) & (n - k >= least)
        gain = np.where(fit, s**2 / np.maximum(k, 1) + (total - s) ** 2 / np.maximum(n - k, 1) - total**2 / n, -1)
        if gain.max() > best[0]:
            best = (gain.max(), f, int(gain.argmax()))
    return best


def tree_rules(values: np.ndarray, label: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, least: int = 5) -> list[Rule]:
    """Paths of boosted regression trees on the logistic gradient, as rules."""
    edges = [np.unique(np.quantile(v, np.linspace(0.01, 0.99, 64))) for v in values.T]
    x = np.column_stack([np.searchsorted(e, v, side="left") for e, v in zip(edges, values.T)])
    margin, rules = np.zeros(len(label)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, curve = label - p, p * (1 - p)
        leaves = [((), np.arange(len(label)))]
        for _ in range(depth):
            grown = []
            for path, rows in leaves:
                _, f, b = _split(x, edges, gradient, rows, least) if len(rows) >= 2 * least else (0, -1, -1)
                if f < 0:
                    grown.append((path, rows))
                    continue
                low = x[rows, f] <= b
                for at_most, part in ((True, rows[low]), (False, rows[~low])):
                    grown.append(((*path, (f, at_most, float(edges[f][b]))), part))
                    rules[grown[-1][0]] = None
            leaves = grown
        for _, rows in leaves:
            margin[rows] += rate * gradient[rows].sum() / (curve[rows].sum() + 1.0)
    return list(rules)


def holds(rules: list[Rule], values: np.ndarray) -> np.ndarray:
    out = np.ones((len(values), len(rules)))
    for k, rule in enumerate(rules):
        for f, at_most, t in rule:
            out[:, k] *= values[:, f] <= t if at_most else values[:, f] > t
    return out


def lasso_logistic(z: np.ndarray, label: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights by accelerated proximal gradient steps."""
    n = len(label)
    full = np.column_stack([np.ones(n), z])
    v = np.ones(full.shape[1])
    for _ in range(15):
        v = full.T @ (full @ v)
        v /= np.linalg.norm(v) or 1.0
    step = 4 * n / max(float(v @ (full.T @ (full @ v))), 1e-9)
    w = y = np.zeros(full.shape[1])
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ y, -40, 40)))
        new = y + step / n * (full.T @ (label - p))
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return float(w[0]), w[1:]


class RuleEnsemble:
    """Weighted rules; ``column()`` is the score as a Spark column over the statistics."""

    def __init__(self, base: float, weighted: list[tuple[Rule, float]]):
        self.base, self.weighted = base, weighted

    @classmethod
    def fit(cls, values: np.ndarray, label: np.ndarray, penalty: float = 5e-4) -> RuleEnsemble:
        n, good = len(label), float(label.sum())
        if good == 0 or good == n:
            return cls(float(np.log((good + 0.5) / (n - good + 0.5))) if n else 0.0, [])
        rules = tree_rules(values, label)
        z = holds(rules, values)
        kept = np.unique(z, axis=1, return_index=True)[1]  # of rules that say the same the first
        kept.sort()
        base, weights = lasso_logistic(z[:, kept], label, penalty)
        return cls(base, [(rules[k], float(w)) for k, w in zip(kept, weights) if abs(w) > 1e-6])

    def column(self) -> Column:
        def both(rule: Rule) -> Column:
            parts = [F.col(FEATURES[f]) <= t if at_most else F.col(FEATURES[f]) > t for f, at_most, t in rule]
            return reduce(lambda a, b: a & b, parts)

        margin = reduce(lambda a, b: a + b, [F.when(both(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.weighted], F.lit(self.base))
        return 1 / (1 + F.exp(-margin))


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, train_rows: int = TRAIN_ROWS) -> RuleEnsemble:
    """Rules from labelled rows outside the held-out fold, at most ``train_rows`` of them."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label"))
    usable = usable.filter(F.col("label").isin(0.0, 1.0) & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), folds, held_out))
    sample = stored(usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(train_rows), "label-sample")
    wanted = F.broadcast(sample.select("doc_id").distinct())  # at most train_rows ids
    stats = text_statistics(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi"))
    rows = stats.join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES, "label").limit(2 * train_rows).toPandas()
    return RuleEnsemble.fit(rows[FEATURES].to_numpy(dtype=float), rows["label"].to_numpy(dtype=float))


def score(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.5) -> DataFrame:
    """``doc_id, score, predicted`` of every row, by its text alone."""
    scored = text_statistics(docs).select("doc_id", model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = score(docs, fit_quality(docs, labels, folds, held_out), threshold)
    return scored.select("doc_id", in_fold(F.col("doc_id"), folds, held_out).alias("held_out"), "score", "predicted")
