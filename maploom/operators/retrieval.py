"""Retrieval over embeddings and text, top-k and selection."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from maploom.functions.vectors import dot, norm
from maploom.sources.tables import bounded, dealt, stored


#: Most queries and records of a block.
QUERIES, RECORDS = 16384, 524288


def _plain(v: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` entries, none of them null, not a number or so large that single precision fails."""
    return F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < 1e15, F.lit(False))), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products of equally many rows, entry by entry in array order, as `dot` makes them: equal vectors, equal sums."""
    out = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for d in range(a.shape[-1]):
        out += a[..., d] * b[..., d]
    return out


def _grid(queries: DataFrame, records: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None, int]:
    """(queries and records by ``_i, _j``, blocks of both that each meet once; the scores of vectors that aren't plain; the dimension).

    ``most`` queries of a block and no more blocks of records than tasks, for steps that leave something for each query and block.
    """
    spark = records.sparkSession
    taken = "own" in queries.columns
    q = queries.select("query", *[F.col("own").alias("_own")] * taken, "embedding")
    sizes = q.agg(F.max(F.size("embedding")), F.count(F.lit(1))).first()
    dim = max(sizes[0] or 1, 1)
    n = records.agg(F.count(F.lit(1)), F.count_if(~_plain(F.col("embedding"), dim))).first()
    odd_queries = q.filter(~_plain(F.col("embedding"), dim))
    odd = None
    if n[1]:
        odd = _each(q, records.filter(~_plain(F.col("embedding"), dim)))
    if not odd_queries.isEmpty():
        more = _each(odd_queries, records.filter(_plain(F.col("embedding"), dim)))
        odd = more if odd is None else odd.unionByName(more)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    across = max(1, math.ceil(sizes[1] / QUERIES))
    down = max(1, math.ceil(n[0] / RECORDS), min(math.ceil(n[0] / 1024), math.ceil(2 * tasks / across)))
    if most:
        across = max(1, math.ceil(sizes[1] / most), min(math.ceil(sizes[1] / 512), math.ceil(math.sqrt(tasks))))
        down = max(1, min(math.ceil(n[0] / 1024), math.ceil(tasks / across)))
    block = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    q = q.filter(_plain(F.col("embedding"), dim)).withColumn("_i", block("query", across)).withColumn("_j", every(down))
    r = records.filter(_plain(F.col("embedding"), dim)).withColumn("_j", block("ord", down)).withColumn("_i", every(across))
    return q, r, odd, dim


def _each(q: DataFrame, records: DataFrame) -> DataFrame:
    """Scores row by row, for vectors of any kind."""
    s = records.join(bounded(q.withColumnRenamed("embedding", "_q")), F.lit(True))
    if "_own" in q.columns:
        s = s.filter(F.coalesce(F.col("ord") != F.col("_own"), F.lit(True))).drop("_own")
    return s.withColumn("score", dot(F.col("_q"), F.col("embedding"))).drop("_q", "embedding")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def scores(queries: DataFrame, records: DataFrame) -> DataFrame:
    """Dot product of every query with every record, a block of queries with a block of records at a time.

    A task holds one block of queries; the records of its blocks pass by.  A query
    with ``own`` was taken from the record with that ``ord``: this one record isn't scored for it.
    """
    taken = "own" in queries.columns
    q, r, odd, dim = _grid(queries, records)
    rest = [c for c in records.columns if c != "embedding"]
    shape = records.select(*rest).limit(0).join(queries.select("query").limit(0), F.lit(True)).withColumn("score", F.lit(0.0))
    u = q.withColumn("_side", F.lit(0)).unionByName(r.withColumn("_side", F.lit(1)), allowMissingColumns=True)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ready = None, [], None
        for batch in batches:
            key = np.column_stack([batch.column(c).to_numpy() for c in ("_i", "_j", "_side")])
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1), True])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                part = pa.Table.from_batches([batch.slice(lo, hi - lo)])
                if key[lo, 2] == 0:
                    if at != tuple(key[lo, :2]):
                        at, held, ready = tuple(key[lo, :2]), [], None
                    held.append(part)
                    continue
                if at != tuple(key[lo, :2]):
                    continue  # records that no query meets
                if ready is None:
                    t = pa.concat_tables(held)
                    ready = (_matrix(t["embedding"], dim).astype(np.float64), t["query"].combine_chunks(), t["_own"].combine_chunks() if taken else None)
                qm, ids, own = ready
                columns, rm = part.select(rest).combine_chunks(), _matrix(part["embedding"], dim).astype(np.float64)
                for a in range(0, len(qm), 64):
                    for b in range(0, len(rm), 1024):
                        x, y = qm[a : a + 64], rm[b : b + 1024]
                        s = _in_order(x[:, None], np.asfortranarray(y)[None])
                        ia, ib = np.repeat(np.arange(a, a + len(x)), len(y)), np.tile(np.arange(b, b + len(y)), len(x))
                        out = columns.take(pa.array(ib)).append_column("query", ids.take(pa.array(ia))).append_column("score", pa.array(s.ravel()))
                        if taken:
                            out = out.filter(pc.fill_null(pc.not_equal(out["ord"], own.take(pa.array(ia))), True))
                        yield from out.combine_chunks().to_batches()

    s = dealt(u, "_i", "_j").sortWithinPartitions("_i", "_j", "_side").mapInArrow(score, _ddl(shape))
    return s if odd is None else s.unionByName(odd)


def top_k(queries: DataFrame, records: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The ``k`` best records of each query (and each ``by`` group), ties in record order, with ``rank``.

    Every block of queries meets every block of records in a matrix product of single precision; what may be among a query's best by it
    is summed again in order, and only the best ``k`` of a block go on.
    """
    taken, by = "own" in queries.columns, by or []
    q, r, odd, dim = _grid(queries, records)
    rest = [c for c in records.columns if c != "embedding"]
    shape = records.select(*rest).limit(0).join(queries.select("query").limit(0), F.lit(True)).withColumn("score", F.lit(0.0))

    empty = shape.toArrow()

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        if by:
            order = pc.sort_indices(right.select([*by, "ord"]), sort_keys=[(c, "ascending") for c in (*by, "ord")], null_placement="at_start")
        else:
            order = pc.sort_indices(right, sort_keys=[("ord", "ascending")], null_placement="at_start")
        right = right.take(order).combine_chunks()
        qm, rm = _matrix(left["_e"], dim).astype(np.float64), _matrix(right["embedding"], dim)
        ids, columns = left["query"].combine_chunks(), right.select(rest)
        ords, own = right["ord"].combine_chunks(), left["_own"].combine_chunks() if taken else None
        q32, r32 = qm.astype(np.float32), rm.astype(np.float32)
        slack = (dim + 8) * 2e-7 * np.linalg.norm(qm, axis=1) * (np.linalg.norm(r32, axis=1).max() if len(r32) else 0) + 1e-30
        groups = right.select(by).to_pandas().ne(right.select(by).to_pandas().shift()).any(axis=1).to_numpy() if by else np.zeros(len(rm), dtype=bool)
        starts = np.unique(np.r_[0, np.flatnonzero(groups), len(rm)])
        found_q, found_r, found_s = [], [], []
        for lo, hi in zip(starts[:-1], starts[1:]):
            for a in range(0, len(qm), 1024):
                x = q32[a : a + 1024]
                least = np.full(len(x), -np.inf)
                kq, kr, ks = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
                for b in range(lo, hi, 8192):
                    s = x @ r32[b : min(b + 8192, hi)].T
                    want = k + taken
                    if b == lo and s.shape[1] > want:
                        least = np.partition(s, -want, axis=1)[:, -want] - 2 * slack[a : a + 1024]
                    hq, hr = np.nonzero(s >= least[:, None])
                    hr += b
                    if taken and len(hq):
                        other = pc.fill_null(pc.not_equal(ords.take(pa.array(hr)), own.take(pa.array(hq + a))), True).to_numpy(zero_copy_only=False)
                        hq, hr = hq[other], hr[other]
                    if not len(hq):
                        continue
                    exact = np.concatenate([_in_order(qm[hq[c : c + 65536] + a], rm[hr[c : c + 65536]].astype(np.float64)) for c in range(0, len(hq), 65536)])
                    kq, kr, ks = np.r_[kq, hq], np.r_[kr, hr], np.r_[ks, exact]
                    o = np.lexsort((kr, -ks, kq))
                    kq, kr, ks = kq[o], kr[o], ks[o]
                    place = np.arange(len(kq)) - np.searchsorted(kq, kq)
                    last = place == k - 1
                    least[kq[last]] = np.maximum(least[kq[last]], ks[last] - slack[a + kq[last]])
                    kq, kr, ks = kq[place < k], kr[place < k], ks[place < k]
                found_q.append(kq + a), found_r.append(kr), found_s.append(ks)
        fq, fr, fs = (np.concatenate(f) if f else np.empty(0, kind) for f, kind in ((found_q, np.int64), (found_r, np.int64), (found_s, np.float64)))
        return columns.take(pa.array(fr)).append_column("query", ids.take(pa.array(fq))).append_column("score", pa.array(fs))

    s = dealt(r, "_i", "_j").groupBy("_i", "_j").cogroup(dealt(q.withColumnsRenamed({"_i": "_a", "_j": "_b", "embedding": "_e"}), "_a", "_b").groupBy("_a", "_b"))
    s = s.applyInArrow(lambda right, left: best(left, right), _ddl(shape))
    s = s if odd is None else s.unionByName(odd)
    w = W.partitionBy("query", *by).orderBy(F.desc("score"), "ord")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def retrieve_with_decision(queries: DataFrame, records: DataFrame, k: int = 5, min_sim: float = 0.55, min_margin: float = 0.0, require_mesh: bool = False) -> DataFrame:
    """One row per query and match: the decision, and matches only where it is ``found``.

    ``records``: ``ord, embedding`` and, for ``require_mesh``, ``geometry_status``.
    """
    _checked(k, min_sim, min_margin)
    if require_mesh:
        records = records.filter("geometry_status = 'mesh'")
    return decide(queries, stored(top_k(queries, records, max(k, 2)), "top"), k, min_sim, min_margin)


def _checked(k: int, min_sim: float, min_margin: float) -> None:
    if k < 1 or not -1 <= min_sim <= 1 or not 0 <= min_margin <= 2:
        raise ValueError("k must be at least 1, min_sim in [-1, 1] and min_margin in [0, 2]")


def decide(queries: DataFrame, top: DataFrame, k: int = 5, min_sim: float = 0.55, min_margin: float = 0.0) -> DataFrame:
    """The decisions of `retrieve_with_decision` from matches that `top_k` found, at least two a query; ``top`` is read three times."""
    _checked(k, min_sim, min_margin)
    d = top.groupBy("query").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("_second"))
    d = queries.select("query").join(d, "query", "left").withColumn("margin", F.col("top_score") - F.col("_second"))
    low = F.coalesce(F.col("top_score") < min_sim, F.lit(True))
    close = F.lit(min_margin > 0) & F.coalesce(F.col("margin") < min_margin, F.lit(False))
    d = d.withColumn("reason", F.when(low, "below_min_similarity").when(close, "below_min_margin")).withColumn("found", F.col("reason").isNull()).drop("_second")
    hits = top.filter(F.col("rank") <= k).select("query", F.col("ord").alias("match"), "score", "rank")
    return d.join(hits.join(d.filter("found").select("query"), "query", "left_semi"), "query", "left")


#: Bins of a group's scores, between its smallest and its largest.
BINS = 1024


def _binned(scored: DataFrame, group: list[str], score: str) -> tuple[DataFrame, DataFrame]:
    """(``group, _x, _b``: scores with their bin; one row a bin with the counts and sums before it and over all).

    Only bins go through windows, so a group's list of scores is never in one place.
    """
    s = scored.select(*group, F.col(score).alias("_x"))
    ends = stored(s.groupBy(*group).agg(F.min("_x").alias("_min"), F.max("_x").alias("_max")), "score-ends")
    wide = F.col("_max") > F.col("_min")
    place = F.when(wide, F.least(F.floor((F.col("_x") - F.col("_min")) / (F.col("_max") - F.col("_min")) * BINS), F.lit(BINS - 1))).otherwise(0)
    s = s.join(bounded(ends), group).select(*group, "_x", place.cast("int").alias("_b"))
    h = s.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"), F.sum("_x").alias("_s"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    return s, stored(_summed(h, group), "score-bins")


def _summed(h: DataFrame, group: list[str]) -> DataFrame:
    """Bins with the counts and sums before them and over all."""
    upto, whole = W.partitionBy(*group).orderBy("_b"), W.partitionBy(*group)
    h = h.withColumns({"_i1": F.sum("_n").over(upto), "_s1": F.sum("_s").over(upto), "_all": F.sum("_n").over(whole), "_total": F.sum("_s").over(whole), "_next": F.lead("_lo").over(upto)})
    return h.withColumns({"_i0": F.col("_i1") - F.col("_n"), "_s0": F.col("_s1") - F.col("_s")})


def exact_percentile(scored: DataFrame, group: list[str], score: str, percent: float) -> DataFrame:
    """``group, value``: the interpolated percentile; only the one or two bins that hold its ranks are sorted."""
    s, h = _binned(scored, group, score)
    return _percentile(lambda bins: s.join(bounded(bins), [*group, "_b"]), h, group, percent)


def _percentile(pick: Callable[[DataFrame], DataFrame], h: DataFrame, group: list[str], percent: float) -> DataFrame:
    """The percentile from bins; ``pick`` adds the scores (``_x``) that the bins it is given hold."""
    at = percent * (F.col("_all") - 1)
    h = h.withColumns({"_at": at, "_low": F.floor(at), "_high": F.ceil(at)})
    holds = h.filter(((F.col("_low") >= F.col("_i0")) & (F.col("_low") < F.col("_i1"))) | ((F.col("_high") >= F.col("_i0")) & (F.col("_high") < F.col("_i1"))))
    r = pick(holds.select(*group, "_b", "_i0", "_at", "_low", "_high"))
    r = r.withColumn("_r", F.col("_i0") + F.row_number().over(W.partitionBy(*group, "_b").orderBy("_x")) - 1)
    low, high = (F.max(F.when(F.col("_r") == F.col(c), F.col("_x"))) for c in ("_low", "_high"))
    part = F.max(F.col("_at") - F.col("_low"))
    return r.groupBy(*group).agg((low + (high - low) * part).alias("value"))


def otsu(scored: DataFrame, group: list[str], score: str) -> DataFrame:
    """``group, threshold``: the midpoint of the split with the largest between-class variance, the first of equals.

    One value gives itself; equal values give that value.  A histogram gives the variance at the end of every bin and
    a bound of it inside; only the scores of bins whose bound reaches the best end are looked at one by one.
    """
    s, h = _binned(scored, group, score)
    return _otsu(lambda bins: s.join(bounded(bins), [*group, "_b"]), h, group)


def _otsu(pick: Callable[[DataFrame], DataFrame], h: DataFrame, group: list[str]) -> DataFrame:
    n, total = F.col("_all").cast("double"), F.col("_total")
    gap = lambda i, part: i * total - part * n
    inner = F.when((F.col("_lo") * n < total) & (F.col("_hi") * n > total), gap(F.col("_i0"), F.col("_s0")) + F.col("_n") * (total - n * F.col("_lo")))
    most = F.greatest(gap(F.col("_i0"), F.col("_s0")), gap(F.col("_i1"), F.col("_s1")), F.coalesce(inner, F.lit(0.0)))
    first, last = F.greatest(F.col("_i0"), F.lit(1)), F.least(F.col("_i1"), F.col("_all") - 1)
    inside = F.col("_all") > 1
    bound = F.when(inside, most * most / (n * n * F.greatest(F.least(first * (n - first), last * (n - last)), F.lit(1.0))))
    w0, m0 = F.col("_i") / n, F.col("_sum") / F.col("_i")
    m1 = (total - F.col("_sum")) / (n - F.col("_i"))
    var = F.round(w0 * (1 - w0) * (m0 - m1) * (m0 - m1), 12)
    ends = h.withColumns({"_i": F.col("_i1"), "_sum": F.col("_s1")}).filter("_i < _all")
    ends = ends.select(*group, var.alias("_v"), "_i", ((F.col("_hi") + F.col("_next")) / 2).alias("_mid"))
    best = ends.groupBy(*group).agg(F.max("_v").alias("_best"))
    # of equal scores the best split is at an end
    close = h.withColumn("_bound", bound).join(bounded(best), group, "left").filter(F.col("_lo") < F.col("_hi")).filter(F.col("_bound") * (1 + 1e-9) + 1e-11 >= F.coalesce("_best", F.lit(0.0)))
    x = pick(close.select(*group, "_b", "_i0", "_s0", "_all", "_total", "_next"))
    w = W.partitionBy(*group, "_b").orderBy("_x")
    x = x.withColumns({"_i": F.col("_i0") + F.row_number().over(w), "_sum": F.col("_s0") + F.sum("_x").over(w.rowsBetween(W.unboundedPreceding, 0)), "_after": F.coalesce(F.lead("_x").over(w), F.col("_next"))})
    splits = x.filter("_i < _all").select(*group, var.alias("_v"), "_i", ((F.col("_x") + F.col("_after")) / 2).alias("_mid")).unionByName(ends)
    found = splits.groupBy(*group).agg(F.min_by("_mid", F.struct((-F.col("_v")).alias("v"), "_i")).alias("_mid"))
    whole = h.groupBy(*group).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    return whole.join(found, group, "left").select(*group, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.col("_mid")).alias("threshold"))


def semantic_candidates(scored: DataFrame, k: int, percent: float = 0.85) -> DataFrame:
    """Per query the records over the Otsu threshold of its best scores; the top ``k`` if those are fewer.

    The best scores are those from the percentile on, or the top ``k`` of a query with fewer.  The products are made once and written.
    """
    scored = stored(scored, "scores")
    w = W.partitionBy("query").orderBy(F.desc("score"), "ord")

    def top(queries: DataFrame) -> DataFrame:
        few = scored.join(bounded(queries.select("query")), "query", "left_semi")
        return few.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")

    cut = exact_percentile(scored, ["query"], "score", percent)
    upper = scored.join(bounded(stored(cut, "percentiles")), "query").filter(F.col("score") >= F.col("value")).drop("value")
    counts = upper.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    few = stored(counts.filter(F.col("n") < k), "few")
    t = otsu(upper.join(bounded(few), "query", "left_anti").unionByName(top(few)), ["query"], "score")
    over = scored.join(bounded(stored(t, "thresholds")), "query").filter(F.col("score") >= F.col("threshold")).drop("threshold")
    many = stored(over.groupBy("query").agg(F.count(F.lit(1)).alias("n")).join(scored.select("query").distinct(), "query", "right").filter(F.coalesce("n", F.lit(0)) < k), "too-few")
    return over.join(bounded(many.select("query")), "query", "left_anti").unionByName(top(many))


class _Block:
    """A block of queries that records pass by: double-precision products a tile at a time, those with a query's own record as NaN."""

    def __init__(self, held: pa.Table, dim: int, ids: pa.DataType):
        self.ids, self.dim = held["query"].combine_chunks().cast(ids), dim
        self.vectors = _matrix(held["embedding"], dim).astype(np.float64)
        self.length = np.linalg.norm(self.vectors, axis=1)
        self.own = held.select(["_own"]).to_pandas().rename(columns={"_own": "o"}).assign(q=range(held.num_rows)).dropna() if "_own" in held.column_names else None

    def number(self, held: pa.Table, c: str) -> np.ndarray:
        return held[c].to_numpy().astype(np.float64)

    def tiles(self, part: pa.Table, some: Callable[[], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, first record, products, vectors of records, error of a product); ``some``: queries that are still wanted."""
        rm = _matrix(part["embedding"], self.dim).astype(np.float64)
        same = None if self.own is None else self.own.merge(part.select(["ord"]).to_pandas().rename(columns={"ord": "o"}).assign(r=range(len(rm))).dropna(), on="o")
        mine = np.full(len(self.vectors), -1) if same is None or same["q"].duplicated().any() else None
        if mine is None:
            mine = np.full(len(self.vectors), -1)
            mine[same["q"].to_numpy()] = same["r"].to_numpy()
            same = None
        for b in range(0, len(rm), 4096):
            y = rm[b : b + 4096]
            far = np.linalg.norm(y, axis=1).max()
            take = np.arange(len(self.vectors)) if some is None else some()
            for a in range(0, len(take), 256):
                q = take[a : a + 256]
                s = self.vectors[q] @ y.T
                at = mine[q] - b
                hit = np.flatnonzero((at >= 0) & (at < len(y)))
                s[hit, at[hit]] = np.nan
                if same is not None:
                    for i, r in same[same["q"].isin(q) & same["r"].between(b, b + len(y) - 1)][["q", "r"]].itertuples(index=False):
                        s[np.searchsorted(q, i), r - b] = np.nan
                yield q, b, s, y, (self.dim + 8) * 4e-16 * self.length[q] * far

    def settle(self, q: np.ndarray, s: np.ndarray, y: np.ndarray, error: np.ndarray, limit: np.ndarray) -> None:
        """Products that are too near to a query's limit to tell are summed again in order."""
        i, j = np.nonzero(np.abs(s - limit[:, None]) <= error[:, None])
        for c in range(0, len(i), 65536):
            s[i[c : c + 65536], j[c : c + 65536]] = _in_order(self.vectors[q[i[c : c + 65536]]], y[j[c : c + 65536]])

    def rows(self, q: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(q)), *[pa.array(c) for c in columns.values()]], names=["query", *columns])


def _bins(s: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bins of products between a query's ends; what is no number gets the bin after the last."""
    with np.errstate(invalid="ignore", divide="ignore"):
        x = (s - low[:, None]) * np.where(high > low, BINS / (high - low), 0.0)[:, None]
        return np.where(np.isnan(x), BINS, np.clip(x, 0, BINS - 1)).astype(np.int64)


def _meet(q: DataFrame, r: DataFrame, begin: Callable[[pa.Table], tuple[Callable, Callable]], ddl: str, *order: str) -> DataFrame:
    """Records pass by the blocks of queries: ``begin`` takes a block's queries and gives what takes some records and what ends a block; both give batches."""
    u = q.withColumn("_side", F.lit(0)).unionByName(r.withColumn("_side", F.lit(1)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for batch in batches:
            key = np.column_stack([batch.column(c).to_numpy() for c in ("_i", "_j", "_side")])
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1), True])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                part = pa.Table.from_batches([batch.slice(lo, hi - lo)])
                if key[lo, 2] == 0:
                    if at != tuple(key[lo, :2]):
                        if block:
                            yield from block[1]()
                        at, held, block = tuple(key[lo, :2]), [], None
                    held.append(part)
                elif at == tuple(key[lo, :2]):
                    block = block or begin(pa.concat_tables(held))
                    yield from block[0](part)
        if block:
            yield from block[1]()

    return dealt(u, "_i", "_j").sortWithinPartitions("_i", "_j", "_side", *order).mapInArrow(run, ddl)


class _Products:
    """Scores of queries with records that are never written: each step makes the products anew, block by block, and keeps a query's ends, bins or few scores.

    Records without a score (null or not a number) are left out.
    """

    def __init__(self, queries: DataFrame, records: DataFrame):
        self.queries, self.records = queries, records
        self.q, r, odd, self.dim = _grid(queries, records, BLOCK_QUERIES)
        self.r = r.select("_i", "_j", "ord", "embedding")
        self.odd = None if odd is None else stored(odd.filter("score is not null and not isnan(score)"), "odd-scores")
        self.id = queries.schema["query"].dataType.simpleString()
        self.arrow = queries.select("query").limit(0).toArrow().schema.field("query").type

    def _with(self, odd: DataFrame, made: DataFrame) -> DataFrame:
        return made if odd is None else made.unionByName(odd)

    def ends(self) -> DataFrame:
        """``query, _min, _max``"""
        dim, arrow = self.dim, self.arrow

        def begin(held):
            block = _Block(held, dim, arrow)
            low, high = np.full(held.num_rows, np.inf), np.full(held.num_rows, -np.inf)

            def take(part):
                for q, _, s, _, error in block.tiles(part):
                    low[q] = np.fmin(low[q], np.fmin.reduce(s, axis=1) - 2 * error)  # below every sum in order, too
                    high[q] = np.fmax(high[q], np.fmax.reduce(s, axis=1))
                return iter(())

            def end():
                q = np.flatnonzero(low <= high)
                yield block.rows(q, _min=low[q], _max=high[q])

            return take, end

        e = _meet(self.q, self.r, begin, f"query {self.id}, _min double, _max double", "ord")
        e = e if self.odd is None else e.unionByName(self.odd.select("query", F.col("score").alias("_min"), F.col("score").alias("_max")))
        return stored(e.groupBy("query").agg(F.min("_min").alias("_min"), F.max("_max").alias("_max")), "score-ends")

    def _odd_bins(self, ends: DataFrame) -> DataFrame:
        x = self.odd.join(ends, "query").filter(F.col("score") >= F.col("_min"))
        wide = F.col("_max") > F.col("_min")
        place = F.when(wide, F.greatest(F.lit(0.0), F.least((F.col("score") - F.col("_min")) * (BINS / (F.col("_max") - F.col("_min"))), F.lit(BINS - 1.0)))).otherwise(0.0)
        return x.select("query", F.floor(place).cast("int").alias("_b"), F.col("score").alias("_x"))

    def bins(self, ends: DataFrame, counts: bool = False) -> DataFrame:
        """Bins (as of ``_summed``) of the scores from a query's ``_min`` on; ``counts``: without sums and ends of bins."""
        dim, arrow, blank = self.dim, self.arrow, counts

        def begin(held):
            block = _Block(held, dim, arrow)
            low, high = block.number(held, "_min"), block.number(held, "_max")
            shape = (held.num_rows, BINS)
            n, total = np.zeros(shape, np.int64), None if blank else np.zeros(shape)
            first, last = (None, None) if blank else (np.full(shape, np.inf), np.full(shape, -np.inf))

            def take(part):
                for q, _, s, y, error in block.tiles(part):
                    block.settle(q, s, y, error, low[q])
                    if blank:
                        k = _bins(s, low[q], high[q]) + (np.arange(len(q)) * (BINS + 1))[:, None]
                        n[q] += np.bincount(k.ravel(), minlength=len(q) * (BINS + 1)).reshape(-1, BINS + 1)[:, :BINS]
                        continue
                    i, j = np.nonzero(s >= low[q][:, None])
                    x = s[i, j]
                    k = _bins(x[:, None], low[q][i], high[q][i])[:, 0] + i * BINS
                    size = len(q) * BINS
                    n[q] += np.bincount(k, minlength=size).reshape(-1, BINS)
                    total[q] += np.bincount(k, weights=x, minlength=size).reshape(-1, BINS)
                    f, t = first[q].ravel(), last[q].ravel()
                    np.minimum.at(f, k, x)
                    np.maximum.at(t, k, x)
                    first[q], last[q] = f.reshape(-1, BINS), t.reshape(-1, BINS)
                return iter(())

            def end():
                for a in range(0, len(n), 64):
                    i, b = np.nonzero(n[a : a + 64])
                    i += a
                    none = np.zeros(len(i))
                    yield block.rows(i, _b=b.astype(np.int32), _n=n[i, b], _s=none if blank else total[i, b], _lo=none if blank else first[i, b], _hi=none if blank else last[i, b])

            return take, end

        h = _meet(self.q.join(bounded(ends), "query"), self.r, begin, f"query {self.id}, _b int, _n long, _s double, _lo double, _hi double", "ord")
        if self.odd is not None:
            h = h.unionByName(self._odd_bins(ends).select("query", "_b", F.lit(1).cast("long").alias("_n"), F.col("_x").alias("_s"), F.col("_x").alias("_lo"), F.col("_x").alias("_hi")))
        h = h.groupBy("query", "_b").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        return stored(_summed(h, ["query"]), "score-bins")

    def pick(self, ends: DataFrame) -> Callable[[DataFrame], DataFrame]:
        """Adds to given bins the scores (``_x``, summed in order) that they hold."""
        dim, arrow = self.dim, self.arrow

        def begin(held):
            block = _Block(held, dim, arrow)
            low, high = block.number(held, "_min"), block.number(held, "_max")
            wanted = np.zeros((held.num_rows, BINS + 1), dtype=bool)
            for i, b in enumerate(held["_bins"].to_pylist()):
                wanted[i, b] = True

            def take(part):
                for q, _, s, y, error in block.tiles(part):
                    block.settle(q, s, y, error, low[q])
                    b = _bins(s, low[q], high[q])
                    i, j = np.nonzero(wanted[q[:, None], b] & (s >= low[q][:, None]))
                    x = [_in_order(block.vectors[q[i[c : c + 65536]]], y[j[c : c + 65536]]) for c in range(0, len(i), 65536)]
                    if len(i):
                        yield block.rows(q[i], _b=b[i, j].astype(np.int32), _x=np.concatenate(x))

            return take, lambda: iter(())

        def add(bins: DataFrame) -> DataFrame:
            bins = stored(bins, "bins")
            q = self.q.join(bounded(ends), "query").join(bounded(bins.groupBy("query").agg(F.collect_list("_b").alias("_bins"))), "query")
            x = _meet(q, self.r, begin, f"query {self.id}, _b int, _x double", "ord")
            x = x if self.odd is None else x.unionByName(self._odd_bins(ends))
            return x.join(bounded(bins), ["query", "_b"])

        return add

    def over(self, limits: DataFrame, records: DataFrame, nearest: tuple[str, int] | None = None) -> DataFrame:
        """Records with a score of at least a query's ``threshold``; ``nearest`` (a column and a number): at least those with the smallest values, ties by ``ord``."""
        dim, arrow = self.dim, self.arrow
        rest = [c for c in records.columns if c != "embedding"]
        shape = records.select(*rest).limit(0).join(self.queries.select("query").limit(0), F.lit(True)).withColumn("score", F.lit(0.0))
        q, r, odd, _ = _grid(self.queries, records, BLOCK_QUERIES)

        def begin(held):
            block = _Block(held, dim, arrow)
            limit, found = block.number(held, "threshold"), np.zeros(held.num_rows, np.int64)

            def take(part):
                columns = part.select(rest).combine_chunks()
                some = None if nearest is None else lambda: np.flatnonzero(found < nearest[1])  # records come by that column
                for q, b, s, y, error in block.tiles(part, some):
                    block.settle(q, s, y, error, limit[q])
                    hit = s >= limit[q][:, None]
                    if nearest is not None:
                        place = found[q][:, None] + np.cumsum(hit, axis=1)
                        found[q] += hit.sum(axis=1)
                        hit &= place <= nearest[1]
                    i, j = np.nonzero(hit)
                    for c in range(0, len(i), 65536):
                        qi, rj = q[i[c : c + 65536]], j[c : c + 65536]
                        out = columns.take(pa.array(rj + b)).append_column("query", block.ids.take(pa.array(qi))).append_column("score", pa.array(_in_order(block.vectors[qi], y[rj])))
                        yield from out.combine_chunks().to_batches()

            return take, lambda: iter(())

        order = [F.col(nearest[0]).asc_nulls_last(), "ord"] if nearest else []
        made = _meet(q.join(bounded(limits), "query"), r, begin, _ddl(shape), *order)
        return made if odd is None else made.unionByName(odd.join(limits, "query").filter("score >= threshold and not isnan(score)").select(*made.columns))


#: Most queries of a block that keeps bins of each.
BLOCK_QUERIES = 4096


def otsu_of_products(queries: DataFrame, records: DataFrame) -> DataFrame:
    """``query, threshold``: `otsu` of a query's scores with all records, without writing them."""
    p = _Products(queries, records)
    ends = p.ends()
    return _otsu(p.pick(ends), p.bins(ends), ["query"])


def candidates_of_products(queries: DataFrame, records: DataFrame, k: int, percent: float = 0.85, extra: DataFrame | None = None, nearest: tuple[str, int] | None = None) -> DataFrame:
    """`semantic_candidates` of the scores of queries with records, without writing the scores.

    ``extra`` (by ``ord``) is joined to the candidates; with ``nearest`` (one of its columns and a number) a query may come with only
    the candidates that are smallest by it, ties by ``ord``: they are found while records pass by in that order.
    """
    p = _Products(queries, records)
    ends = p.ends()
    cut = stored(_percentile(p.pick(ends), p.bins(ends, counts=True), ["query"], percent), "percentiles")
    upper = stored(ends.join(bounded(cut), "query").select("query", F.col("value").alias("_min"), "_max"), "upper")
    h = p.bins(upper)
    few = h.groupBy("query").agg(F.sum("_n").alias("n")).filter(F.col("n") < k).select("query")
    few = stored(few, "few")
    top = lambda ids: top_k(queries.join(bounded(ids), "query", "left_semi"), records, k).filter("score is not null and not isnan(score)").drop("rank")
    some = not few.isEmpty()
    t = _otsu(p.pick(upper), h.join(bounded(few), "query", "left_anti") if some else h, ["query"])
    t = stored(t.unionByName(otsu(top(few), ["query"], "score")) if some else t, "thresholds")
    # the k best tell whether a query has fewer than k over its threshold
    best = stored(top(t.select("query")), "best")
    many = stored(best.join(t, "query").groupBy("query").agg(F.count_if(F.col("score") >= F.col("threshold")).alias("n")).filter(F.col("n") < k).select("query"), "too-few")
    met = records if extra is None else records.join(extra, "ord")
    rest = best.join(bounded(many), "query", "left_semi")
    over = p.over(t.join(bounded(many), "query", "left_anti"), met, nearest)
    return over.unionByName((rest if extra is None else rest.join(extra, "ord")).select(*over.columns))


def away(position: tuple[float, float, float]) -> Column:
    return F.sqrt(sum(((F.col(c) - p) * (F.col(c) - p) for c, p in zip("yz", position[1:])), (F.col("x") - position[0]) * (F.col("x") - position[0])))


def rank_by_distance(cands: DataFrame, position: tuple[float, float, float], k: int) -> DataFrame:
    c = cands.withColumn("distance", away(position))
    return c.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy("distance", "ord"))).filter(F.col("place") <= k)


def best_evidence(cands: DataFrame) -> DataFrame:
    """Per label the best view: depth, depth share, score (border views count 0.4), pixels, then the earliest frame."""
    score = F.col("area") * F.when(F.col("border"), 0.4).otherwise(1.0)
    c = cands.withColumn("score", score)
    w = W.partitionBy("label").orderBy(F.desc("has_depth"), F.desc("depth_ratio"), F.desc("score"), F.desc("pixels"), "frame")
    return c.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def uniform_select(rows: DataFrame, group: str, order: str, m: int, must: Column) -> DataFrame:
    """``m`` rows of each group at even steps of the order; a ``must`` row that was missed takes the last place."""
    w = W.partitionBy(group).orderBy(order)
    r = rows.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(group)))
    steps = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / max(m - 1, 1)))
    r = r.withColumn("_in", (F.col("_n") <= m) | F.array_contains(steps, F.col("_i").cast("bigint"))).withColumn("_must", must)
    miss = F.bool_or(F.col("_must") & ~F.col("_in")).over(W.partitionBy(group))
    first = F.min(F.when(F.col("_must") & ~F.col("_in"), F.col("_i"))).over(W.partitionBy(group))
    last = F.max(F.when(F.col("_in"), F.col("_i"))).over(W.partitionBy(group))
    r = r.withColumns({"_miss": miss, "_first": first, "_last": last})
    keep = F.when(F.col("_miss"), (F.col("_in") & (F.col("_i") != F.col("_last"))) | (F.col("_i") == F.col("_first"))).otherwise(F.col("_in"))
    return r.filter(keep).select(*rows.columns)


def farthest_first(objects: DataFrame, group: str, k: int) -> DataFrame:
    """``k`` objects of each region that spread over its embeddings: ``group, ord, pick``.

    Starts farthest from the mean; then whatever is farthest from all that were chosen, the lowest ``ord``
    of equals.  ``k`` rounds over a stored table, so no task holds a region.  Regions of up to ``k`` objects come whole, by ``ord``.
    """
    def meet(rows: DataFrame, side: DataFrame) -> DataFrame:  # one row a region, also for a null region
        return rows.join(bounded(side.withColumnRenamed(group, "_g")), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")

    e = objects.select(group, "ord", F.col("embedding").cast("array<double>").alias("embedding")).withColumn("_l", norm(F.col("embedding")))
    e = e.withColumn("embedding", F.transform("embedding", lambda x: x / F.when(F.col("_l") == 0, 1.0).otherwise(F.col("_l")))).drop("_l")
    n = e.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    few = meet(e, n.filter(F.col("_n") <= k)).select(group, "ord", (F.row_number().over(W.partitionBy(group).orderBy("ord")) - 1).cast("bigint").alias("pick"))
    many = meet(e, n.filter(F.col("_n") > k)).drop("_n")
    axis = many.select(group, F.posexplode("embedding").alias("_d", "_x")).groupBy(group, "_d").agg(F.avg("_x").alias("_x"))
    at = axis.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_x"))), lambda s: s["_x"]).alias("_at"))
    at = at.withColumn("_l", norm(F.col("_at")))
    far = 1 - dot(F.col("embedding"), F.col("_at")) / F.when(F.col("_l") == 0, 1.0).otherwise(F.col("_l"))
    left = stored(meet(many, at).withColumn("_far", far).drop("_at", "_l"), "farthest")
    picks = few
    for i in range(k):
        best = F.max_by(F.struct("ord", "embedding"), F.struct(F.col("_far"), (-F.col("ord")).alias("_o")))
        new = stored(left.groupBy(group).agg(best.alias("_b")).select(group, F.col("_b.ord").alias("_ord"), F.col("_b.embedding").alias("_e")), "picks")
        picks = picks.unionByName(new.select(group, F.col("_ord").alias("ord"), F.lit(i).cast("bigint").alias("pick")))
        if i + 1 < k:
            apart = 1 - dot(F.col("embedding"), F.col("_e"))
            left = meet(left, new).filter(F.col("ord") != F.col("_ord"))
            left = stored(left.withColumn("_far", F.least("_far", apart) if i else apart).drop("_ord", "_e"), "farthest")
    return picks


def qualified_tracks(obs: DataFrame, least: int, prompted: DataFrame | None = None) -> DataFrame:
    """Tracks with some valid depth, seen in at least ``least`` frames and not prompted yet."""
    t = obs.groupBy("task", "track").agg(F.bool_or("depth_valid").alias("_d"), F.countDistinct("frame").alias("_n")).filter((F.col("_n") >= least) & F.col("_d")).select("task", "track")
    return t if prompted is None else t.join(prompted, ["task", "track"], "left_anti")


def greedy_frame_cover(obs: DataFrame, least: int = 2, batch: int = 64) -> DataFrame:
    """Frames that show every qualified track: ``task, pick, frame, track, batch``; the frame with most new tracks first, the earliest of equals."""
    use = obs.select("task", "frame", "track", "depth_valid").dropna(subset=["task", "frame", "track"])

    def cover(pdf: pd.DataFrame) -> pd.DataFrame:
        # as in `qualified_tracks`, but in the task that has the rows anyway
        seen = pdf.groupby("track").agg(frames=("frame", "nunique"), depth=("depth_valid", lambda d: (d == True).any()))  # noqa: E712
        pdf = pdf[pdf["track"].isin(seen.index[(seen["frames"] >= least) & seen["depth"]])]
        frames = {f: set(g) for f, g in sorted(pdf.groupby("frame")["track"])}
        left, out, n = set(pdf["track"]), [], 0
        while left:
            frame = max(frames, key=lambda f: (len(frames[f] & left), -f))
            new = sorted(frames.pop(frame) & left)
            out += [(pdf["task"].iloc[0], n, frame, t) for t in new]
            left -= set(new)
            n += 1
        res = pd.DataFrame(out, columns=["task", "pick", "frame", "track"])
        res["batch"] = res["pick"] // batch
        return res

    return use.groupBy("task").applyInPandas(cover, "task long, pick long, frame long, track long, batch long")


def best_frame_assignment(cover: DataFrame, obs: DataFrame) -> DataFrame:
    """Each covered track goes to the chosen frame with its largest ``reward``, the earliest of equals."""
    frames, tracks = cover.select("task", "frame").distinct(), cover.select("task", "track").distinct()
    o = obs.join(frames, ["task", "frame"]).join(tracks, ["task", "track"])
    w = W.partitionBy("task", "track").orderBy(F.desc("reward"), "frame")
    return o.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("task", "track", "frame", "reward")


def select_nonoverlapping(pairs: DataFrame, group: str, radius: int, most: int) -> DataFrame:
    """Pairs by falling quality, leaving out those with both ends within ``radius`` of a taken pair."""
    kind = dict(pairs.dtypes)[group]

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["quality", "a", "b"], ascending=[False, True, True])
        taken: list[tuple[int, int]] = []
        for a, b in pdf[["a", "b"]].itertuples(index=False):
            if all(abs(a - x) > radius or abs(b - y) > radius for x, y in taken):
                taken.append((a, b))
                if len(taken) == most:
                    break
        return pd.DataFrame({group: pdf[group].iloc[0], "a": [t[0] for t in taken], "b": [t[1] for t in taken]})

    return pairs.groupBy(group).applyInPandas(pick, f"{group} {kind}, a long, b long")


def finite_sample(population: DataFrame, id_: str, fraction: float, seed: int) -> DataFrame:
    """``ceil(n * fraction)`` rows without replacement: those with the smallest seeded hash of their id.

    Counts of the hashes' first four digits give the digits at which the sample ends; only the rows of that one
    bin are ranked, so no task sorts the sample.
    """
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(id_).cast("string")), 256)
    p = population.withColumn("_h", digest).withColumn("_bin", F.substring("_h", 1, 4))
    bins = p.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n")).orderBy("_bin").collect()  # at most 16**4 rows
    want, at = math.ceil(sum(r["_n"] for r in bins) * fraction), None
    for r in bins:
        at = r["_bin"]
        if want <= r["_n"]:
            break
        want -= r["_n"]
    edge = p.filter(F.col("_bin") == at).orderBy("_h", id_).limit(want)
    return p.filter(F.col("_bin") < at).unionByName(edge).drop("_h", "_bin")


def population_digest(population: DataFrame, id_: str) -> DataFrame:
    """One row: how many ids a population has and a digest of them that no order changes."""
    h = F.xxhash64(F.col(id_).cast("string")).cast("decimal(38,0)")
    return population.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.coalesce(F.sum(h), F.lit(0)).cast("string"), 256).alias("digest"))


def split_ranges(frames: DataFrame, ranges: list[tuple[str, int, int]], index: str) -> DataFrame:
    """Adds ``split``: the named range ``[first, last]`` of each frame; null outside all. Ranges must not overlap."""
    ordered = sorted(ranges, key=lambda r: r[1])
    if any(a[2] >= b[1] for a, b in zip(ordered, ordered[1:])):
        raise ValueError("splits overlap")
    return frames.withColumn("split", F.coalesce(*[F.when(F.col(index).between(lo, hi), F.lit(name)) for name, lo, hi in ordered]))


def attach_embeddings(records: DataFrame, encoder: str) -> DataFrame:
    """Adds ``embedding``: every distinct description is encoded once by the registered encoder and joined back."""
    from maploom.operators.registry import encode

    unique = records.select("description").distinct()
    encoded = unique.select("description", encode(encoder, F.col("description")).alias("embedding"))
    return records.join(encoded, "description", "left")


def tfidf(words: DataFrame) -> DataFrame:
    """``item, word, weight``: counts times ``ln((N + 1) / (df + 1)) + 1``, scaled to unit length per item."""
    tf = stored(words.groupBy("item", "word").agg(F.count(F.lit(1)).alias("tf")), "term-counts")
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    n = tf.select("item").distinct().count()
    t = tf.join(df, "word").withColumn("raw", F.col("tf") * (F.log(F.lit(n + 1.0) / (F.col("df") + 1)) + 1))
    length = t.groupBy("item").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length"))
    return t.join(length, "item").select("item", "word", (F.col("raw") / F.col("length")).alias("weight"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _csr(words: pa.ListArray, values: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the rows, and their words and values one after another."""
    return np.asarray(words.value_lengths()).astype(np.int64), words.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False)


def _lists(lengths: np.ndarray, *values: np.ndarray) -> list[pa.ListArray]:
    ends = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    return [pa.ListArray.from_arrays(ends, pa.array(v)) for v in values]


def word_vectors(bags: DataFrame) -> DataFrame:
    """``item, words, weights``: the vectors of `tfidf`, a row an item, hashes of words in order; ``bags``: ``item, words`` (all its words, repeats included).

    Words are counted where a row lies, so only counts of words travel.  A word that a single item has needs no look-up.
    """
    b = bags.filter(F.size("words") > 0)
    if not bags.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():  # reads no words
        b = b.groupBy("item").agg(F.flatten(F.collect_list("words")).alias("words"))
    b = b.select("item", F.transform("words", lambda w: F.xxhash64(w)).alias("words"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            row = np.repeat(np.arange(batch.num_rows), np.asarray(words.value_lengths()))
            known, code = np.unique(words.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            key, n = np.unique(row * max(len(known), 1) + code, return_counts=True)
            lengths = np.bincount(key // max(len(known), 1), minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("item"), *_lists(lengths, known[key % max(len(known), 1)], n.astype(np.int32))], names=["item", "words", "counts"])

    kind = dict(bags.dtypes)["item"]
    c = stored(b.mapInArrow(count, f"item {kind}, words array<long>, counts array<int>"), "term-lists")
    n = c.count()
    df = stored(c.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "word-counts")
    small = df.limit(2_000_001).count() <= 2_000_000
    t = c.select("item", F.size("words").alias("size"), F.explode(F.arrays_zip("words", "counts")).alias("e")).select("item", "size", F.col("e.words").alias("word"), F.col("e.counts").alias("tf"))
    t = t.join(F.broadcast(df) if small else df, "word", "left")
    t = t.select("item", "size", "word", (F.col("tf") * (F.log(F.lit(n + 1.0) / (F.coalesce("df", F.lit(1)) + 1)) + 1)).alias("raw"))
    if not small:  # else the rows of an item still follow each other
        t = dealt(t, "item").sortWithinPartitions("item", "word")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            whole = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            sizes = whole["size"].to_numpy()
            start, starts = 0, []
            while start < len(sizes) and start + sizes[start] <= len(sizes):
                starts.append(start)
                start += sizes[start]
            rest = whole.slice(start)
            if starts:
                yield packed(whole.slice(0, start).combine_chunks(), np.array(starts), sizes[starts].astype(np.int64))
        if rest is not None and rest.num_rows:
            raise RuntimeError("the rows of an item are apart")

    def packed(rows: pa.Table, starts: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        items = rows["item"].combine_chunks()
        first = items.take(pa.array(np.repeat(starts, lengths)))
        if not pc.all(pc.fill_null(pc.equal(items, first), True)).as_py():
            raise RuntimeError("the rows of an item are apart")
        word, raw, row = rows["word"].to_numpy(), rows["raw"].to_numpy(), np.repeat(np.arange(len(starts)), lengths)
        o = np.lexsort((word, row))
        word, raw = word[o], raw[o]
        length = np.sqrt(np.add.reduceat(raw * raw, starts))
        return pa.RecordBatch.from_arrays([items.take(pa.array(starts)), *_lists(lengths, word, raw / np.repeat(length, lengths))], names=["item", "words", "weights"])

    return stored(t.mapInArrow(pack, f"item {kind}, words array<long>, weights array<double>"), "vectors")


#: Places of a vector's outline: a word of its own each for the heaviest words, shared ones for all others.
OWN, SHARED = 64, 960
#: Most items of a block, and most words of its vectors; items that meet a block at once.
BLOCK, WORDS, TILE = 16384, 1 << 23, 512


def similar_pairs(vectors: DataFrame, min_sim: float) -> DataFrame:
    """``a < b, score``: pairs of unit vectors (``item, word, weight``) with a product of at least ``min_sim``."""
    v = vectors.groupBy("item").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("word").alias("word"), "weight"))).alias("v"))
    return similar_lists(stored(v.select("item", F.transform("v", lambda e: e["word"]).alias("words"), F.transform("v", lambda e: e["weight"]).alias("weights")), "vectors"), min_sim)


def similar_lists(vectors: DataFrame, min_sim: float, most: int | None = None) -> DataFrame:
    """``a < b, score``: pairs of unit vectors (``item, words, weights``, words in order) with a product of at least ``min_sim``.

    An outline holds the norm of a vector's weights at each of a fixed number of places, so the product of two outlines is never under that of the
    vectors.  Blocks of vectors meet two by two, so vectors travel, not pairs; what outlines leave is summed at once.
    ``most``: of two blocks, only pairs go on that are among the best so many of one end (by nine digits, then the smaller item), and some that round to the same.
    """
    spark = vectors.sparkSession

    def heaviest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, word, weight = _csr(batch.column("words"), batch.column("weights"))
            known, code = np.unique(word, return_inverse=True)
            w = np.bincount(code, weights=weight * weight, minlength=len(known))
            top = np.argsort(-w)[: 4 * OWN]
            yield pa.RecordBatch.from_arrays([pa.array(known[top]), pa.array(w[top])], names=["word", "w"])

    heavy = vectors.mapInArrow(heaviest, "word long, w double").groupBy("word").agg(F.sum("w").alias("w")).orderBy(F.desc("w"), "word").limit(OWN)
    own = np.sort(np.array([r["word"] for r in heavy.select("word").collect()], dtype=np.int64))  # at most OWN; others would do as well
    n, words = (v or 0 for v in vectors.agg(F.count(F.lit(1)), F.sum(F.size("words"))).first())
    blocks = max(1, math.ceil(n / BLOCK), math.ceil(words / WORDS), min(math.ceil(n / TILE), math.ceil(math.sqrt(6 * spark.sparkContext.defaultParallelism))))
    width = OWN + SHARED

    def outline(lengths: np.ndarray, word: np.ndarray, weight: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(own, word), max(len(own) - 1, 0))
        place = np.where(own[at] == word, at, OWN + word % SHARED) if len(own) else OWN + word % SHARED
        where = np.repeat(np.arange(len(lengths)), lengths) * width + place
        return np.sqrt(np.bincount(where, weights=weight * weight, minlength=len(lengths) * width)).astype(np.float32).reshape(-1, width)

    def outlines(lengths: np.ndarray, word: np.ndarray, weight: np.ndarray) -> np.ndarray:
        ends, out = np.r_[0, np.cumsum(lengths)], np.empty((len(lengths), width), dtype=np.float32)
        for k in range(0, len(lengths), 1024):
            part = slice(ends[k], ends[min(k + 1024, len(lengths))])
            out[k : k + 1024] = outline(lengths[k : k + 1024], word[part], weight[part])
        return out

    def met(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = (k.as_py() for k in key)
        block = rows["block"].to_numpy()
        rows = rows.take(pa.array(np.argsort(block, kind="stable"))).combine_chunks()
        ids = rows["item"].to_numpy()
        lengths, word, weight = _csr(rows["words"].combine_chunks(), rows["weights"].combine_chunks())
        cut = int((block == i).sum())
        second = 0 if i == j else cut  # where the second block begins
        if not cut or second == len(ids):
            return pairs.empty_table()
        m, starts, at, spread = outlines(lengths, word, weight), np.cumsum(lengths) - lengths, None, None
        best = np.full((len(ids), most), -np.inf) if most else None  # of each item so far
        found = [np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)]

        def sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            """Products of the vectors of ``x``, in order, and ``y``: one side spread out, the lists of its partners against it."""
            score, cuts = np.empty(len(x)), np.flatnonzero(np.diff(x, prepend=-1, append=-1))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                mine = slice(starts[x[lo]], starts[x[lo]] + lengths[x[lo]])
                spread[at[mine]] = weight[mine]
                for c in range(lo, hi, 256):
                    other = y[c : min(c + 256, hi)]
                    many = lengths[other]
                    begin = np.cumsum(many) - many
                    where = np.arange(many.sum()) + np.repeat(starts[other] - begin, many)
                    score[c : c + len(other)] = np.add.reduceat(spread[at[where]] * weight[where], begin)
                spread[at[mine]] = 0.0
            if most:
                ends, both = np.r_[x, y], np.r_[score, score]
                o = np.lexsort((-both, ends))
                ends, both = ends[o], both[o]
                place = np.arange(len(ends)) - np.searchsorted(ends, ends)
                known, row = np.unique(ends, return_inverse=True)
                more = np.full((len(known), most), -np.inf)
                more[row[place < most], place[place < most]] = both[place < most]
                best[known] = -np.sort(-np.concatenate([best[known], more], axis=1), axis=1)[:, :most]
            return score

        for k in range(0, cut, TILE):
            x, y, bound = [], [], []
            for l in range(second, len(ids), 8192):
                s = m[k : min(k + TILE, cut)] @ m[l : l + 8192].T
                f = np.flatnonzero(s >= min_sim - 1e-3)  # more than single precision loses
                x.append(f // s.shape[1] + k), y.append(f % s.shape[1] + l), bound.append(s.ravel()[f])
            x, y, bound = np.concatenate(x), np.concatenate(y), np.concatenate(bound)
            if i == j:
                x, y, bound = x[x < y], y[x < y], bound[x < y]
            if not len(x):
                continue
            if at is None:
                at = np.unique(word, return_inverse=True)[1]
                spread = np.zeros(at.max() + 1)
            o = np.lexsort((-bound, x))
            x, y, bound = x[o], y[o], bound[o]
            if most:  # those with the best bounds first; others only if their bound reaches what an end has by then
                first = np.arange(len(x)) - np.searchsorted(x, x) < most
                o = np.lexsort((-bound, y))
                first[o[np.arange(len(y)) - np.searchsorted(y[o], y[o]) < most]] = True
                score = np.full(len(x), -np.inf)
                score[first] = sums(x[first], y[first])
                rest = ~first & (bound + 1e-4 >= np.minimum(best[x, -1], best[y, -1]))
                score[rest] = sums(x[rest], y[rest])
            else:
                score = sums(x, y)
            good = score >= min_sim
            a, b = ids[x[good]], ids[y[good]]
            found = [np.r_[f, v] for f, v in zip(found, (np.minimum(a, b), np.maximum(a, b), score[good]))]
            if most:
                kept = _best_of_ends(*found, most)
                found = [f[kept] for f in found]
        return pa.table(found, schema=pairs)

    pairs = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64())])
    v = vectors.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    v = v.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"i": F.least("block", "_k"), "j": F.greatest("block", "_k")}).drop("_k")
    # a task a pair of blocks, as nearly as a hash does it
    return v.repartition(2 * blocks * (blocks + 1), "i", "j").groupBy("i", "j").applyInArrow(met, "a long, b long, score double")


def _best_of_ends(a: np.ndarray, b: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the best ``most`` of one end by nine digits of the score, then the smaller other end; those whose rounding is in doubt stay."""
    scaled = score * 1e9
    doubt = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3
    keep, sure = doubt.copy(), np.flatnonzero(~doubt)
    digits = np.rint(scaled)
    for me, other in ((a, b), (b, a)):
        o = sure[np.lexsort((other[sure], -digits[sure], me[sure]))]
        place = np.arange(len(o)) - np.searchsorted(me[o], me[o])
        keep[o[place < most]] = True
    return keep


def retrieve_pairs(vectors: DataFrame, apart: int, k: int, min_sim: float) -> DataFrame:
    """Pairs ``a < b`` that one side ranks among its best ``k``, at least ``apart`` items away: ``a, b, score``; ``vectors``: those of `word_vectors`.

    Scores rank by nine digits, then the smaller item.  Items with equal vectors form a class; classes are compared,
    not their members.  A member leaves out at most ``2 * apart - 1`` items (itself included), so the best
    ``k + 2 * apart - 1`` items of its class's list hold its best ``k``; and those lie in as many classes.
    """
    most = k + 2 * apart - 1

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, word, weight = _csr(batch.column("words"), batch.column("weights"))
            word, digits, starts = word.astype(np.uint64), np.rint(weight * 1e9).astype(np.uint64), np.cumsum(lengths) - lengths
            p = [np.add.reduceat(_mixed(_mixed(word + np.uint64(seed)) ^ digits), starts).astype(np.int64) if len(word) else np.empty(0, np.int64) for seed in (1, 2)]
            own = np.add.reduceat(weight * weight, starts) if len(word) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("item"), *map(pa.array, (*p, own))], names=["item", "p1", "p2", "own"])

    prints = stored(vectors.mapInArrow(fingerprint, "item long, p1 long, p2 long, own double"), "prints")
    classes = prints.groupBy("p1", "p2").agg(F.min("item").alias("cls"), F.count(F.lit(1)).alias("n"), F.max("own").alias("own"))
    classes = stored(prints.select("item", "p1", "p2").join(bounded(classes), ["p1", "p2"]).select("item", "cls", "n", "own"), "classes")
    copies = classes.filter("item <> cls").select("item")
    s = stored(similar_lists(vectors.join(bounded(copies), "item", "left_anti"), min_sim, most), "similar")
    own = classes.filter("item = cls and n > 1").select(F.col("cls").alias("me"), F.col("cls").alias("other"), F.col("own").alias("score"))
    sides = s.select(F.col("a").alias("me"), F.col("b").alias("other"), "score").union(s.select(F.col("b").alias("me"), F.col("a").alias("other"), "score")).union(own)
    best = W.partitionBy("me").orderBy(F.desc(F.round("score", 9)), "other")
    sides = sides.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= most).drop("_r")  # a class is named by its first item
    first = classes.withColumn("_r", F.row_number().over(W.partitionBy("cls").orderBy("item"))).filter(F.col("_r") <= most).select(F.col("cls").alias("cls_o"), F.col("item").alias("other"))
    listed = sides.withColumnRenamed("other", "cls_o").join(first, "cls_o").withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= most)
    lists = listed.groupBy(F.col("me").alias("cls")).agg(F.collect_list(F.struct("other", "score")).alias("l"))
    each = classes.select(F.col("item").alias("me"), "cls").join(bounded(lists), "cls").select("me", F.inline("l")).filter(F.abs(F.col("me") - F.col("other")) >= apart)
    r = each.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k)
    return r.groupBy(F.least("me", "other").alias("a"), F.greatest("me", "other").alias("b")).agg(F.max("score").alias("score"))


def alias_conflict(ranked: DataFrame, copies: int) -> DataFrame:
    """Margin of each query before and after ``copies`` duplicates of its best match are put in and the matches ranked again.

    ``ranked``: ``query, ord, score, rank`` with at least two ranks, as :func:`top_k` gives them.  Duplicates have the best match's score.
    """
    def margin(r: DataFrame, name: str) -> DataFrame:
        return r.filter("rank <= 2").groupBy("query").agg((F.max(F.when(F.col("rank") == 1, F.col("score"))) - F.max(F.when(F.col("rank") == 2, F.col("score")))).alias(name))

    put_in = ranked.filter("rank = 1").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies)))).filter("_copy > 0")
    both = ranked.select("query", "ord", "score", F.lit(0).alias("_copy")).unionByName(put_in.select("query", "ord", "score", "_copy"))
    again = both.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "ord", "_copy")))
    j = margin(ranked, "margin").join(margin(again, "margin_after"), "query")
    return j.withColumn("drop", F.col("margin") - F.col("margin_after"))


def find_by_name(entities: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """Entities (deleted ones too) whose name or alias equals ``name`` ignoring case."""
    wanted = name.lower()
    by_name = entities.filter(F.lower("name") == wanted).select("entity")
    return by_name.union(aliases.filter(F.lower("alias") == wanted).select("entity")).distinct()


def current_position(trajectory: DataFrame, key: str, t: str) -> DataFrame:
    return trajectory.groupBy(key).agg(F.max_by("x", t).alias("x"), F.max_by("y", t).alias("y"), F.max(t).alias("t"))


def evaluate_queries(decisions: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: pass rate, recall of the queries that should find something, rejection of the others.

    ``expected``: ``query, expected_found, expected_terms, text`` (of the top match, may be null), and where known
    ``evidence`` (of the top match) and ``latency_ms``: then also the share of found queries with evidence, and mean and largest latency.
    """
    d = judged_queries(decisions, expected)
    rate = lambda c, when: F.avg(F.when(when, c.cast("double")))
    more = [rate(F.coalesce(F.length("evidence") > 0, F.lit(False)), F.col("found")).alias("evidence_coverage")] if "evidence" in d.columns else []
    more += [F.avg("latency_ms").alias("latency_mean"), F.max("latency_ms").alias("latency_max")] if "latency_ms" in d.columns else []
    return d.agg(F.count(F.lit(1)).alias("queries"), F.avg(F.col("ok").cast("double")).alias("pass_rate"), rate(F.col("found"), F.col("expected_found")).alias("recall"), rate(~F.col("found"), ~F.col("expected_found")).alias("rejection"), *more)


def judged_queries(decisions: DataFrame, expected: DataFrame) -> DataFrame:
    """``expected`` with ``found`` and ``ok``: a query passes if it finds something just when it should, and then a term is in the top match's text."""
    d = decisions.groupBy("query").agg(F.bool_or("found").alias("found")).join(expected, "query")
    term = F.exists("expected_terms", lambda t: F.contains(F.lower("text"), F.lower(t))) | (F.size("expected_terms") == 0)
    ok = (F.col("found") == F.col("expected_found")) & (~F.col("expected_found") | F.coalesce(term, F.lit(False)))
    return d.withColumn("ok", ok)


def rejected_to_sidecar(events: DataFrame, entities: DataFrame, obs: DataFrame) -> DataFrame:
    """Sidecar records of entities whose binding ended without a mesh: interval, status, and a conflict flag.

    ``events``: ``entity, status``; an entity must end in one status only.  Records with
    a position are ``spatial_only``, others ``image_only``.
    """
    ends = events.filter(F.col("status").startswith("rejected")).groupBy("entity").agg(F.countDistinct("status").alias("_n"), F.min("status").alias("status"))
    span = obs.groupBy("entity").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.max(F.col("x").isNotNull()).alias("_placed"))
    r = ends.join(entities.filter("not deleted"), "entity").join(span, "entity", "left")
    kind = F.when(F.coalesce("_placed", F.lit(False)), "spatial_only").otherwise("image_only")
    return r.filter((F.col("status") == "rejected_no_mesh") | (F.col("_n") > 1)).select("entity", "name", "first", "last", kind.alias("geometry_status"), (F.col("_n") > 1).alias("conflict"))
