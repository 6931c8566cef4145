"""Data-quality expectations and gates: every check gives rows that say what was judged and whether it passed."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def check_rules(df: DataFrame, id_: str, rules: dict[str, Column]) -> DataFrame:
    """``id, rule`` of every broken rule; a rule that is null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return df.select(F.col(id_).alias("id"), F.explode(broken).alias("rule"))


def correction_rules() -> dict[str, Column]:
    return {"operation_id": F.length("op") > 0, "confidence": F.col("confidence").between(0, 1), "revision": F.col("revision") >= 0, "label": F.length(F.trim("label")) > 0, "time": F.col("us") > 0}


def check_monotonic(df: DataFrame, key: str, t: str, order: str) -> DataFrame:
    """Per key: whether time always rises, and the first row where it doesn't."""
    w = W.partitionBy(key).orderBy(order)
    d = df.withColumn("_bad", F.coalesce(F.col(t) <= F.lag(t).over(w), F.lit(False)))
    return d.groupBy(key).agg((~F.bool_or("_bad")).alias("passed"), F.min(F.when(F.col("_bad"), F.col(order))).alias("first_offender"))


def check_pose(df: DataFrame, id_: str, m: str) -> DataFrame:
    """Rules of rigid 4x4 poses: finite, last row, orthonormal, determinant one."""
    c = lambda r, k: F.get(m, F.lit(4 * r + k))
    finite = F.forall(m, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    last = reduce(lambda a, b: a & b, [F.abs(c(3, k) - float(k == 3)) <= 1e-8 for k in range(4)])
    ortho = reduce(lambda a, b: a & b, [F.abs(sum((c(i, a) * c(i, b) for i in range(1, 3)), c(0, a) * c(0, b)) - float(a == b)) <= 1e-5 for a in range(3) for b in range(a, 3)])
    det = c(0, 0) * (c(1, 1) * c(2, 2) - c(1, 2) * c(2, 1)) - c(0, 1) * (c(1, 0) * c(2, 2) - c(1, 2) * c(2, 0)) + c(0, 2) * (c(1, 0) * c(2, 1) - c(1, 1) * c(2, 0))
    return check_rules(df, id_, {"finite": finite, "homogeneous": last, "orthonormal": ortho, "determinant": F.abs(det - 1) <= 1e-3})


def covariance_ok(cov: Column) -> Column:
    """Whether a flat square matrix is symmetric and positive semidefinite (Arrow batches of eigenvalues)."""

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        def one(v) -> bool:
            n = int(round(len(v) ** 0.5))
            a = np.asarray(v, dtype=float).reshape(n, n)
            return bool(np.isfinite(a).all() and np.abs(a - a.T).max() <= 1e-10 and np.linalg.eigvalsh(a).min() >= -1e-10)

        return s.map(one)

    return run(cov)


def check_unique(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_manifest(records: DataFrame, manifest: dict[str, int]) -> DataFrame:
    """``item, declared, found, passed``: what a manifest says against the data, from one pass."""
    a = records.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("label").alias("labels"), F.max(F.size("embedding")).cast("bigint").alias("dimension"))
    found = a.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in manifest]), F.array(*[F.col(k) for k in manifest]))).alias("item", "found"))
    said = F.create_map(*[x for k, v in manifest.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])
    return found.select("item", said[F.col("item")].alias("declared"), "found", (said[F.col("item")] == F.col("found")).alias("passed"))


def run_gates(evidence: DataFrame, gates: list[tuple[str, str, str, float, float, bool]]) -> DataFrame:
    """``id, stage, code, status, hard``: per gate (stage, code, column, warn, fail, hard); missing evidence fails."""
    each = []
    for stage, code, col, warn, fail, hard in gates:
        status = F.when(F.col(col).isNull(), "FAIL").when(F.col(col) > fail, "FAIL").when(F.col(col) > warn, "WARN").otherwise("PASS")
        each.append(F.struct(F.lit(stage).alias("stage"), F.lit(code).alias("code"), status.alias("status"), F.lit(hard).alias("hard")))
    return evidence.select("id", F.explode(F.array(*each)).alias("g")).select("id", "g.*")


def gates_passed(gated: DataFrame) -> DataFrame:
    bad = F.col("hard") & (F.col("status") == "FAIL")
    return gated.groupBy("id").agg((~F.bool_or(bad)).alias("passed"), F.array_join(F.array_sort(F.collect_set(F.when(bad, F.col("code")))), ",").alias("blocking"))


def check_graph_commit(objects: DataFrame, places: DataFrame, memory: DataFrame) -> DataFrame:
    """Broken rules of committed objects (``id, entity, name, parent``) against places and memory."""
    m = memory.select(F.col("entity"), F.col("name").alias("known"), "deleted")
    p = places.select(F.col("place").alias("parent"), F.lit(True).alias("_p"))
    j = objects.join(m, "entity", "left").join(p, "parent", "left")
    n = F.count(F.lit(1)).over(W.partitionBy("entity"))
    j = j.withColumn("_n", n)
    return check_rules(j, "id", {"described": F.length("name") > 0, "unique_entity": F.col("_n") == 1, "in_memory": F.col("known").isNotNull(), "active": ~F.col("deleted"), "has_place": F.col("_p").isNotNull(), "same_name": F.lower("known") == F.lower("name")})


def detection_by_dose(df: DataFrame, doses: list[float], value: str, limit: float) -> DataFrame:
    """Share of rows that a limit catches after each dose of an offset."""
    d = df.withColumn("dose", F.explode(F.array(*[F.lit(float(x)) for x in doses])))
    return d.groupBy("dose").agg(F.count(F.lit(1)).alias("n"), F.avg((F.abs(F.col(value) + F.col("dose")) > limit).cast("double")).alias("detected"))


LABEL_FIELDS = ("time", "configuration", "digest", "dtype", "shape")


def check_label_frames(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``frame, problem``: frames missing on one side, and the first of ``LABEL_FIELDS`` that differs (null equals null only)."""
    side = lambda df, n: df.select("frame", F.lit(True).alias(n), *[F.col(c).alias(f"{n}_{c}") for c in LABEL_FIELDS])
    j = side(expected, "_e").join(side(actual, "_a"), "frame", "full")
    p = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected")
    for c in LABEL_FIELDS:
        p = p.when(~F.col(f"_e_{c}").eqNullSafe(F.col(f"_a_{c}")), f"{c}_differs")
    return j.select("frame", p.alias("problem")).filter("problem is not null")


def label_coverage(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``expected, good, coverage, passed``: the share of expected frames without a problem must be all; none expected fails."""
    bad = check_label_frames(expected, actual).filter("problem <> 'unexpected'").agg(F.count(F.lit(1)).alias("_b"))
    n = expected.agg(F.count(F.lit(1)).alias("expected")).join(bad, F.lit(True))
    n = n.select("expected", (F.col("expected") - F.col("_b")).alias("good"))
    share = F.when(F.col("expected") > 0, F.col("good") / F.col("expected")).otherwise(0.0)
    return n.select("expected", "good", share.alias("coverage"), (share == 1).alias("passed"))
