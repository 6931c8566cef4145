"""Operators on pixel tables (one row per frame and pixel), vertices and point clouds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def round_floats(df: DataFrame, places: int = 4) -> DataFrame:
    """Every float in the table, nested ones too, rounded half to even."""

    def go(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.bround(c, places)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: go(x, kind.elementType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[go(c[f.name], f.dataType).alias(f.name) for f in kind]))
        return c

    return df.select(*[go(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def format_object(objects: DataFrame) -> DataFrame:
    """``object_id`` (``o(n)`` for background objects), ``description``, ``is_background``."""
    name = F.when(F.col("is_background"), F.concat(F.lit("o("), F.col("id").cast("string"), F.lit(")"))).otherwise(F.col("id").cast("string"))
    return objects.select(name.alias("object_id"), "description", "is_background")


def static_depth_isolation(px: DataFrame, least_weight: float) -> DataFrame:
    """Adds ``excluded`` (moving, unknown, invalid or light pixels) and sets their ``depth`` and ``weight`` to 0 as ``kept_*``."""
    out = F.col("dynamic") | F.col("unknown") | ~F.col("valid") | (F.col("weight") < least_weight)
    px = px.withColumn("excluded", out)
    zero = lambda c: F.when(F.col("excluded"), 0.0).otherwise(F.col(c))
    return px.withColumn("kept_depth", zero("depth")).withColumn("kept_weight", zero("weight"))


def isolation_report(px: DataFrame) -> DataFrame:
    """Per frame: pixel counts, the moving share of valid depth, and moving pixels that still carry depth."""
    total = lambda c: F.sum(c.cast("bigint"))
    return px.groupBy("frame").agg(
        F.count(F.lit(1)).alias("pixels"), total(F.col("dynamic")).alias("dynamic"), total(F.col("unknown")).alias("unknown"),
        total(~F.col("valid")).alias("invalid"), total(F.col("excluded")).alias("excluded"),
        F.round(total(F.col("dynamic") & F.col("valid")) / F.greatest(total(F.col("valid")), F.lit(1)), 6).alias("contamination"),
        total(F.col("dynamic") & (F.col("kept_depth") > 0)).alias("leaked"),
    )


def flow_classify(px: DataFrame, most_error: float = 1.5, least_residual: float = 2.5, least_pixels: int = 24) -> DataFrame:
    """Adds ``reliable``, ``dynamic`` and ``unknown``; few moving pixels in a frame count as unknown."""
    finite = ~F.isnan("residual") & (F.abs("residual") < float("inf"))
    px = px.withColumn("reliable", F.col("valid") & finite & (F.col("fb_error") <= most_error))
    px = px.withColumn("_moving", F.col("reliable") & (F.col("residual") > least_residual))
    enough = F.sum(F.col("_moving").cast("bigint")).over(W.partitionBy("frame")) >= least_pixels
    px = px.withColumn("dynamic", F.col("_moving") & enough).withColumn("unknown", ~F.col("reliable") | (F.col("_moving") & ~enough))
    return px.drop("_moving")


def scale_and_clip(px: DataFrame, depth: str, scale: float, most: int) -> DataFrame:
    """Adds ``scaled`` (integer depth times scale, 0 where over ``most``) and ``clipped``."""
    px = px.withColumn("_s", F.rint(F.col(depth) * scale).cast("bigint"))
    return px.withColumn("clipped", F.col("_s") > most).withColumn("scaled", F.when(F.col("_s") > most, 0).otherwise(F.col("_s"))).drop("_s")
