"""Readers and writers: manifests, tick indexes, pose text, odometry, question tables, scene graphs, telemetry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "tick long, sensor_time_ns long, images array<struct<name: string, timestamp_ns: long, error: string>>, lidar array<struct<timestamp_ns: long>>, poses struct<values: map<string, array<double>>>, _corrupt string"
ODOMETRY = "sensor_time_ns long, position_m string, orientation_xyzw string, pose string, header string"
TELEMETRY = "schema string, event string, stage string, recorded_time_ns long, monotonic_time_ns long, queue_wait_ms double, service_ms double, end_to_end_ms double, queue_size int, reason string"
QA_COLUMNS = ["sequence", "question_id", "category", "question", "answer", "start", "end", "position", "text", "notes"]


def read_manifest_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One row per record with the stereo time difference, presence flags and error count; bad lines keep ``_corrupt``."""
    m = spark.read.schema(MANIFEST).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    has = lambda n: F.coalesce(F.exists("images", lambda i: i["name"] == n), F.lit(False))
    return m.select(
        "tick", "sensor_time_ns", (F.abs(F.when(has("left") & has("right"), F.get(F.filter("images", lambda i: i["name"] == "left"), F.lit(0))["timestamp_ns"] - F.get(F.filter("images", lambda i: i["name"] == "right"), F.lit(0))["timestamp_ns"])) / 1e6).alias("stereo_ms"),
        has("left").alias("has_left"), has("right").alias("has_right"), (F.coalesce(F.size("lidar"), F.lit(0)) > 0).alias("has_lidar"),
        F.coalesce(F.map_contains_key(F.col("poses.values"), "base"), F.lit(False)).alias("has_pose"), F.coalesce(F.size(F.filter("images", lambda i: i["error"].isNotNull())), F.lit(0)).alias("errors"), "_corrupt",
    )


def read_tick_index(spark: SparkSession, path: str) -> DataFrame:
    """Frames of an index document; ``timestamp`` is seconds since the origin (the first frame if none is given)."""
    schema = "origin_ns long, frames array<struct<index: long, timestamp_ns: long, timestamp: double>>"
    d = spark.read.schema(schema).option("multiLine", True).json(path)
    f = d.select("origin_ns", F.col("frames")[0]["timestamp_ns"].alias("_first"), F.posexplode("frames").alias("ordinal", "f"))
    origin = F.coalesce("origin_ns", "_first")
    derived = (F.col("f.timestamp_ns") - origin) / 1e9
    return f.select("ordinal", "f.index", "f.timestamp_ns", derived.alias("timestamp"), F.coalesce(F.abs(F.col("f.timestamp") - derived) <= 1e-6, F.lit(True)).alias("agrees"))


def read_pose_text(spark: SparkSession, poses: str, times: str) -> DataFrame:
    """``ordinal, timestamp_ns, m``: 16 numbers a line, and a parallel file of times (both small files)."""

    def numbered(path: str, value: str) -> DataFrame:
        t = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("ordinal", value))
        return t

    a = numbered(poses, "line").withColumn("m", F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.cast("double")))
    b = numbered(times, "time").withColumn("timestamp_ns", F.trim("time").cast("long"))
    j = a.join(b, "ordinal", "full")
    return j.select("ordinal", "timestamp_ns", "m", (F.col("m").isNotNull() & F.col("timestamp_ns").isNotNull() & (F.size("m") == 16)).alias("complete"))


def read_odometry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine): compact or nested records; vectors as lists or as objects with x, y, z, w."""
    raw = spark.read.schema(ODOMETRY).json(path)
    nested = lambda *p: F.get_json_object("pose", "$." + ".".join(p))
    pos = F.coalesce("position_m", nested("position"))
    rot = F.coalesce("orientation_xyzw", nested("orientation"))
    t = F.coalesce("sensor_time_ns", F.get_json_object("header", "$.stamp_ns").cast("long"))

    def vector(c, names: str):
        listed = F.from_json(c, "array<double>")
        named = F.from_json(c, "struct<x: double, y: double, z: double, w: double>")
        return F.when(F.ltrim(c).startswith("["), listed).otherwise(F.array(*[named[n] for n in names]))

    d = raw.select(t.alias("sensor_time_ns"), vector(pos, "xyz").alias("pos"), vector(rot, "xyzw").alias("quat"))
    finite = lambda c: F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    length = F.aggregate("quat", F.lit(0.0), lambda s, x: s + x * x)
    ok = F.coalesce(F.col("sensor_time_ns").isNotNull() & (F.size("pos") == 3) & (F.size("quat") == 4) & finite("pos") & finite("quat") & (length > 0), F.lit(False))
    d = d.withColumn("_ok", ok)
    return d.filter("_ok").drop("_ok"), d.filter("not _ok").drop("_ok")


def read_qa_csv(spark: SparkSession, path: str) -> DataFrame:
    """Question table with quoted, multi-line cells and headers; columns are named by place."""
    d = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return d.toDF(*(QA_COLUMNS[: len(d.columns)] + [f"c{i}" for i in range(len(QA_COLUMNS), len(d.columns))]))


def read_scene_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph document; the top byte of a node id is its prefix character."""
    schema = "nodes array<struct<id: long, layer: int, partition: int, attributes: string>>, edges array<struct<source: long, target: long>>"
    d = spark.read.schema(schema).option("multiLine", True).json(path)
    n = d.select(F.explode("nodes").alias("n")).select("n.*")
    n = n.withColumn("prefix", F.chr(F.shiftrightunsigned("id", 56))).withColumn("number", F.col("id").bitwiseAND(F.lit((1 << 56) - 1)))
    n = n.withColumn("name", F.get_json_object("attributes", "$.name"))
    return n, d.select(F.explode("edges").alias("e")).select("e.*")


def _plain(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text; columns by name."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[(F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")).alias(f.name) for f in sorted(df.schema, key=lambda f: f.name)])


def write_collection(df: DataFrame, path: str) -> None:
    """The same rows as JSON lines, CSV (header sorted, nested cells as JSON) and Parquet; NaN is an error."""
    for f in df.schema:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            bad = F.isnan(f.name)
            df = df.withColumn(f.name, F.when(bad, F.raise_error(F.lit(f"NaN in {f.name}"))).otherwise(F.col(f.name)))
    df.write.mode("overwrite").json(f"{path}/jsonl")
    _plain(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/csv")
    df.write.mode("overwrite").parquet(f"{path}/parquet")


def read_telemetry_stream(spark: SparkSession, path: str, schema: str = TELEMETRY) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def write_telemetry(stream: DataFrame, path: str, checkpoint: str, kind: str = "parquet"):
    """Append a telemetry stream to files, once for what is there now."""
    return stream.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


LOADERS: dict[str, Callable] = {"manifest": read_manifest_jsonl, "tick_index": read_tick_index, "pose_text": read_pose_text, "odometry": read_odometry, "qa_csv": read_qa_csv, "scene_graph": read_scene_graph_json}


def load(name: str, spark: SparkSession, *paths: str):
    """A dataset by the name of its registered loader."""
    if name not in LOADERS:
        raise KeyError(f"no loader {name!r}")
    return LOADERS[name](spark, *paths)
