"""The corpus pipeline: each stage works on all that its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and
read again as the next stage's ``docs``.  All stages but the last return the columns
of ``documents``.  A stage judges rows, not ids: a row's key is a hash of its id and text,
so rows with a null or repeated ``doc_id`` are judged each by its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maploom.llm import decontaminate, jaccard, mixing, quality, tokenids
from maploom.llm.queries import tokenizer_path
from maploom.llm.tables import join_small, read, small, stored

#: Ids up to which a list of decisions is broadcast.
BROADCAST_ROWS = 500_000

#: Nothing here is plain SQL: trees, hashes and a tokenizer decide.
ORACLE_SQL = None


def _key() -> Column:
    """A key for each row that only rows with the same id and text share."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` as an operator sees them: with the row key for an id."""
    return docs.withColumn("doc_id", _key())


def _meet(docs: DataFrame, side: DataFrame, how: str) -> DataFrame:
    """Join on the row key, which no two different rows share."""
    docs = docs.withColumn("_key", _key())
    side = side.withColumnRenamed("doc_id", "_key")
    return docs.join(F.broadcast(side) if small(side, BROADCAST_ROWS) else side, "_key", how).drop("_key")


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    return _meet(docs, keys.select("doc_id").distinct(), "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that the quality classifier rejects."""
    model = quality.fit_quality(docs, read(spark, sf_dir, "labels"), folds=3, held_out=1)
    return _without(docs, stored(quality.score(_keyed(docs), model).filter("predicted = 0").select("doc_id"), "rejected"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group linked at 0.8 on five-word shingles: that with the smallest id (null last), of equal ids the smallest key.

    Of rows with the same id and text one stays.
    """
    classes = stored(jaccard.jaccard_components(_keyed(docs), size=5, percent=80).select("doc_id", "component_id"), "classes")
    linked = stored(classes.filter("doc_id <> component_id").select("component_id").distinct(), "linked")
    members = join_small(classes, linked, "component_id", "left_semi", BROADCAST_ROWS).distinct()
    ids = docs.select(_key().alias("doc_id"), F.col("doc_id").alias("id")).distinct()
    members = stored(members.join(ids, "doc_id"), "members")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "doc_id"))["doc_id"].alias("first"))
    kept = _without(docs, join_small(members, stored(first, "first"), "component_id", "inner", BROADCAST_ROWS).filter("doc_id <> first"))
    again = stored(classes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "repeated-rows")
    if again.isEmpty():
        return kept
    repeated = _meet(kept, again, "left_semi").dropDuplicates(["doc_id", "text"])
    return _without(kept, again).unionByName(repeated)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that the benchmark contaminates."""
    judged = decontaminate.contamination(_keyed(docs), read(spark, sf_dir, "benchmark"), size=13, share=20)
    return _without(docs, stored(judged.filter("contaminated").select("doc_id"), "contaminated"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out whole rows so that each source's words come to what the mix takes of it.

    A row of which the mix takes 1.3 times its words comes once, and with a seeded
    chance of 0.3 twice.  Rows without words stay once.  Rows with the same id and
    text come alike, by what the mix takes of them on average.
    """
    mixed = mixing.mix(_keyed(docs), weights=(3, 1, 2), share=1.5, most=2.0, seed=7)
    mixed = mixed.groupBy("doc_id").agg(F.first("size").alias("size"), F.avg("taken").alias("taken"))
    times = F.col("taken") / F.col("size")
    chance = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor(times) + (chance < times - F.floor(times)).cast("int")).cast("int")
    drawn = _meet(docs, stored(mixed.select("doc_id", copies.alias("_copies")), "copies"), "left").filter("_copies > 0")
    return drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token-id files and describe every document from them."""
    blocks = tokenids.write_token_ids(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return tokenids.verified_token_ids(blocks)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
    ("token id output", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
