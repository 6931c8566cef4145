"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maploom.llm import decontaminate, jaccard, langid, media, mixing, oracles, pieces, prefix_trie, quality, substring, tokencount, tokenids, urls, whitening
from maploom.llm.tables import read

#: Where vocabulary files are looked up by name; None: the installed public_tokenizers package.
TOKENIZER_PATH: Callable[[str], str] | None = None


def tokenizer_path(name: str) -> str:
    if TOKENIZER_PATH is not None:
        return TOKENIZER_PATH(name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: (verdict, host, path prefix)
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op5_ngram_jaccard_join", oracles.OP5)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"), size=3, percent=90)


@query("op4_substring_dedup", oracles.OP4)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeated(read(spark, sf_dir, "documents"), size=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op1_benchmark_decontamination", oracles.OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), size=13, share=20)
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), limit=4096)


@query("op10_token_id_output")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = tokenids.write_token_ids(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return tokenids.verified_token_ids(blocks)


@query("op7_media_columns")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read(spark, sf_dir, "documents"))


@query("op6_source_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0, seed=7)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op8_url_filters")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(read(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_score")


@query("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), folds=3, held_out=1)


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"), folds=5, held_out=0)


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read(spark, sf_dir, "embeddings"), components=8).drop("deviation_exact")


@query("op12_conversation_prefix_trie")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


@query("op13_sentencepiece_codec")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    both = pieces.decode_pieces(pieces.encode_pieces(read(spark, sf_dir, "documents"), path), path)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
