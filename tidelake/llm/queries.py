"""The registered query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from . import editlines, linefreq, sql, subword, urlfilter
from .minhash import near_duplicates
from .packing import pack
from .sharding import shard
from .suffixdedup import remove_repeats
from .tokenscan import token_counts, write_tokens
from .winnow import contamination, digest


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linefreq.judge(_table(spark, sf_dir, "documents")).drop("mark")


def op3_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op4_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = subword.fit(docs, labels.where(~held_out))
    scored = subword.score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: The production rules of the URL filter.
URL_RULES = ("block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"), [urlfilter.Rule.parse(x) for x in URL_RULES])


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer())


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editlines.line_report(_table(spark, sf_dir, "documents"))


def op9_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_tokens(_table(spark, sf_dir, "documents"), tokenizer())
    files = index.groupBy("file").agg(F.sum("n_bytes").alias("n_bytes"))
    return index.join(token_counts(files), ["file", "ordinal"]).select("doc_id", "n_tokens", "ordinal", "start")


def op10_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    return shard(docs, "doc_id", 8, ("size", "text_crc32", "law"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return sql.oracles()
