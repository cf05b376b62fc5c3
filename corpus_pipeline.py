"""Documents to packed training sequences: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and its decisions
take effect. All but the last return the columns of ``documents``. Nulls, empty and long texts,
repeated rows, empty tables and further columns have the results stated at the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import editlines, linefreq, minhash, packing, scratch, winnow
from tidelake.llm.queries import tokenizer
from tidelake.runtime import ship


#: What near-dedup takes as copies; line dedup spares the same ones.
NEAR = {"words": 5, "percent": 80}


def _recount(docs: DataFrame) -> DataFrame:
    """n_chars anew, as texts may have lost lines."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the rules; the others lose lines that too many documents of their source share."""
    return _recount(linefreq.clean(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines equal to or within two edits of an earlier line of the corpus.

    Documents that near-dedup would drop own no line, and keep or lose lines as the document of
    their group that stays does: taken from the copies alone, lines would leave fragments that no
    longer resemble it.
    """
    return _recount(editlines.dedup_lines(docs, copies=editlines.near_copies(docs, **NEAR)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a similarity of 0.8 or more on 5-word shingles."""
    ship(spark)
    return minhash.deduplicate(docs, **NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or the whole of a shorter one."""
    ship(spark)
    return winnow.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of what is left into sequences of 2048."""
    ship(spark)
    return packing.pack(docs, tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: The tokenizer can't be expressed in SQL. No plain version of the whole pipeline exists yet; tests cover single stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch.passing() as made:
            docs = scratch.materialize(stage(spark, docs, sf_dir), name)
            made.remove(docs)
        if before is not None:
            scratch.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
