"""Corpus cleaning in five stages, each one operator of sluice.llm on all that the stage before kept.

quality rules -> line dedup -> MinHash near-dedup -> benchmark decontamination -> byte-level BPE

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. run() writes what each stage returns to the cluster's shared folder and reads it for the next, and
deletes what the stage wrote on the way.

Defined results, for every stage: an empty table gives an empty one. Extra columns, whatever their names,
pass through unread. Texts are handled whole, however long. What a stage does with null and empty texts,
null or repeated doc_ids and ties stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import bpe, common, decontaminate, lines, neardup, rules


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    A null, empty or white-space text is rejected; a row's doc_id plays no part, and equal rows fare alike.
    """
    common.small_batches(spark)
    return rules.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share; n_chars is counted anew where lines went.

    Every row stays, if with an empty text; a null text stays null. Rows that repeat a doc_id count as one
    document; a null doc_id counts as one below all others, so a line that it shares goes from it.
    """
    into = common.unused(docs, "_lines")
    found = lines.restore(docs, into)
    gone = F.col(f"`{into}`.n_dropped") > 0
    kept = F.col(f"`{into}`.kept")
    changed = {"text": F.when(gone, kept).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(gone, F.length(kept).cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns(changed).drop(into)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id.

    Rows without words or without a doc_id all stay. A doc_id that repeats with different texts is a document
    for each text; of equal rows one stays.
    """
    common.small_batches(spark)
    return neardup.distinct(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay; an empty benchmark rejects nothing; null items match nothing.
    """
    common.small_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the digests of its ids and of the bytes that they decode to.

    A row for each row; a null text is encoded as an empty one.
    """
    common.small_batches(spark)
    return bpe.digest(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL has no byte-pair encoding; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held = None
    for name, stage in STAGES[:-1]:
        with common.scope():
            docs = common.table(stage(spark, docs, sf_dir), name, keep=True)
        if held is not None:
            common.drop(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
