"""A training corpus from documents, stage by stage; each stage's result is written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm.common import cut, named, short_batches, table
from loomline.llm.minhash import near_duplicates
from loomline.llm.mixing import mixture
from loomline.llm.packing import packed
from loomline.llm.pii import without_personal_data
from loomline.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network rejects go; null and empty texts are judged as texts without words, equal texts alike."""
    short_batches(spark)
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, likeness 0.8) stays: that of the least doc_id.

    Of rows that repeat a doc_id all stay or go; rows without doc_id stay.
    """
    short_batches(spark)
    gone = near_duplicates(docs, k=5).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*named(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind, row by row; a null text stays null, n_chars follows."""
    return without_personal_data(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, up to one and a half times, towards even weights; every document stays once at least.

    A null source is a source of its own; null and empty texts come once with each epoch; equal rows come equally often.
    """
    return mixture(docs, max_repeats=1.5).select(*named(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with the sequence and the offset that each has; a null text is empty, rows that repeat are packed each.

    An empty table gives no rows in every stage; columns beside those of documents are kept, whatever their names, up to here.
    """
    short_batches(spark)
    return packed(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mixing", mixing), ("packing", packing)]

#: Networks, components and packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
