"""The corpus pipeline: stages over documents, each calling one operator of kinweave.llm.

Every stage takes any rows: null and empty texts, null ids, ids that several rows have, equal rows and no rows at all. Columns
beyond those of documents come along, whatever their names, but for the last stage, which returns its digests only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import common, mixing, pieces, simhash, suffixes, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine, learned from docs and the labels, does not reject. Rows stay or go each by its own text; null and
    empty texts stay; without toxic labels all stay."""
    common.short_batches(spark)
    return toxicity.drop_toxic(docs, toxicity.machine_for(docs, common.table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest id, one row. Null and word-less texts are a group like any other. Rows
    without an id stay only where no row of their group has one; of rows that share the id one stays."""
    common.short_batches(spark)
    return simhash.drop_near_duplicates(docs)


def strip_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 200-byte strings that the rest of the corpus or they themselves hold again, in whole characters. No row goes;
    null texts become empty; each row is a text of its own, whatever its id."""
    common.short_batches(spark)
    return suffixes.strip_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order: each document as often as it is taken, whole. Texts without words are not taken; a null source is one of
    its own, the last; rows that repeat an id follow one another."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids, and of their decoding, of each document of the mix, one row a row; null texts count as empty."""
    common.short_batches(spark)
    return pieces.piece_digests(docs)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("suffixes", strip_repeats), ("mixing", mix_sources), ("pieces", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet in the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = common.written(docs, name)
    return docs


#: No SQL expresses the stages; tests hold the pipeline against plain versions of them.
ORACLE_SQL = None
