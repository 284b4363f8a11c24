"""A corpus from raw documents to a training mix, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and gives documents back; the last gives the documents of the mix and how
many times each is taken.  Stages keep every column of their input, whatever its
name, and give an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontamination, mixing, quality, simhash_dedup, substring_dedup
from millrace.llm.components import shared_folder
from millrace.llm.registry import table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored like others; without labels all stay.
    """
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id.

    Texts without a word are one group; rows without a doc_id all stay; of rows
    with an equal doc_id at most one stays.
    """
    return simhash_dedup.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Word windows that stand earlier in the corpus are cut out of the texts.

    Null and empty texts stay as they are; documents that lose every word go;
    rows with an equal doc_id, or none, are one document.
    """
    return substring_dedup.cut_repeats(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or an edited copy of one, go.

    Null and empty texts hold none; without items all stay.
    """
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken so that each source comes to its target of words.

    Null and empty texts have no words; a null source is a source; an input column
    called copies stays, and the new one is copies_2.
    """
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("mix", mix),
]

#: A classifier's fit and a random draw have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again, and goes once the next is there."""
    context = spark.sparkContext
    base = f"{shared_folder(spark)}/pipeline-{context._jvm.java.util.UUID.randomUUID().toString()}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            place = context._jvm.org.apache.hadoop.fs.Path(before)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
