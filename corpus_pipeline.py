"""Corpus cleaning: language identification, near-duplicate removal, repeated-text removal, decontamination, segmentation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and rereads it as the
next one's docs.  All but the last return the columns of documents, whatever others there are and whatever their names.
Repeated rows are rows like any other; an empty table passes through every stage as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontamination, language_id, lattice, line_dedup, near_dedup, suffixes
from weftline.llm.queries import PIECES
from weftline.llm.rows import BROADCAST_IDS, shared_folder, steady

#: near copies are documents that share at least this percentage of their five-word shingles
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language a model of these documents accepts.

    Null and empty texts and texts without a letter go; null languages are not learned from, and where all are null nothing
    is accepted.  Texts of any length are read whole; equal texts fare alike.
    """
    return language_id.accepted_rows(docs, language_id.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one of smallest doc_id.

    Rows without an id stay, and so do null and wordless texts, which are near nothing.  Rows that repeat the kept doc_id stay too.
    """
    gone = near_dedup.near_duplicates(docs, NEAR_PERCENT).where("not kept").select("doc_id").distinct()
    return _without(docs, gone)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without those whose doc_id is in ``gone``."""
    gone = steady(gone)
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_units(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines, sentences and passages of 50 words that occur earlier; n_chars follows the text.

    Every row stays, with an empty text if all of it is repeated.  Null texts and null ids pass through unchanged, and
    such rows cut nothing from others.  Occurrences are ranked by (doc_id, position); rows that repeat a doc_id count as one occurrence.
    """
    cuts = line_dedup.repeated_units(docs).select("doc_id", "at", "end")
    passages = suffixes.passages(docs).select("doc_id", F.explode("removed").alias("s")).select("doc_id", "s.at", "s.end")
    cut = line_dedup.remove_repeats(docs, cuts.unionAll(passages))
    return cut.withColumn("n_chars", _length(cut)) if "n_chars" in docs.columns else cut


def _length(docs: DataFrame):
    return F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Rows without an id stay, and so do null and empty texts.  Of rows that share a doc_id all go if one holds an item.
    """
    found = decontamination.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.select("doc_id").distinct())


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document, pieces included.

    Null and empty texts give one row without pieces; a null id counts as key 0; repeated rows get the same samples.
    """
    return lattice.sample_segmentations(docs, lattice.Vocabulary.load(PIECES))


STAGES = [
    ("language identification", identify_language),
    ("near-duplicate removal", drop_near_duplicates),
    ("repeated-text removal", drop_repeated_units),
    ("decontamination", drop_contaminated),
    ("segmentation", segment),
]

#: language identification is a fitted classifier, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; intermediate tables lie in ``spark.checkpoint.dir``.

    A stage's table is deleted once the next one is written; the last one is the result and stays.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
        if i:
            _delete(spark, f"{at}/{i - 1}")
    return docs


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
