"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import chat_format, decontamination, language_id, lattice, line_dedup, near_dedup, quality, suffixes, toxicity, vector_index

#: piece vocabulary of the segmentation sampler; any SentencePiece model file
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; learned from labels outside the held-out third."""
    docs = _table(spark, sf_dir, "documents")
    held_out = language_id.held_out(F.col("doc_id"), 3, 1)
    found = toxicity.toxicity(docs, _table(spark, sf_dir, "labels"), ~held_out)
    matches = F.aggregate("matches", F.lit(0), lambda a, x: a + x).alias("n_matches")
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), matches)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or re-parameterised."""
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document, with a digest of their pieces."""
    found = lattice.sample_segmentations(_table(spark, sf_dir, "documents"), lattice.Vocabulary.load(PIECES))
    return found.select("doc_id", "sample", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("pieces"), "logp", "value", "inclusion", "decoded")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its rendered form; conversation -1 holds control strings."""
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.read_back(chat_format.format_conversations(rows))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    return vector_index.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by two co-trained views."""
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of 50 words and more in every document that has some."""
    return suffixes.passages(_table(spark, sf_dir, "documents"))


def op9_repeated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines and sentences that deduplication removes, with their original offsets."""
    found = line_dedup.removals(line_dedup.repeated_units(_table(spark, sf_dir, "documents")))
    spans = F.transform("removed", lambda s: F.concat_ws("-", s["at"].cast("string"), s["end"].cast("string")))
    return found.withColumn("removed", F.array_join(spans, ","))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from documents outside the held-out quarter."""
    docs = _table(spark, sf_dir, "documents")
    held_out = language_id.held_out(F.col("doc_id"), 4, 2)
    model = language_id.fit(docs.where(F.col("doc_id").isNotNull() & ~held_out))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cosine", "accepted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_near_dedup, op2_toxicity, op3_decontamination, op4_segmentation, op5_chat_format, op6_neighbours, op7_quality,
        op8_repeated_passages, op9_repeated_units, op10_language,
    )
    return {f.__name__: f for f in found}
