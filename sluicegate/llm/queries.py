"""The registered queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import flat_graph, langid, line_dedup, mixing, pii, sentencepiece_codec, simhash, token_rollups, training_order, transport_stream
from .common import cut, ensure_checkpoint_dir

#: The session setting of the pseudonyms' secret key, and what queries take where it is not set.
KEY_SETTING, TEST_KEY = "spark.sluicegate.pii.key", "no secret, for tests only"
#: Token ids of a sequence; ids of the vocabulary of 50,256 take two bytes each.
SEQ_LEN = 512


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _shared(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def op1_flat_graph_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of vectors at cosine 0.93 or more, components and kept vectors."""
    return flat_graph.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op2_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, linked at two or fewer differing bits."""
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_kernel_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every text."""
    return langid.identify(_read(spark, sf_dir, "documents"))


def op4_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals by source, language and tokenizer version after three batches and two replays.

    All documents enter with their word counts, every count is revised to the
    tokenizer's, documents without a word are deleted; a replay, before or
    after a compaction, changes nothing.
    """
    counts = cut(token_rollups.count_tokens(_read(spark, sf_dir, "documents")))
    rollup = token_rollups.Rollup(spark, _shared(spark, "rollup"))
    load = token_rollups.inserts(counts, "words", "n_words")
    revise = token_rollups.revisions(counts, "words", "n_words", "byte_bpe_50k", "n_tokens")
    drop = token_rollups.deletes(counts.where("n_words = 0"), "byte_bpe_50k", "n_tokens")
    for batch, rows in (("load", load), ("revise", revise), ("load", load)):
        rollup.commit(batch, rows)
    rollup.compact()
    for batch, rows in (("revise", revise), ("drop", drop)):
        rollup.commit(batch, rows)
    return rollup.totals()


def op5_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all sources at weights 1, 2, 3, ... takes of each document."""
    return mixing.plan(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text (their number and digest) and whether decoding gives it back."""
    return sentencepiece_codec.digests(_read(spark, sf_dir, "documents"))


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence of token ids with its global slot, as read back from the written shards."""
    path = _shared(spark, "shards")
    training_order.materialise(_read(spark, sf_dir, "documents"), path, key=20_240_229, seq_len=SEQ_LEN, width=2)
    back = training_order.read_slots(spark, path, digest=True)
    return back.select("slot", F.col("id").alias("doc_id"), "seq", "n_tokens", "tokens_crc32")


def op8_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and features of every text stored as an MPEG transport stream and read back."""
    path = _shared(spark, "media")
    transport_stream.store(_read(spark, sf_dir, "documents")).write.option("compression", "zstd").parquet(path)
    return transport_stream.summary(spark.read.parquet(path))


def op9_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines removed from each document, and the digest of what is left."""
    out = line_dedup.dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.md5("text").alias("text_md5"))


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with pseudonyms for personal numbers, dates and addresses."""
    out = pii.pseudonymise(_read(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(KEY_SETTING, TEST_KEY))
    return out.select("doc_id", "text", F.col("_n_found").alias("n_found"), F.col("_n_replaced").alias("n_replaced"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_flat_graph_near_dup,
        op2_covering_simhash,
        op3_kernel_language_id,
        op4_token_rollups,
        op5_fair_queue_mix,
        op6_sentencepiece,
        op7_training_order,
        op8_transport_stream,
        op9_line_windows,
        op10_pii_pseudonyms,
    )
}

#: The flat graph as SQL is every pair of a label and a recursive closure; it is tested on small fixtures instead.
ORACLE = {"op5_fair_queue_mix": mixing.ORACLE, "op9_line_windows": line_dedup.ORACLE}
