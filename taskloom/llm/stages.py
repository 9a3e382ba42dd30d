"""The stages of the corpus pipeline: each applies one operator to documents and keeps their columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import minhash, mixing, packing, substrings, toxicity
from .common import load, ranked, saved, word_count


def _row_mark(docs: DataFrame) -> Column:
    """Tells rows of the same doc_id apart by their text and source."""
    return F.xxhash64(F.coalesce("text", F.lit("")), F.coalesce("source", F.lit("")), F.col("source").isNull())


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below toxicity.CUT; the network learns from the labelled documents of sf_dir.

    Null and empty texts stay. Every row is judged by its text alone, so copies go or stay together.
    """
    model = toxicity.fitted(toxicity.sample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), "toxic", ~toxicity.held_out()))
    return toxicity.toxicity(docs, model, score="_toxic").where(F.col("_toxic") < toxicity.CUT).drop("_toxic")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words, Jaccard 0.8): the one of least doc_id.

    Documents without words are in no group and stay. Where doc_ids are null or repeated, every row is a document of its
    own, numbered by doc_id (null first), then by a hash of its text; so rows of one doc_id with different texts stay.
    Of rows that are equal in all columns, doc_id not null, one stays.
    """
    if docs.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1 or doc_id is null").isEmpty():
        kept = saved(minhash.near_duplicates(docs)).where("kept").select("doc_id")
        return docs.join(kept, "doc_id").select(*docs.columns)
    alone = docs.where("doc_id is not null").distinct().unionByName(docs.where("doc_id is null"))
    rows = saved(alone.withColumn("_row", F.monotonically_increasing_id()))
    narrow = rows.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"), "_row")
    numbers = ranked(narrow, F.col("doc_id").asc_nulls_first(), F.col("_hash"), F.col("_row"), rank="_no").select("_row", "_no")
    numbered = saved(rows.join(numbers, "_row"))
    kept = saved(minhash.near_duplicates(numbered, key="_no")).where("kept").select("_no")
    return numbered.join(kept, "_no").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows of 20 that start earlier in the corpus; n_chars follows the new text.

    Rows stay, even those of which no word is left; untouched texts are not changed at all.
    """
    out = substrings.remove_repeats(docs)
    changed = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else out
    return changed.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: sources to weights 5, 2, 1 in turn, at most three copies.

    Documents without words take nothing of the mix and go. Identical rows are taken alike.
    """
    rows = docs.select("doc_id", "source", word_count("text").alias("size"), _row_mark(docs).alias("mark"))
    mixed = mixing.pareto_mix(rows).where("copies > 0 and size > 0").groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_m")).agg(F.max("copies").cast("int").alias("_copies"))
    met = docs["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_m"))
    taken = docs.withColumn("_mark", _row_mark(docs)).join(mixed, met)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each a sequence of a power of two of tokens."""
    return packing.pack(docs)


def chain(spark: SparkSession, stages: list[tuple[str, Callable]], docs: DataFrame, sf_dir: str) -> DataFrame:
    for i, (_, stage) in enumerate(stages):
        docs = stage(spark, docs, sf_dir)
        if i < len(stages) - 1:
            docs = saved(docs)
    return docs
