"""The corpus pipeline: toxicity, near-duplicates, repeated passages, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from taskloom.llm import stages

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("minhash_near_dedup", stages.drop_near_duplicates),
    ("substring_dedup", stages.drop_repeats),
    ("pareto_mixing", stages.mix_sources),
    ("binary_packing", stages.pack_sequences),
]

#: Models, samples by Spark's hash and tokenisation have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows written and read again before the next."""
    return stages.chain(spark, STAGES, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
