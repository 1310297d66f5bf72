"""The corpus pipeline: language, near duplicates, repeated passages, source mix, packed sequences.

``STAGES`` are applied in turn; what a stage returns is written as Parquet and read again as the
documents of the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.driver_tables import table
from tickloom.llm import langid, mixing, packing, simhash, suffix_dedup
from tickloom.llm.common import fresh, with_row_key
from tickloom.session import stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each near-duplicate group."""
    return simhash.keep_one_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages of 200 bytes and more out of the texts."""
    return suffix_dedup.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that the sources meet their target words.

    Each row has the copies chosen for it, whatever other rows share its id or text.
    """
    own = fresh("_row", docs.columns)
    keyed, keys = with_row_key(docs, own)
    chosen = mixing.mix_sources(keyed, row=keys).where("copies > 0")
    chosen = chosen.select(*[F.col(k).alias(f"{k}_met") for k in keys], F.col("copies").cast("int").alias(f"{own}_copies"))
    met = keyed.join(chosen, [F.col(k) == F.col(f"{k}_met") for k in keys])
    times = F.explode(F.sequence(F.lit(1), F.col(f"{own}_copies"))).alias(f"{own}_times")
    return met.select(*docs.columns, times).drop(f"{own}_times")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences of 2,048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

#: Fingerprints, byte runs and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
