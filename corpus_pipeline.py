"""From raw documents to packed token ids: five operators of the llm part, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.common import Store, table
from strandline.llm.decontaminate import decontaminate_documents
from strandline.llm.mixing import mix_documents
from strandline.llm.near_dedup import dedup_documents
from strandline.llm.packing import pack
from strandline.llm.quality import quality_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, on shingles of five words and a similarity of 0.8."""
    return dedup_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return pack(docs)


STAGES = [("quality rules", quality), ("near-duplicates", near_dedup), ("decontamination", decontamination), ("source mix", source_mix), ("token ids", token_ids)]

#: SQL has no tokenizer; tests hold each stage, and run(), against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents; each one's result is stored in the shared folder and read by the next."""
    store, docs, before = Store(spark), table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = store.put(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        store.drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
