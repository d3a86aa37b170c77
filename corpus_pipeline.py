"""The corpus pipeline: from raw documents to packed token ids, stage by stage.

Each stage reads what its predecessor wrote as Parquet and works on all of it. All but
the last return the columns of documents. ``run`` applies the stages one after the
other; between them rows are stored in the shared folder of ``spark.checkpoint.dir``.

Defined cases: rows of null or empty text are rejected by the first stage; the
operators' docstrings state how each treats repeated rows, null ids and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spendframe.llm import decontamination, mixing, ngram_join, packing, quality
from spendframe.llm.frames import store, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the isolation forest reject go."""
    return quality.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of at least 0.8 on five-word shingles, one stays."""
    return ngram_join.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is repeated, or left out, as its source's target asks."""
    return mixing.mix_documents(docs)


def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_packing", token_packing),
]

#: Isolation forest and tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
