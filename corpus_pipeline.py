"""Corpus pipeline: stages over ``documents``, each written as Parquet and reread.

Every stage reads all that its predecessor kept and returns the columns of documents; the
last one returns the packing of what is left. Clean documents pass all filters.

Defined cases, in all stages: null text counts as empty; rows with a null doc_id are documents
like any other; of repeated rows one is left after the exact stage; an empty table gives an
empty result; further columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstream.llm import decontamination, exact_dedup, near_copies, packing, toxicity
from quillstream.llm.queries import vocabulary
from quillstream.sources.session import materialise, prepare, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is one half or more go; repeated rows go or stay alike.
    Without labels of both kinds the fixed lexicon decides."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the row with the longest original, then the
    smallest doc_id (null last), stays: one row of each group."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (5-word similarity of 0.8 or more) stays: the one with
    the smallest doc_id, null last. Documents without words are near to each other only."""
    return near_copies.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; an empty benchmark takes none."""
    return decontamination.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, with their sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL can't express the grammar, the fingerprints or the tokens; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
