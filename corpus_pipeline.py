"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read back as the next
stage's ``docs``. All but the last return the columns they were given; every stage accepts null, empty and very long
texts, repeated rows, empty tables and further columns, as its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import bpe, fertility, linededup, minhash, mixing
from vigil.llm.common import written
from vigil.llm.queries import prepare
from vigil.sources.tables import read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rules and the fertility bands keep; the others go."""
    prepare(spark)
    return fertility.judge(docs, only_kept=True)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the runs of lines (50 words or more) that occur earlier; ``n_chars`` follows the text."""
    prepare(spark)
    got = linededup.dedup_lines(docs).drop("_n_lines", "_cut_lines")
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return got.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8 or more."""
    prepare(spark)
    return minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    prepare(spark)
    return mixing.mix(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document in place of its text."""
    import public_tokenizers as P

    prepare(spark)
    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode(docs, ranks, P.PATTERN, drop_text=True, lists=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode_bpe", encode_bpe),
]

#: Tokenisation and MinHash components are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
