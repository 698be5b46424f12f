"""Registered queries of the subpackage: ``opN_<name>`` for each operator, and ``pipeline``."""

from __future__ import annotations

import functools
from collections.abc import Callable

from vigil.llm import bpe, crossalign, fertility, linededup, minhash, mixing, multiindex, perspective, prefixhash, toccurrence, tokenfile, urlfilter, zquality
from vigil.session import ship_package
from vigil.sources.tables import read_table

#: Arrow batches stay small however long the texts are.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def prepare(spark) -> None:
    """Session settings the operators count on: bounded Arrow batches; the package on the workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ship_package(spark)


def query(name: str, sql: str | None = None):
    def wrap(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            prepare(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


@query("op1_bpe")
def op1(spark, sf_dir):
    return bpe.op1_bpe(spark, read_table(spark, sf_dir, "documents"))


@query("op2_zstd")
def op2(spark, sf_dir):
    return zquality.op2_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op3_minhash")
def op3(spark, sf_dir):
    return minhash.op3_minhash(read_table(spark, sf_dir, "documents"))


@query("op4_tokens")
def op4(spark, sf_dir):
    return tokenfile.op4_tokens(spark, read_table(spark, sf_dir, "documents"))


@query("op5_urls", urlfilter.ORACLE)
def op5(spark, sf_dir):
    return urlfilter.op5_urls(read_table(spark, sf_dir, "pages"))


@query("op7_fingerprints")
def op7(spark, sf_dir):
    return prefixhash.op7_fingerprints(read_table(spark, sf_dir, "documents"))


@query("op10_chat", perspective.ORACLE)
def op10(spark, sf_dir):
    return perspective.op10_chat(read_table(spark, sf_dir, "conversations"))


@query("op6_lines", linededup.ORACLE)
def op6(spark, sf_dir):
    return linededup.op6_lines(read_table(spark, sf_dir, "documents"))


@query("op8_quality")
def op8(spark, sf_dir):
    return fertility.op8_quality(spark, read_table(spark, sf_dir, "documents"))


@query("op9_mix", mixing.ORACLE)
def op9(spark, sf_dir):
    return mixing.op9_mix(read_table(spark, sf_dir, "documents"))


@query("op11_negatives", multiindex.ORACLE)
def op11(spark, sf_dir):
    return multiindex.op11_negatives(read_table(spark, sf_dir, "embeddings"))


@query("op12_jaccard")
def op12(spark, sf_dir):
    return toccurrence.op12_jaccard(read_table(spark, sf_dir, "documents"))


@query("op13_align")
def op13(spark, sf_dir):
    return crossalign.op13_align(spark, read_table(spark, sf_dir, "documents"))
