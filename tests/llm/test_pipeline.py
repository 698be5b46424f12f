"""The pipeline, stage by stage, against brute force on its own input."""

from collections import Counter

import corpus_pipeline as C
import public_tokenizers as P
import tiktoken
from vigil.llm import bpe, fertility
from vigil.llm.common import written

from .test_llm_operators import ODD, SCHEMA, SF, brute_components


def brute_lines(rows, words=50):
    """A line goes if it lies in a run of ``words`` words that occurs earlier."""
    seen, out = set(), {}
    for d, text in sorted(rows):
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if x.split()]
        runs = []
        for a in range(len(full)):
            n = 0
            for b in range(a, len(full)):
                n += len(lines[full[b]].split())
                runs.append((a, b, tuple(lines[i].strip(" \t\r\x0b\x0c") for i in full[a:b + 1]), n))
        gone = set()
        for a, b, key, n in runs:
            if n >= words:
                if key in seen:
                    gone.update(range(full[a], full[b] + 1))
                seen.add(key)
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    meter = fertility.Meter(P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model"))
    first = written(C.STAGES[0][1](spark, docs, SF), "t")
    assert first.columns == docs.columns
    ids = {r["doc_id"] for r in first.collect()}
    want = set()
    for r in docs.collect():
        m = meter.measure(r["text"])
        band = fertility.BANDS.get(r["lang"]) or fertility.BANDS[fertility.script_of(r["text"] or "")]
        if not fertility.base_failed(m) and fertility.in_band(m, band):
            want.add(r["doc_id"])
    assert ids == want

    second = written(C.STAGES[1][1](spark, first, SF), "t")
    rows = {r["doc_id"]: r for r in second.collect()}
    assert second.columns == docs.columns and set(rows) == ids
    assert {d: r["text"] for d, r in rows.items()} == brute_lines([(r["doc_id"], r["text"]) for r in first.collect()])
    assert all(r["n_chars"] == len(r["text"]) for r in rows.values())

    third = written(C.STAGES[2][1](spark, second, SF), "t")
    comp = brute_components([(d, r["text"]) for d, r in rows.items()], 5)
    assert third.columns == docs.columns and {r["doc_id"] for r in third.collect()} == {d for d, c in comp.items() if c[2]}

    fourth = written(C.STAGES[3][1](spark, third, SF), "t")
    assert fourth.columns == docs.columns
    times = Counter(r["doc_id"] for r in fourth.collect())
    assert max(times.values()) <= 3 and set(times) <= {r["doc_id"] for r in third.collect()}

    last = C.STAGES[4][1](spark, fourth, SF).collect()
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")),
                            special_tokens={})
    assert Counter(r["doc_id"] for r in last) == times
    assert all(r["ids"] == lib.encode_ordinary(rows[r["doc_id"]]["text"]) for r in last)


def test_stages_on_odd_and_empty_tables(spark):
    for rows in (ODD, []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for i, (_, stage) in enumerate(C.STAGES):
            docs = written(stage(spark, docs, SF), "t")
            assert i == 4 or docs.columns == SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")
