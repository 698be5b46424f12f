"""Document fingerprints from prefix polynomial hashes.

The hash of a text is the polynomial of its code points modulo 2^31 - 1, at two bases. The array of the hashes of all
its prefixes answers in constant time whether two spans are equal, and a binary search over prefix lengths finds how
far two texts agree from given places (longest common extension).

A fingerprint is a short string cut from these arrays: the length, the hash of the whole text, the hashes of its
prefixes at fixed lengths that grow by an eighth, and the least hashes of its 16-character spans (bottom-k). Two
fingerprints are compared without the texts: a binary search over the prefix hashes finds the common prefix to an
eighth, the least span hashes estimate the share of common spans wherever they stand; the likeness is the larger.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import range_bounds, range_column, ranges_for

P = np.uint64(2 ** 31 - 1)
BASES = (1_103_515_245, 1_664_525_003)
#: Characters of a span, least span hashes kept, bytes kept of a prefix hash and of a span hash.
SPAN, LEAST, PREFIX_BYTES, SPAN_BYTES = 16, 32, 3, 4
_MASK = np.uint64(2 ** 31 - 1)


def _fold(x: np.ndarray) -> np.ndarray:
    """x below 2^63 to an equal value below 2^33."""
    return (x & _MASK) + (x >> np.uint64(31))


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 for x below 2^63."""
    x = _fold(_fold(x))
    x -= P * (x >= P)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1); the table of a worker grows by doubling up to its longest text."""
    t = _POWERS.get(base, np.ones(1, dtype=np.uint64))
    while len(t) < n:
        step = _mod(t[-1:] * np.uint64(base))
        t = np.concatenate([t, _mod(t * step[0])])
    _POWERS[base] = t if len(t) <= 1 << 22 else t[:1 << 22]
    return t[:n]


class Prefixes:
    """The prefix arrays of a text: ``at[k][i]`` is the hash of its first i code points at base k, the code point
    at place j weighing base^j."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        self.n = len(points)
        self.at = []
        for b in BASES:
            # folded terms are below 2^33: their sums stay below 2^63 for texts of up to 2^30 characters
            terms = _fold((points + np.uint64(1)) * powers(b, self.n))
            self.at.append(np.concatenate([[np.uint64(0)], _mod(np.cumsum(terms, dtype=np.uint64))]))

    def span(self, start: int, length: int, k: int) -> int:
        """Hash of a span at base k as if it stood at place 0: equal spans have equal ones wherever they stand."""
        a, p = self.at[k], int(P)
        return (int(a[start + length]) - int(a[start])) * pow(BASES[k], -start, p) % p

    def spans(self, length: int, k: int) -> np.ndarray:
        """The hashes of all spans of one length."""
        a, m = self.at[k], self.n - length + 1
        return _mod((a[length:] + P - a[:m]) * powers(pow(BASES[k], -1, int(P)), m))

    def same(self, start: int, other: Prefixes, other_start: int, length: int) -> bool:
        """Whether two spans are equal."""
        if start + length > self.n or other_start + length > other.n:
            return False
        return all(self.span(start, length, k) == other.span(other_start, length, k) for k in range(len(BASES)))

    def common(self, start: int, other: Prefixes, other_start: int) -> int:
        """Longest common extension to the right, by binary search over its length."""
        lo, hi = 0, min(self.n - start, other.n - other_start)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.same(start, other, other_start, mid):
                lo = mid
            else:
                hi = mid - 1
        return lo


@lru_cache(maxsize=64)
def _grid_to(power: int) -> tuple[int, ...]:
    out, x = [], 1
    while x < 1 << power:
        out.append(x)
        x = max(x + 1, x + x // 8)
    return tuple(out)


def grid(n: int) -> tuple[int, ...]:
    """The prefix lengths that a text of n characters has hashes of; the same ones for all texts."""
    return tuple(x for x in _grid_to(max(1, n.bit_length())) if x <= n)


def fingerprint(text: str) -> str:
    """``length.whole.prefixes.spans``: hexadecimal, then base64. Equal texts have equal fingerprints."""
    p = Prefixes(text)
    n = p.n
    whole = "".join(f"{int(a[n]):08x}" for a in p.at)
    at = np.array(grid(n), dtype=np.int64)
    both = (p.at[0][at] << np.uint64(31)) | p.at[1][at]
    both ^= both >> np.uint64(29)
    prefix = (both * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 8 * PREFIX_BYTES)).astype("<u4")
    prefix = prefix.view(np.uint8).reshape(-1, 4)[:, :PREFIX_BYTES].tobytes()
    size = min(SPAN, n)
    spans = b""
    if n:
        h = p.spans(size, 0) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F) >> np.uint64(64 - 8 * SPAN_BYTES)
        low = np.unique(h[h < np.uint64(min(1.0, 8 * LEAST / len(h)) * 2 ** (8 * SPAN_BYTES))])
        h = low if len(low) >= LEAST else np.unique(h)  # the least ones, mostly without sorting all
        spans = h[:LEAST].astype("<u4").tobytes()
    return f"{n:x}.{whole}.{base64.b64encode(prefix).decode()}.{base64.b64encode(spans).decode()}"


def likeness(a: str, b: str) -> float:
    """How alike two fingerprints' texts are, 0 to 1; 1 for equal ones."""
    if a == b:
        return 1.0
    (n, _, pa_, sa), (m, _, pb, sb) = a.split("."), b.split(".")
    n, m = int(n, 16), int(m, 16)
    if not n or not m:
        return 0.0
    x, y = base64.b64decode(pa_), base64.b64decode(pb)
    at = grid(min(n, m))
    lo, hi = 0, len(at)
    w = PREFIX_BYTES
    while lo < hi:  # prefixes agree up to some length and no further
        mid = (lo + hi) // 2
        if x[w * mid:w * mid + w] == y[w * mid:w * mid + w]:
            lo = mid + 1
        else:
            hi = mid
    prefix = at[lo - 1] / max(n, m) if lo else 0.0
    s, t = np.frombuffer(base64.b64decode(sa), dtype="<u4"), np.frombuffer(base64.b64decode(sb), dtype="<u4")
    least = np.union1d(s, t)[:LEAST]
    spans = float(np.isin(least, np.intersect1d(s, t)).mean()) if len(least) else 0.0
    return min(1.0, max(prefix, spans))


def fingerprints(df: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of a text to every row (null counts as empty); nothing is shuffled."""
    from vigil.llm.common import arrow_map

    return arrow_map(df, lambda b: {out: [fingerprint(t or "") for t in b.column(text_col).to_pylist()]},
                     [T.StructField(out, T.StringType(), False)])


def with_next(docs: DataFrame) -> DataFrame:
    """(range, extra, doc_id, text) dealt so that a task holds ranges of doc_id in falling order, each followed by
    the first row of the next range (``extra``; after the last, of the first).

    Only the ranges' largest ids pass through the driver, one for each range.
    """
    spark = docs.sparkSession
    bounds = range_bounds(docs, "doc_id", ranges_for(spark))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = docs.withColumn("range", range_column(bounds, "doc_id"))
    # from the ids alone: the largest id of each range and the ranges there are, in falling order; null ids are range 0
    tops = sorted(((r["range"], r["top"]) for r in ranged.groupBy("range").agg(F.max("doc_id").alias("top")).collect()),
                  reverse=True)
    before = [(top, tops[i - 1][0], k) for i, (k, top) in enumerate(tops)]
    extra = spark.createDataFrame(before, "top bigint, before int, own int")  # a row for each range
    met = ranged.join(F.broadcast(extra), F.col("doc_id").eqNullSafe(F.col("top")) & (F.col("range") == F.col("own")), "left")
    place = F.when(F.col("before").isNull(), F.array(F.struct("range", F.lit(0).alias("extra")))).otherwise(
        F.array(F.struct("range", F.lit(0).alias("extra")), F.struct(F.col("before").alias("range"), F.lit(1).alias("extra"))))
    dealt = met.select("doc_id", "text", F.explode(place).alias("p")).select("p.range", "p.extra", "doc_id", "text")
    return dealt.repartition("range").sortWithinPartitions(
        "range", "extra", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())


def edited(text: str, other: str) -> str:
    """``text`` with its last third (floor) replaced by the first as many code points (or all) of ``other``."""
    k = len(text) // 3
    return text[:len(text) - k] + other[:k]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``with_next`` in order: each document against the one after it."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held = None  # (range, doc_id, text, fingerprint) that waits for its next document
    for b in batches:
        out = []
        for k, extra, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("range", "extra", "doc_id", "text"))):
            text = text or ""
            mark = None
            if held is not None and held[0] == k:
                mark = fingerprint(text)
                other = edited(held[2], text)
                changed = held[3] if other == held[2] else fingerprint(other)
                out.append((held[1], len(held[2]), hashlib.sha256(other.encode()).hexdigest(), held[3], changed,
                            likeness(held[3], changed), likeness(held[3], mark)))
            held = None if extra else (k, doc_id, text, mark or fingerprint(text))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=t) for i, t in enumerate(types)], names=names)


def compared(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and the likeness to it and to the next document.

    The next document is the one with the next smaller doc_id (rows with one id by text, those without id last);
    after the last comes the first, so a single document is its own next. Null texts count as empty; an empty table
    gives an empty result. The texts are shuffled once; a task holds two of them at a time.
    """
    schema = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    return with_next(docs).mapInArrow(_compared, schema)


def op7_fingerprints(docs: DataFrame) -> DataFrame:
    return compared(docs.select("doc_id", "text"))
