"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token is a doubly linked list of byte spans. Each mergeable neighbour pair waits in the bucket of its merge
rank; a bucket holds list positions, leftmost first. A bitmap of two levels marks the buckets in use, so
find-first-set on two words gives the next rank. A merge only removes and adds the pairs beside it; entries whose
pair has changed since are stale and are skipped when they come up. A pre-token of n bytes costs O(n log n), also
when it has millions of bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import CUT, Cache2, arrow_map, held

#: Bytes of a worker's lookup tables: pieces at the start of a text, pieces after a space, pre-tokens.
FIRST_BYTES, PIECE_BYTES, PRE_TOKEN_BYTES = 8 << 20, 56 << 20, 160 << 20
#: Longer pieces are not kept.
CACHE_CHARS = 48


def load_ranks(path: str) -> dict[bytes, int]:
    """Merge ranks from a tiktoken file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: Ranks in a word of the lower bitmap level.
WORD_BITS = 8
LOW = (1 << WORD_BITS) - 1
_BIT = [1 << i for i in range(LOW + 1)]


class Encoder:
    """Encodes texts to packed little-endian unsigned 32-bit ids, each match of ``pattern`` separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find: Callable = regex.compile(pattern).findall
        self.longest = max(map(len, ranks), default=1)
        n = max(ranks.values(), default=0) + 1
        # the rank queue, empty between calls: buckets by rank, a bitmap of the ranks in use; merge keeps the upper level
        self.buckets: dict[int, int | list[int]] = {}
        self.in_use = [0] * ((n >> WORD_BITS) + 1)
        self.byte_pairs = [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.tokens = Cache2(self.pre_token, PRE_TOKEN_BYTES)
        self.first = Cache2(lambda piece: self.pieces(piece), FIRST_BYTES)
        self.later = Cache2(lambda piece: self.pieces(" " + piece), PIECE_BYTES)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the lowest-ranked neighbour pair merges first, the leftmost of equals."""
        ranks, n, longest = self.ranks, len(piece), self.longest
        get, buckets, in_use, bit = ranks.get, self.buckets, self.in_use, _BIT
        get_bucket = buckets.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # rank of the span at i with the one after it; -1: none, or i is no span's start
        byte_pairs = self.byte_pairs
        pair = [byte_pairs[a << 8 | b] for a, b in zip(piece, piece[1:])]
        pair.append(-1)
        top = 0  # bitmap of the words of in_use that are not 0
        new = [(r, i) for i, r in enumerate(pair) if r >= 0]
        while True:
            for r, at in new:
                b = get_bucket(r)
                if b is None:
                    buckets[r] = at
                    w = r >> WORD_BITS
                    in_use[w] |= bit[r & LOW]
                    top |= bit[w] if w <= LOW else 1 << w
                elif type(b) is int:  # most buckets hold one position
                    buckets[r] = [b, at] if b < at else [at, b]
                else:
                    heappush(b, at)
            while top:
                # find-first-set on both levels: the lowest rank in use, and its leftmost position
                w = (top & -top).bit_length() - 1
                x = in_use[w]
                rank = (w << WORD_BITS) + (x & -x).bit_length() - 1
                i = buckets[rank]
                if type(i) is not int:
                    b = i
                    i = heappop(b)
                    if len(b) == 1:
                        buckets[rank] = b[0]
                else:
                    del buckets[rank]
                    in_use[w] = x = x & (x - 1)
                    if not x:
                        top &= top - 1
                if pair[i] == rank:
                    break  # others are stale
            else:
                break
            j = after[i]
            after[i] = k = after[j]
            pair[j] = pair[i] = -1
            new = []
            if k < n:
                before[k] = i
                end = after[k]
                if end - i <= longest and (r := get(piece[i:end], -1)) >= 0:
                    pair[i] = r
                    new.append((r, i))
            h = before[i]
            if h >= 0:
                pair[h] = -1
                if k - h <= longest and (r := get(piece[h:k], -1)) >= 0:
                    pair[h] = r
                    new.append((r, h))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i:after[i]]])
            i = after[i]
        return ids

    def pre_token(self, text: str) -> bytes:
        piece = text.encode("utf-8")
        whole = self.ranks.get(piece)
        ids = [whole] if whole is not None else self.merge(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def pieces(self, text: str) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[t] if len(t) <= CACHE_CHARS else self.pre_token(t) for t in self.find(text)])

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a text; null counts as empty."""
        if not text:
            return b""
        parts = CUT.split(text)
        first, later = self.first, self.later
        head = parts[0]
        if len(text) <= CACHE_CHARS or max(map(len, parts)) <= CACHE_CHARS:
            return first[head] + b"".join(map(later.__getitem__, parts[1:]))
        out = [first[head] if len(head) <= CACHE_CHARS else self.pieces(head)]
        out += [later[p] if len(p) <= CACHE_CHARS else self.pieces(" " + p) for p in parts[1:]]
        return b"".join(out)


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", out: str = "ids",
           drop_text: bool = False, lists: bool = False) -> DataFrame:
    """Add ``out`` (binary: ids as little-endian unsigned 32-bit integers; ``lists``: ``array<int>``) and ``n_tokens`` to
    every row.

    Null and empty texts give no ids. Special tokens are ordinary text. Rows are independent: repeated rows get
    equal ids, other columns pass through (a column named ``out`` or ``n_tokens`` is replaced). The vocabulary is
    broadcast (its size is the file's, about 1 MB); nothing is shuffled.
    """
    sc = df.sparkSession.sparkContext
    shared, key = sc.broadcast(ranks), ("bpe", sc.applicationId, len(ranks), hash(frozenset(ranks.items())), pattern)

    def run(b):
        enc = held(key, lambda: Encoder(shared.value, pattern))
        got = [enc.encode(t) for t in b.column(text_col).to_pylist()]
        return {out: id_lists(got) if lists else got, "n_tokens": [len(g) // 4 for g in got]}

    keep = [c for c in df.columns if not (drop_text and c == text_col)]
    kind = T.ArrayType(T.IntegerType()) if lists else T.BinaryType()
    return arrow_map(df, run, [T.StructField(out, kind, False), T.StructField("n_tokens", T.LongType(), False)],
                     keep)


def decode(df: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` (binary): the bytes of the packed ids, null for null. An id outside the vocabulary is an error."""
    shared = df.sparkSession.sparkContext.broadcast({i: t for t, i in ranks.items()})

    def run(b):
        token = shared.value.__getitem__
        return {out: [None if x is None else b"".join(map(token, memoryview(x).cast("I").tolist()))
                      for x in b.column(ids_col).to_pylist()]}

    return arrow_map(df, run, [T.StructField(out, T.BinaryType(), True)])


def id_lists(packed: list[bytes], null=None) -> pa.ListArray:
    """Packed ids as an Arrow list array."""
    flat = np.frombuffer(b"".join(packed), dtype="<u4").astype("int32")
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=null)


def unpack(df: DataFrame, ids_col: str = "ids") -> DataFrame:
    """Packed ids as ``array<int>``, null for null."""
    def run(b):
        col = b.column(ids_col)
        return {ids_col: id_lists([x or b"" for x in col.to_pylist()], col.is_null())}

    return arrow_map(df, run, [T.StructField(ids_col, T.ArrayType(T.IntegerType()), True)])


def op1_bpe(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The digests of every document's ids and of their decoding."""
    import public_tokenizers as P

    ranks = load_ranks(vocabulary or P.path("byte_bpe_multi_50k.tiktoken"))
    ids = encode(docs.select("doc_id", "text"), ranks, P.PATTERN, drop_text=True)
    back = decode(ids, ranks)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
