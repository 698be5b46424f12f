"""Alignment of two tokenizers over the same bytes, by pointer jumping.

Both tokenizers cut one byte string. Every token points to the token of the other side that reaches farthest right
among those it overlaps; a token whose end is also an end of the other side's token points to the end token of that
place. Doubling the pointers (``succ = succ[succ]``) until nothing changes leads every token to the last one of its
component: components are the groups between common ends. All texts of an Arrow batch are aligned in the same arrays.

The links (pairs of token occurrences in one group) of a document become its distinct id pairs with their numbers; a
corpus-wide count says how many documents hold a pair. The pairs that most documents hold, ``LIMIT`` at most, are
broadcast; what a document holds beside them is joined by its code.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import arrow_map, held, written

#: Pairs in the broadcast table (16 bytes each) at most.
LIMIT = 1 << 20
#: Pairs a task counts before it hands them on.
FLUSH = 1 << 21
#: A group with more links than this counts its distinct ids instead of listing its links.
MANY_LINKS = 1 << 12
#: White space as the byte-level vocabulary's pattern has it, which never takes the end of a word with what follows.
WHITE, NOT_WHITE = re.compile(r"[^\S\x1c-\x1f]"), r"[\S\x1c-\x1f]"
#: Stretches a worker keeps the alignment of, and the longest of them.
KEPT, KEPT_CHARS = 1 << 17, 48
#: Characters of new stretches that go through the libraries in one call.
BLOCK_CHARS = 1 << 18


def byte_level_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, the others for U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


class ByteLevel:
    """A byte-level BPE of the tokenizers library's file format whose ids are merge ranks; special tokens are text."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = byte_level_alphabet()
        ranks = {bytes(map(back.__getitem__, t)): i for t, i in model["vocab"].items() if all(c in back for c in t)}
        merges = ("".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"])
        merged = [ranks[bytes(map(back.__getitem__, m))] for m in merges]
        if merged != sorted(merged) or sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError(f"{path}: ids are not merge ranks")
        self.tokens = sorted(ranks, key=ranks.get)
        self.encode = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Pieces:
    """A sentencepiece model that puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.vocab_size())]
        self.tokens = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("\u2581", " ").encode("utf-8")
                       for i, n in enumerate(names)]
        self.encode = model.encode
        self.cuts = self._cuts(names)

    @staticmethod
    def _cuts(names: list[str]) -> re.Pattern | None:
        """Finds the stretches that every encoding may be cut into, None if there are none: a run of white space and what
        follows, as long as no piece of several characters has that white space. Pieces with line ends, say, join."""
        joined = {c for n in names if len(n) > 1 for c in n.lstrip("\u2581") if c == "\u2581" or WHITE.match(c)}
        if joined & {" ", "\u2581"}:
            return None
        if not joined:
            return re.compile(f"{WHITE.pattern}*{NOT_WHITE}+|{WHITE.pattern}+")
        join = "[" + "".join(map(re.escape, sorted(joined))) + "]"
        return re.compile(f"{WHITE.pattern}*{NOT_WHITE}+(?:{join}{WHITE.pattern}*{NOT_WHITE}*)*|{WHITE.pattern}+")


def groups(len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of every token of both sides, given the tokens' byte lengths (equal totals, none 0)."""
    na, nb = len(len_a), len(len_b)
    if not na:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
    to_b = np.searchsorted(end_b, end_a)  # holds the token's last byte, so none it overlaps lies farther right
    to_a = np.searchsorted(end_a, end_b)
    own = np.arange(na, na + nb)
    succ = np.concatenate([to_b + na, np.where(end_a[to_a] > end_b, to_a, own)])
    while True:
        jump = succ[succ]
        if np.array_equal(jump, succ):
            break
        succ = jump
    number = np.cumsum(succ[na:] == own) - 1
    return number[succ[:na] - na], number[succ[na:] - na]


def code_type(size_a: int, size_b: int) -> type:
    """The type that holds the code of every pair."""
    return np.uint32 if size_a * size_b < 1 << 32 else np.uint64


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), dtype=bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n


def _blocks(stretches: set[str]) -> Iterator[tuple[bool, list[str]]]:
    """Blocks of some ``BLOCK_CHARS``: those that may stand in one text, then the others."""
    for apart in (True, False):
        block, size = [], 0
        for s in stretches:
            if s[-1].isspace() != apart:
                block.append(s)
                size += len(s)
                if size > BLOCK_CHARS:
                    yield apart, block
                    block, size = [], 0
        if block:
            yield apart, block


def _spans(sizes: np.ndarray) -> np.ndarray:
    """Start of each span and the end of the last."""
    return np.concatenate([[0], np.cumsum(sizes)])


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


#: What the alignment says of one stretch: n_a, n_b, n_groups, n_links, its groups' text, the code of every link (or of
#: every distinct pair, if the links of each follow as the last entry, else None). None in its place: a side changes it.
Record = tuple[int, int, int, int, bytes, bytes, bytes | None]


class Aligner:
    """Encodes and aligns texts. What lies between two runs of white space is aligned once and kept: both sides' tokens
    end before such a run, so groups never go on over it."""

    def __init__(self, first: ByteLevel, second: Pieces):
        self.a, self.b = first, second
        self.size_a, self.size_b = len(first.tokens), len(second.tokens)
        self.len_a = np.array([len(t) for t in first.tokens])
        self.len_b = np.array([len(t) for t in second.tokens])
        self.code = code_type(self.size_a, self.size_b)
        # decimal ids with what follows them: A inside and at the end of its group's ids, then B likewise
        self.say = [b"%d%c" % (i, c) for n, last in ((self.size_a, b"|"), (self.size_b, b";"))
                    for i in range(n) for c in (b",", last)]
        self.say_len = np.array(list(map(len, self.say)))
        self.known: dict[str, Record | None] = {}
        self.before: dict[str, Record | None] = {}

    def _tokens(self, whole: str) -> tuple[list[int], list[int]] | None:
        """Both sides' ids of a text that may begin with white space, None if a side's bytes differ from it."""
        if whole[0] == " ":
            b = self.b.encode(whole[1:])
        else:  # a stretch after other white space: without the space that the model puts first
            b = self.b.encode(whole)[1:]
        raw = whole.encode("utf-8")
        if b"".join(map(self.b.tokens.__getitem__, b)) != raw:
            return None
        a = self.a.encode(whole)
        return (a, b) if sum(map(len, map(self.a.tokens.__getitem__, a))) == len(raw) else None

    def _joined(self, stretches: list[str]) -> tuple | None:
        """Ids of both sides and how many each stretch has, from one call of each library, None if bytes differ.
        All stretches begin with white space and end with something else, so they stay apart in one text."""
        texts = [" .", *stretches]
        sides = self._tokens("".join(texts))
        if sides is None:
            return None
        ends = np.cumsum([len(t) if t.isascii() else len(t.encode("utf-8")) for t in texts])
        out = []
        for ids, lengths in zip(sides, (self.len_a, self.len_b)):
            ids = np.array(ids, dtype=np.int64)
            n = np.searchsorted(np.cumsum(lengths[ids]), ends) + 1
            out += [ids[n[0]:], np.diff(n)]
        return out

    def align(self, texts: list[str], apart: bool = False) -> list[Record | None]:
        """The records of texts, aligned in the same arrays. ``apart``: they are stretches that begin with white space and
        end with something else."""
        got = self._joined(texts) if apart else None
        if got is not None:
            ids_a, n_a, ids_b, n_b = got
        else:
            sides = [self._tokens(t) for t in texts]
            good = [x for x in sides if x is not None]
            n_a, n_b = (np.array([len(x[i]) for x in good], dtype=np.int64) for i in (0, 1))
            ids_a, ids_b = (np.array(list(chain.from_iterable(x[i] for x in good)), dtype=np.int64) for i in (0, 1))
        doc_a, doc_b = _spans(n_a), _spans(n_b)
        of_a, of_b = groups(self.len_a[ids_a], self.len_b[ids_b])
        k_a, k_b = np.bincount(of_a), np.bincount(of_b)
        at_a, at_b = _spans(k_a), _spans(k_b)
        # the ids as they are said: in group order, A before B, the last of each side in a group marked
        order = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        for ids, of, at, shift, base in ((ids_a, of_a, at_a, at_b[:-1], 0), (ids_b, of_b, at_b, at_a[1:], self.size_a)):
            last = np.zeros(len(ids), dtype=np.int64)
            last[at[1:] - 1] = 1
            order[np.arange(len(ids)) + shift[of]] = 2 * (base + ids) + last
        said = b"".join(map(self.say.__getitem__, order.tolist()))
        said_at = _spans(self.say_len[order])[doc_a + doc_b].tolist()
        doc_g = np.searchsorted(at_b, doc_b)  # each text's first group
        links = k_a * k_b
        n_groups, n_links = np.diff(doc_g), np.diff(_spans(links)[doc_g])
        # every link of the groups with few of them
        few = links <= MANY_LINKS
        times = np.where(few, k_b, 0)[of_a]
        into = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        codes = (np.repeat(ids_a * self.size_b, times) + ids_b[np.repeat(at_b[of_a], times) + into]).astype(self.code)
        codes_at = _spans(np.where(few, links, 0))[doc_g]
        large = np.flatnonzero(~few)
        large_at = np.searchsorted(large, doc_g)
        raw, raw_at = codes.tobytes(), (codes_at * codes.itemsize).tolist()
        out = list(zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(),
                       [said[s:e - 1] for s, e in zip(said_at, said_at[1:])],
                       [raw[s:e] for s, e in zip(raw_at, raw_at[1:])], repeat(None)))
        for i in np.flatnonzero(np.diff(large_at)):
            found, n = self._large(codes[codes_at[i]:codes_at[i + 1]], ids_a, ids_b, at_a, at_b,
                                   large[large_at[i]:large_at[i + 1]])
            out[i] = (*out[i][:5], found.tobytes(), n.tobytes())
        if got is not None:
            return out
        rest = iter(out)
        return [None if x is None else next(rest) for x in sides]

    def _large(self, codes, ids_a, ids_b, at_a, at_b, those) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs and their links: ``codes``, one link each, and groups with many links, by their distinct ids."""
        pairs, times = [codes], [np.ones(len(codes), dtype=np.int64)]
        for g in those:
            x, nx = np.unique(ids_a[at_a[g]:at_a[g + 1]], return_counts=True)
            y, ny = np.unique(ids_b[at_b[g]:at_b[g + 1]], return_counts=True)
            pairs.append(((x * self.size_b)[:, None] + y).ravel().astype(self.code))
            times.append((nx[:, None] * ny).ravel())
        return summed(np.concatenate(pairs), np.concatenate(times))

    def records(self, wanted: set[str]) -> dict[str, Record | None]:
        """The records of stretches; those met lately are kept, ``KEPT`` at most in each of two generations."""
        known, before = self.known, self.before
        fresh = wanted.difference(known)
        again = fresh.intersection(before)
        known.update((s, before[s]) for s in again)
        out = {s: known[s] for s in wanted - fresh | again}
        for apart, block in _blocks(fresh - again):
            out.update(zip(block, self.align(block, apart)))
        known.update((s, out[s]) for s in fresh - again if len(s) <= KEPT_CHARS)
        if len(known) > KEPT:
            self.before, self.known = known, {}
        return out

    def batch(self, texts: list[str | None]) -> dict[str, list]:
        """Per text: the numbers of tokens, groups and links, the groups' digest, and the packed distinct pairs (codes
        A * size(B) + B, ascending) with how many links each has."""
        parts = [(self.b.cuts.findall(" " + t) if self.b.cuts else [" " + t]) if t else [] for t in texts]
        known = self.records(set(chain.from_iterable(parts)))
        out = {k: [] for k in (*_COUNTS, "groups_sha256")}
        held, weighted = [], {}
        for i, p in enumerate(parts):
            records = list(map(known.__getitem__, p))
            if None in records:  # a side changes a stretch: the text is judged as a whole
                records = self.align([" " + texts[i]])
            if not records or records[0] is None:
                columns = [()] * 7
            else:
                columns = list(zip(*records))
            for k, c in zip(_COUNTS, columns):
                out[k].append(sum(c))
            out["groups_sha256"].append(hashlib.sha256(b";".join(columns[4])).hexdigest() if columns[4] else "")
            held.append(b"".join(columns[5]))
            if columns[6].count(None) != len(columns[6]):
                weighted[i] = [np.ones(len(c) // self.code().itemsize, dtype=np.int64) if n is None else
                               np.frombuffer(n, dtype=np.int64)
                               for c, n in zip(columns[5], columns[6])]
        size = np.array([len(h) // self.code().itemsize for h in held], dtype=np.int64)
        keys = np.frombuffer(b"".join(held), dtype=self.code).astype(np.int64)
        n_codes = self.size_a * self.size_b
        keys += np.repeat(np.arange(len(texts)) * n_codes, size)
        if weighted:
            n = np.ones(len(keys), dtype=np.int64)
            at = _spans(size)
            for i, w in weighted.items():
                n[at[i]:at[i + 1]] = np.concatenate(w)
            keys, n = summed(keys, n)
        else:
            keys.sort()
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            keys, n = keys[first], np.diff(first, append=len(keys))
        at = np.searchsorted(keys, np.arange(len(texts) + 1) * n_codes)
        codes, n = (keys % n_codes).astype(self.code), n.astype(np.int64)
        out["pairs"] = [codes[s:e].tobytes() for s, e in zip(at[:-1], at[1:])]
        out["times"] = [n[s:e].tobytes() for s, e in zip(at[:-1], at[1:])]
        return out


def aligner_of(first: str, second: str) -> Aligner:
    """The worker's aligner of two vocabulary files, kept across tasks."""
    return held(("align", first, second), lambda: Aligner(ByteLevel(first), Pieces(second)))


def aligned(df: DataFrame, first: str, second: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row of ``df`` with ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256`` and its packed pairs
    (``pairs``: codes, ``times``: links of each as 64-bit integers). Nothing is shuffled."""
    fields = [T.StructField(c, T.LongType(), False) for c in _COUNTS] + [
        T.StructField("groups_sha256", T.StringType(), False), T.StructField("pairs", T.BinaryType(), False),
        T.StructField("times", T.BinaryType(), False)]
    return arrow_map(df, lambda b: aligner_of(first, second).batch(b.column(text_col).to_pylist()), fields, keep)


def pair_counts(rows: DataFrame, code: str) -> DataFrame:
    """(code, n): in how many rows each pair is; tasks add up before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged():
            return summed(np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held]))

        def rows_of(codes, n):
            for s in range(0, len(codes), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(codes[s:s + (1 << 16)].astype(np.int64)),
                                                  pa.array(n[s:s + (1 << 16)])], names=["code", "n"])

        for b in batches:
            codes = np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=code)
            if not len(codes):
                continue
            codes, n = np.unique(codes, return_counts=True)
            held.append((codes, n.astype(np.int64)))
            size += len(codes)
            if size > 2 * FLUSH:
                held = [merged()]
                size = len(held[0][0])
                if size > FLUSH:
                    yield from rows_of(*held[0])
                    held, size = [], 0
        if held:
            yield from rows_of(*merged())

    return rows.select("pairs").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def align_corpus(spark: SparkSession, df: DataFrame, first: str, second: str, text_col: str = "text",
                 keep: list[str] | None = None, limit: int = LIMIT) -> DataFrame:
    """``aligned`` plus, for every row, ``n_best``: links whose pair is in as many documents as any pair of its A id, and
    ``count_sum``: its links' document counts added up.

    Each row is a document, also a repeated one or one without an id. Null and empty texts, and texts a tokenizer does
    not give back byte for byte, have zeros and an empty digest. Other columns pass through (one named like a result is
    replaced). Groups of any size are counted whole.
    """
    import public_tokenizers as P

    first, second = first or P.path("byte_bpe_50k.json"), second or P.path("piece_bpe_32k.model")
    rows = aligned(df, first, second, text_col, keep).withColumn("_row", F.monotonically_increasing_id())
    rows = written(rows, "align-rows", "zstd")
    size_b = len(Pieces(second).tokens)
    code = code_type(len(ByteLevel(first).tokens), size_b)
    counts = written(pair_counts(rows, code), "align-counts")
    of_a = F.expr(f"code div {size_b}")
    best = counts.groupBy(of_a.alias("a")).agg(F.max("n").alias("most"))
    table = counts.withColumn("a", of_a).join(best, "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))

    # the pairs of most documents, at most ``limit`` of them: by the power of two of their count
    steps = sorted(((r["k"], r["c"]) for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k"))
                    .agg(F.count("*").alias("c")).collect()), reverse=True)
    least, total = 1 << 62, 0
    for k, c in steps:
        if total + c > limit:
            break
        least, total = 1 << k, total + c
    whole = total == sum(c for _, c in steps)
    if not whole:
        table = written(table, "align-table")
    known = table.filter(F.col("n") >= least).orderBy("code").toArrow()
    shared = spark.sparkContext.broadcast(tuple(np.ascontiguousarray(known.column(c).to_numpy()) for c in ("code", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, best = shared.value
        for b in batches:
            raw = b.column("pairs").to_pylist()
            own = np.frombuffer(b"".join(raw), dtype=code).astype(np.int64)
            times = np.frombuffer(b"".join(b.column("times").to_pylist()), dtype=np.int64)
            at = _spans(np.array([len(x) // code().itemsize for x in raw], dtype=np.int64))
            place = np.minimum(np.searchsorted(codes, own), max(0, len(codes) - 1))
            hit = codes[place] == own if len(codes) else np.zeros(len(own), dtype=bool)
            held = np.where(hit, n[place], 0) * times if len(codes) else np.zeros(len(own), dtype=np.int64)
            top = np.where(hit & best[place], times, 0) if len(codes) else held
            cols = [b.column(c) for c in names if c not in ("n_best", "count_sum", "rest")]
            sums = [np.diff(_spans(x)[at]) for x in (top, held)]
            rest = [None] * len(raw)
            if not whole:
                for i in np.unique(np.searchsorted(at, np.flatnonzero(~hit), side="right") - 1):
                    s = slice(at[i], at[i + 1])
                    miss = ~hit[s]
                    rest[i] = [{"code": c, "times": t} for c, t in zip(own[s][miss].tolist(), times[s][miss].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*cols, *map(pa.array, sums), pa.array(rest, type=rest_type)], names=names)

    rest_type = pa.list_(pa.struct([("code", pa.int64()), ("times", pa.int64())]))
    new = ("n_best", "count_sum")
    kept = [f for f in rows.schema.fields if f.name not in ("pairs", "times", *new, "rest")]
    names = [f.name for f in kept] + [*new, "rest"]
    schema = T.StructType(kept + [T.StructField(c, T.LongType(), False) for c in new] + [T.StructField(
        "rest", T.ArrayType(T.StructType([T.StructField("code", T.LongType()), T.StructField("times", T.LongType())])))])
    out = rows.mapInArrow(run, schema)
    if whole:
        return out.drop("rest", "_row")
    out = written(out, "align-known")
    rare = (out.select("_row", F.explode("rest").alias("x")).select("_row", "x.*")
            .join(table.filter(F.col("n") < least), "code").groupBy("_row")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"),
                 F.sum(F.col("times") * F.col("n")).alias("_sum")))
    out = out.join(rare, "_row", "left")
    return (out.withColumn("n_best", F.col("n_best") + F.coalesce("_best", F.lit(0)))
            .withColumn("count_sum", F.col("count_sum") + F.coalesce("_sum", F.lit(0)))
            .drop("_row", "rest", "_best", "_sum"))


def op13_align(spark: SparkSession, docs: DataFrame) -> DataFrame:
    got = align_corpus(spark, docs.select("doc_id", "text"), None, None, keep=["doc_id"])
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), *_COUNTS, "n_best", "count_sum", "groups_sha256")
