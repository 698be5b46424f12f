"""Token ids in compact binary files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are counted over the whole corpus and renamed by falling frequency, so that the common ones fit one byte. A
document's renamed ids are stored as two streams: control bytes, two bits for each id with its length in bytes less
one, four ids to a byte; then the data bytes, little-endian, without the leading zero bytes. A reader looks each
control byte up in a 256 x 4 table of lengths and gathers all ids of a document with numpy.

A file holds documents in ascending order of doc_id, files are ordered by name, and every file says at which id of
the corpus it begins, so that files can be read in any order and by any task. ``ranks.bin`` has the ids by rank.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import held, range_bounds, range_of, ranges_for, shared_path, written

MAGIC = b"VTOK1\n"
#: A file is closed when its streams reach so many bytes; a larger document has a file of its own.
FILE_BYTES = 8 << 20
CACHE_BYTES = 128 << 20
#: Longer pieces are not kept.
KEPT_BYTES = 64
RUNS_A_CALL = 256

#: Letters of which every Unicode version says so (Latin and Cyrillic); others are left to the library's pattern.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏЀ-ҁҊ-ԯ"
#: Kinds of bytes. Hard ones keep a text from being cut at its runs of letters: other letters and marks beyond ASCII, an
#: apostrophe (it takes letters with it) and control characters; so do two white ones in a row (the last is cut off).
_LETTER, _WHITE, _HARD = 1, 2, 3
_IS_LETTER = np.array([re.match(f"[{_LETTERS}]", chr(c)) is not None for c in range(0x800)])
_KINDS = np.full(256, _HARD, dtype=np.uint8)
_KINDS[0x21:0x7F] = 0
_KINDS[ord("'")] = _HARD
_KINDS[:0x80][_IS_LETTER[:0x80]] = _LETTER
_KINDS[[0x20, 0x0A, 0x09]] = _WHITE
#: White space as ``CUT`` sees it: its ASCII bytes, and the other characters by their two or three bytes.
_BLANKS = [chr(c).encode() for c in range(0x3001) if chr(c).isspace()]
_BLANK = np.isin(np.arange(256), [b[0] for b in _BLANKS if len(b) == 1])
_BLANK2, _BLANK3 = ([int.from_bytes(b) for b in _BLANKS if len(b) == n] for n in (2, 3))
#: A run of letters with the space before it, a pre-token as it is.
_RUN, _ASCII_RUN = re.compile(rf" ?[{_LETTERS}]+"), re.compile(rb" ?[A-Za-z]+")
#: The byte-level alphabet writes printable Latin-1 bytes as themselves, the others from U+0100 on.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_ALPHABET = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: The alphabet by byte, for runs of letters with zero bytes between them, which become the spaces the runs are split at.
_SPLIT = " " + "".join(chr(_ALPHABET.get(b, b)) for b in range(1, 256))

#: Bytes of the four ids of each control byte, and the mask of an id with so many bytes.
LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3).astype(np.int64) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit integers."""
    v = np.ascontiguousarray(values, dtype="<u4")
    n = len(v)
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    two = np.zeros(-(-n // 4) * 4, dtype=np.uint8)
    two[:n] = size - 1
    control = (two.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    data = v.view(np.uint8).reshape(n, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` integers of control and data bytes (``data`` may run on)."""
    size = LENGTHS[control].ravel()[:n]
    at = np.cumsum(size) - size
    padded = np.concatenate([data[:int(size.sum())], np.zeros(4, dtype=np.uint8)])
    return padded[at[:, None] + np.arange(4)].view("<u4").ravel() & _MASKS[size]


def pieces(data: np.ndarray, heads: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin whose UTF-8 bytes follow each other in ``data``. ``heads``: where the texts begin;
    ``alone``: which of them stay whole. Plain stretches are cut into runs of letters, with the space before them, and
    what is between two of them; a part from one ``CUT`` to the next that has something hard in it is one piece."""
    kind = _KINDS[data]
    if data.max() > 0x7F:
        at = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xDF) & (data[1:] >> 6 == 2))
        at = at[_IS_LETTER[(data[at].astype(np.int64) & 0x1F) << 6 | data[at + 1] & 0x3F]]
        kind[at] = kind[at + 1] = _LETTER
    letter, white, hard = kind == _LETTER, kind == _WHITE, kind == _HARD
    space = data == 0x20
    head = np.zeros(len(data), dtype=bool)
    head[heads] = True
    begins = letter[1:] & ~letter[:-1]
    spaced = begins & space[:-1] & ~head[1:]
    cut = head.copy()
    cut[1:] |= (letter[:-1] & ~letter[1:]) | (begins & ~spaced)
    cut[:-1] |= spaced
    pair = white[:-1] & white[1:] & ~head[1:]
    if not (hard.any() or pair.any() or alone.any()):
        return np.flatnonzero(cut)
    part = head.copy()
    part[:-1] |= space[:-1] & ~_BLANK[data[1:]] & ~head[1:]
    odd = np.flatnonzero(part[:-1] & space[:-1] & (data[1:] > 0x7F) & ~head[1:])  # before white space beyond ASCII?
    if len(odd):
        code = np.append(data, np.zeros(3, dtype=np.uint8))[odd[:, None] + [1, 2, 3]].astype(np.int64) @ [1 << 16, 1 << 8, 1]
        blank = odd[np.isin(code, _BLANK3) | np.isin(code >> 8, _BLANK2)]
        part[blank] = head[blank]
    at = np.flatnonzero(part)
    whole = alone[np.searchsorted(heads, at, side="right") - 1]
    at, whole = at[~whole | head[at]], whole[~whole | head[at]]
    hard[1:] |= pair & ~part[1:]
    whole[np.searchsorted(at, np.flatnonzero(hard), side="right") - 1] = True
    cuts = np.flatnonzero(cut)
    cut[cuts[whole[np.searchsorted(at, cuts, side="right") - 1]]] = False
    cut[at[whole]] = True
    cut[at[1:][whole[:-1]]] = True
    return np.flatnonzero(cut)


class Table:
    """A bounded table of the ids of pieces, in two generations: when half of ``limit`` bytes (keys, values and the table's
    own) are in use it becomes the old one; entries still in use come back from there, the others go."""

    def __init__(self, limit: int):
        self.limit, self.now, self.old, self.used = limit // 2, {}, {}, 0

    def get_all(self, keys: list[bytes], make: Callable[[list[bytes]], list[bytes]]) -> list[bytes]:
        """The values of distinct keys; ``make`` gives those of all that are missing."""
        got = list(map(self.now.get, keys))
        late = [i for i, v in enumerate(got) if v is None]
        for i in late:
            got[i] = self.old.get(keys[i])
        new = [i for i in late if got[i] is None]
        for i, v in zip(new, make([keys[i] for i in new])):
            got[i] = v
        for i in late:
            k, v = keys[i], got[i]
            if len(k) <= KEPT_BYTES:
                self.used += 170 + len(k) + len(v)
                if self.used >= self.limit:
                    self.old, self.now, self.used = self.now, {}, 0
                self.now[k] = v
        return got


class Tokens:
    """Encodes texts by a tokenizers file whose pre-tokenizer cuts before a space that no white space follows.
    A batch's texts are cut into pieces (see ``pieces``), and each distinct piece is looked up once; what the table lacks
    is encoded together: runs of letters, which are pre-tokens as they are, by the library's model, any other piece by
    the whole library. Unless ``special_as_text``, a text that contains an added token's content is never cut: the
    library finds such tokens first, in the whole text."""

    def __init__(self, definition: str, special_as_text: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit
        self.model = Tokenizer.from_str(definition)
        self.model.encode_special_tokens = special_as_text
        self.kind = "<u2" if self.model.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.merges = Tokenizer(self.model.model)
        self.merges.pre_tokenizer = CharDelimiterSplit(" ")  # no byte is written as a space in the byte-level alphabet
        vocabulary = self.merges.get_vocab(with_added_tokens=False)
        self.lengths = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        self.lengths[list(vocabulary.values())] = list(map(len, vocabulary))
        self.by_space = self._cuts_at_spaces(definition)
        added = [] if special_as_text else [a["content"] for a in json.loads(definition).get("added_tokens") or []]
        self.added = re.compile(b"|".join(re.escape(a.encode()) for a in added)) if added else None
        self.table = Table(CACHE_BYTES)

    @staticmethod
    def _cuts_at_spaces(definition: str) -> bool:
        d = json.loads(definition)
        pre = d.get("pre_tokenizer") or {}
        return (d.get("normalizer") is None and pre.get("type") == "ByteLevel"
                and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
                and all(a.get("special") for a in d.get("added_tokens") or []))

    def whole(self, text: str) -> bytes:
        return array(self.code, self.model.encode(text, add_special_tokens=False).ids).tobytes()

    def runs(self, runs: list[bytes]) -> list[bytes]:
        """Ids of runs of letters: the library's merges over their bytes in the byte-level alphabet, many runs a call.
        A token has as many bytes as its entry has characters, which tells where a run's ids end."""
        shown = charmap_decode(b"\0".join(runs), "strict", _SPLIT)[0]
        ids = self.merges.encode_batch_fast([shown], add_special_tokens=False)[0].ids
        covered = np.cumsum(self.lengths[ids])
        want = np.cumsum(list(map(len, runs)))
        ends = np.searchsorted(covered, want) + 1
        if len(covered) < len(runs) or covered[-1] != want[-1] or (covered[ends - 1] != want).any():
            return [self.whole(r.decode()) for r in runs]  # a vocabulary that lacks some byte
        packed, ends = array(self.code, ids).tobytes(), (ends * np.dtype(self.kind).itemsize).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def made(self, keys: list[bytes]) -> list[bytes]:
        """Ids of pieces by the library."""
        plain = [_ASCII_RUN.fullmatch(k) is not None or not k.isascii() and _RUN.fullmatch(k.decode()) is not None
                 for k in keys]
        runs = list(compress(keys, plain))
        by_run = iter([ids for i in range(0, len(runs), RUNS_A_CALL) for ids in self.runs(runs[i:i + RUNS_A_CALL])])
        return [next(by_run) if p else self.whole(k.decode()) for k, p in zip(keys, plain)]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts (strings or UTF-8 bytes), one after another, and how many each text has; null counts
        as empty."""
        texts = texts.cast(pa.binary()).fill_null(b"")
        bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]
        if not len(texts) or bounds[0] == bounds[-1]:
            return np.zeros(0, dtype=self.kind), np.zeros(len(texts), dtype=np.int64)
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[bounds[0]:bounds[-1]]
        bounds = bounds.astype(np.int64) - bounds[0]
        full = np.flatnonzero(bounds[1:] > bounds[:-1])
        alone = np.full(len(full), not self.by_space)
        if self.added is not None:
            hits = [m.start() for m in self.added.finditer(data)]
            alone[np.searchsorted(bounds[full], hits, side="right") - 1] = True
        cuts = pieces(data, bounds[full], alone)
        at = pa.py_buffer(np.append(cuts, len(data)).astype(np.int32))
        found = pa.Array.from_buffers(pa.binary(), len(cuts), [None, at, pa.py_buffer(data)]).dictionary_encode()
        key_at, keys = np.frombuffer(found.dictionary.buffers()[1], dtype=np.int32).tolist(), found.dictionary.buffers()[2]
        keys = keys.to_pybytes()
        by_key = self.table.get_all([keys[a:b] for a, b in zip(key_at, key_at[1:len(found.dictionary) + 1])], self.made)
        flat = np.frombuffer(b"".join(by_key), dtype=self.kind)
        size = np.fromiter(map(len, by_key), dtype=np.int64, count=len(by_key)) // flat.itemsize
        codes = found.indices.to_numpy()
        n = size[codes]
        ends = np.cumsum(n)
        ids = flat[np.repeat((np.cumsum(size) - size)[codes] - ends + n, n) + np.arange(ends[-1])]
        ends = np.append(0, ends)[np.searchsorted(cuts, bounds)]
        return ids, np.diff(ends)

    def encode(self, text: str | None) -> bytes:
        """Packed ids (``kind`` integers) of a whole text; null counts as empty."""
        return self.encode_all(pa.array([text], type=pa.string()))[0].tobytes()


def tokens_of(definition: str, special_as_text: bool) -> Tokens:
    return held(("tokens", hash(definition), special_as_text), lambda: Tokens(definition, special_as_text))


def tokenised(docs: DataFrame, definition: str, end_id: int | None, bounds: list[int],
              special_as_text: bool = True) -> DataFrame:
    """(range, doc_id, ids binary, n): the ids of every document with the end id, and the range of its doc_id."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tok = tokens_of(shared.value, special_as_text)
            ids, n = tok.encode_all(b.column("text"))
            if end_id is not None:
                ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
            at = np.append(0, np.cumsum(n) * ids.itemsize).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(range_of(bounds, b.column("doc_id")), type=pa.int32()), b.column("doc_id"), packed, pa.array(n)],
                names=["range", "doc_id", "ids", "n"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "range int, doc_id bigint, ids binary, n bigint")


def _counted(rows: DataFrame, kind: str) -> DataFrame:
    """(id, n): each task adds its ids up, so at most one row for each id and task is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for b in batches:
            got = np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), dtype=kind), minlength=len(total))
            got[:len(total)] += total
            total = got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, type=pa.int64()), pa.array(total[at])], names=["id", "n"])

    return rows.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def _put(folder: str, name: str, data: bytes) -> None:
    """Write a file whole: under a name of its own first, so that a task that is lost or runs twice leaves no part."""
    fs, path = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, f"{path}/{name}")


class _File:
    """Documents of one file to be."""

    def __init__(self, start: int):
        self.start, self.docs, self.control, self.data, self.size = start, [], [], [], 0

    def add(self, doc_id: int | None, n: int, control: bytes, data: bytes) -> None:
        self.docs.append((0 if doc_id is None else doc_id, doc_id is None, n, len(data)))
        self.control.append(control)
        self.data.append(data)
        self.size += len(control) + len(data)

    def bytes(self) -> bytes:
        head = np.array([self.start, len(self.docs)], dtype="<i8").tobytes()
        docs = np.array(self.docs, dtype="<i8").reshape(-1, 4).tobytes()
        return MAGIC + head + docs + b"".join(self.control) + b"".join(self.data)


def write_tokens(docs: DataFrame, definition: str, folder: str, end_id: int | None = 0,
                 special_as_text: bool = True) -> DataFrame:
    """Write the ids of all documents to ``folder`` and return the manifest (name, start, docs, ids).

    Null and empty texts have the end id alone. Documents come by ascending doc_id, those without one first, rows
    with one doc_id by their packed ids. The texts are encoded once; ids and counts are written to the shared folder,
    renamed and packed, then dealt into ranges of doc_id, each sorted and written by one task. Only the counts by id and the totals by range
    pass through the driver; their number is the vocabulary's and the ranges'. ``folder`` is a URI (or path) that
    executors can write to; a folder without files is what an empty table gives.
    """
    spark = docs.sparkSession
    tok = tokens_of(definition, special_as_text)
    kind = tok.kind
    bounds = range_bounds(docs, "doc_id", ranges_for(spark))
    rows = written(tokenised(docs, definition, end_id, bounds, special_as_text), "token-ids", "zstd")
    counts = sorted((-r["n"], r["id"]) for r in _counted(rows, kind).collect())
    by_rank = np.array([i for _, i in counts], dtype="<u4")
    rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, dtype="<u4")
    rank[by_rank] = np.arange(len(by_rank), dtype="<u4")
    totals = {r["range"]: r["n"] for r in rows.groupBy("range").agg(F.sum("n").alias("n")).collect()}
    starts, at = {}, 0
    for k in sorted(totals):
        starts[k] = at
        at += totals[k]
    _put(folder, "ranks.bin", MAGIC + by_rank.tobytes())  # never empty: Spark's reader passes over empty files
    given = spark.sparkContext.broadcast((rank, starts))

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = given.value[0]
        for b in batches:
            control, data = [], []
            for ids in b.column("ids").to_pylist():
                c, d = pack(rank[np.frombuffer(ids, dtype=kind)])
                control.append(c)
                data.append(d)
            yield pa.RecordBatch.from_arrays(
                [b.column("range"), b.column("doc_id"), b.column("n"), pa.array(control, type=pa.binary()),
                 pa.array(data, type=pa.binary())], names=["range", "doc_id", "n", "control", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = given.value[1]
        now, at, nth, out, done = None, 0, 0, None, []

        def close():
            nonlocal out, nth
            if out is not None and out.docs:
                name = f"{now:06d}-{nth:06d}.tok"
                _put(folder, name, out.bytes())
                done.append((name, out.start, len(out.docs), at - out.start))
                nth += 1
            out = None

        for b in batches:
            for k, doc_id, n, control, data in zip(*(b.column(c).to_pylist() for c in b.schema.names)):
                if k != now:
                    close()
                    now, at, nth = k, starts[k], 0
                if out is not None and out.size and out.size + len(control) + len(data) > FILE_BYTES:
                    close()
                if out is None:
                    out = _File(at)
                out.add(doc_id, n, control, data)
                at += n
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[i] for d in done], type=t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))],
            names=["name", "start", "docs", "ids"])

    # packed before the shuffle: it carries what the files hold
    dealt = rows.select("range", "doc_id", "n", "ids").mapInArrow(
        renamed, "range int, doc_id bigint, n bigint, control binary, data binary")
    dealt = dealt.repartition("range").sortWithinPartitions("range", "doc_id", "control", "data")
    return written(dealt.mapInArrow(
        run, "name string, start bigint, docs bigint, ids bigint"), "token-manifest")


def read_file(content: bytes, by_rank: np.ndarray) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start, ids) of each document of a file."""
    if content[:len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    raw = np.frombuffer(content, dtype=np.uint8)
    start, n_docs = (int(x) for x in np.frombuffer(content, dtype="<i8", count=2, offset=len(MAGIC)))
    docs = np.frombuffer(content, dtype="<i8", count=4 * n_docs, offset=len(MAGIC) + 16).reshape(-1, 4)
    control = len(MAGIC) + 16 + 32 * n_docs
    data = control + int((-(-docs[:, 2] // 4)).sum())
    for doc_id, no_id, n, size in docs.tolist():
        c = -(-n // 4)
        yield None if no_id else doc_id, start, by_rank[unpack(raw[control:control + c], raw[data:data + size], n)]
        control, data, start = control + c, data + size, start + n


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids array<int>]) from the files of ``folder``, with Spark's reader."""
    binary = "path string, modificationTime timestamp, length bigint, content binary"
    load = spark.read.format("binaryFile").schema(binary)
    ranks = load.option("pathGlobFilter", "ranks.bin").load(folder).first()["content"]
    by_rank = np.frombuffer(bytes(ranks)[len(MAGIC):], dtype="<u4")
    given = spark.sparkContext.broadcast(by_rank)
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows = [(doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()),
                         *([ids.astype(np.int32)] if with_ids else []))
                        for doc_id, start, ids in read_file(content.as_buffer().to_pybytes(), given.value)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)],
                                                 names=names)

    files = spark.read.format("binaryFile").schema(binary).option("pathGlobFilter", "*.tok").load(folder)
    schema = T.StructType([T.StructField(n, T.LongType()) for n in names[:4]]
                          + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)
    return files.select("content").mapInArrow(run, schema)


def op4_tokens(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers as P

    with open(vocabulary or P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    folder = shared_path(spark, "tokens")
    write_tokens(docs.select("doc_id", "text"), definition, folder, special_as_text=False)  # as the library's default
    return read_tokens(spark, folder, with_ids=False)
