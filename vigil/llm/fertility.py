"""Quality rules from tokeniser fertility.

Two public vocabularies read every word: a byte-level BPE (tokens, their entropy) and a piece vocabulary with byte
fallback. Text like the language a vocabulary knows needs few tokens a word, spreads them over many ids and seldom
falls back to bytes; symbol runs, shouting, tables of one separator and encoded data leave these bands. A document is
rejected when a measure leaves the band of its language (or, for an unknown language, of its script).
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from vigil.llm.common import Cache2, arrow_map, held

#: Bytes of a worker's table of words.
CACHE_BYTES = 76 << 20
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: The limits of documents with fewer tokens are widened further: they say little about their distribution.
MIN_TOKENS = 30


@dataclass(frozen=True)
class Band:
    """Limits of one language or script. ``top_share``: share of the commonest token (its negative logarithm is the
    min-entropy); ``entropy``: Shannon entropy as a share of the most that so many tokens could have."""

    tokens_per_word: tuple[float, float] = (0.0, math.inf)
    chars_per_token: tuple[float, float] = (0.0, math.inf)
    byte_share: float = 1.0
    top_share: float = 1.0
    entropy: float = 0.0


#: Fixed values. Measured on rows labelled good (labels.quality = 1) of the 0.1 tables, widened by about a tenth.
BANDS: dict[str, Band] = {
    "en": Band(tokens_per_word=(1.2, 2.6), chars_per_token=(1.5, 6.0), byte_share=0.25, top_share=0.11, entropy=0.30),
    "fr": Band(tokens_per_word=(1.2, 3.3), chars_per_token=(1.3, 6.0), byte_share=0.25, top_share=0.11, entropy=0.30),
    "de": Band(tokens_per_word=(1.2, 3.3), chars_per_token=(1.3, 6.0), byte_share=0.25, top_share=0.11, entropy=0.30),
    "es": Band(tokens_per_word=(1.2, 3.5), chars_per_token=(1.3, 6.0), byte_share=0.25, top_share=0.11, entropy=0.30),
    "latin": Band(tokens_per_word=(1.0, 3.8), chars_per_token=(1.2, 7.0), byte_share=0.35, top_share=0.13, entropy=0.30),
    "greek": Band(chars_per_token=(0.5, 5.0), byte_share=0.6, top_share=0.25, entropy=0.25),
    "cyrillic": Band(chars_per_token=(0.5, 5.0), byte_share=0.4, top_share=0.25, entropy=0.25),
}
#: Fixed wide values, set by a few sentences a script (the tables have none of these): both vocabularies cut these
#: scripts into parts of letters, so the common parts take a large share. No byte limit where pieces may know no letter.
BANDS |= {
    "hebrew": Band((2.0, math.inf), (0.25, 4.0), byte_share=0.3, top_share=0.35, entropy=0.18),
    "arabic": Band((2.0, math.inf), (0.25, 4.0), byte_share=0.3, top_share=0.25, entropy=0.18),
    "devanagari": Band((2.5, math.inf), (0.25, 3.0), byte_share=0.5, top_share=0.40, entropy=0.15),
    "thai": Band((3.0, math.inf), (0.25, 3.0), byte_share=0.4, top_share=0.50, entropy=0.15),
    "kana": Band((2.0, math.inf), (0.25, 3.0), byte_share=0.4, top_share=0.25, entropy=0.18),
    "hangul": Band((3.0, math.inf), (0.25, 2.5), byte_share=0.5, top_share=0.25, entropy=0.18),
    "han": Band((1.5, math.inf), (0.25, 3.0), byte_share=0.5, top_share=0.20, entropy=0.20),
    "unlisted": Band((2.0, math.inf), (0.25, 4.0), top_share=0.45, entropy=0.12),
    # no letters: numbers, symbols and separators have shorter tokens, or few of them
    "other": Band(chars_per_token=(5.0, 6.0), byte_share=0.1, top_share=0.08, entropy=0.60),
}
#: A small sample strays further: limits above widen by these over the square root of the words and of the tokens.
WORDS_SLACK, TOKENS_SLACK = 3.0, 0.2
#: Scripts by the code points of their letters (ranges of the Unicode blocks).
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF),),
    "cyrillic": ((0x400, 0x52F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "thai": ((0xE00, 0xE7F),),
    "kana": ((0x3040, 0x30FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
}


def script_of(text: str) -> str:
    """The script with the most letters; texts with letters of other scripts alone are ``unlisted``, those without
    letters ``other``."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "other"
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    best, most = "other", 0
    for name, spans in SCRIPTS.items():
        n = sum(int(np.count_nonzero((points >= a) & (points <= b))) for a, b in spans)
        if n > most:
            best, most = name, n
    return best if most or not any(map(str.isalpha, text)) else "unlisted"


_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
              dtype=np.uint64)


@dataclass
class Meter:
    """Measures texts; keeps what the vocabularies say of words met often."""

    ranks_path: str
    pieces_path: str
    words: Cache2 = field(init=False)

    def __post_init__(self):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        from vigil.llm.bpe import load_ranks
        self.bpe = tiktoken.Encoding("fertility", pat_str=PATTERN, mergeable_ranks=load_ranks(self.ranks_path),
                                     special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=self.pieces_path)
        self.is_byte = frozenset(i for i in range(self.pieces.vocab_size()) if self.pieces.is_byte(i))
        self.words = Cache2(self.word, CACHE_BYTES)

    def word(self, word: bytes) -> tuple[bytes, bytes]:
        """(hash, pieces, byte pieces) packed; packed ids."""
        text = word.decode("utf-8", "replace")
        ids = self.bpe.encode_ordinary(" " + text)
        pieces = self.pieces.encode(text)
        return (struct.pack("<QII", xxhash.xxh3_64_intdigest(word), len(pieces), sum(map(self.is_byte.__contains__, pieces))),
                struct.pack(f"<{len(ids)}I", *ids))

    def measure(self, text: str | None) -> dict:
        text = text or ""
        words = text.encode("utf-8").split()  # bytes split at space and \\t to \\r alone
        n = len(words)
        got = {"n_words": n, "word_chars": len(text) - sum(map(text.count, " \t\n\r\x0b\x0c")),
               "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": 0, "n_repeat_words": 0, "n_tokens": 0,
               "tokens_per_word": 0.0, "chars_per_token": 0.0, "byte_share": 0.0, "top_share": 0.0, "entropy": 0.0}
        if not n:
            return got
        lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
        got["n_dup_lines"] = len(lines) - len(set(lines))
        records, ids = zip(*map(self.words.__getitem__, words))
        records = np.frombuffer(b"".join(records), dtype=[("h", "<u8"), ("p", "<u4"), ("b", "<u4")])
        if n >= WINDOW:
            m = n - WINDOW + 1
            h = sum(records["h"][i:i + m] * _K[i] for i in range(WINDOW))
            _, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
            again = np.flatnonzero(times[inverse] > 1)
            if len(again):
                edge = np.zeros(n + 1, dtype=np.int64)
                np.add.at(edge, again, 1)
                np.add.at(edge, again + WINDOW, -1)
                got["n_repeat_words"] = int(np.count_nonzero(np.cumsum(edge[:n])))
        ids = np.frombuffer(b"".join(ids), dtype="<u4")
        t, pieces = len(ids), int(records["p"].sum())
        counts = np.unique(ids, return_counts=True)[1]
        p = counts / t
        got |= {"n_tokens": t, "tokens_per_word": t / n, "chars_per_token": got["word_chars"] / t,
                "byte_share": int(records["b"].sum()) / max(1, pieces), "top_share": float(counts.max()) / t,
                "entropy": float(-(p * np.log2(p)).sum() / math.log2(t)) if t > 1 else 0.0}
        return got


def base_failed(m: dict) -> bool:
    return m["n_words"] < MIN_WORDS or 100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"]


def in_band(m: dict, band: Band) -> bool:
    if not m["n_tokens"]:
        return True
    wide, high = WORDS_SLACK / math.sqrt(m["n_words"]), TOKENS_SLACK / math.sqrt(m["n_tokens"])
    less, more = 0.0, 1.0
    if m["n_tokens"] < MIN_TOKENS:
        less, more = wide, MIN_TOKENS / m["n_tokens"]
    return (band.tokens_per_word[0] - less <= m["tokens_per_word"] <= band.tokens_per_word[1] + wide
            and band.chars_per_token[0] - less <= m["chars_per_token"] <= band.chars_per_token[1] + less
            and m["byte_share"] <= band.byte_share * more and m["top_share"] <= band.top_share + high * more
            and m["entropy"] >= band.entropy)


_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")
_DOUBLES = ("tokens_per_word", "chars_per_token", "byte_share", "top_share", "entropy")


def judge(df: DataFrame, text_col: str = "text", lang_col: str | None = "lang", bands: dict[str, Band] | None = None,
          ranks_path: str | None = None, pieces_path: str | None = None, keep: list[str] | None = None,
          only_kept: bool = False) -> DataFrame:
    """Add the measures, ``script``, ``base_failed`` and ``kept`` to every row (``only_kept``: drop the others and add
    nothing).

    Null texts count as empty: no words, so the base rule fails them. A null or unknown language falls back to the
    script's band (of ``BANDS`` every script has one). Rows are independent and nothing is shuffled; a column named
    like a measure is replaced. The vocabulary files (about 1 MB) are read from a path that every executor has.
    """
    import public_tokenizers as P

    files = (ranks_path or P.path("byte_bpe_50k.tiktoken"), pieces_path or P.path("piece_bpe_32k.model"))
    bands = BANDS if bands is None else bands

    def run(b):
        meter = held(("fertility", *files), lambda: Meter(*files))
        texts = b.column(text_col).to_pylist()
        langs = b.column(lang_col).to_pylist() if lang_col else [None] * len(texts)
        out = {k: [] for k in (*_LONGS, *_DOUBLES, "script", "base_failed", "kept")}
        for t, lang in zip(texts, langs):
            m = meter.measure(t)
            m["script"] = script_of(t or "")
            m["base_failed"] = base_failed(m)
            m["kept"] = not m["base_failed"] and in_band(m, bands.get(lang) or bands.get(m["script"]) or Band())
            for k, v in m.items():
                out[k].append(v)
        return out

    if only_kept:
        return arrow_map(df, run, [], when="kept")
    fields = ([T.StructField(k, T.LongType(), False) for k in _LONGS]
              + [T.StructField(k, T.DoubleType(), False) for k in _DOUBLES]
              + [T.StructField("script", T.StringType(), False), T.StructField("base_failed", T.BooleanType(), False),
                 T.StructField("kept", T.BooleanType(), False)])
    return arrow_map(df, run, fields, keep)


def op8_quality(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text", "lang"), keep=["doc_id"])
