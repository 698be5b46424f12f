"""Hard negatives, the n-gram join and the token alignment against brute force."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vigil.llm import crossalign, multiindex, toccurrence

from .test_llm_operators import SF, brute_components

VECTORS = "vec_id bigint, embedding array<float>, label int, row string"


# op11

def brute_negatives(rows):
    """rows: (id, vector of floats, label), as the contract has it."""
    kept = set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)))
    out = set()
    for i, label, v in kept:
        if i % 100:
            continue
        def score(w):
            return sum(a * b for a, b in zip(v, w))
        others = sorted(((-score(w), j, m) for j, m, w in kept if j != i))
        for s, p in [(-s, j) for s, j, m in others if m == label][:5]:
            fits = [(-t, j) for t, j, m in others if m != label and 30 * s <= -100 * t <= 90 * s][:10]
            out |= {(i, p, r + 1, j, s, t) for r, (t, j) in enumerate(fits)}
    return out


def _found(df):
    return {tuple(r) for r in multiindex.op11_negatives(df).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()}


def _vectors(n, dim, seed, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (labels, dim))
    rows = []
    for i in range(n):
        label = int(rng.integers(labels))
        v = centres[label] + rng.normal(0, 0.25, dim) if i % 9 else np.full(dim, 0.25)  # many equal vectors: ties
        rows.append((i, [float(np.float32(x)) for x in v], label))
    return rows


@pytest.mark.parametrize("dim,first", [(6, 4096), (7, 64)])
def test_negatives_equal_brute_force(spark, monkeypatch, dim, first):
    monkeypatch.setattr(multiindex, "FIRST_ROWS", first)  # several rounds
    monkeypatch.setattr(multiindex, "CELL_ROWS", 8)
    monkeypatch.setattr(multiindex, "BLOCK_ROWS", 16)
    rows = _vectors(1200, dim, dim)
    df = spark.createDataFrame([(*r, "x") for r in rows], VECTORS).repartition(5)
    want = brute_negatives(rows)
    assert want and _found(df) == want


def test_negatives_odd_rows(spark):
    rows = _vectors(260, 4, 3)
    odd = [(100, None, 1), (200, [0.5, None, 0.1, 0.2], 1), (201, [0.5, float("nan"), 0.1, 0.2], 1), (None, [0.1] * 4, 1),
           (202, [float("inf")] * 4, 2), (204, [0.3] * 4, None), (300, [], 1), (301, [0.9], 1), (302, [-0.2] * 4, 2)]
    rows = [r for r in rows if r[0] not in (100, 200, 201, 202, 204)] + odd
    df = spark.createDataFrame([(*r, "x") for r in rows + rows[:40]], VECTORS)  # repeated rows count once
    filled = [(i, None if v is None else v + [0.0] * (4 - len(v)), m) for i, v, m in rows]  # short vectors: zeros
    assert _found(df) == brute_negatives(filled)
    assert _found(df.limit(0)) == set() and multiindex.op11_negatives(df.limit(0)).columns[0] == "anchor_id"
    assert _found(df.filter("vec_id = 0")) == set()
    with pytest.raises(Exception, match="too large"):
        _found(spark.createDataFrame([(0, [3e9, 1.0], 1, "x"), (1, [1.0, 1.0], 1, "x")], VECTORS))


def test_cells_come_in_the_order_of_their_bounds():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 50, (500, 6)).round()
    books = multiindex.Codebooks(x, 6)
    cell, da, db = books.place(x)
    ids = np.unique(cell)
    books.hold(ids, np.bincount(cell)[ids], np.array([da[cell == c].max() for c in ids]), np.array([db[cell == c].max() for c in ids]))
    for q in x[:20]:
        got = list(books.visits(q))
        assert sorted(c for _, _, c in got) == ids.tolist()
        bounds = [b for b, _, _ in got]
        assert all(a >= b - 1e-9 for a, b in zip(bounds, bounds[1:]))
        for bound, own, c in got:
            assert (x[cell == c] @ q).max() <= own + 1e-6 and own <= bound + 1e-6


# op12

def test_join_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in toccurrence.op12_jaccard(docs).collect()}
    assert got == {d: (w[0], w[1]) for d, w in want.items()}
    assert any(d != c for d, (_, c) in got.items())


def test_join_of_a_large_group_in_blocks(spark, monkeypatch):
    """One text with few or many words changed, a passage that all share, exact copies: blocks and outliers."""
    monkeypatch.setattr(toccurrence, "BLOCK_SETS", 16)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    shared = " ".join(f"p{i}" for i in range(25))
    rows = []
    for d in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 12])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10 ** 6)}"
        rows.append((d, " ".join(words)))
    rows += [(200 + d, shared + " " + " ".join(f"u{d}_{i}" for i in range(rng.randrange(2, 40)))) for d in range(60)]
    rows += [(300 + d, rows[3][1]) for d in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    want = brute_components(rows, 5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in toccurrence.op12_jaccard(docs).collect()}
    assert got == {d: (w[0], w[1]) for d, w in want.items()}


def test_join_odd_rows(spark):
    text = " ".join(f"t{i}" for i in range(60))
    near = text.replace("t7 ", "T7 ").replace("t30", "zz")
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n", "c"), (4, text, "d"), (4, text, "e"), (5, near, "f"), (6, "one two", "g"),
            (7, "ONE two", "h"), (None, text, "i"), (None, None, "j"), (8, "alpha beta gamma delta epsilon zeta", "k"),
            (5, "alpha beta gamma delta epsilon zeta", "l"), (9, "wörd", "m")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, set string")
    got = sorted((tuple(r) for r in toccurrence.jaccard_join(docs).collect()), key=repr)
    comp = {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 4, 9: 9, None: None}  # doc 5 ties both its texts
    size = [0, 0, 0, 56, 56, 56, 1, 1, 56, 0, 2, 2, 1]
    assert got == sorted(((d, n, comp[d]) for (d, _, _), n in zip(rows, size)), key=repr)
    assert toccurrence.jaccard_join(docs.limit(0)).count() == 0


def test_merge_skip_and_divide_skip_count_all_lists():
    rng = np.random.default_rng(2)
    for _ in range(300):
        lists = [sorted(rng.choice(40, rng.integers(1, 25), replace=False).tolist()) for _ in range(rng.integers(1, 14))]
        need = int(rng.integers(1, len(lists) + 1))
        times = {}
        for x in lists:
            for e in x:
                times[e] = times.get(e, 0) + 1
        want = {e: n for e, n in times.items() if n >= need}
        assert dict(toccurrence.merge_skip(lists, need)) == want
        got = toccurrence.divide_skip(np.concatenate(lists), np.array([len(x) for x in lists]), need)
        assert dict(zip(*map(list, got))) == want


# op13

class Reference:
    """The libraries themselves, and groups by walking along the bytes."""

    def __init__(self):
        self.a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        back = crossalign.byte_level_alphabet()
        self.bytes_a = {i: bytes(map(back.get, t)) for t, i in self.a.get_vocab().items() if all(c in back for c in t)}
        self.b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))

    def piece(self, i):
        name = self.b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode()

    def align(self, text):
        if not text:
            return [], [], []
        whole = (" " + text).encode()
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        bytes_a, bytes_b = [self.bytes_a[i] for i in a], [self.piece(i) for i in b]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return [], [], []
        groups, i, j, ea, eb, ga, gb = [], 0, 0, 0, 0, [], []
        while i < len(a) or j < len(b):
            if ea <= eb:
                ea += len(bytes_a[i])
                ga.append(a[i])
                i += 1
            else:
                eb += len(bytes_b[j])
                gb.append(b[j])
                j += 1
            if ea == eb:
                groups.append((ga, gb))
                ga, gb = [], []
        return a, b, groups

    def corpus(self, texts):
        made = [self.align(t) for t in texts]
        links = [[(x, y) for ga, gb in g for x in ga for y in gb] for _, _, g in made]
        held = {}
        for ls in links:
            for p in set(ls):
                held[p] = held.get(p, 0) + 1
        best = {}
        for (x, _), n in held.items():
            best[x] = max(best.get(x, 0), n)
        out = []
        for (a, b, g), ls in zip(made, links):
            said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g)
            out.append((len(a), len(b), len(g), len(ls), sum(held[p] == best[p[0]] for p in ls), sum(held[p] for p in ls),
                        hashlib.sha256(said.encode()).hexdigest() if g else ""))
        return out


def _texts():
    rng = random.Random(5)
    parts = ["a", "the", "fox", " ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", "!", "'s", "é", "日", "😀", "<s>", "▁",
             "<0x0A>", "​", "1", "23", "\r", ";\r", "{", "\r\n", "<|endoftext|>", "ᄀ", "ﬁ"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    return [None, "", " ", "a" * 3000, "日本語 テキスト" * 20, "x", "x", *odd]


@pytest.mark.parametrize("limit,links", [(1 << 20, 1 << 12), (100, 2)])
def test_alignment_equals_the_libraries(spark, monkeypatch, limit, links):
    """Whole rows, with all pairs broadcast or most of them joined, and with groups counted by their distinct ids."""
    monkeypatch.setattr(crossalign, "MANY_LINKS", links)
    texts = _texts() + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    aligner = crossalign.Aligner(crossalign.ByteLevel(P.path("byte_bpe_50k.json")), crossalign.Pieces(P.path("piece_bpe_32k.model")))
    want = Reference().corpus(texts)
    if links == 2:  # the setting holds in this process alone
        got = aligner.batch(texts)
        assert [tuple(got[c][i] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")) for i in range(len(texts))] == [
            w[:4] + w[6:] for w in want]
        for times, w in zip(got["times"], want):
            assert np.frombuffer(times, dtype=np.int64).sum() == w[3]
    rows = crossalign.align_corpus(spark, docs, None, None, keep=["doc_id"], limit=limit).collect()
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in rows}
    assert got == dict(enumerate(want))


def test_alignment_odd_tables(spark):
    schema = "doc_id bigint, text string, n_a string, Pairs string"
    rows = [(1, "same words here", "x", "y"), (1, "same words here", "x", "y"), (None, "same words here", "x", "y"), (2, None, "x", "y")]
    got = crossalign.align_corpus(spark, spark.createDataFrame(rows, schema), None, None).collect()
    assert len(got) == 4 and {r["count_sum"] for r in got if r["text"]} == {3 * got[0]["n_links"]}  # each row is a document
    assert [r["n_links"] for r in got if r["text"] is None] == [0]
    empty = crossalign.op13_align(spark, spark.createDataFrame([], schema))
    assert empty.count() == 0 and empty.columns[0] == "doc_id"


def test_pointer_doubling_labels_components():
    rng = np.random.default_rng(3)
    for _ in range(100):
        ends = [np.unique(np.append(rng.integers(1, 60, rng.integers(1, 40)), 60)) for _ in range(2)]
        a, b = crossalign.groups(*[np.diff(e, prepend=0) for e in ends])
        common = np.intersect1d(*ends)
        assert a.tolist() == np.searchsorted(common, ends[0]).tolist() and b.tolist() == np.searchsorted(common, ends[1]).tolist()
