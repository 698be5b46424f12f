"""The training-data operators against libraries, brute force and awkward rows."""

import hashlib
import json
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from tools.check_oracles import rows_of
from vigil.llm import bpe, fertility, linededup, minhash, mixing, perspective, prefixhash, tokenfile, urlfilter, zquality
from vigil.llm.common import Cache2
from vigil.llm.graph import connected
from vigil.llm.queries import ORACLES, QUERIES, prepare
from vigil.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word " * 30000 + "x" * 20000
#: Nulls in every column, empty and blank texts, repeated rows, a repeated id, a very long text.
ODD = [(1, "one two three four five six seven", "en", "a", 5), (1, "one two three four five six seven", "en", "a", 5),
       (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t ", "xx", "b", 4), (None, "no id here", "fr", None, 10),
       (None, None, None, None, None), (5, LONG, "en", "b", len(LONG)), (6, "été 日本 🙂 <|endoftext|>", "fr", "c", 7),
       (7, "one two three four five six seven", "en", "c", 5), (1, "another text under one id", "en", "b", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    prepare(spark)
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    prepare(spark)
    return spark.createDataFrame([], SCHEMA)


def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    res = con.execute(ORACLES[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())


# op1

def test_bpe_equals_tiktoken_and_decodes():
    import tiktoken
    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = bpe.Encoder(ranks, P.PATTERN)
    rnd = random.Random(3)
    bits = ["a", "th", "e", " ", "  ", "\n", "\t", "'s", "'ll", "1", "23", "é", "日本", "🙂", "　", ".", "***", "\r\n", "A", "x" * 60]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 30))) for _ in range(1500)] + ["", "a" * 3000, "ab" * 2000, " " * 99]
    for t in texts + [x for _, x in documents()[:40]]:
        assert list(memoryview(mine.encode(t)).cast("I")) == lib.encode_ordinary(t)


def test_bpe_query(spark):
    import tiktoken
    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op1_bpe"](spark, SF).collect()}
    for d, t in documents():
        ids = lib.encode_ordinary(t or "")
        assert got[d] == (d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                          hashlib.sha256((t or "").encode()).hexdigest())


def test_bpe_odd_rows(odd, empty):
    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    got = bpe.decode(bpe.encode(odd.withColumn("IDS", F.lit(7)), ranks, P.PATTERN), ranks)
    assert {c.lower() for c in got.columns} == {"doc_id", "text", "lang", "source", "n_chars", "ids", "n_tokens", "decoded"}
    rows = got.collect()
    assert len(rows) == len(ODD) and all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in rows)
    assert bpe.unpack(bpe.encode(empty, ranks, P.PATTERN)).count() == 0


def test_cache_keeps_results():
    c = Cache2(lambda k: k * 2, 3)
    assert [c[i] for i in (1, 2, 3, 4, 1, 5, 6, 7, 1)] == [2, 4, 6, 8, 2, 10, 12, 14, 2]


# op2

def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op2_zstd"](spark, sf).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for d, r in got.items())
    test = [(got[d]["predicted"], q) for d, q in labels if got[d]["held_out"]]
    assert sum(a == b for a, b in test) / len(test) >= 0.95


def test_classifier_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (6, None), (7, 0), (7, 1)], "doc_id bigint, label int")
    model = zquality.fit(odd, labels)
    scores = [r["score"] for r in zquality.score(odd.withColumn("Score", F.lit("x")), model).collect()]
    assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores)
    nothing = zquality.fit(empty, labels.limit(0))
    assert zquality.score(empty, nothing).count() == 0
    assert nothing.score("") == nothing.score("text") == 0.5


# op3

def brute_components(rows, k, percent=80):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
        sets[d] = s
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    ids = [d for d in sets if sets[d]]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: (len(sets[d]), top(d), top(d) == d) for d in sets}


def test_near_duplicates_query(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op3_minhash"](spark, SF).collect()}
    assert got == brute_components(documents(), 4)


def test_near_duplicates_in_a_group_of_many_blocks(spark, monkeypatch):
    """Copies with so many edits that only some pairs are linked, in blocks of 16."""
    prepare(spark)
    monkeypatch.setattr(minhash, "BLOCK_SETS", 16)
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(w if rnd.random() > 0.02 * (i % 5) else f"z{rnd.random()}" for w in base)) for i in range(150)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)] + [(2000 + i, f"lonely text number {i} of its own") for i in range(20)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 4)
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == brute_components(rows, 4)


def test_near_duplicates_odd_rows(odd, empty):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in rows}
    assert by[(7, 3)] == (1, False) and by[(1, 3)] == (1, True) and by[(3, 0)] == (3, True) and by[(None, 0)] == (None, True)
    left = minhash.drop_near_duplicates(odd.withColumn("node", F.lit(1)).withColumn("kept", F.lit(False)))
    assert left.columns[:5] == odd.columns and 7 not in {r["doc_id"] for r in left.collect()}
    assert minhash.near_duplicates(empty).count() == 0


def test_one_row_of_each_group_is_left(spark, odd):
    left = [tuple(r) for r in minhash.drop_near_duplicates(odd).collect()]
    want = [ODD[10], ODD[2], ODD[3], ODD[4], ODD[5], ODD[6], ODD[7], ODD[8]]
    assert sorted(map(repr, left)) == sorted(map(repr, want))
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(9, a), (9, a), (None, a), (None, a + " more"), (None, b), (None, b), (None, b + " more"), (None, c), (8, ""),
            (8, c), (8, None), (10, None), (10, ""), (None, ""), (None, "")]
    got = minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    counted = Counter(("b" if r["doc_id"] is None and r["text"] in (b, b + " more") else r["doc_id"], r["text"] if r["doc_id"]
                       else bool(r["text"])) for r in got)
    assert counted == Counter({(9, a): 1, ("b", True): 1, (8, c): 1, (10, None): 1, (None, False): 2})
    top = spark.createDataFrame([(2 ** 63 - 1, a), (None, a), (None, b), (None, b)], "doc_id bigint, text string")
    assert {r["text"] for r in minhash.drop_near_duplicates(top).collect()} == {a, b}
    assert minhash.drop_near_duplicates(top).count() == 2


def test_connected_components(spark):
    prepare(spark)
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(40)]
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = connected(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()
    want = {x: top(x) for a, b in edges if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in got} == want


# op4

def test_stream_coding_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (rng.integers(0, 2 ** 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype("<u4")
        control, data = tokenfile.pack(v)
        assert len(control) == -(-n // 4)
        assert (tokenfile.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == v).all()


def test_token_files_query(spark):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op4_tokens"](spark, SF).collect()}
    at = 0
    for d, x in documents():
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        assert got[d] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_have_the_librarys_special_tokens(spark):
    from tokenizers import Tokenizer
    prepare(spark)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [(1, "a <|endoftext|> b"), (2, "a<|endoftext|><|endoftext|>  b's"), (3, "<|endoftext|>"), (4, "a <|endoftext| > b"),
            (5, "plain words"), (6, ODD[8][1])]
    got = {r["doc_id"]: tuple(r)[1:] for r in tokenfile.op4_tokens(
        spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    at = 0
    for d, x in rows:
        ids = np.array(t.encode(x, add_special_tokens=False).ids + [0], "<u4")
        assert got[d] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_runs_equal_library_with_special_tokens():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        mine = tokenfile.Tokens(f.read(), False)
    assert mine.by_space
    bits = ["a", "é", "中", "'s", " ", "  ", "\n", "\xa0", ".", "12", "<|endoftext|>", "<|", "|>", "😀"]
    r = random.Random(9)
    for _ in range(5000):
        text = "".join(r.choice(bits) for _ in range(r.randint(1, 12)))
        assert mine.encode(text) == mine.whole(text), repr(text)


def test_token_batches_equal_library():
    with open(P.path("byte_bpe_50k.json")) as f:
        definition = f.read()
    bits = ["a", "é", "中", "'s", "'", " ", "  ", "\n", "\t", "\r", "\0", "\x1c", "\x85", "\xa0", "\u3000", "\u2009", ".", "12",
            "<|endoftext|>", "<|", "|>", "😀", "Жук", "ȟ", "ʼ", "\u0301", "“", "×", "word", "x" * 70]
    r = random.Random(4)
    for special_as_text in (False, True):
        mine = tokenfile.Tokens(definition, special_as_text)
        for _ in range(300):
            texts = [r.choice([None, "", *["".join(r.choices(bits, k=r.randint(1, 14))) for _ in range(4)]]) for _ in range(12)]
            ids, n = mine.encode_all(pa.array(["cut off", *texts], type=pa.string())[1:])
            assert [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])] == [mine.whole(t) if t else b"" for t in texts]
    assert [len(x) for x in mine.encode_all(pa.array([], type=pa.string()))] == [0, 0]


def test_token_batches_encode_each_new_run_once_in_few_calls(monkeypatch):
    with open(P.path("byte_bpe_50k.json")) as f:
        mine = tokenfile.Tokens(f.read(), False)
    r = random.Random(5)
    words = ["".join(r.choices("abcdefgh", k=12)) for _ in range(1000)]
    texts = [" ".join(r.sample(words, 1000)) for _ in range(5)]
    want = b"".join(map(mine.whole, texts))
    runs, made = [], mine.runs
    monkeypatch.setattr(mine, "runs", lambda x: runs.append(x) or made(x))
    for _ in range(2):  # the second time every run is in the table
        assert mine.encode_all(pa.array(texts))[0].tobytes() == want
    seen = [x for call in runs for x in call]
    assert len(seen) == len(set(seen)) <= 1005 and len(runs) <= 1 + 1005 // tokenfile.RUNS_A_CALL


def test_token_runs_of_a_vocabulary_without_some_bytes():
    with open(P.path("byte_bpe_50k.json")) as f:
        d = json.loads(f.read())
    d["added_tokens"], d["model"]["vocab"], d["model"]["merges"] = [], {"a": 0, "b": 1, "ab": 2}, [["a", "b"]]
    mine = tokenfile.Tokens(json.dumps(d), False)
    text = "ab xb ab abx x ba é"
    assert mine.by_space and mine.encode(text) == mine.whole(text)


def test_token_table_keeps_what_is_used_and_stays_small():
    table = tokenfile.Table(40_000)
    made = []

    def make(keys):
        made.extend(keys)
        return [k * 2 for k in keys]
    for i in range(2000):
        keys = [b"often", b"%d" % i, b"long" * 30]
        assert table.get_all(keys, make) == [k * 2 for k in keys]
    assert made.count(b"often") == 1 and len(table.now) + len(table.old) < 250


def test_token_files_odd_rows(spark, odd, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "FILE_BYTES", 2000)  # several files
    definition = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
    made = tokenfile.write_tokens(odd, definition, f"{tmp_path}/a").collect()
    rows = sorted(tokenfile.read_tokens(spark, f"{tmp_path}/a").collect(), key=lambda r: r["start"])
    assert len(rows) == len(ODD) and sum(r["docs"] for r in made) == len(ODD) and len(made) > 1
    assert [r["doc_id"] for r in rows] == [None, None, 1, 1, 1, 2, 3, 4, 5, 6, 7]
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:i]) for i in range(len(rows))]
    assert all(r["ids"][-1] == 0 for r in rows) and rows[5]["ids"] == [0]
    tokenfile.write_tokens(empty, definition, f"{tmp_path}/b")
    assert tokenfile.read_tokens(spark, f"{tmp_path}/b").count() == 0


# op5

@pytest.mark.parametrize("url, want", [
    ("http://EXAMPLE.com/en/1", ("example.com", "/en/1", "example.com/en/", "block")),
    ("http://www.example.com/en/1?x", ("www.example.com", "/en/1", "www.example.com/en/", "allow")),
    ("http://www.example.com", ("www.example.com", "", None, "allow")),
    ("https://a.net/fr/x#y", ("a.net", "/fr/x", "net/fr/", "block")),
    ("https://adult-x.example.org/a", ("adult-x.example.org", "/a", None, "block")),
    ("https://essex.example.org/freely", ("essex.example.org", "/freely", None, "allow")),
    ("https://free-bets.example.org/", ("free-bets.example.org", "/", None, "block")),
    ("https://free.example.org/free", ("free.example.org", "/free", None, "allow")),
    ("no scheme casino", ("", "", None, "block")), (None, ("", "", None, "allow")), ("", ("", "", None, "allow"))])
def test_url_filter(spark, url, want):
    prepare(spark)
    df = spark.createDataFrame([(1, url, "x")], "page_id bigint, url string, Host string")
    r = urlfilter.filter_urls(df).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == want


# op6

def test_line_runs(spark):
    prepare(spark)
    p = " ".join(f"p{i}" for i in range(30))
    q = " ".join(f"q{i}" for i in range(25))
    rows = [(1, f"head one\n{p}\n\n{q}\ntail one"), (2, f"head two\n{p}\n\n{q}\ntail two"), (3, f"{p}\nbetween\n{q}"),
            (4, f"head one\n{p}\n\n{q}\ntail one"), (5, None), (6, ""), (None, f"{p}\n{q}")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, run int")
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df).collect()}
    assert got == {1: rows[0][1], 2: "head two\ntail two", 3: rows[2][1], 4: "", 5: None, 6: "", None: ""}


def test_line_dedup_odd_rows(odd, empty):
    got = linededup.dedup_lines(odd)
    assert got.count() == len(ODD) and got.columns == odd.columns + ["_n_lines", "_cut_lines"]
    assert linededup.dedup_lines(empty).count() == 0


# op7

def test_prefix_spans_and_extensions():
    rnd = random.Random(2)
    t = "".join(rnd.choices("ab", k=300))
    p = prefixhash.Prefixes(t)
    for _ in range(300):
        i, j, n = rnd.randrange(300), rnd.randrange(300), rnd.randrange(1, 9)
        assert p.same(i, p, j, n) == (len(t[i:i + n]) == n == len(t[j:j + n]) and t[i:i + n] == t[j:j + n])
        want = next((k for k in range(300) if i + k >= 300 or j + k >= 300 or t[i + k] != t[j + k]), 300)
        assert p.common(i, p, j) == want


def test_fingerprint_query(spark):
    docs = documents()[::-1]
    got = {r["doc_id"]: r for r in QUERIES["op7_fingerprints"](spark, SF).collect()}
    assert len(got) == len(docs)
    for i, (d, t) in enumerate(docs):
        e = prefixhash.edited(t or "", docs[(i + 1) % len(docs)][1] or "")
        r = got[d]
        assert r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and r["n_chars"] == len(t or "")
        assert r["fingerprint"] == prefixhash.fingerprint(t or "") and r["edited_fingerprint"] == prefixhash.fingerprint(e)
        assert 0 <= r["near_next"] < r["near_edited"] <= 1 or t == docs[(i + 1) % len(docs)][1]


def test_fingerprint_odd_rows(odd, empty, spark):
    rows = prefixhash.op7_fingerprints(odd).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in rows) == sorted((d or 0, len(t or "")) for d, t, *_ in ODD)
    assert prefixhash.op7_fingerprints(empty).count() == 0
    one = prefixhash.op7_fingerprints(odd.filter("doc_id = 5")).first()
    assert one["near_next"] == 1.0


# op8

def brute_base(text):
    t = text or ""
    spaces = " \t\n\r\x0b\x0c"
    words, w = [], ""
    for c in t + " ":
        if c in spaces:
            words += [w] if w else []
            w = ""
        else:
            w += c
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    again = {j for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if x.strip(spaces):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(again)


def test_quality_rules_query(spark):
    texts = dict(documents())
    for r in QUERIES["op8_quality"](spark, SF).collect():
        n, chars, symbols, dup, again = brute_base(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, again)
        assert r["base_failed"] == (n < 10 or 100 * again > 20 * n) and not (r["base_failed"] and r["kept"])


def test_quality_rules_agree_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    kept = {r["doc_id"]: r for r in QUERIES["op8_quality"](spark, sf).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall()
    good = [kept[d]["kept"] for d, q in labels if q == 1 and not kept[d]["base_failed"]]
    bad = [kept[d]["kept"] for d, q in labels if q == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_quality_rules_odd_rows(odd, empty):
    got = fertility.judge(odd.withColumn("Kept", F.lit(1)))
    assert got.count() == len(ODD)
    assert fertility.judge(odd, only_kept=True).columns == odd.columns
    assert fertility.judge(empty).count() == 0


SCRIPT_TEXTS = {
    "hebrew": "בראשית ברא אלהים את השמים ואת הארץ והארץ היתה תהו ובהו וחשך על פני תהום ורוח אלהים מרחפת על פני המים",
    "arabic": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا",
    "devanagari": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है उन्हें बुद्धि",
    "thai": "มนุษย์ทั้งหลาย เกิดมามีอิสระ และเสมอภาคกัน ในเกียรติศักดิ์ และสิทธิ ต่างมีเหตุผล และมโนธรรม และควรปฏิบัติ ต่อกัน ด้วยเจตนารมณ์",
    "kana": "すべての にんげんは うまれながらにして じゆうであり かつ そんげんと けんりとに ついて びょうどうである にんげんは りせいと",
    "hangul": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다 인간은 천부적으로 이성과 양심을",
    "han": "人人生而自由 在尊严和权利上 一律平等 他们赋有理性和良心 并应以兄弟关系的精神 相对待 人人有资格 享有本宣言所载的 一切权利和自由 不分种族 肤色",
    "unlisted": "மனிதப் பிறிவியினர் சகலரும் சுதந்திரமாகவே பிறக்கின்றனர் அவர்கள் மதிப்பிலும் உரிமைகளிலும் சமமானவர்கள் அவர்கள் நியாயத்தையும் மனச்சாட்சியையும்"}


def test_every_script_has_a_band(spark):
    prepare(spark)
    assert {*fertility.SCRIPTS, "unlisted", "other"} <= set(fertility.BANDS)
    rnd, rows = random.Random(1), []
    for name, text in SCRIPT_TEXTS.items():
        letter = text[0]
        rows += [(name, True, text), (name, False, " ".join(letter * rnd.randint(3, 60) for _ in range(60)))]
    junk = [" ".join(str(rnd.randint(0, 10 ** 6)) for _ in range(100)), " ".join(str(1900 + i) for i in range(12)),
            " ".join(rnd.choice("=-*_") * rnd.randint(3, 40) for _ in range(60)),
            " ".join("".join(rnd.choices("#*$%&<>=-+", k=rnd.randint(1, 8))) for _ in range(100))]
    rows += [("other", False, t) for t in junk]
    rows += [("latin", True, "the cat sat on the mat and it was a good day for the dog"),
             ("latin", False, "a | b | c | | d | | | e | | f | | |")]
    df = spark.createDataFrame([(i, t, None) for i, (_, _, t) in enumerate(rows)], "doc_id int, text string, lang string")
    got = {r["doc_id"]: r for r in fertility.judge(df).collect()}
    assert not any(r["base_failed"] for i, r in got.items() if rows[i][1])
    assert [(got[i]["script"], got[i]["kept"]) for i in range(len(rows))] == [(s, k) for s, k, _ in rows]


# op9

def test_targets_stop_at_three_times_the_size(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), ("d", 0), (None, 5)], "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["a"] == 30 and got["d"] == 0 and got[None] == 15
    assert abs(got["b"] / got["c"] - 2) < 1e-9 and abs(sum(got.values()) - 2015) < 1e-6


def test_mix_comes_near_its_targets(spark):
    rows = mixing.op9_mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        key = r["source_size"], r["target"]
        taken[key] += r["taken"]
        target[key] = r["target"]
        largest[key] = max(largest[key], r["size"])
    assert all(abs(taken[k] - target[k]) <= 1.5 * largest[k] for k in target)


@pytest.mark.parametrize("doc_id", [7, None])
def test_mix_of_repeated_rows_comes_near_its_target(spark, doc_id):
    schema = "doc_id bigint, text string, lang string, source string, n_chars int, note int"
    rows = [(i, "w " * 10, "en", s, 20, 0) for s in "ab" for i in range(500)] + [
        (doc_id, "w " * 10, "en", "c", 20, i) for i in range(400)]
    docs = spark.createDataFrame(rows, schema).repartition(7)
    for r in (mixing.op9_mix(docs).groupBy("source_size", "target").sum("taken").collect()):
        assert abs(r["sum(taken)"] - r["target"]) <= 15
    got = mixing.mix(docs).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in got} == {"a": 875, "b": 350, "c": 175}
    # equal rows that differ elsewhere: each of them at most as often as the rate says
    assert mixing.mix(docs).filter("source = 'c'").groupBy("note").count().filter("count > 1").count() == 0


def test_mix_odd_rows(odd, empty):
    docs = odd.withColumn("key", F.lit(1)).withColumn("row", F.lit(2))
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    times = Counter((r["doc_id"], r["text"], r["source"]) for r in got.collect())
    assert all(times[k] <= 3 * n for k, n in Counter((r[0], r[1], r[3]) for r in ODD).items())
    assert mixing.mix(empty).count() == 0


# op10

def test_rotation(spark):
    prepare(spark)
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 130, "ann", "bye"),
            (1, 3, None, "who"), (2, None, "eve", "x"), (None, 0, "eve", "y"), (3, 0, "system", "alone")]
    got = perspective.rotate(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    by = {(r["conv_id"], r["perspective"], r["chunk"]): r for r in got}
    ann = by[(1, "ann", 0)]
    assert ann["text"] == ("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi <| im_end|><|im_end|>\n"
                           "<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>user name=unknown\nwho<|im_end|>\n")
    assert [ann["text"][s["start"]:s["end"]] for s in ann["spans"]] == ["hi <| im_end|><|im_end|>"] and ann["mask"] == "0100"
    assert by[(1, "ann", 2)]["mask"] == "1" and by[(1, "bob", 2)]["mask"] == "0"
    assert {k[:2] for k in by} == {(1, "ann"), (1, "bob"), (2, "eve"), (None, "eve")}


def test_cuts_at_spaces_never_split_white_space_runs():
    """Both encoders equal their libraries on runs of mixed white space, no-break spaces included."""
    import tiktoken
    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    theirs = tiktoken.Encoding("all", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = bpe.Encoder(ranks, P.PATTERN)
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        files = tokenfile.Tokens(f.read(), True)
    r = random.Random(3)
    marks = ["a", "b", "'s", " ", " ", "\n", "\t", "\xa0", "　", "\x1c", "1", ".", "é"]
    texts = ["".join(r.choice(marks) for _ in range(r.randint(0, 12))) for _ in range(3000)] + [" \xa0 \xa0"]
    for t in texts:
        assert np.frombuffer(mine.encode(t), dtype="<u4").tolist() == theirs.encode_ordinary(t), repr(t)
        assert files.encode(t) == files.whole(t), repr(t)


def test_token_runs_equal_library():
    """Texts cut at letter runs get the library's ids: contractions, odd letters, marks, digits and white space beside them."""
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        mine = tokenfile.Tokens(f.read(), True)
    assert mine.by_space
    bits = ["a", "B", "é", "ß", "Ж", "ª", "ɐ", "中", "\u0301", "'", "'s", "'ll", " ", "  ", "\n", "\t", "\r", "\xa0",
            "\x1c", "\x00", ".", "!?", "12", "²", "<|endoftext|>", "_", "$", "word" * 20, "😀"]
    r = random.Random(8)
    for _ in range(20000):
        text = "".join(r.choice(bits) for _ in range(r.randint(1, 12)))
        assert mine.encode(text) == mine.whole(text), repr(text)
