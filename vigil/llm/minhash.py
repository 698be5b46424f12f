"""Near-duplicate documents by MinHash with tensored banding.

A document's set holds the hashes of its distinct word shingles. Two collections of ``HALVES`` short MinHash tuples
are drawn from it, and every table key pairs a tuple of the first collection with one of the second: 2 x 20 tuples of
4 minima (160 MinHash functions) make the keys of 400 tables, which drawn singly would take 3,200 functions. A pair
with similarity 0.8 misses all tables with probability 5e-5, one with 0.3 meets in some table with probability 0.02.

Equal sets are one class first, represented by its least doc_id. Classes that meet in a table, directly or over
others, form a cluster; inside clusters every pair that could change the result is compared on the full sets:

* a cluster is cut into blocks of bounded size; each block is compared within itself and with the first block;
* the classes that are then not yet in their cluster's largest component are compared with all the cluster's blocks.

Two classes of one component need no comparison of their own, so nothing is lost: what a task emits is a spanning
forest of the links it finds, not all pairs. A group of thousands of close copies costs one pass; only its outliers
meet all of it, block by block. No bucket, cluster or partner list is capped.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import WORD, Cache2, arrow_map, held, packed, written
from vigil.llm.graph import connected

SHINGLE, PERCENT = 5, 80
#: Tuples in each of the two collections, MinHash functions in a tuple.
HALVES, TUPLE = 20, 4
#: A block holds about so many sets and so many hashes at most.
BLOCK_SETS, BLOCK_HASHES = 1024, 1 << 20
#: Bytes of a worker's table of word hashes.
CACHE_BYTES = 48 << 20

_RNG = np.random.default_rng(20)
_MUL = (_RNG.integers(0, 2 ** 32, 2 * HALVES * TUPLE, dtype=np.uint32) | np.uint32(1))[:, None]
_ADD = _RNG.integers(0, 2 ** 32, 2 * HALVES * TUPLE, dtype=np.uint32)[:, None]
_MIX = _RNG.integers(0, 2 ** 63, TUPLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _RNG.integers(0, 2 ** 63, 2 * HALVES, dtype=np.uint64)
_PLACE = _RNG.integers(0, 2 ** 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles. Words are what lies between space and tab to carriage
    return, A-Z lower-cased; fewer words than ``size`` are one shingle, no words none."""
    words = (text or "").encode("utf-8").lower().split()  # on bytes: A-Z alone, white space as said
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    table = held("words", lambda: Cache2(xxhash.xxh3_64_intdigest, CACHE_BYTES))
    h = np.fromiter(map(table.__getitem__, words), dtype=np.uint64, count=n)
    k = min(n, size)
    m = n - k + 1
    out = np.full(m, np.uint64(k * 0xD6E8FEB86659FD93 % 2 ** 64))
    for i in range(k):
        out += h[i:i + m] * _PLACE[i]
    return np.unique(_mixed(out))


def collections_of(hashes: np.ndarray) -> np.ndarray:
    """The 2 x HALVES tuple keys of a set as signed 64-bit integers."""
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_MUL), np.uint32(0xFFFFFFFF))
    for at in range(0, len(h), 4096):
        np.minimum(least, (h[at:at + 4096] * _MUL + _ADD).min(axis=1), out=least)
    keys = (least.reshape(-1, TUPLE).astype(np.uint64) * _MIX).sum(axis=1, dtype=np.uint64)
    return _mixed(_mixed(keys) + _SALT).view(np.int64)


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, set_key, left, right); the last three are null for an empty set."""
    def run(b):
        ns, keys, sides = [], [], ([], [])
        for t in b.column("text").to_pylist():
            h = shingles(t, shingle)
            ns.append(len(h))
            keys.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
            c = collections_of(h) if len(h) else None
            for i in (0, 1):
                sides[i].append(None if c is None else c[i * HALVES:(i + 1) * HALVES])
        return {"n_shingles": ns, "set_key": keys, "left": sides[0], "right": sides[1]}

    long_list = T.ArrayType(T.LongType())
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                     [T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()),
                      T.StructField("left", long_list), T.StructField("right", long_list)], ["doc_id"])


def candidate_edges(classes: DataFrame) -> DataFrame:
    """(leader, node): the classes that share a table key with a smaller one, by the least of each table bucket.

    A pair meets in a table only if it shares a tuple on either side, so tuples that occur once go first.
    """
    halves = classes.select("node", F.explode(F.concat(
        F.transform("left", lambda k: F.struct(F.lit(0).alias("side"), k.alias("k"))),
        F.transform("right", lambda k: F.struct(F.lit(1).alias("side"), k.alias("k"))))).alias("x")).select("node", "x.*")
    shared = halves.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k")
    sides = (halves.join(shared, "k", "left_semi").groupBy("node")
             .agg(F.collect_list(F.when(F.col("side") == 0, F.col("k"))).alias("l"),
                  F.collect_list(F.when(F.col("side") == 1, F.col("k"))).alias("r"))
             .filter((F.size("l") > 0) & (F.size("r") > 0)))
    sides = written(sides, "minhash-sides")
    tables = sides.select("node", F.explode(F.flatten(F.transform("l", lambda x: F.transform(
        F.col("r"), lambda y: F.xxhash64(x, y))))).alias("t"))
    leaders = tables.groupBy("t").agg(F.min("node").alias("leader"), F.max("node").alias("z")).filter("leader < z")
    return (tables.join(leaders.drop("z"), "t").filter("node > leader").select("leader", "node").distinct())


def block_links(nodes: np.ndarray, sets: list[np.ndarray], is_query: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between queries and all sets of a block: 100 |A n B| >= percent |A u B|."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size, nodes, is_query = size[order], nodes[order], is_query[order]
    _, dense = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(int(dense.max()) + 1, dtype=np.int32)
    # rows of one node are joined from the start
    _, comp = np.unique(nodes, return_inverse=True)
    every = bool(is_query.all())
    found = []
    for q in np.flatnonzero(is_query):
        n = size[q]
        lo = q + 1 if every else np.searchsorted(size, -(-percent * n // 100), side="left")
        hi = np.searchsorted(size, 100 * n // percent, side="right")
        if lo >= hi or (comp[lo:hi] == comp[q]).all():
            continue
        own = dense[at[q]:at[q + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[dense[at[lo]:at[hi]]], at[lo:hi] - at[lo])
        mark[own] = 0
        for i in lo + np.flatnonzero(100 * both >= percent * (n + size[lo:hi] - both)):
            if comp[i] != comp[q]:
                found.append((int(nodes[q]), int(nodes[i])))
                comp[comp == comp[i]] = comp[q]
    return found


def _verified(groups: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """(a, b): spanning forests of the groups' links. Rows: keys, node, set, query."""
    def run(group):
        import pandas as pd  # here alone: the other tasks do without its memory

        sets = [np.frombuffer(s, dtype=np.uint64) for s in group["set"]]
        found = block_links(group["node"].to_numpy(), sets, group["query"].to_numpy(dtype=bool), percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return groups.groupBy(*keys).applyInPandas(run, "a bigint, b bigint")


def _blocks(count, hashes):
    """Blocks that so many sets with so many hashes are cut into."""
    return F.greatest(F.ceil(count / F.lit(BLOCK_SETS)), F.ceil(hashes / F.lit(BLOCK_HASHES))).cast("int")


def _block_of(n):
    return F.pmod(F.xxhash64("node", "set_key"), n).cast("int")


def links(docs: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b): links between classes that connect all that are connected."""
    cluster = connected(candidate_edges(classes), "leader", "node", "minhash-clusters")
    members = (classes.select("node", "set_key", "n_shingles")
               .join(cluster.withColumnRenamed("component", "cluster"), "node"))
    per = members.groupBy("cluster").agg(_blocks(F.count("*"), F.sum("n_shingles")).alias("n_blocks"))
    members = members.join(per, "cluster").withColumnRenamed("set_key", "key")

    def sets_of(b):
        got = [shingles(t, shingle) for t in b.column("text").to_pylist()]
        return {"set": [h.tobytes() for h in got],
                "same": [xxhash.xxh3_128_digest(h.tobytes()) == k for h, k in zip(got, b.column("set_key").to_pylist())]}

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(
        members.select("node", F.col("key").alias("set_key"), "cluster", "n_blocks"), "node")
    sets = arrow_map(texts, sets_of, [T.StructField("set", T.BinaryType())],
                     ["node", "set_key", "cluster", "n_blocks"], when="same")
    sets = written(sets.withColumn("block", _block_of(F.col("n_blocks"))), "minhash-sets")

    # each block within itself and with the first one
    place = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("n_blocks") - 1)).otherwise(F.array("block"))
    first = _verified(sets.select("cluster", F.explode(place).alias("group"), "node", "set", F.lit(True).alias("query")),
                      ["cluster", "group"], percent)
    first = written(first, "minhash-links")

    # what is not in the largest component of a cluster of several blocks, with all of that cluster
    comp = connected(first, "a", "b", "minhash-first")
    big = sets.filter("n_blocks > 1").select("cluster", "node", "set_key", F.octet_length("set").alias("bytes"))
    named = big.join(comp, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    counts = named.groupBy("cluster", "comp").agg(F.count("*").alias("n"))
    main = counts.groupBy("cluster").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"))
    out = named.join(main, "cluster").filter("comp != main").select("cluster", "node", "set_key", "bytes")
    parts = out.groupBy("cluster").agg(_blocks(F.count("*"), F.sum("bytes") / 8).alias("n_out"))
    queries = (sets.join(out.select("node", "set_key"), ["node", "set_key"], "left_semi").join(parts, "cluster")
               .withColumn("part", _block_of(F.col("n_out")))
               .select("cluster", "part", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("group"), "node",
                       "set", F.lit(True).alias("query")))
    targets = (sets.join(parts, "cluster")
               .select("cluster", F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)).alias("part"),
                       F.col("block").alias("group"), "node", "set", F.lit(False).alias("query")))
    second = _verified(queries.union(targets), ["cluster", "part", "group"], percent)
    return first.union(second)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    ``component_id``: the least doc_id that links lead to, itself included; ``kept``: the document is that one. Empty
    and null texts have no shingles and no links. Rows with one doc_id are one document, also when their texts
    differ: it is linked with all that either text links to. Rows without doc_id cannot be named by a component: they
    get a null one, link nothing and are kept.
    """
    sig = written(signatures(docs, shingle), "minhash-signatures")
    named = sig.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = named.groupBy("set_key").agg(
        F.min(F.struct("doc_id", "n_shingles", "left", "right")).alias("x")).select(
        "set_key", F.col("x.doc_id").alias("node"), "x.n_shingles", "x.left", "x.right")
    classes = written(classes, "minhash-classes")
    found = links(docs, classes, shingle, percent)
    rep = classes.select("set_key", "node")
    of_doc = sig.select("doc_id", "n_shingles", "set_key").join(rep, "set_key", "left")
    # a doc_id with several texts ties their classes together
    tied = (of_doc.filter("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id")
            .agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z"))
    tied = of_doc.join(tied, "doc_id").filter("node > a").select("a", F.col("node").alias("b"))
    comp = connected(found.union(tied), "a", "b", "minhash-components")
    got = of_doc.join(comp, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.least(F.coalesce("component", "node", "doc_id"), F.col("doc_id")))
    return got.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _numbered(texts: DataFrame, low: int, high: int) -> DataFrame:
    """(text, node): the distinct texts with numbers that no doc_id between ``low`` and ``high`` has."""
    at = written(texts.distinct().withColumn("_at", F.monotonically_increasing_id()), "minhash-nameless")
    part = F.shiftright("_at", 33).cast("int")
    counts = sorted((r["p"], r["n"]) for r in at.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    if high + total < 1 << 63:
        first = high + 1
    elif low - total >= -(1 << 63):
        first = low - total
    else:
        raise ValueError("doc_id leaves no numbers for the rows without one")
    start = at.sparkSession.createDataFrame(starts, "p int, start long")
    node = F.lit(first).cast("long") + F.col("start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return written(at.join(F.broadcast(start), part == F.col("p")).select("text", node.alias("node")), "minhash-numbered")


def _one_each(rows: DataFrame, key: str) -> DataFrame:
    """One ``row`` for each ``key``: one with words if there is any, the least text, then the least hash."""
    plain = [F.col(f"row.`{f.name}`") for f in rows.schema["row"].dataType.fields if "map<" not in f.dataType.simpleString()]
    words = F.coalesce(F.col("row.text").rlike(WORD), F.lit(False))
    return rows.groupBy(key).agg(F.min_by("row", F.struct(~words, F.col("row.text"), F.xxhash64(*plain))).alias("row"))


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` for each group of near copies: that of its least doc_id, and of repeated rows with it the one
    with words and the least text. A row without doc_id is a document of its own that links by its text like any other;
    it stays only if its group has no doc_id (of equal texts one). Rows without words link with nothing: those
    without doc_id stay, those with one leave one row a doc_id."""
    rows = packed(docs)
    # numbers for texts without doc_id: above every doc_id, so that a doc_id comes before them
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    nameless = F.col("doc_id").isNull() & F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    facts = texts.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
                      F.max(nameless).alias("nameless")).first()
    numbered = None
    if facts["nameless"]:
        numbered = _numbered(texts.filter(nameless).select("text"), facts["low"] or 0, facts["high"] or 0)
        texts = texts.filter("doc_id IS NOT NULL").union(numbered.select("node", "text"))
    near = near_duplicates(texts, shingle, percent)
    gone = near.filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    twice = written(docs.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(
        F.count("*").alias("n")).filter("n > 1").select("_id"), "minhash-twice")
    if numbered is None and twice.isEmpty():
        return rows.join(gone, F.col("row.doc_id") == F.col("_gone"), "left_anti").select("row.*")
    gone = written(gone, "minhash-gone")
    left = rows.join(gone, F.col("row.doc_id") == F.col("_gone"), "left_anti")
    if numbered is not None:
        left = left.filter(F.col("row.doc_id").isNotNull() | ~F.coalesce(F.col("row.text").rlike(WORD), F.lit(False)))
    out = left.join(twice, F.col("row.doc_id") == F.col("_id"), "left_anti")
    out = out.union(_one_each(left.join(twice, F.col("row.doc_id") == F.col("_id")), "_id").select("row"))
    if numbered is not None:
        stay = numbered.join(gone, F.col("node") == F.col("_gone"), "left_anti").withColumnRenamed("text", "_text")
        named = rows.filter("row.doc_id IS NULL").join(stay, F.col("row.text") == F.col("_text"))
        out = out.union(_one_each(named, "node").select("row"))
    return out.select("row.*")


def op3_minhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text"), shingle=4)
