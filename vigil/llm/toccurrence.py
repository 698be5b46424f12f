"""N-gram Jaccard join by T-occurrence search (DivideSkip).

A document's set holds the hashes of its distinct word shingles; equal sets are one class. Two sets with a similarity
of at least 0.8 share T = ceil(0.8 n) hashes of each, so three exact filters come before the search:

1. of the 0.2 n + t least hashes of each, the two share at least t. Tasks sort these prefixes, settle what they see
   twice themselves, and send each other hash once to its bucket; a class goes on if enough of its prefix is shared;
2. of a class's hashes, T must be in some other class. The number of classes that hold a hash is the length of its
   inverted list; the n - T + 1 shortest lists of a class are its short ones, and linked classes share a short list;
3. the lists of one leader, their least class, make a group: linked classes meet in the group of a list that they share.
   A group of many classes is cut into blocks; every block is searched together with the first, and classes that this
   leaves apart from the first block's largest component are searched in all blocks.

In a block the inverted lists are built, and every set searches them: the longest lists are set aside, a heap merges
the others and skips to the first set that can still occur often enough, and the sets it returns are looked up in the
long lists by binary search. What remains are the overlaps themselves, so the threshold is exact. A search leaves out
sets that are connected already: what a task emits is a spanning forest of the links, and nothing else is left out.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager
from heapq import heapify, heappop, heappush, heapreplace
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import arrow_map, written
from vigil.llm.graph import connected
from vigil.llm.minhash import shingles

SHINGLE, PERCENT = 5, 80
#: Percent of a set's size that two linked prefixes share, and by which a prefix is longer than without that.
SHARED = 8
#: Hashes that a task holds before it sends them on, and hashes of a bucket, about.
FLUSH, BUCKET = 1 << 20, 1 << 21
#: A block holds about so many sets and so many hashes at most.
BLOCK_SETS, BLOCK_HASHES = 1024, 1 << 20
#: Weight of a binary search against a step of the merge (the method's constant).
MU = 0.0085


def _share(n, percent: int):
    """ceil(percent / 100 * n), for integers, arrays and columns."""
    return -(-n * percent // 100) if not hasattr(n, "cast") else F.ceil(n * percent / 100)


def prefix_of(hashes: np.ndarray, percent: int) -> np.ndarray:
    n = len(hashes)
    return hashes[:n - _share(n, percent) + max(1, _share(n, SHARED))]


def prefixes(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, sid, prefix); the last three are null for an empty set (``sid``: 64 bits of the key,
    ``prefix``: packed hashes)."""
    def run(b):
        sets = [shingles(t, shingle) for t in b.column("text").to_pylist()]
        keys = [xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in sets]
        return {"n_shingles": list(map(len, sets)), "set_key": keys,
                "sid": [None if k is None else int.from_bytes(k[:8], "little", signed=True) for k in keys],
                "prefix": [prefix_of(h, percent).tobytes() if len(h) else None for h in sets]}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                     [T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()),
                      T.StructField("sid", T.LongType()), T.StructField("prefix", T.BinaryType())], ["doc_id"])


def _column(group: pd.DataFrame, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(group[name]), dtype=dtype)


def shared_counts(sets: DataFrame, buckets: int) -> DataFrame:
    """(sid, n): for classes at least how many of their prefix hashes others have too (more for equal sets that several
    tasks meet). Rows: sid, prefix. A task sends a hash once, however many of its classes hold it: those know already."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(held: dict[int, bytes]) -> pa.RecordBatch:
            h = np.frombuffer(b"".join(held.values()), dtype=np.uint64)
            own = np.repeat(np.fromiter(held, dtype=np.int64, count=len(held)), [len(p) // 8 for p in held.values()])
            order = np.argsort(h)
            h, own = h[order], own[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            times = np.diff(first, append=len(h))
            many = times > 1
            ids, n = np.unique(own[np.repeat(many, times)], return_counts=True)
            twice, h, own = h[first[many]], h[first[~many]], own[first[~many]]
            to, twice_to = ((x >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32) for x in (h, twice))
            order = np.lexsort((own, to))  # by class in a bucket, which packs better
            h, own, to = h[order], own[order], to[order]
            every = np.arange(buckets, dtype=np.uint64)
            cuts = [np.searchsorted(x, every, side=s).tolist() for x in (to, twice_to) for s in ("left", "right")]
            rows = [(i, h[a:b].tobytes(), own[a:b].tobytes(), twice[c:d].tobytes(), b"", b"")
                    for i, (a, b, c, d) in enumerate(zip(*cuts)) if a < b or c < d]
            rows.append((int(h[0]) % buckets if len(h) else 0, b"", b"", b"", ids.tobytes(), n.tobytes()))
            return pa.RecordBatch.from_arrays(
                [pa.array(x, type=pa.binary() if i else pa.int32()) for i, x in enumerate(zip(*rows))], names=names)

        held, size = {}, 0
        for b in batches:
            for sid, p in zip(b.column("sid").to_pylist(), b.column("prefix").to_pylist()):
                if sid not in held:
                    held[sid] = p
                    size += len(p) // 8
                    if size >= FLUSH:
                        yield sent(held)
                        held, size = {}, 0
        if held:
            yield sent(held)

    def count(group: pd.DataFrame) -> pd.DataFrame:
        h, own = _column(group, "h", np.uint64), _column(group, "own", np.int64)
        order = np.lexsort((own, h))
        h, own = h[order], own[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
        h, own = h[new], own[new]
        found, at, times = np.unique(h, return_inverse=True, return_counts=True)
        shared = (times > 1) | np.isin(found, _column(group, "twice", np.uint64))
        ids, n = np.unique(own[shared[at]], return_counts=True)
        return pd.DataFrame({"sid": np.concatenate([ids, _column(group, "ids", np.int64)]),
                             "n": np.concatenate([n, _column(group, "n", np.int64)])})

    names = ["bucket", "h", "own", "twice", "ids", "n"]
    dealt = sets.select("sid", "prefix").mapInArrow(deal, "bucket int, " + ", ".join(f"{c} binary" for c in names[1:]))
    got = dealt.groupBy("bucket").applyInPandas(count, "sid long, n long")
    return got.groupBy("sid").agg(F.sum("n").alias("n"))


def merge_skip(lists: list[list[int]], need: int) -> list[tuple[int, int]]:
    """(entry, lists that hold it) of the ascending ``lists`` for every entry in ``need`` of them or more."""
    k = len(lists)
    at, ends = [0] * k, list(map(len, lists))
    heap = [x[0] * k + i for i, x in enumerate(lists)]
    heapify(heap)
    found = []
    while len(heap) >= need:
        until = (heap[0] // k + 1) * k
        times = 0
        while heap and heap[0] < until:
            i = heap[0] % k
            times += 1
            at[i] = j = at[i] + 1
            if j < ends[i]:
                heapreplace(heap, lists[i][j] * k + i)
            else:
                heappop(heap)
        if times >= need:
            found.append((until // k - 1, times))
        elif need > 2 and len(heap) >= need and heap[need - 1] >= until + k:
            # nothing below the entry that need - 1 lists stand before can be in enough of them
            popped = [heappop(heap) % k for _ in range(need - 1)]
            least = heap[0] // k
            for i in popped:
                x = lists[i]
                at[i] = j = bisect_left(x, least, at[i])
                if j < ends[i]:
                    heappush(heap, x[j] * k + i)
    return found


def divide_skip(entries: np.ndarray, sizes: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """(entries, overlaps): what is in ``need`` or more of the ascending lists that ``entries`` holds one after another."""
    sizes = sizes[sizes > 0]
    if len(sizes) < need:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    ends = np.cumsum(sizes)
    order = np.argsort(sizes, kind="stable")
    aside = min(need - 1, int(need / (MU * log2(int(sizes.max())) + 1)))
    short, long = order[:len(order) - aside], order[len(order) - aside:]
    flat = entries.tolist()
    got = merge_skip([flat[e - n:e] for e, n in zip(ends[short].tolist(), sizes[short].tolist())], need - aside)
    if not got:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    found, times = map(np.array, zip(*got))
    if aside:
        wide = int(entries.max()) + 1
        into = np.arange(int(sizes[long].sum())) - np.repeat(np.cumsum(sizes[long]) - sizes[long], sizes[long])
        keys = np.repeat(np.arange(aside), sizes[long]) * wide + entries[np.repeat(ends[long] - sizes[long], sizes[long]) + into]
        for s in range(0, len(found), 256):
            probe = (np.arange(aside)[:, None] * wide + found[s:s + 256]).ravel()
            hit = keys[np.minimum(np.searchsorted(keys, probe), len(keys) - 1)] == probe
            times[s:s + 256] += hit.reshape(aside, -1).sum(axis=0)
    enough = times >= need
    return found[enough], times[enough]


def block_links(nodes: np.ndarray, sets: list[np.ndarray], is_query: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between queries and all sets of a block: 100 |A n B| >= percent |A u B|."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size, nodes, is_query = size[order], nodes[order], is_query[order]
    k = len(size)
    _, dense = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(size)])
    # the inverted lists, one after another; their entries are places in the order of size
    keys = np.sort(dense * k + np.repeat(np.arange(k), size))
    _, comp = np.unique(nodes, return_inverse=True)  # rows of one node are joined from the start
    every = bool(is_query.all())
    found = []
    for q in np.flatnonzero(is_query):
        n = int(size[q])
        need = _share(n, percent)
        lo = q + 1 if every else np.searchsorted(size, need, side="left")
        hi = np.searchsorted(size, 100 * n // percent, side="right")
        if lo >= hi or (comp[lo:hi] == comp[q]).all():
            continue
        own = np.sort(dense[at[q]:at[q + 1]]) * k
        begin, end = np.searchsorted(keys, own + lo), np.searchsorted(keys, own + hi)
        sizes = end - begin
        if np.count_nonzero(sizes) < need:
            continue
        lists = np.repeat(np.arange(n), sizes)
        entries = keys[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(lists))] % k
        apart = comp[entries] != comp[q]
        others, overlap = divide_skip(entries[apart], np.bincount(lists[apart], minlength=n), need)
        for i in others[100 * overlap >= percent * (n + size[others] - overlap)]:
            if comp[i] != comp[q]:
                found.append((int(nodes[q]), int(nodes[i])))
                comp[comp == comp[i]] = comp[q]
    return found


def stars(links: list[tuple[int, int]]) -> dict[int, int]:
    """Node -> least node of its component, for every node of the links."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def _searched(groups: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """(a, b): every node that the groups' links reach and the least node of its component; (cls, null) for each class
    of a block (``block`` > 0) that is left apart from the largest component of the first block. Rows: keys, leader,
    block, cls, node, set, query."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        found, apart = [], []
        for _, g in group.groupby("leader", sort=False):
            nodes, queries = g["node"].to_numpy(), g["query"].to_numpy(dtype=bool)
            sets = [np.asarray(s).view(np.uint64) for s in g["set"]]
            block = g["block"].to_numpy()
            if block.max() == 0:
                found += stars(block_links(nodes, sets, queries, percent)).items()
                continue
            # the first block by itself names its largest component, the same in every task that holds this block
            first = np.flatnonzero(block == 0)
            links = block_links(nodes[first], [sets[i] for i in first], queries[first], percent)
            comp = stars(links)
            names, times = np.unique([comp.get(n, n) for n in nodes[first].tolist()], return_counts=True)
            joined = np.array([comp.get(n, n) for n in nodes.tolist()])
            comp = stars(links + block_links(joined, sets, queries, percent))
            found += comp.items()
            main = names[np.argmax(times)] if len(names) else None
            apart += [c for c, n, k in zip(g["cls"].tolist(), nodes.tolist(), block.tolist())
                      if k > 0 and (main is None or comp.get(n, n) != comp.get(main, main))]
        return pd.DataFrame({"a": pd.array([a for a, b in found if a != b] + apart, dtype="Int64"),
                             "b": pd.array([b for a, b in found if a != b] + [None] * len(apart), dtype="Int64")})

    return groups.groupBy(*keys).applyInPandas(run, "a bigint, b bigint")


def _blocks(count, hashes):
    """Blocks that so many sets with so many hashes are cut into."""
    return F.greatest(F.ceil(count / F.lit(BLOCK_SETS)), F.ceil(hashes / F.lit(BLOCK_HASHES))).cast("int")


def _short_lists(sets: DataFrame, percent: int) -> DataFrame:
    """(cls, h): the short inverted lists of the classes that share enough hashes with others."""
    held = sets.select("cls", F.explode("set").alias("h"))
    lists = held.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    per = held.join(lists, "h").groupBy("cls").agg(F.collect_list(F.struct("n", "h")).alias("x"))
    need = _share(F.col("n_shingles"), percent).cast("int")
    per = (per.join(sets.select("cls", need.alias("need")), "cls").filter(F.size("x") >= F.col("need"))
           .select("cls", F.slice(F.array_sort("x"), F.lit(1), F.greatest(F.size("x") - F.col("need") + 1, F.lit(0))).alias("x")))
    return written(per.select("cls", F.explode("x.h").alias("h")), "join-lists")


@contextmanager
def filtered_scans(spark: SparkSession):
    """Inside, Spark puts runtime Bloom filters before joins of small inputs too, not only of scans over 10 GB."""
    name = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "0")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def links(docs: DataFrame, classes: DataFrame, shingle: int, percent: int, twice: bool) -> DataFrame:
    """(a, b): links between documents that connect all that are connected. ``classes``: cls, node, n_shingles, set_key;
    ``twice``: rows of ``docs`` are repeated."""
    def sets_of(b):
        got = [shingles(t, shingle) for t in b.column("text").to_pylist()]
        return {"set": [h.view(np.int64) for h in got],
                "same": [xxhash.xxh3_128_digest(h.tobytes()) == k for h, k in zip(got, b.column("set_key").to_pylist())]}

    # a filter on the size lets Spark send a Bloom filter of these classes (8 MB at most) ahead of the texts
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(classes.filter("n_shingles > 0"), "node")
    sets = arrow_map(texts, sets_of, [T.StructField("set", T.ArrayType(T.LongType()))],
                     ["cls", "node", "n_shingles", "set_key"], when="same").drop("set_key")
    if twice:
        sets = sets.dropDuplicates(["cls"])
    with filtered_scans(docs.sparkSession):
        sets = written(sets, "join-sets")

    lists = _short_lists(sets, percent)
    leaders = lists.groupBy("h").agg(F.min("cls").alias("leader"), F.max("cls").alias("z")).filter("leader < z").drop("z")
    groups = written(lists.join(leaders, "h").select("leader", "cls").distinct(), "join-groups")
    size = sets.select("cls", "n_shingles")
    per = groups.join(size, "cls").groupBy("leader").agg(
        _blocks(F.count("*"), F.sum("n_shingles")).alias("n_blocks"), F.sum("n_shingles").alias("hashes"))
    per = written(per, "join-sizes")
    small = per.agg(F.sum(F.when(F.col("n_blocks") == 1, F.col("hashes"))).alias("hashes"), F.max("n_blocks").alias("most")).first()
    packs = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), (small["hashes"] or 0) // BLOCK_HASHES)
    pack = F.when(F.col("n_blocks") == 1, -1 - F.pmod(F.xxhash64("leader"), F.lit(packs))).otherwise(F.col("leader"))
    members = groups.join(per.drop("hashes"), "leader").select(
        "leader", pack.alias("pack"), "n_blocks", "cls",
        F.pmod(F.xxhash64("cls", "leader"), "n_blocks").cast("int").alias("block")).join(sets, "cls")

    # each block within itself and with the first one; small groups share a task
    place = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("n_blocks") - 1)).otherwise(F.array("block"))
    first = _searched(members.select("leader", "block", "pack", F.explode(place).alias("part"), "cls", "node", "set",
                                     F.lit(True).alias("query")), ["pack", "part"], percent)
    first = written(first, "join-links")
    found = first.filter("b IS NOT NULL")
    if (small["most"] or 0) < 2:
        return found
    # what is apart from the largest component of a first block, with all of its group
    big = members.filter("n_blocks > 1")
    out = big.filter("block > 0").join(first.filter("b IS NULL").select(F.col("a").alias("cls")).distinct(), "cls", "left_semi")
    out = written(out.select("leader", "cls", "n_shingles", "node", "set", "n_blocks"), "join-apart")
    parts = written(out.groupBy("leader").agg(_blocks(F.count("*"), F.sum("n_shingles")).alias("n_out")), "join-parts")
    queries = (out.join(parts, "leader").withColumn("part", F.pmod(F.xxhash64("cls"), "n_out").cast("int"))
               .select("leader", F.lit(0).alias("block"), "part", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other"),
                       "cls", "node", "set", F.lit(True).alias("query")))
    targets = (big.join(parts, "leader").select(
        "leader", F.lit(0).alias("block"), F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)).alias("part"),
        F.col("block").alias("other"), "cls", "node", "set", F.lit(False).alias("query")))
    return found.union(_searched(queries.union(targets), ["leader", "part", "other"], percent).filter("b IS NOT NULL"))


def jaccard_join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text; other columns are not read).

    ``component_id``: the least doc_id that links lead to, itself included. Empty and null texts have no shingles and no
    links. Rows with one doc_id are one document, also when their texts differ: it is linked with all that either text
    links to. Rows without doc_id cannot be named by a component: they get a null one and link nothing. No list,
    cluster or document is capped.
    """
    spark = docs.sparkSession
    rows = written(prefixes(docs, shingle, percent), "join-prefixes")
    named = rows.filter("doc_id IS NOT NULL AND n_shingles > 0")
    facts = named.agg(F.sum(F.octet_length("prefix")).alias("bytes"), F.count("*").alias("n")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (facts["bytes"] or 0) // 8 // BUCKET)
    classes = written(named.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("n_shingles"),
                                                       F.min("sid").alias("sid"))
                      .withColumn("cls", F.monotonically_increasing_id()), "join-classes")
    counts = shared_counts(named, buckets)
    # a partner has four fifths of the size at least, and its part of shared hashes
    least = F.greatest(F.lit(1), _share(_share(F.col("n_shingles"), percent), SHARED))
    going = written(classes.join(counts, "sid").filter(F.col("n") >= least)
                    .select("cls", "node", "n_shingles", "set_key"), "join-classes")
    ids = named.groupBy("doc_id", "set_key").agg(F.count("*").alias("n"))
    found = links(docs, going, shingle, percent, twice=not ids.filter("n > 1").isEmpty())
    of_doc = rows.select("doc_id", "n_shingles", "set_key").join(classes.select("set_key", "node"), "set_key", "left")
    # a doc_id with several texts ties their classes together
    tied = (of_doc.filter("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id")
            .agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z"))
    tied = of_doc.join(tied, "doc_id").filter("node > a").select("a", F.col("node").alias("b"))
    comp = connected(found.union(tied), "a", "b", "join-components")
    component = F.when(F.col("doc_id").isNotNull(), F.least(F.coalesce("component", "node", "doc_id"), F.col("doc_id")))
    return of_doc.join(comp, "node", "left").select("doc_id", "n_shingles", component.alias("component_id"))


def op12_jaccard(docs: DataFrame) -> DataFrame:
    return jaccard_join(docs.select("doc_id", "text"))
