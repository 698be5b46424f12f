"""Removal of repeated runs of lines by winnowing over line hashes, in DataFrame operations only.

A run is a stretch of consecutive lines with at least ``words`` words in all. From every line a window looks forward
over the fewest lines that hold so many words, and another looks back. The least line hash of a window is its
fingerprint: equal runs hold equal windows, so they select equal fingerprints (the winnowing guarantee, here in words
instead of lines). Fingerprints found at one position only are set aside with their windows; the positions of the
others are joined, and a match extends both ways over the forward and backward windows around it, compared by the
hashes of all their lines. Every window that occurred earlier (by doc_id, then by line) is cut out; overlapping ones
make up the whole repeated run.

Result: a line goes if and only if it lies in a run of at least ``words`` words that occurs earlier; the first
occurrence always stays. Blank lines do not count as lines of a run; those inside a deleted run go with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import WORD, packed, written

#: Words of the shortest run that counts as repeated.
WORDS = 50
#: White space that does not distinguish lines, at their ends.
EDGES = " \t\r\x0b\x0c"


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, tie, pos, h, h2, words): the lines with a word; equal rows of (doc_id, text) count as one document."""
    split = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("tie"),
                        F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.btrim("line", F.lit(EDGES))
    rows = split.select("doc", "tie", "pos", F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("h2"),
                        F.regexp_count("line", F.lit(WORD)).cast("long").alias("words")).filter("words > 0")
    return rows.repartition("doc", "tie").dropDuplicates(["doc", "tie", "pos"])


def windows(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc, tie, start, last, f, at, u): every full window with its fingerprint ``f`` at line ``at`` and the hash
    ``u`` of all its lines."""
    doc = Window.partitionBy("doc", "tie")
    lines = (_lines(docs)
             .withColumn("end", F.sum("words").over(doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("before", F.col("end") - F.col("words")))
    forward = doc.orderBy("before").rangeBetween(0, words - 1)
    backward = doc.orderBy("end").rangeBetween(1 - words, 0)

    def seen(frame):
        return F.struct(F.min("pos").over(frame).alias("start"), F.max("pos").over(frame).alias("last"),
                        F.sum("words").over(frame).alias("n"),
                        F.min(F.struct("h", "pos")).over(frame).alias("least"),
                        F.xxhash64(F.collect_list("h2").over(frame)).alias("u"))

    both = lines.select("doc", "tie", seen(forward).alias("a"), seen(backward).alias("b"))
    return (both.select("doc", "tie", F.explode(F.array("a", "b")).alias("w")).filter(F.col("w.n") >= words)
            .select("doc", "tie", "w.start", "w.last", F.col("w.least.h").alias("f"), F.col("w.least.pos").alias("at"),
                    "w.u"))


def repeated(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc, tie, runs): of each document the line intervals that lie in windows which occurred earlier."""
    w = written(windows(docs, words), "line-windows")
    place = F.struct("doc", "tie", "at")
    shared = w.groupBy("f").agg(F.min(place).alias("a"), F.max(place).alias("z")).filter("a < z").select("f")
    met = w.join(shared, "f", "left_semi")
    begin = F.struct(F.col("doc").isNull().alias("no_id"), F.col("doc"), F.col("tie"), F.col("start"))
    first = met.groupBy("f", "u").agg(F.min(begin).alias("first"), F.max(begin).alias("final")).filter("first < final")
    later = met.join(first.drop("final"), ["f", "u"]).filter(begin > F.col("first"))
    # overlapping windows of a document make one run: a new one begins where a window starts behind all before it
    doc = Window.partitionBy("doc", "tie").orderBy("start", "last")
    reach = F.max("last").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    opened = later.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    runs = (opened.withColumn("run", F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("doc", "tie", "run").agg(F.min("start").alias("start"), F.max("last").alias("last")))
    return runs.groupBy("doc", "tie").agg(F.sort_array(F.collect_list(F.struct("start", "last"))).alias("runs"))


def dedup_lines(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` with the text of later repeated runs cut out, and ``_n_lines``, ``_cut_lines``.

    No row goes: a document of nothing but repeats keeps an empty text. Null texts stay null, empty ones empty. Rows
    equal in doc_id and text are one document and get equal texts. Documents without doc_id come last in the order.
    A passage that a third of all documents share meets in aggregates that combine before the shuffle and in joins
    whose hot side AQE splits; only the lines of one document ever meet in one task.
    """
    runs = repeated(docs.select("doc_id", "text"), words)
    text = F.col("row.text")
    got = packed(docs).join(runs, F.col("row.doc_id").eqNullSafe(F.col("doc")) & (F.xxhash64(text) == F.col("tie")), "left")
    lines = F.split(text, "\n")
    # the runs are sorted and disjoint: a document's lines outside them are the gaps between neighbours
    gaps = F.transform(
        F.arrays_zip(F.concat(F.array(F.lit(-1)), F.col("runs.last")).alias("l"),
                     F.concat(F.col("runs.start"), F.array(F.size(lines))).alias("r")),
        lambda g: F.slice(lines, g["l"] + 2, F.greatest(g["r"] - g["l"] - 1, F.lit(0))))
    cut = F.aggregate("runs", F.lit(0), lambda n, r: n + r["last"] - r["start"] + 1)
    left = F.when(F.col("runs").isNull(), text).otherwise(F.array_join(F.flatten(gaps), "\n"))
    names = [c for c in docs.columns if c.lower() not in ("_n_lines", "_cut_lines")]
    return got.select(*[left.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in names],
                      F.when(text.isNull(), 0).otherwise(F.size(lines)).alias("_n_lines"),
                      F.coalesce(cut, F.lit(0)).alias("_cut_lines"))


def op6_lines(docs: DataFrame, words: int = WORDS) -> DataFrame:
    got = dedup_lines(docs.select("doc_id", "text"), words)
    return got.select("doc_id", F.col("_n_lines").cast("long").alias("n_lines"),
                      F.col("_cut_lines").cast("long").alias("cut_lines"), F.md5(F.col("text")).alias("text_md5"))


_TRIMMED = "trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12))"

ORACLE = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                  unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, pos, {_TRIMMED} AS line, CAST(len(regexp_extract_all(line, '{WORD}')) AS BIGINT) AS words FROM l),
c AS (SELECT *, CAST(sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS e FROM k WHERE words > 0),
w AS (SELECT doc_id, min(pos) OVER f AS s, max(pos) OVER f AS t, sum(words) OVER f AS n, list(line) OVER f AS body
      FROM (SELECT *, e - words AS b FROM c) WINDOW f AS (PARTITION BY doc_id ORDER BY b RANGE BETWEEN CURRENT ROW AND {WORDS - 1} FOLLOWING)
      UNION ALL
      SELECT doc_id, min(pos) OVER f, max(pos) OVER f, sum(words) OVER f, list(line) OVER f
      FROM c WINDOW f AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN {WORDS - 1} PRECEDING AND CURRENT ROW)),
x AS (SELECT doc_id, s, t, min((doc_id, s)) OVER (PARTITION BY body) AS first FROM w WHERE n >= {WORDS}),
z AS (SELECT DISTINCT doc_id, s, t FROM x WHERE (doc_id, s) > first),
cut AS (SELECT DISTINCT l.doc_id, l.pos FROM l JOIN z ON l.doc_id = z.doc_id AND l.pos BETWEEN z.s AND z.t)
SELECT d.doc_id, coalesce(max(l.pos) + 1, 0) AS n_lines, count(cut.pos) AS cut_lines,
       CASE WHEN any_value(d.text) IS NULL THEN NULL
            ELSE md5(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (cut.pos IS NULL), '')) END AS text_md5
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN cut ON cut.doc_id = l.doc_id AND cut.pos = l.pos
GROUP BY d.doc_id
"""
