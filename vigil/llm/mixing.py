"""Mixing sources to target weights.

Token totals per source give each source's target and repetition rate; every document is emitted floor(rate) times
plus one hash-seeded Bernoulli copy whose probability is the rate's fraction. The draws of one source are
systematic: with its documents in a fixed order (largest first, then by a seeded hash) document number r draws a
copy when ``floor((r + 1) f + u) > floor(r f + u)``, u being uniform by the seed. Each draw is a Bernoulli draw
with probability f, and neighbours in size compensate each other, so that a source's taken words miss its target by
about one document instead of by the noise of independent draws.

The numbering never sorts a source in one task: repeated rows are counted first, the others of a size split into hash
buckets of about ``BUCKET``, and only the bucket counts (one row for each distinct size or 1024 rows) are summed along
a source. Repeated rows have numbers one after another, so they share their draws like any others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import WORD, packed, written

#: Different documents of one source and size that are numbered together.
BUCKET = 1024
#: Repeated rows that one task writes out.
CHUNK = 1 << 16
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix-1"


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) -> also ``target``: the sources by code point, null last, weigh ``weights`` in turn and
    share all words; none gets more than ``max_repeat`` times its size, and what is above is shared anew by weight.

    That sharing ends at target = min(cap, level * weight) with one level for all: sorted by cap / weight, the first
    sources are capped and the level of the rest follows from running sums. One row per source goes through it.
    """
    nth = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(nth) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.lit(max_repeat) * F.col("source_size")
    by_cap = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranked = (sizes.withColumn("_w", w).withColumn("_cap", cap).withColumn("_ratio", F.col("_cap") / F.col("_w"))
              .select("*", F.coalesce(F.sum("_cap").over(before), F.lit(0)).alias("_capped"),
                      F.coalesce(F.sum("_w").over(before), F.lit(0.0)).alias("_w_before"),
                      F.sum("source_size").over(whole).alias("_all"), F.sum("_w").over(whole).alias("_w_all")))
    # the level if exactly the sources before this one were capped; the right one is the first not above its ratio
    level = (F.col("_all") - F.col("_capped")) / (F.col("_w_all") - F.col("_w_before"))
    fits = ranked.withColumn("_level", F.min(F.when(level <= F.col("_ratio"), F.struct(F.col("_ratio"), level.alias("l")))
                                             ).over(whole)["l"])
    return fits.select("source", "source_size",
                       F.when(F.col("source_size") == 0, F.lit(0.0))
                       .otherwise(F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w"))).alias("target"))


def numbered(rows: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """(key, source, size) -> one row for each distinct of them with ``n``, how many rows it stands for, their numbers in
    the source from ``first`` on, ``source_size``, ``target``, ``rate`` and ``start``, for ``copies_of``.

    ``key`` (string, not null) names a row for the draws. An empty source, or a size of 0, is a legal row: a source
    without words has target 0 and gives no copies.
    """
    groups = rows.groupBy("key", "source", "size").agg(F.count("*").alias("n"))
    per_source = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = targets(per_source, weights, max_repeat)
    draw = F.md5(F.concat(F.lit(seed), F.lit("|"), F.col("key")))
    at = F.conv(F.substring(draw, 1, 12), 16, 10).cast("double") / F.lit(float(16 ** 12))
    groups = groups.withColumn("_draw", draw).withColumn("_at", at)
    same = groups.groupBy("source", "size").agg(F.count("*").alias("_n"))
    n_buckets = F.ceil(F.col("_n") / F.lit(BUCKET))
    groups = null_safe(groups, same, ["source", "size"]).withColumn("_bucket", F.floor(F.col("_at") * n_buckets))
    counts = groups.groupBy("source", "size", "_bucket").agg(F.sum("n").alias("_c"))
    before = (Window.partitionBy("source").orderBy(F.col("size").desc(), "_bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("source", "size", "_bucket", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    counts = null_safe(counts, goal, ["source"])
    inside = (Window.partitionBy("source", "size", "_bucket").orderBy("_draw", "key")
              .rowsBetween(Window.unboundedPreceding, -1))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.lit("#"), F.coalesce("source", F.lit("")))), 1, 12),
                   16, 10).cast("double") / F.lit(float(16 ** 12))
    return null_safe(groups, counts, ["source", "size", "_bucket"]).select(
        "key", "source", "size", "n", (F.col("_before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("first"),
        "source_size", "target", rate.alias("rate"), start.alias("start"))


def copies_of(nth: Column) -> Column:
    """Copies of the ``nth`` row (from 0) that a row of ``numbered`` stands for."""
    f, r = F.col("rate") - F.floor("rate"), (F.col("first") + nth).cast("double")
    drawn = F.floor((r + 1) * f + F.col("start")) - F.floor(r * f + F.col("start"))
    return (F.floor("rate") + drawn).cast("long")


def copies(rows: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """(key, source, size) -> also ``source_size``, ``target`` and ``copies``, a row for every row. Rows equal in all
    three cannot be told apart; each draws with a number of its own."""
    groups = numbered(rows, weights, max_repeat, seed)
    one = groups.filter("n = 1").withColumn("_i", F.lit(0).cast("long"))
    chunks = groups.filter("n > 1").withColumn("_c", F.explode(F.expr(f"sequence(0, (n - 1) div {CHUNK})")))
    many = chunks.repartition("key", "_c").withColumn("_i", F.explode(F.expr(
        f"sequence(_c * {CHUNK}, least(n, (_c + 1) * {CHUNK}) - 1)"))).drop("_c")
    return one.unionByName(many).select("key", "source", "size", "source_size", "target",
                                        copies_of(F.col("_i")).alias("copies"))


def null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Equi-join in which null equals null; ``right`` has each key once. AQE splits hot keys of ``left``."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in on], *[c for c in right.columns if c not in on])
    cond = None
    for c in on:
        e = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        cond = e if cond is None else cond & e
    return left.join(r, cond).drop(*[f"_r_{c}" for c in on])


def doc_key(doc_id: Column, text: Column) -> Column:
    """Names a document row for the draws: its id, and its text where ids repeat."""
    return F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit(""))))


def _nth(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with ``_i``: their number among those equal in ``by``, from 0. They are written first, so that the numbers
    stay; a hot key is numbered partition by partition."""
    rows = written(rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)),
                   "mix-repeated")
    counts = rows.groupBy(*by, "_part").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_part").orderBy("_at")
    return null_safe(rows, counts, [*by, "_part"]).withColumn(
        "_i", F.col("_before") + F.row_number().over(inside) - 1).drop("_at", "_part", "_before")


def mix(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` repeated as the mix takes them (0 to ``max_repeat`` times), with its columns.

    The draws are made on (key, source, size); the texts are shuffled once, to meet their number of copies. Rows that
    repeat in id, source and text are numbered one by one and draw with numbers of their own, so that their source
    comes as near its target as any.
    """
    named = packed(docs).withColumn("name", doc_key(F.col("row.doc_id"), F.col("row.text"))).withColumn("_s", F.col("row.source"))
    drawn = written(numbered(named.select(F.col("name").alias("key"), F.col("_s").alias("source"), n_words("row.text").alias("size")),
                             weights, max_repeat, seed), "mix-drawn")
    same = (F.col("name") == F.col("key")) & F.col("_s").eqNullSafe(F.col("source"))
    times = copies_of(F.lit(0))
    out = named.join(drawn.filter("n = 1").withColumn("_copies", times).filter("_copies > 0").select("key", "source", "_copies"),
                     same).select("row", "_copies")
    if not drawn.filter("n > 1").isEmpty():
        again = named.join(drawn.filter("n > 1").select("key", "source"), same, "left_semi")
        again = _nth(again, ["name", "_s"]).join(drawn.filter("n > 1").drop("size"), same)
        out = out.union(again.withColumn("_copies", copies_of(F.col("_i"))).filter("_copies > 0").select("row", "_copies"))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("row.*")


def op9_mix(docs: DataFrame) -> DataFrame:
    """What the mix takes of every document. Rows with one doc_id, source and size (or none) draw one by one."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select(key.alias("key"), "source", n_words("text").alias("size"))
    return copies(rows).select(F.expr("try_cast(key AS bigint)").alias("doc_id"), "size", "source_size", "target",
                               (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size
           FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w,
             {MAX_REPEAT} * source_size AS cap FROM s),
r AS (SELECT *, cap / w AS ratio FROM w),
b AS (SELECT *, coalesce(sum(cap) OVER p, 0) AS capped, coalesce(sum(w) OVER p, 0) AS w_before,
             sum(source_size) OVER () AS total, sum(w) OVER () AS w_all FROM r
      WINDOW p AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CAST(total - capped AS DOUBLE) / (w_all - w_before) AS lv FROM b),
v AS (SELECT *, (SELECT arg_min(lv, ratio) FROM l WHERE lv <= ratio) AS level FROM l),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0
             ELSE least(CAST(cap AS DOUBLE), level * w) END AS target FROM v),
k AS (SELECT doc_id, source, size,
             row_number() OVER (PARTITION BY source ORDER BY size DESC,
                          substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12),
                          md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null'))) - 1.0::DOUBLE AS r FROM d),
j AS (SELECT k.*, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
             CAST(('0x' || substr(md5('{SEED}#' || coalesce(k.source, '')), 1, 12)) AS BIGINT)::DOUBLE / {16 ** 12}::DOUBLE AS u
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + floor((r + 1) * (rate - floor(rate)) + u) - floor(r * (rate - floor(rate)) + u)) AS BIGINT) AS taken
FROM j
"""
