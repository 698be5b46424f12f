"""Idempotent ledgers as DataFrame operations: upsert, insert-if-absent, state folds, pages, counts, summaries.

Parquet has no MERGE, so an upsert returns the next version of the table
(source ∪ target-without-matches) for the caller to write to a new version
folder; nothing is updated in place, so a failed write never leaves a half
table. State folds turn an append-only event log into current state with
declarative aggregates (``max_by`` on a total order), which combine map-side
and therefore never gather one key's events into a single task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Open investigation statuses, terminal job statuses, and default page bounds.
OPEN_STATUSES = ["open", "running", "waiting_for_job", "waiting_for_approval"]
JOB_FINISHED = ["completed", "failed", "dlq", "skipped_duplicate"]
PAGE_DEFAULT, PAGE_MIN, PAGE_MAX = 50, 1, 200


def _null_safe_on(left: DataFrame, right: DataFrame, keys) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def latest_by_key(df: DataFrame, keys, order_cols) -> DataFrame:
    """One row per key: the row with the greatest ``order_cols`` (in-batch de-duplication).

    ``max_by`` on a struct is a declarative aggregate, so it is combined map-side.
    """
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(c) for c in order_cols])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordering).alias("_r")).select(*keys, "_r.*")


def upsert(target: DataFrame, source: DataFrame, keys, order_cols=None) -> DataFrame:
    """Next version of ``target``: every source row (the latest per key when ``order_cols`` is given) plus the
    target rows whose key (null-safe) is not in the source."""
    src = latest_by_key(source, keys, order_cols) if order_cols else source
    src = src.select(*target.columns)
    t, s = target.alias("t"), src.alias("s")
    kept = t.join(s, _null_safe_on(t, s, keys), "left_anti")
    return src.unionByName(kept)


def insert_if_absent(target: DataFrame, incoming: DataFrame, keys, order_cols) -> DataFrame:
    """Rows of ``incoming`` to append: first per key within the batch (by ``order_cols``), and key not yet in
    ``target``. A repeated key returns nothing (the stored row wins: first-write-wins ledgers).

    The in-batch first is a ``min_by`` aggregate, combined map-side, so a key repeated a billion times is
    reduced before the shuffle instead of being sorted in one task.
    """
    return insert_if_absent_agg(target, incoming, keys, order_cols)


def insert_if_absent_agg(target: DataFrame, incoming: DataFrame, keys, order_cols) -> DataFrame:
    """Same as ``insert_if_absent`` with the in-batch de-duplication as a map-side ``min_by`` (hot keys safe)."""
    rest = [c for c in incoming.columns if c not in keys]
    first = incoming.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in order_cols])).alias("_r")).select(*keys, "_r.*")
    i, t = first.alias("i"), target.select(*keys).alias("t")
    return first.join(t, _null_safe_on(i, t, keys), "left_anti")


def fold_state(events: DataFrame, keys, order_cols, fields: dict, extra_aggs=()) -> DataFrame:
    """Current state per key from an event log.

    ``fields`` maps an output name to ``(value, condition)``: the value of the latest
    event (by ``order_cols``) for which ``condition`` holds — an event whose condition
    holds *sets* the field, even to null; other events leave it.
    """
    order = F.struct(*[F.col(c) for c in order_cols])
    aggs = []
    for name, (value, cond) in fields.items():
        v = F.col(value) if isinstance(value, str) else value
        c = F.lit(True) if cond is None else cond
        aggs.append(F.max_by(F.struct(v.alias("v")), F.when(c, order)).alias(f"_{name}"))
    out = events.groupBy(*keys).agg(*aggs, *extra_aggs)
    return out.select(*keys, *[F.col(f"_{n}.v").alias(n) for n in fields], *[a for a in out.columns
                                                                            if a not in keys and not a.startswith("_")])


def job_state(events: DataFrame, key: str = "job_id", order_cols=("ts", "seq")) -> DataFrame:
    """Fold job-ledger events (running, completed, failed, retrying, dlq, skipped_duplicate) into current state."""
    st = F.col("status")
    fin = st.isin(*JOB_FINISHED)
    fields = {
        "status": ("status", None),
        "attempts": ("attempts", F.col("attempts").isNotNull()),
        "error_message": ("error_message", st.isin("failed", "retrying", "completed")),
        "started_at": ("ts", st == "running"),
        "finished_at": ("ts", fin),
        "next_retry_at": ("next_retry_at", st == "retrying"),
        "dlq_reason": ("dlq_reason", st == "dlq"),
    }
    extra = [F.bool_or(st == "dlq").alias("sent_to_dlq"), F.count_if(st == "retrying").alias("n_retries"),
             F.count(F.lit(1)).alias("n_events")]
    return fold_state(events, [key], list(order_cols), fields, extra)


def investigation_state(events: DataFrame, key: str = "investigation_id", order_cols=("ts", "seq")) -> DataFrame:
    """Fold investigation updates: null fields keep the stored value; ``resolved_at`` is the first time the
    status became resolved on the update path, unless an explicit resolve event (``op='resolve'``) came later."""
    fields = {c: (c, F.col(c).isNotNull()) for c in ("status", "current_step", "recommended_action", "summary")}
    out = fold_state(events, [key], list(order_cols), fields, [
        F.min_by("ts", F.when(F.col("status") == "resolved", F.struct(*[F.col(c) for c in order_cols])))
        .alias("first_resolved"),
        F.max_by("ts", F.when(F.col("op") == "resolve", F.struct(*[F.col(c) for c in order_cols])))
        .alias("explicit_resolved"),
        F.min("ts").alias("opened_at"), F.max("ts").alias("updated_at")])
    return out.withColumn("resolved_at", F.coalesce("explicit_resolved", "first_resolved")).drop(
        "explicit_resolved", "first_resolved")


def approval_state(events: DataFrame, key: str = "approval_id", order_cols=("ts", "seq")) -> DataFrame:
    """Fold approval events: pending → approved / rejected / expired."""
    st = F.col("status")
    fields = {
        "status": ("status", None),
        "approved": (F.when(st == "approved", True).when(st.isin("rejected", "expired"), False), st != "pending"),
        "approved_by": ("actor", st == "approved"),
        "approved_at": ("ts", st == "approved"),
        "rejected_by": ("actor", st == "rejected"),
        "rejected_at": ("ts", st == "rejected"),
        "rejection_reason": ("reason", st.isin("rejected", "expired")),
    }
    return fold_state(events, [key], list(order_cols), fields, [F.min("ts").alias("created_at"),
                                                                F.max("ts").alias("updated_at")])


def clamp_limit(limit: int) -> int:
    """The page limit; one out of bounds is an error, never cut in silence."""
    if not PAGE_MIN <= int(limit) <= PAGE_MAX:
        raise ValueError(f"limit must be from {PAGE_MIN} to {PAGE_MAX}, not {limit}")
    return int(limit)


def recent_page(df: DataFrame, ts_col: str, id_col: str, offset: int = 0, limit: int = PAGE_DEFAULT,
                status_col: str | None = None, status: str | None = None, ascending: bool = False) -> DataFrame:
    """Newest first (or oldest first), optional status filter, offset + limit (1..200)."""
    if status is not None:
        df = df.where(F.col(status_col) == status)
    order = [F.col(ts_col).asc(), F.col(id_col).asc()] if ascending else [F.col(ts_col).desc(), F.col(id_col).desc()]
    return df.orderBy(*order).offset(int(offset)).limit(clamp_limit(limit))


def status_counts(df: DataFrame, status_col: str = "status", total: bool = True) -> DataFrame:
    """Count per status; with ``total`` a rollup row (status null) carries the grand total."""
    if total:
        return df.rollup(status_col).agg(F.count(F.lit(1)).alias("n"))
    return df.groupBy(status_col).agg(F.count(F.lit(1)).alias("n"))


def lookup_by_key(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """Bulk point lookup: rows of ``df`` whose key is in ``keys`` (semi join; no fan-out)."""
    return df.join(keys, on, "left_semi")


def nested_children(children: DataFrame, parent_key: str, order_cols, fields, name: str,
                    descending: bool = False) -> DataFrame:
    """Children of each parent as one ordered array of structs (pre-aggregated before the parent join)."""
    key = F.struct(*[F.col(c) for c in order_cols])
    item = F.struct(key.alias("_o"), F.struct(*[F.col(c) for c in fields]).alias("v"))
    agg = children.groupBy(parent_key).agg(F.sort_array(F.collect_list(item), asc=not descending).alias("_l"))
    return agg.select(parent_key, F.transform("_l", lambda x: x["v"]).alias(name))
