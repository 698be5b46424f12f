"""Job attempts: numbering, retry schedule, DLQ routing, overlap (lock) detection, queue depth.

Attempt numbers come from ``running_totals`` (exact rank within a job, range
split when a job is huge), never from a window that sorts a whole key in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.ordered import running_totals

# Fixed values of the worker: attempts before the dead-letter queue, base delay, lock lifetime.
MAX_ATTEMPTS = 3
BASE_DELAY_SECONDS = 2
LOCK_TTL_MINUTES = 30
DLQ_REASON = "max attempts reached"


def backoff_seconds(attempt) -> F.Column:
    """base * 2^(max(n-1, 0))."""
    n = F.col(attempt) if isinstance(attempt, str) else attempt
    return (F.lit(BASE_DELAY_SECONDS) * F.pow(F.lit(2), F.greatest(n - 1, F.lit(0)))).cast("long")


def number_attempts(attempts: DataFrame, key: str = "job_id", ts_col: str = "ts", tiebreak=("event_id",)) -> DataFrame:
    """Adds ``attempt`` (1-based, by time then tiebreak) within each key."""
    one = attempts.withColumn("_one", F.lit(1))
    ranked = running_totals(one, [key], ts_col, ["_one"], tiebreak_cols=list(tiebreak))
    return ranked.withColumnRenamed("_one_cum", "attempt").drop("_one", "_one_total")


def route_attempts(attempts: DataFrame, key: str = "job_id", ts_col: str = "ts", ok_col: str = "ok",
                   max_attempts: int = MAX_ATTEMPTS, prior: DataFrame | None = None) -> DataFrame:
    """Outcome of every attempt: retrying (with ``not_before``), completed, dlq, or skipped_duplicate.

    The first success ends the job; a failure on attempt ``max_attempts`` sends it to
    the DLQ; later deliveries of a finished job are duplicates. ``prior`` (key, attempts, done; one row a key)
    says what earlier batches left: numbers go on from ``attempts``, and a ``done`` job has duplicates only.
    """
    n = number_attempts(attempts, key, ts_col)
    done = F.lit(False)
    if prior is not None:
        before = prior.select(F.col(key).alias("_key"), F.col("attempts").alias("_before"), F.col("done").alias("_done"))
        n = n.join(before, n[key].eqNullSafe(before["_key"]), "left").drop("_key")
        n = n.withColumn("attempt", F.col("attempt") + F.coalesce("_before", F.lit(0)))
        done = F.coalesce("_done", F.lit(False))
    first_ok = n.groupBy(key).agg(F.min(F.when(F.col(ok_col), F.col("attempt"))).alias("_first_ok"))
    term = F.least(F.coalesce(F.col("_first_ok"), F.lit(max_attempts)), F.lit(max_attempts))
    a = F.col("attempt")
    first_ok = first_ok.withColumnRenamed(key, "_key")
    out = n.join(first_ok, n[key].eqNullSafe(first_ok["_key"])).drop("_key").withColumn(
        "_term", F.when(done, F.lit(0)).otherwise(term))
    outcome = (F.when(a < F.col("_term"), "retrying")
               .when((a == F.col("_term")) & F.col(ok_col), "completed")
               .when(a == F.col("_term"), "dlq").otherwise("skipped_duplicate"))
    return out.withColumn("outcome", outcome).withColumn(
        "delay_seconds", F.when(F.col("outcome") == "retrying", backoff_seconds(a))).withColumn(
        "not_before", F.when(F.col("outcome") == "retrying",
                             F.col(ts_col) + F.make_dt_interval(secs=F.col("delay_seconds").cast("decimal(18,6)")))
    ).drop("_first_ok", "_term", "_before", "_done")


def dead_letters(routed: DataFrame, key: str = "job_id", ts_col: str = "ts") -> DataFrame:
    """Rows of the dead-letter table: the job, its last attempt, the error and when it was given up."""
    return routed.where(F.col("outcome") == "dlq").select(
        key, "event_id", "attempt", F.concat(F.lit("attempt "), F.col("attempt").cast("string"), F.lit(" failed"))
        .alias("error_message"), F.lit(DLQ_REASON).alias("reason"), F.col(ts_col).alias("sent_to_dlq_at"))


def ledger_events(routed: DataFrame, key: str = "job_id", ts_col: str = "ts") -> DataFrame:
    """Job-ledger events of routed attempts: a ``running`` event then the outcome (duplicates only the outcome)."""
    a = F.col("attempt")
    running = routed.where(F.col("outcome") != "skipped_duplicate").select(
        key, F.col(ts_col).alias("ts"), (a * 2 - 1).alias("seq"), F.lit("running").alias("status"),
        a.alias("attempts"), F.lit(None).cast("string").alias("error_message"),
        F.lit(None).cast(routed.schema[ts_col].dataType).alias("next_retry_at"),
        F.lit(None).cast("string").alias("dlq_reason"))
    st = F.col("outcome")
    err = F.when(st.isin("retrying", "dlq"), F.concat(F.lit("attempt "), a.cast("string"), F.lit(" failed")))
    done = routed.select(
        key, F.col(ts_col).alias("ts"), (a * 2).alias("seq"), st.alias("status"),
        F.when(st != "skipped_duplicate", a).alias("attempts"), err.alias("error_message"),
        F.col("not_before").alias("next_retry_at"), F.when(st == "dlq", F.lit(DLQ_REASON)).alias("dlq_reason"))
    return running.unionByName(done)


def lag_by_rank(df: DataFrame, key: str, rank_col: str, cols) -> DataFrame:
    """``lag`` of ``cols`` within ``key`` by an existing dense rank, as an equi-join on (key, rank-1).

    The join is hashed on (key, rank), so a hot key spreads over all tasks.
    """
    prev = df.select(F.col(key).alias("_pk"), (F.col(rank_col) + 1).alias("_pr"), *[F.col(c).alias(f"prev_{c}") for c in cols])
    return df.join(prev, F.col(key).eqNullSafe(F.col("_pk")) & (F.col(rank_col) == F.col("_pr")), "left").drop("_pk", "_pr")


def overlapping_attempts(attempts: DataFrame, key: str = "user_id", ts_col: str = "ts", id_col: str = "event_id",
                         ttl_minutes: int = LOCK_TTL_MINUTES) -> DataFrame:
    """Attempts that start while another attempt of the same key holds its lock. An attempt that finds the lock free holds it
    for the TTL from its start (of equal starts the least id); one that is refused does not extend it. A null key is a
    key like any other; attempts without a time hold and find no lock."""
    from vigil.streaming.ops import _kept_times  # the same rule as the dedupe's: times kept a TTL apart
    timed = attempts.where(F.col(ts_col).isNotNull()).withColumn("_u", F.unix_micros(F.col(ts_col).cast("timestamp")))
    starts = _kept_times(timed.select(key, "_u").distinct(), [key], ttl_minutes * 60_000_000)
    holders = timed.alias("a").join(starts.alias("s"), F.col(f"a.{key}").eqNullSafe(F.col(f"s.{key}")) & (
        F.col("a._u") == F.col("s._u"))).groupBy(F.col(f"a.{key}").alias("_k"), F.col("a._u").alias("_h")).agg(
        F.min(f"a.{id_col}").alias("_id"))
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.col("_u") == F.col("_h")) & (F.col(id_col) == F.col("_id"))
    return timed.join(holders, same, "left_anti").drop("_u")


def queue_depth(state: DataFrame, status_col: str = "status") -> DataFrame:
    """pending (waiting to retry), processing (running) and dead-lettered jobs."""
    s = F.col(status_col)
    return state.agg(F.count_if(s == "retrying").alias("pending"), F.count_if(s == "running").alias("processing"),
                     F.count_if(s == "dlq").alias("dlq"), F.count(F.lit(1)).alias("total"))


# Fixed handler names per job type.
HANDLERS = {"replay_test": "replay_test_handler", "retrain": "retrain_handler", "rollback": "rollback_handler"}


def dispatch(jobs: DataFrame, type_col: str = "job_type") -> DataFrame:
    """Partition job rows by type into handlers; unknown types get an error instead of a handler."""
    t = F.col(type_col)
    handler = None
    for k, v in HANDLERS.items():
        handler = F.when(t == k, v) if handler is None else handler.when(t == k, v)
    return jobs.withColumn("handler", handler).withColumn(
        "error", F.when(~t.isin(*HANDLERS), F.concat(F.lit("Unsupported job type: "), t)))
