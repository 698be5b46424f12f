"""Streaming operators.

* ``event_stream``       — file source over a table's own path, event time as TIMESTAMP (UTC).
* ``stream_dedupe``      — Spark's own dedupe: one row a key until the watermark passes it (never inside a batch).
* ``dedupe_batch``       — foreachBatch dedupe with a TTL: a key's row is kept 24 h or more after its last kept one.
* ``drift_batch``        — foreachBatch drift check: per-group state = its newest rows; one check a group and batch.
* ``stream_slot_counts`` — windowed drift counts: watermark + window + (model, feature, slot) counts, append.
* ``severity_changes``   — foreachBatch severity-change detector: per-model state = last severity.
* ``route_batch``        — foreachBatch retry / DLQ router: per-job state = attempts so far and whether it finished.
* ``score_split``        — foreachBatch scorer: scored rows to one table, rows with an error to a quarantine table.
* ``contract_split``     — foreachBatch writer: valid events to one table, violations to a quarantine table.

Stateful writers keep a bounded state per key beside their output (``runner.StreamState``: folders of the epochs,
snapshots, expiry); the source is replayable and every epoch overwrites its own folders and reads the state of
earlier ones only, so a lost executor or a restart resumes without loss or duplication.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.functions.drift import CRITICAL_THRESHOLD, MIN_SAMPLES, RECENT_WINDOW_SIZE, WARNING_THRESHOLD
from vigil.operators.drift import drift_analyze, recent_window, slot_rows
from vigil.operators.joins import BROADCAST_MAX_ROWS, attach
from vigil.operators.queue import dead_letters, route_attempts
from vigil.sources.manifest import is_folder
from vigil.sources.sinks import drift_checks, predictions_with_day, write_epoch
from vigil.sources.tables import read_table
from vigil.streaming.runner import SNAPSHOT_EVERY, StreamState, scratch_path, written

DEDUPE_TTL = "24 hours"
DAY_US = 24 * 3600 * 1_000_000
#: Keys with more distinct times in a batch are not gathered in a row: they are cut into chains, and those into spans.
HOT_TIMES = 10_000
#: How far a row may lie behind the latest kept one and still be judged; keys that no such row can meet expire.
LATENESS = 7 * DAY_US


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events", ts_col: str = "ts",
                 max_files: int | None = None) -> DataFrame:
    """Stream of a table's rows; ``ts`` (stored without zone) becomes a TIMESTAMP so watermarks apply."""
    schema = read_table(spark, sf_dir, table).schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    path = f"{sf_dir.rstrip('/')}/{table}.parquet"
    if is_folder(spark, path):
        s = reader.parquet(path)
    else:  # a stream reads folders: the file's own, and of that this file alone
        s = reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir.rstrip("/"))
    return s.withColumn(ts_col, F.col(ts_col).cast("timestamp")) if ts_col in schema.fieldNames() else s


def stream_dedupe(stream: DataFrame, key_cols, ts_col: str = "ts", ttl: str = DEDUPE_TTL) -> DataFrame:
    """Spark's dedupe within a watermark. A key does not expire inside a micro-batch; ``dedupe_batch`` applies the TTL."""
    return stream.withWatermark(ts_col, ttl).dropDuplicatesWithinWatermark(list(key_cols))


def _same(a: str, b: str, keys):
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return cond


def _kept_times(times: DataFrame, keys, ttl_us: int) -> DataFrame:
    """(keys, _u): the times that are kept of distinct ``times``: a key's first, then always the first one that is
    ``ttl_us`` or more after the last kept."""
    spark = times.sparkSession
    hot = written(times.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_TIMES).drop("_n"),
                  "dedupe-hot")
    n_hot = hot.count()
    side = F.broadcast(hot) if n_hot <= BROADCAST_MAX_ROWS else hot
    cold = times.alias("t").join(side.alias("h"), _same("t", "h", keys), "left_anti") if n_hot else times
    none = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<long>").alias("kept"))
    kept = cold.groupBy(*keys).agg(F.sort_array(F.collect_list("_u")).alias("_us")).select(*keys, F.explode(F.aggregate(
        "_us", none, lambda a, u: F.when(a["last"].isNull() | (u >= a["last"] + ttl_us), F.struct(
            u.alias("last"), F.concat(a["kept"], F.array(u)).alias("kept"))).otherwise(a), lambda a: a["kept"])).alias("_u"))
    if not n_hot:
        return kept
    # a time that lies a TTL or more after the one before it is kept whatever came earlier: chains begin there, and all
    # chains are taken side by side, span by span; at most one time of a chain is kept in a span of the TTL
    rows = times.alias("t").join(side.alias("h"), _same("t", "h", keys), "left_semi")
    rows = written(_chains(rows, keys, ttl_us).withColumn("_span", F.floor((F.col("_u") - F.col("_chain")) / F.lit(ttl_us))),
                   "dedupe-spans")
    spans = rows.agg(F.max("_span")).first()[0]
    by, last, path = [*keys, "_chain"], None, scratch_path(spark, "dedupe-kept")
    for span in range(spans + 1):  # as many steps as the longest chain has spans
        now = rows.where(F.col("_span") == span).drop("_span")
        if last is not None:
            before = last.withColumnRenamed("_u", "_last")
            now = now.alias("t").join(before.alias("l"), _same("t", "l", by), "left").where(
                F.col("_last").isNull() | (F.col("_u") >= F.col("_last") + ttl_us)).select("t.*")
        first = now.groupBy(*by).agg(F.min("_u").alias("_u"))
        first.write.parquet(f"{path}/step={span}")
        last = spark.read.schema(first.schema).parquet(f"{path}/step={span}")
    return kept.unionByName(spark.read.schema(first.schema).parquet(path).select(*keys, "_u"))


def _chains(times: DataFrame, keys, ttl_us: int) -> DataFrame:
    """``times`` with ``_chain``, the first time of their chain: it lies a TTL or more after the key's time before it.
    Such a gap can only end before the least time of a stretch of one TTL, so a key is ordered by its stretches alone."""
    times = times.withColumn("_part", F.floor(F.col("_u") / F.lit(ttl_us)))
    by = Window.partitionBy(*keys).orderBy("_part")
    parts = times.groupBy(*keys, "_part").agg(F.min("_u").alias("_lo"), F.max("_u").alias("_hi"))
    gap = F.lag("_hi").over(by).isNull() | (F.col("_lo") - F.lag("_hi").over(by) >= ttl_us)
    parts = parts.withColumn("_from", F.when(gap, F.col("_lo"))).withColumn("_chain", F.max("_from").over(by))
    return times.alias("t").join(parts.select(*keys, "_part", "_chain").alias("p"), _same("t", "p", [*keys, "_part"])).select(
        *[F.col(f"t.{k}") for k in keys], "t._u", "p._chain")


def dedupe_batch(key_cols, ts_col: str = "ts", ttl_us: int = DAY_US, lateness_us: int = LATENESS,
                 every: int = SNAPSHOT_EVERY):
    """foreachBatch writer: idempotency keys with a TTL, counted from a key's last kept row.

    A batch is taken in time order, whatever files or chunks it came in; of a key's rows at one time the least one
    counts. Kept rows go to ``<out>/data``, and each key's last kept time carries to the next batch. Rows that cannot be
    judged, without a time, a TTL or more before a last kept time of an earlier batch, or more than ``lateness_us`` before
    the latest time kept by earlier batches, go to ``<out>/aside``; keys whose TTL is over for every row that can still
    be judged leave the state at its next snapshot. Null is a key like any other. Columns must be orderable.
    """
    keys = list(key_cols)

    def live(state: DataFrame) -> DataFrame:
        clock = state.agg(F.max("_last").alias("_clock"))
        return attach(state, clock).where(F.col("_last") + ttl_us > F.col("_clock") - lateness_us).drop("_clock")

    def write(batch: DataFrame, epoch: int, out: str) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in [*keys, ts_col]]
        types = ", ".join(f"`{k}` {batch.schema[k].dataType.simpleString()}" for k in keys)
        state = StreamState(spark, out, keys, f"{types}, _last long", every, live)
        prior = state.before(epoch)
        clock = prior.agg(F.max("_last")).first()[0]
        now = batch.withColumn("_u", F.unix_micros(F.col(ts_col).cast("timestamp"))).alias("t").join(
            prior.alias("p"), _same("t", "p", keys), "left").select("t.*", "_last").persist()
        late = F.lit(False) if clock is None else F.col("_u") < clock - lateness_us
        aside = F.col("_u").isNull() | late | F.coalesce(F.col("_u") <= F.col("_last") - ttl_us, F.lit(False))
        now.where(aside).select(*batch.columns).write.mode("overwrite").parquet(f"{out}/aside/epoch={epoch}")
        new = now.where(F.col("_u").isNotNull() & ~late & (F.col("_last").isNull() | (F.col("_u") >= F.col("_last") + ttl_us)))
        times = _kept_times(new.select(*keys, "_u").distinct(), keys, ttl_us)
        first = new.groupBy(*keys, ts_col, "_u").agg(F.min(F.struct(F.lit(0).alias("_0"), *rest)).alias("_r"))
        kept = first.alias("f").join(times.alias("k"), _same("f", "k", [*keys, "_u"]), "left_semi")
        folder = f"{out}/data/epoch={epoch}"
        kept.select(*keys, ts_col, "_r.*").select(*batch.columns).write.mode("overwrite").parquet(folder)
        done = spark.read.schema(batch.schema).parquet(folder)
        state.write(done.groupBy(*keys).agg(F.max(F.unix_micros(F.col(ts_col).cast("timestamp"))).alias("_last")), epoch)
        now.unpersist()
    return write


def drift_batch(reference: DataFrame, group_cols, numeric=(), categorical=(), prob_col: str | None = "probability",
                n: int = RECENT_WINDOW_SIZE, min_samples: int = MIN_SAMPLES, warning: float = WARNING_THRESHOLD,
                critical: float = CRITICAL_THRESHOLD, ts_col: str = "created_at", id_col: str = "id",
                every: int = SNAPSHOT_EVERY):
    """foreachBatch writer: continuous drift. A batch is added to the log (``<out>/log``, never read here), and every
    group's newest ``n`` rows so far, which are the state, are checked against the reference; the checks go to
    ``<out>/checks`` (``sinks.drift_checks``). A batch costs its own rows plus the state's, ``n`` a group."""
    g = list(group_cols)

    def write(batch: DataFrame, epoch: int, out: str) -> None:
        spark = batch.sparkSession
        cols = list(dict.fromkeys([*g, id_col, ts_col, *numeric, *categorical, *([prob_col] if prob_col else [])]))
        now = batch.persist()
        write_epoch(predictions_with_day(now, ts_col), f"{out}/log", epoch)
        rows = now.select(*cols)
        state = StreamState(spark, out, g, rows.schema, every)
        newest = written(recent_window(state.before(epoch).unionByName(rows), g, n, ts_col, id_col), "drift-newest")
        touched = now.select(*g).distinct()
        state.write(newest.alias("t").join(touched.alias("h"), _same("t", "h", g), "left_semi"), epoch)
        summary, feats = drift_analyze(newest, reference, g, numeric, categorical, prob_col, None, min_samples, ts_col, id_col,
                                       warning, critical)
        at = newest.groupBy(*g).agg(F.max(ts_col).alias("checked_at"))
        checks = drift_checks(summary, feats, g, at, warning, critical)
        checks.write.mode("overwrite").parquet(f"{out}/checks/epoch={epoch}")
        now.unpersist()
    return write


def stream_slot_counts(stream: DataFrame, reference: DataFrame, group_cols, numeric=(), categorical=(),
                       prob_col: str | None = "probability", ts_col: str = "created_at", duration: str = "1 day",
                       watermark: str = "1 day") -> DataFrame:
    """(group, window_start, feature, slot) → n for closed windows (append mode). The reference is a static
    side joined by broadcast."""
    g = list(group_cols)
    s = stream.withWatermark(ts_col, watermark).withColumn("window_start", F.window(ts_col, duration).start)
    rows = slot_rows(s, reference, [*g, "window_start"], numeric, categorical, prob_col, ref_group_cols=g,
                     keep=[ts_col])
    return (rows.groupBy(F.window(ts_col, duration).alias("_w"), *g, "window_start", "feature", "_slot")
            .agg(F.count(F.lit(1)).alias("_n")).drop("_w"))


def severity_changes(checks: DataFrame, epoch: int, out: str) -> None:
    """foreachBatch writer: change events of a batch of checks (model_name, window_start, severity) go to ``<out>/data``.

    Rows are taken in window order, whatever files or chunks they came in; each model's last severity carries to the
    next batch, and a model's first check emits nothing.
    """
    now = checks.select("model_name", "window_start", "severity").persist()
    state = StreamState(now.sparkSession, out, ["model_name"], "model_name string, severity string")
    last = state.before(epoch).select(
        F.col("model_name").alias("_model"), F.col("severity").alias("_last"))
    by = Window.partitionBy("model_name").orderBy("window_start")
    lagged = now.join(last, F.col("model_name").eqNullSafe(F.col("_model")), "left").withColumn(
        "previous_severity", F.coalesce(F.lag("severity").over(by), F.col("_last")))
    lagged.where("previous_severity <> severity").select(
        "model_name", "window_start", "previous_severity", F.col("severity").alias("new_severity")) \
        .write.mode("overwrite").parquet(f"{out}/data/epoch={epoch}")
    state.write(now.groupBy("model_name").agg(F.max_by("severity", "window_start").alias("severity")), epoch)
    now.unpersist()


def _open_jobs(state: DataFrame) -> DataFrame:
    """Jobs that are not finished, and finished ones within the idempotency TTL and the lateness of the latest attempt."""
    clock = state.agg(F.max("last").alias("_clock"))
    keep = F.col("last") > F.col("_clock") - F.expr(f"make_dt_interval(0, 0, 0, {(DAY_US + LATENESS) // 1_000_000})")
    return attach(state, clock).where(~F.col("done") | keep).drop("_clock")


def route_batch(attempts: DataFrame, epoch: int, out: str) -> None:
    """foreachBatch writer: retry / DLQ router over delivery attempts (job_id, event_id, ts, ok).

    A batch is numbered and routed as a whole by ``queue.route_attempts``, so neither the order of its rows nor the
    size of a job matters; attempts so far and whether a job is finished carry to the next batch. Every attempt goes to
    ``<out>/data`` with its outcome and ``not_before``, dead letters also to ``<out>/dlq``.
    """
    spark = attempts.sparkSession
    now = attempts.select("job_id", "event_id", "ts", "ok")
    state = StreamState(spark, out, ["job_id"], "job_id string, attempts long, done boolean, last timestamp", expire=_open_jobs)
    prior = state.before(epoch).drop("last")
    folder = f"{out}/data/epoch={epoch}"
    route_attempts(now, prior=prior).drop("ok").write.mode("overwrite").parquet(folder)
    routed = spark.read.parquet(folder)
    dead_letters(routed).write.mode("overwrite").parquet(f"{out}/dlq/epoch={epoch}")
    # a batch in which a finished job has duplicates only says so, too: they follow no other outcome
    state.write(routed.groupBy("job_id").agg(F.max("attempt").alias("attempts"), F.max(
        F.col("outcome").isin("completed", "dlq", "skipped_duplicate")).alias("done"),
        F.max(F.col("ts").cast("timestamp")).alias("last")), epoch)


def score_split(model, key_cols, threshold: float, model_version: str):
    """foreachBatch writer: rows pass the scoring checks of ``train.predict_batch``; scored ones go to ``<out>/data``,
    those with an error to ``<out>/quarantine``, by epoch. Every row goes to one of them."""
    from vigil.operators.train import predict_batch
    keys, features = list(key_cols), [*model.numeric, *model.categorical]

    def write(batch: DataFrame, epoch: int, out: str) -> None:
        raw = F.create_map(*[x for c in features for x in (F.lit(c), F.col(f"`{c}`").cast("string"))])
        done = predict_batch(batch.select(F.struct(*keys).alias("_id"), raw.alias("_raw")), model, threshold,
                             model_version, "_id", "_raw").select("request_id.*", "probability", "predicted_class", "error")
        done = done.persist()
        done.where("error IS NULL").write.mode("overwrite").parquet(f"{out}/data/epoch={epoch}")
        done.where("error IS NOT NULL").write.mode("overwrite").parquet(f"{out}/quarantine/epoch={epoch}")
        done.unpersist()
    return write


def contract_split(validate):
    """foreachBatch writer: rows passing ``validate`` (which adds ``valid``) go to ``<out>/valid``, the rest with
    their violations to ``<out>/quarantine``. Writes are keyed by epoch, so a replayed batch overwrites itself."""
    def write(batch: DataFrame, epoch: int, out: str) -> None:
        checked = validate(batch).persist()
        checked.where("valid").drop("valid").write.mode("overwrite").parquet(f"{out}/valid/epoch={epoch}")
        checked.where("NOT valid").write.mode("overwrite").parquet(f"{out}/quarantine/epoch={epoch}")
        checked.unpersist()
    return write
