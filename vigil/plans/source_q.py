"""Source queries: data derived from the tables is written in the artifact formats, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.operators import ml as M
from vigil.operators import stats as S
from vigil.plans.registry import query, r6
from vigil.plans.sqlparts import LOG_CTE, events_cte, reference_cte
from vigil.sources import files as FS
from vigil.sources.standins import (LOG_CATEGORICAL, LOG_NUMERIC, TRAIN_KEY, prediction_log, reference_rows,
                                    training_frame)
from vigil.sources.tables import read_table
from vigil.streaming.runner import run_to_table, scratch_path

TRAINING_SCHEMA = T.StructType([
    T.StructField("l_quantity", T.DoubleType()), T.StructField("l_extendedprice", T.DoubleType()),
    T.StructField("l_discount", T.DoubleType()), T.StructField("l_tax", T.DoubleType()),
    T.StructField("l_linestatus", T.StringType()), T.StructField("duration", T.DoubleType()),
    T.StructField("y", T.StringType())])


@query("read_training", sql="""SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus,
  l_extendedprice / l_quantity AS duration, CASE WHEN l_returnflag = 'R' THEN 'yes' ELSE 'no' END AS y FROM lineitem""")
def read_training(spark, sf_dir):
    """lineitem written as a ';' delimited file with a header, read back with the training reader."""
    li = read_table(spark, sf_dir, "lineitem")
    path = scratch_path(spark, "training-csv")
    li.select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus",
              (F.col("l_extendedprice") / F.col("l_quantity")).alias("duration"),
              F.when(F.col("l_returnflag") == "R", "yes").otherwise("no").alias("y")) \
        .write.option("header", True).option("sep", ";").csv(path)
    return FS.read_training(spark, path, "y", TRAINING_SCHEMA)


REF_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()), T.StructField("feature", T.StringType()),
    T.StructField("kind", T.StringType()), T.StructField("bins", T.ArrayType(T.DoubleType())),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("reference_distribution", T.ArrayType(T.LongType())),
    T.StructField("mean", T.DoubleType()), T.StructField("std", T.DoubleType())])


@query("reference_stats", sql=f"""WITH {LOG_CTE}, {reference_cte('model_name')},
n AS (SELECT model_name, count(*) AS n_rows FROM ref GROUP BY ALL)
SELECT model_name, n_rows, count(*) AS n_features,
  string_agg(feature || ':' || kind || ':' || coalesce(array_to_string(categories, ','), '') || ':' ||
             array_to_string(expected, ','), ';' ORDER BY feature) AS signature
FROM ref_dict JOIN n USING (model_name) GROUP BY model_name, n_rows""")
def reference_stats(spark, sf_dir):
    """The whole reference document per model (features as a nested list plus the output histogram); compared
    through a per-model signature of every feature's kind, categories and distribution."""
    log = prediction_log(spark, sf_dir)
    ref = S.reference_stats(reference_rows(log), ["model_name"], LOG_NUMERIC, LOG_CATEGORICAL, "probability")
    doc = S.reference_document(ref, reference_rows(log), ["model_name"])
    sig = F.array_join(F.transform("features", lambda f: F.concat_ws(
        ":", f["feature"], f["kind"], F.coalesce(F.array_join(f["categories"], ","), F.lit("")),
        F.array_join(F.transform(f["reference_distribution"], lambda x: x.cast("string")), ","))), ";")
    return doc.select("model_name", "n_rows", F.size("features").cast("long").alias("n_features"),
                      sig.alias("signature"))


@query("read_reference", sql=f"WITH {LOG_CTE}, {reference_cte('model_name')} SELECT model_name, feature, kind, "
       "array_to_string(categories, ',') AS categories, array_to_string(expected, ',') AS reference_distribution "
       "FROM ref_dict")
def read_reference(spark, sf_dir):
    """Reference statistics written as JSON artifacts and read back with an explicit schema
    (a missing path reads as an empty table)."""
    log = prediction_log(spark, sf_dir)
    ref = S.reference_stats(reference_rows(log), ["model_name"], LOG_NUMERIC, LOG_CATEGORICAL, "probability")
    path = scratch_path(spark, "reference-json")
    ref.select(*[f.name for f in REF_SCHEMA.fields]).write.json(path)
    got = FS.read_json_artifact(spark, path, REF_SCHEMA, multi_line=False)
    missing = FS.read_json_artifact(spark, path + "-absent", REF_SCHEMA)
    both = got.unionByName(missing)
    return both.select("model_name", "feature", "kind", F.array_join("categories", ",").alias("categories"),
                       F.array_join(F.transform("reference_distribution", lambda x: x.cast("string")), ",")
                       .alias("reference_distribution"))


@query("fixture_rows", sql="""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  l_quantity * (1 - l_discount) / 50 AS score, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem),
h AS (SELECT *, ('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) || ':' ||
  CAST(l_partkey AS VARCHAR) || ':' || CAST(l_suppkey AS VARCHAR) || ':42'), 1, 15))::BIGINT AS h FROM t),
rk AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY h, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS r,
  count(*) OVER (PARTITION BY y) AS n FROM h),
sp AS (SELECT * FROM rk WHERE r > n - floor((n - floor(n * 6 / 10) + 1) / 2)),
c AS (SELECT count(*) FILTER (WHERE y = 1) AS P, count(*) FILTER (WHERE y = 0) AS N FROM sp),
q AS (SELECT least(N, 20 - least(P, 10)) AS qn, P FROM c),
r2 AS (SELECT sp.*, row_number() OVER (PARTITION BY y = 1 ORDER BY h, l_orderkey, l_linenumber, l_partkey, l_suppkey)
  AS rk2 FROM sp),
pick AS (SELECT * FROM r2, q WHERE (y = 1 AND rk2 <= least(q.P, 20 - q.qn)) OR (y <> 1 AND rk2 <= q.qn))
SELECT row_number() OVER (ORDER BY ('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || ':' ||
  CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR) || ':' || CAST(l_suppkey AS VARCHAR) || ':43'),
  1, 15))::BIGINT, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS row_index,
  round(score, 6) AS expected_probability, CAST(score >= 0.5 AS INTEGER) AS expected_prediction, y AS actual_class
FROM pick""")
def fixture_rows(spark, sf_dir):
    """Replay fixture built from the test split (20 rows), written as a wrapped JSON document, read back."""
    t = M.stratified_split(training_frame(spark, sf_dir), TRAIN_KEY, "y", seed=42)
    s = M.replay_sample(t.where(F.col("split") == "test"), TRAIN_KEY, "y", n=20, seed=42)
    # the sample is bounded (20 rows), so one document holds it
    doc = s.groupBy().agg(F.array_sort(F.collect_list(F.struct(
        "sample_order", F.create_map(F.lit("l_quantity"), F.col("l_quantity").cast("string"),
                                     F.lit("l_linestatus"), F.col("l_linestatus")).alias("row"),
        F.col("score").alias("p"), (F.col("score") >= 0.5).cast("int").alias("c"), F.col("y").alias("a"))),
        lambda a, b: a["sample_order"] - b["sample_order"]).alias("s"))
    fixture = doc.select(F.struct(
        F.lit("Small replay fixture from test set for prediction consistency checks.").alias("description"),
        F.lit(0.5).alias("selected_threshold"),
        F.transform("s", lambda x: x["row"]).alias("rows"),
        F.transform("s", lambda x: x["p"]).alias("expected_probabilities"),
        F.transform("s", lambda x: x["c"]).alias("expected_predictions"),
        F.transform("s", lambda x: x["a"]).alias("actual_classes")).alias("fixture"))
    path = scratch_path(spark, "fixture-json")
    fixture.coalesce(1).write.json(path)
    rows = FS.read_replay_fixture(spark, path)
    return rows.select("row_index", r6("expected_probability").alias("expected_probability"),
                       "expected_prediction", "actual_class")


EVENT_SCHEMA = T.StructType([
    T.StructField("contract_version", T.StringType()), T.StructField("event_type", T.StringType()),
    T.StructField("event_id", T.StringType()), T.StructField("model_name", T.StringType()),
    T.StructField("previous_severity", T.StringType()), T.StructField("new_severity", T.StringType()),
    T.StructField("overall_score", T.DoubleType()), T.StructField("sample_size", T.LongType())])


@query("drift_event_ingest", sql=f"WITH {events_cte()} SELECT CASE WHEN model_name = 'error' THEN NULL ELSE "
       "event_id END AS event_id, model_name = 'error' AS malformed FROM ev")
def drift_event_ingest(spark, sf_dir):
    """Drift events as JSON lines (events of model 'error' arrive cut short) ingested as a stream;
    malformed lines are kept and flagged, not lost."""
    from vigil.plans.decide_q import drift_event_table
    ev = drift_event_table(spark, sf_dir)
    line = F.when(F.col("model_name") == "error", F.substring("payload", 1, 40)).otherwise(F.col("payload"))
    src = scratch_path(spark, "events-jsonl")
    ev.select(line.alias("value")).write.text(src)
    out = run_to_table(FS.ingest_json_lines(FS.read_text_stream(spark, src), EVENT_SCHEMA), "event-ingest")
    got = spark.read.parquet(out + "/data")
    return got.select(F.col("parsed.event_id").alias("event_id"), "malformed")


ENVELOPE_SCHEMA = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("idempotency_key", T.StringType()),
    T.StructField("investigation_id", T.StringType()), T.StructField("job_type", T.StringType()),
    T.StructField("payload", T.MapType(T.StringType(), T.StringType())), T.StructField("attempts", T.IntegerType()),
    T.StructField("max_attempts", T.IntegerType()), T.StructField("queued_at", T.StringType())])


@query("job_envelope_ingest", sql="SELECT CASE WHEN value > 300 THEN NULL ELSE 'job_' || CAST(event_id AS VARCHAR) "
       "END AS job_id, CASE WHEN value > 300 THEN NULL ELSE 'retrain' END AS job_type, value > 300 AS malformed "
       "FROM events")
def job_envelope_ingest(spark, sf_dir):
    """Job envelopes (one per event) as JSON lines with some non-JSON lines, ingested as a stream."""
    ev = read_table(spark, sf_dir, "events")
    env = F.to_json(F.struct(
        F.concat(F.lit("job_"), F.col("event_id").cast("string")).alias("job_id"),
        F.concat(F.lit("retrain:inv_"), F.col("user_id").cast("string"), F.lit(":unknown")).alias("idempotency_key"),
        F.concat(F.lit("inv_"), F.col("user_id").cast("string")).alias("investigation_id"),
        F.lit("retrain").alias("job_type"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("payload"),
        F.lit(0).alias("attempts"), F.lit(3).alias("max_attempts"), F.col("ts").cast("string").alias("queued_at")))
    line = F.when(F.col("value") > 300, F.lit("not json")).otherwise(env)
    src = scratch_path(spark, "envelopes-jsonl")
    ev.select(line.alias("value")).write.text(src)
    out = run_to_table(FS.ingest_json_lines(FS.read_text_stream(spark, src), ENVELOPE_SCHEMA), "envelope-ingest")
    got = spark.read.parquet(out + "/data")
    return got.select(F.col("parsed.job_id").alias("job_id"), F.col("parsed.job_type").alias("job_type"), "malformed")
