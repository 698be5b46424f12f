"""Drift queries: profiles, learned bins, histograms, PSI, chi-square, grouped drift checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.drift import MIN_SAMPLES
from vigil.operators import categories as C
from vigil.operators import drift as D
from vigil.operators import stats as S
from vigil.plans.registry import query, r6
from vigil.plans import sqlparts
from vigil.plans.sqlparts import (LOG_CTE, drift_cte, reference_cte, sql_bin,
                                  sql_chi, sql_lstr)
from vigil.sources.standins import LOG_CATEGORICAL, LOG_NUMERIC, LOG_WIDE, prediction_log, recent_rows, reference_rows

G = ["model_name"]


def lstr(c):
    return F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",")


def _reference(spark, sf_dir, g=G):
    log = prediction_log(spark, sf_dir)
    return log, S.reference_stats(reference_rows(log), g, LOG_NUMERIC, LOG_CATEGORICAL, "probability")


def _drift(spark, sf_dir, g=G, window=200):
    log, ref = _reference(spark, sf_dir, g)
    return D.drift_analyze(recent_rows(log), ref, g, LOG_NUMERIC, LOG_CATEGORICAL, "probability", window=window)


@query("drift_analyze", sql=f"WITH {LOG_CTE}, {reference_cte('model_name')}, {drift_cte('model_name')} "
       "SELECT model_name, sample_size, min_required_samples, severity, round(overall_score, 6) AS overall_score, "
       "n_features, n_drifted FROM summary")
def drift_analyze(spark, sf_dir):
    """Flagship: per event type, newest 200 recent predictions against the reference period."""
    summary, _ = _drift(spark, sf_dir)
    return summary.select(*G, "sample_size", "min_required_samples", "severity", r6("overall_score").alias(
        "overall_score"), "n_features", "n_drifted")


_FEAT_SQL = ("SELECT {g}, feature, kind, round(score, 6) AS score, severity, "
             f"{sql_lstr('expected')} AS expected_distribution, {sql_lstr('actual')} AS actual_distribution, "
             "CASE WHEN kind = 'categorical' THEN coalesce(unknown_count, 0) END AS unknown_count FROM feat")


def _feat_out(feats, g):
    return feats.select(*g, "feature", "kind", r6("score").alias("score"), "severity",
                        lstr("expected_distribution").alias("expected_distribution"),
                        lstr("actual_distribution").alias("actual_distribution"), "unknown_count")


@query("feature_drift", sql=f"WITH {LOG_CTE}, {reference_cte('model_name')}, {drift_cte('model_name')} "
       + _FEAT_SQL.format(g="model_name"))
def feature_drift(spark, sf_dir):
    _, feats = _drift(spark, sf_dir)
    return _feat_out(feats, G)


@query("segment_drift", sql=f"WITH {LOG_CTE}, {reference_cte('model_name, segment')}, "
       f"{drift_cte('model_name, segment')} "
       "SELECT model_name, segment, sample_size, severity, round(overall_score, 6) AS overall_score, n_drifted "
       "FROM summary")
def segment_drift(spark, sf_dir):
    """Drift per (event type, user segment): 50 groups checked in one plan."""
    summary, _ = _drift(spark, sf_dir, ["model_name", "segment"])
    return summary.select("model_name", "segment", "sample_size", "severity", r6("overall_score").alias(
        "overall_score"), "n_drifted")


@query("period_drift", sql=f"WITH {LOG_CTE}, {reference_cte('model_name')}, {drift_cte('model_name', None)} "
       + _FEAT_SQL.format(g="model_name"))
def period_drift(spark, sf_dir):
    """Whole recent period against the whole reference period (no row window)."""
    log, ref = _reference(spark, sf_dir)
    _, feats = D.drift_analyze(recent_rows(log), ref, G, LOG_NUMERIC, LOG_CATEGORICAL, "probability", window=None)
    return _feat_out(feats, G)


@query("psi_numeric", sql=f"WITH {LOG_CTE}, {reference_cte('model_name')}, {drift_cte('model_name')} "
       "SELECT model_name, feature, round(score, 6) AS psi FROM feat WHERE kind = 'numeric'")
def psi_numeric(spark, sf_dir):
    _, feats = _drift(spark, sf_dir)
    return feats.where(F.col("kind") == "numeric").select(*G, "feature", r6("score").alias("psi"))


def _category_drift(spark, sf_dir, features=LOG_CATEGORICAL, window=200):
    """Categorical drift per model, from the reference's category rows; models with enough recent rows."""
    log = prediction_log(spark, sf_dir)
    recent = D.recent_window(recent_rows(log), G, window)
    enough = recent.groupBy(*G).agg(F.count("*").alias("n")).where(F.col("n") >= MIN_SAMPLES).select(*G)
    return C.category_drift(recent, C.category_dictionary(reference_rows(log), G, features), G, features, enough)


@query("psi_categorical", sql=f"WITH {LOG_CTE}, {reference_cte('model_name')}, {drift_cte('model_name')} "
       "SELECT model_name, feature, round(score, 6) AS psi, unknown_count FROM feat WHERE kind = 'categorical'")
def psi_categorical(spark, sf_dir):
    return _category_drift(spark, sf_dir).select(*G, "feature", r6("score").alias("psi"), "unknown_count")


@query("chi_square", sql=f"WITH {LOG_CTE}, {reference_cte('model_name')}, {drift_cte('model_name')} "
       f"SELECT model_name, feature, round({sql_chi('expected', 'actual')}, 6) AS chi_square_stat, "
       "len(expected) - 1 AS dof FROM feat WHERE kind = 'categorical'")
def chi_square(spark, sf_dir):
    return _category_drift(spark, sf_dir).select(*G, "feature", r6("chi_square_stat").alias("chi_square_stat"), "dof")


@query("numeric_profile", sql=f"""WITH {LOG_CTE},
ref_num AS (SELECT model_name, 'value' AS feature, value AS v FROM ref
            UNION ALL SELECT model_name, 'k', CAST(k AS DOUBLE) FROM ref)
SELECT model_name, feature, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max,
       round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.25), 6) AS q25,
       round(quantile_cont(v, 0.75), 6) AS q75, count(*) FILTER (WHERE v IS NULL) AS missing_count
FROM ref_num GROUP BY ALL""")
def numeric_profile(spark, sf_dir):
    _, ref = _reference(spark, sf_dir)
    return ref.where(F.col("kind") == "numeric").select(
        *G, "feature", r6("mean").alias("mean"), r6("std").alias("std"), "min", "max", r6("median").alias("median"),
        r6("q25").alias("q25"), r6("q75").alias("q75"), "missing_count")


@query("numeric_profile_approx", sql=f"""WITH {LOG_CTE},
ref_num AS (SELECT model_name, 'value' AS feature, value AS v FROM ref
            UNION ALL SELECT model_name, 'k', CAST(k AS DOUBLE) FROM ref)
SELECT model_name, feature, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max,
       count(*) FILTER (WHERE v IS NULL) AS missing_count, 14 AS n_quantiles, 14 AS n_within FROM ref_num GROUP BY ALL""")
def numeric_profile_approx(spark, sf_dir):
    """The profile with sketched quantiles: exact moments, and how many of the 14 quantiles (deciles, median, quartiles) lie
    within the stated rank error, counted against all rows."""
    rows = S.to_long(reference_rows(prediction_log(spark, sf_dir)), G, LOG_NUMERIC).select(*G, "feature", "num_value")
    prof = S.numeric_profile(rows, G, approx=True)
    levels = F.array(*[F.lit(float(p)) for p in S.PROFILE_LEVELS])
    quantiles = F.concat("bins", F.array("median", "q25", "q75"))
    asked = prof.where(F.size("bins") == 11).select(*G, "feature", "n_valid", F.explode(
        F.arrays_zip(quantiles.alias("q"), levels.alias("p"))).alias("x")).select(*G, "feature", "n_valid", "x.*")
    asked = asked.withColumn("i", F.monotonically_increasing_id())
    counted = rows.join(F.broadcast(asked), [*G, "feature"]).groupBy(*G, "feature", "i", "p", "n_valid").agg(
        F.count_if(F.col("num_value") < F.col("q")).alias("lt"), F.count_if(F.col("num_value") <= F.col("q")).alias("le"))
    error = F.lit(S.kll_rank_error()) * F.col("n_valid")
    within = (F.col("lt") - error <= F.col("p") * F.col("n_valid")) & (F.col("p") * F.col("n_valid") <= F.col("le") + error)
    per = counted.groupBy(*G, "feature").agg(F.count("*").cast("int").alias("n_quantiles"), F.count_if(within).cast("int").alias("n_within"))
    return prof.join(per, [*G, "feature"]).select(
        *G, "feature", r6("mean").alias("mean"), r6("std").alias("std"), "min", "max", "missing_count", "n_quantiles", "n_within")


@query("quantile_bins", sql=f"""WITH {LOG_CTE}, {reference_cte('model_name')}
SELECT model_name, feature, i AS edge_index, round(bins[i + 1], 6) AS edge
FROM (SELECT model_name, feature, bins, unnest(range(len(bins))) AS i FROM num_edges)""")
def quantile_bins(spark, sf_dir):
    _, ref = _reference(spark, sf_dir)
    return ref.where(F.col("kind") == "numeric").select(*G, "feature", F.posexplode("bins").alias(
        "edge_index", "edge")).select(*G, "feature", "edge_index", r6("edge").alias("edge"))


@query("reference_histogram", sql=f"""WITH {LOG_CTE}, {reference_cte('model_name')}
SELECT model_name, feature, {sql_lstr('expected')} AS reference_distribution FROM num_ref""")
def reference_histogram(spark, sf_dir):
    _, ref = _reference(spark, sf_dir)
    return ref.where(F.col("kind") == "numeric").select(*G, "feature", lstr("reference_distribution").alias(
        "reference_distribution"))


@query("recent_histogram", sql=f"WITH {LOG_CTE}, {reference_cte('model_name')}, {drift_cte('model_name')} "
       f"SELECT model_name, feature, {sql_lstr('actual')} AS actual_distribution FROM feat WHERE kind = 'numeric'")
def recent_histogram(spark, sf_dir):
    _, feats = _drift(spark, sf_dir)
    return feats.where(F.col("kind") == "numeric").select(*G, "feature", lstr("actual_distribution").alias(
        "actual_distribution"))


@query("probability_histogram", sql=f"""WITH {LOG_CTE}, {reference_cte('model_name')}
SELECT model_name, {sql_lstr('expected')} AS reference_distribution FROM out_ref""")
def probability_histogram(spark, sf_dir):
    log = prediction_log(spark, sf_dir)
    h = S.probability_histogram(reference_rows(log), G, "probability")
    return h.select(*G, lstr("reference_distribution").alias("reference_distribution"))


@query("categorical_profile", sql=f"""WITH {LOG_CTE}, {reference_cte('model_name')}
SELECT c.model_name, c.feature, array_to_string(c.categories, ',') AS categories,
       {sql_lstr('c.expected')} AS reference_distribution,
       (SELECT count(*) FROM ref r WHERE r.model_name = c.model_name AND r.user_segment IS NULL) AS missing_count,
       len(c.categories) AS n_unique
FROM cat_ref c""")
def categorical_profile(spark, sf_dir):
    _, ref = _reference(spark, sf_dir)
    return ref.where(F.col("kind") == "categorical").select(
        *G, "feature", F.array_join("categories", ",").alias("categories"),
        lstr("reference_distribution").alias("reference_distribution"), "missing_count",
        F.col("n_unique").cast("long").alias("n_unique"))


@query("class_distribution", sql=f"""WITH {LOG_CTE}
SELECT model_name, predicted_class AS class, count(*) AS n FROM ref GROUP BY ALL""")
def class_distribution(spark, sf_dir):
    log = prediction_log(spark, sf_dir)
    return S.class_distribution(reference_rows(log), G)


def _bins(spark, sf_dir, features):
    """(id, feature, bin) of the recent rows' numeric features."""
    from vigil.functions.drift import bin_index
    from vigil.operators.joins import join_small
    log, ref = _reference(spark, sf_dir)
    edges = ref.where(F.col("feature").isin(*features) & (F.col("kind") == "numeric")).select(*G, "feature", "bins")
    rows = recent_rows(log).select("id", *G, F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("_v")) for f in features])))
    return join_small(rows, edges, [*G, "feature"]).select("id", "feature", bin_index("_v", "bins").alias("bin"))


@query("bin_assign", sql=f"""WITH {LOG_CTE}, {reference_cte('model_name')}
SELECT r.id, {sql_bin('r.value', 'e.bins')} AS bin
FROM rec_all r JOIN num_edges e ON e.model_name = r.model_name AND e.feature = 'value'""")
def bin_assign(spark, sf_dir):
    """Every recent ``value`` placed in its learned bin (null = outside the reference range); ``bin_assign_all`` has
    all numeric features."""
    return _bins(spark, sf_dir, ["value"]).select("id", "bin")


@query("bin_assign_all", sql=f"""WITH {LOG_CTE}, {reference_cte('model_name')},
long AS (SELECT id, model_name, 'value' AS feature, value AS v FROM rec_all
         UNION ALL SELECT id, model_name, 'k', CAST(k AS DOUBLE) FROM rec_all)
SELECT r.id, r.feature, {sql_bin('r.v', 'e.bins')} AS bin
FROM long r JOIN num_edges e ON e.model_name = r.model_name AND e.feature = r.feature""")
def bin_assign_all(spark, sf_dir):
    """Every recent value of every numeric feature placed in its learned bin (null = outside the reference range)."""
    return _bins(spark, sf_dir, LOG_NUMERIC)


@query("category_counts", sql=f"WITH {LOG_CTE}, {reference_cte('model_name')}, {drift_cte('model_name', None)} "
       "SELECT model_name, feature, array_to_string(d.categories, ',') AS categories, "
       f"{sql_lstr('actual')} AS actual_distribution, unknown_count "
       "FROM feat JOIN ref_dict d USING (model_name, feature) WHERE feat.kind = 'categorical'")
def category_counts(spark, sf_dir):
    """Recent counts over the reference categories, zero-filled, plus the unknown count; listed per feature by frequency."""
    log = prediction_log(spark, sf_dir)
    recent = recent_rows(log)
    enough = recent.groupBy(*G).agg(F.count("*").alias("n")).where(F.col("n") >= MIN_SAMPLES).select(*G)
    rows = C.compare_categories(C.recent_category_counts(recent, G, LOG_CATEGORICAL),
                                C.category_dictionary(reference_rows(log), G, LOG_CATEGORICAL), enough, G)
    known = F.struct((-F.col("reference_count")).alias("n"), "category", "recent_count")
    lists = rows.groupBy(*G, "feature").agg(
        F.array_sort(F.collect_list(F.when(F.col("known"), known))).alias("x"),
        F.sum(F.when(~F.col("known"), F.col("recent_count")).otherwise(0)).alias("unknown_count"))
    return lists.select(*G, "feature", F.array_join("x.category", ",").alias("categories"),
                        lstr("x.recent_count").alias("actual_distribution"), "unknown_count")


@query("category_rows", sql=f"WITH {LOG_CTE}, {sqlparts.category_cte()} "
       "SELECT model_name, feature, category, reference_count, recent_count, known FROM cmp")
def category_rows(spark, sf_dir):
    """The category dictionary as rows against the whole recent period, for a narrow and a wide feature (every user)."""
    log = prediction_log(spark, sf_dir)
    recent, features = recent_rows(log), [*LOG_CATEGORICAL, *LOG_WIDE]
    return C.compare_categories(C.recent_category_counts(recent, G, features),
                                C.category_dictionary(reference_rows(log), G, features), recent.select(*G).distinct(), G)


@query("category_drift", sql=f"WITH {LOG_CTE}, {sqlparts.category_cte()} "
       "SELECT model_name, feature, n_categories, round(score, 6) AS score, "
       f"{sqlparts.sql_sev('score')} AS severity, unknown_count, round(chi, 6) AS chi_square_stat, "
       f"CAST(n_categories - 1 AS INTEGER) AS dof, round({sqlparts.sql_chi2_tail('chi', '(n_categories - 1)')}, 6) + 0.0 "
       "AS chi_square_p_value FROM cat_feat")
def category_drift(spark, sf_dir):
    """PSI, chi-square and its p-value per model for a narrow and a wide feature, whole recent period."""
    return _category_drift(spark, sf_dir, [*LOG_CATEGORICAL, *LOG_WIDE], None).select(
        *G, "feature", "n_categories", r6("score").alias("score"), "severity", "unknown_count",
        r6("chi_square_stat").alias("chi_square_stat"), "dof", r6("chi_square_p_value").alias("chi_square_p_value"))


@query("recent_per_model", sql=f"""WITH {LOG_CTE}
SELECT model_name, id, round(probability, 6) AS probability FROM (
  SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY created_at DESC, id DESC) AS rn FROM log)
WHERE rn <= 200""")
def recent_per_model(spark, sf_dir):
    log = prediction_log(spark, sf_dir)
    return D.recent_window(log, G, 200).select(*G, "id", r6("probability").alias("probability"))


@query("recent_predictions", sql=f"""WITH {LOG_CTE}
SELECT id, model_name, round(probability, 6) AS probability FROM log ORDER BY created_at DESC, id DESC LIMIT 200""")
def recent_predictions(spark, sf_dir):
    """Newest 200 rows of the whole log (TakeOrderedAndProject)."""
    log = prediction_log(spark, sf_dir)
    return D.recent_window(log, [], 200).select("id", *G, r6("probability").alias("probability"))


# ---- daily checks over the whole log: windows, changes, events, reports --------------------------------------

def checks(spark, sf_dir):
    """Daily drift checks per model (every row of each day) against the model's reference period."""
    log, ref = _reference(spark, sf_dir)
    summary, feats = D.windowed_drift(log, ref, G, LOG_NUMERIC, LOG_CATEGORICAL, "probability", "1 day")
    label = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")
    cid = F.concat_ws("_", "model_name", F.date_format("window_start", "yyyyMMddHHmmss"))
    # checks are small (models x windows): written once, so the event / triage / gate plans start from them
    from vigil.operators.joins import cut_lineage
    return (cut_lineage(summary.withColumn("check_id", cid).withColumn("window_label", label)),
            cut_lineage(feats.withColumn("check_id", cid)))


@query("windowed_drift", sql=f"WITH {sqlparts.checks_cte()} SELECT model_name, window_label, sample_size, severity, "
       "round(overall_score, 6) AS overall_score, n_drifted FROM checks")
def windowed_drift(spark, sf_dir):
    summary, _ = checks(spark, sf_dir)
    return summary.select(*G, "window_label", "sample_size", "severity", r6("overall_score").alias("overall_score"),
                          "n_drifted")


@query("severity_changes", sql=f"WITH {sqlparts.checks_cte()} SELECT model_name, window_label, previous_severity, "
       "new_severity FROM (SELECT *, lag(severity) OVER (PARTITION BY model_name ORDER BY window_start) "
       "AS previous_severity, severity AS new_severity FROM checks) "
       "WHERE previous_severity IS NOT NULL AND previous_severity <> new_severity")
def severity_changes(spark, sf_dir):
    summary, _ = checks(spark, sf_dir)
    return D.severity_changes(summary, G, ["window_start"]).select(*G, "window_label", "previous_severity",
                                                                  "new_severity")


@query("latest_check", sql=f"WITH {sqlparts.checks_cte()} SELECT model_name, check_id, severity, "
       "round(overall_score, 6) AS overall_score FROM checks "
       "QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY window_start DESC) = 1")
def latest_check(spark, sf_dir):
    summary, _ = checks(spark, sf_dir)
    return D.latest_per_group(summary, G, ["window_start"]).select(
        *G, "check_id", "severity", r6("overall_score").alias("overall_score"))


@query("severity_events", sql=f"WITH {sqlparts.checks_cte()} SELECT 'drift_check_' || check_id || "
       "'_severity_changed' AS event_id, 'drift.severity_changed' AS event_type, 'v1' AS contract_version, "
       "model_name, previous_severity, new_severity, round(overall_score, 6) AS overall_score, sample_size, "
       "min_required_samples, previous_check_id AS previous_drift_check_id FROM ("
       "SELECT *, lag(severity) OVER (PARTITION BY model_name ORDER BY window_start) AS previous_severity, "
       "severity AS new_severity, lag(check_id) OVER (PARTITION BY model_name ORDER BY window_start) "
       "AS previous_check_id FROM checks) WHERE previous_severity IS NOT NULL AND previous_severity <> new_severity")
def severity_events(spark, sf_dir):
    from vigil.operators.events import drift_events
    summary, feats = checks(spark, sf_dir)
    ev = drift_events(summary, feats, G, ["window_start"])
    return ev.select("event_id", "event_type", "contract_version", "model_name", "previous_severity",
                     "new_severity", r6("overall_score").alias("overall_score"), "sample_size",
                     "min_required_samples", F.col("metadata")["previous_drift_check_id"].alias(
                         "previous_drift_check_id"))


@query("drift_report_rows", sql=f"WITH {sqlparts.checks_cte()} SELECT c.check_id, f.feature, f.kind, "
       "round(f.score, 6) AS score, f.severity, '' AS reason FROM checks c LEFT JOIN (SELECT * FROM feat "
       "WHERE feature <> '__output__') f USING (model_name, window_start)")
def drift_report_rows(spark, sf_dir):
    from vigil.operators.events import report_rows
    summary, feats = checks(spark, sf_dir)
    rep = D.drift_report(summary, feats, [*G, "window_start", "check_id"])
    return report_rows(rep, ["check_id"]).select("check_id", "feature", "kind", r6("score").alias("score"),
                                                 "severity", "reason")


# The stored reference of one model has lost the bins of a feature, that of another its categories.
_LOST = {"error": "k", "click": "user_segment"}


@query("drift_report_reasons", sql=f"WITH {LOG_CTE}, {reference_cte('model_name')}, {drift_cte('model_name', None)} "
       "SELECT model_name, feature, kind, CASE WHEN lost THEN 0.0 ELSE round(score, 6) END AS score, "
       "CASE WHEN lost THEN 'unknown' ELSE severity END AS severity, CASE WHEN lost AND kind = 'numeric' THEN "
       f"'{D.NO_BINS}' WHEN lost THEN '{D.NO_CATEGORIES}' ELSE '' END AS reason, "
       f"CASE WHEN NOT lost THEN {sql_lstr('expected')} END AS expected "
       "FROM (SELECT *, " + " OR ".join(f"(model_name = '{m}' AND feature = '{f}')" for m, f in _LOST.items())
       + " AS lost FROM feat WHERE feature <> '__output__')")
def drift_report_reasons(spark, sf_dir):
    """Report rows of a reference that lacks bins or categories: score 0, severity unknown, and the reason in the details."""
    from vigil.operators.events import report_rows
    log, ref = _reference(spark, sf_dir)
    lost = F.coalesce(F.create_map(*[F.lit(x) for kv in _LOST.items() for x in kv])[F.col("model_name")] == F.col("feature"),
                      F.lit(False))
    for c in ("bins", "categories", "reference_distribution"):
        ref = ref.withColumn(c, F.when(~lost, F.col(c)))
    summary, feats = D.drift_analyze(recent_rows(log), ref, G, LOG_NUMERIC, LOG_CATEGORICAL, "probability", window=None)
    rows = report_rows(D.drift_report(summary, feats, G), G, details=("expected_distribution",))
    expected = F.array_join(F.from_json("expected_distribution", "array<bigint>"), ",")
    return rows.select(*G, "feature", "kind", r6("score").alias("score"), "severity", "reason", expected.alias("expected"))


@query("drifted_features", sql=f"WITH {sqlparts.checks_cte()} SELECT c.check_id, coalesce((SELECT string_agg("
       "f.feature, ',' ORDER BY f.feature) FROM feat f WHERE f.model_name = c.model_name AND f.window_start = "
       "c.window_start AND f.feature <> '__output__' AND f.severity IN ('warning', 'critical')), '') AS drifted "
       "FROM checks c")
def drifted_features(spark, sf_dir):
    from vigil.operators.events import drifted_features as dfeat
    summary, feats = checks(spark, sf_dir)
    rep = D.drift_report(summary, feats, [*G, "window_start", "check_id"])
    return rep.select("check_id", F.array_join(dfeat(F.col("drift_report")), ",").alias("drifted"))
