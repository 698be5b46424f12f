"""DuckDB SQL fragments shared by the oracles (the oracle side of each registered query)."""

from __future__ import annotations

from vigil.functions.drift import DECILE_LEVELS, PROBABILITY_EDGES


def dbl_list(xs) -> str:
    return "[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in xs) + "]"


DECILES_SQL = dbl_list(DECILE_LEVELS)
PROB_EDGES_SQL = dbl_list(PROBABILITY_EDGES)


def sql_bin(v: str, bins: str) -> str:
    """numpy histogram rule: [e_i, e_i+1), last bin closed; outside → NULL."""
    return (f"(CASE WHEN {v} IS NULL OR isnan({v}) OR len({bins}) < 2 THEN NULL "
            f"WHEN {v} < {bins}[1] OR {v} > {bins}[-1] THEN NULL "
            f"WHEN {v} = {bins}[-1] THEN len({bins}) - 2 "
            f"ELSE len(list_filter({bins}, lambda z: z <= {v})) - 1 END)")


def sql_sev(s: str, w: float = 0.10, c: float = 0.25) -> str:
    return f"(CASE WHEN {s} >= {c} THEN 'critical' WHEN {s} >= {w} THEN 'warning' ELSE 'normal' END)"


def sql_norm(arr: str, i: str) -> str:
    """i-th (0-based) share of a count list; uniform when the list sums to <= 0."""
    return (f"(CASE WHEN list_sum({arr}) <= 0 THEN 1.0 / len({arr}) "
            f"ELSE {arr}[{i} + 1]::DOUBLE / list_sum({arr}) END)")


def sql_psi(e: str, a: str) -> str:
    ce = f"greatest({sql_norm(e, 'i')}, 1e-6)"
    ca = f"greatest({sql_norm(a, 'i')}, 1e-6)"
    return f"list_sum(list_transform(range(len({e})), lambda i: ({ca} - {ce}) * ln({ca} / {ce})))"


def sql_chi(e: str, a: str) -> str:
    scale = f"greatest(list_sum({a})::DOUBLE, 1.0)"
    exp = f"({sql_norm(e, 'i')} * {scale} + 1e-6)"
    return f"list_sum(list_transform(range(len({e})), lambda i: pow(({a}[i + 1] + 1e-6) - {exp}, 2) / {exp}))"


def sql_lstr(x: str) -> str:
    """A list as a comma string (the Spark side uses ``array_join``)."""
    return f"array_to_string({x}, ',')"


# Prediction log stand-in over ``events`` and its two periods.
LOG_CTE = """
log AS (
  SELECT event_id AS id, event_type AS model_name, user_id % 10 AS segment, ts AS created_at, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CAST(user_id % 10 AS VARCHAR) AS user_segment, CAST(user_id AS VARCHAR) AS user_key,
         value / (value + 35.0) AS probability,
         CAST(value / (value + 35.0) >= 0.5 AS INTEGER) AS predicted_class,
         0.5 AS threshold
  FROM events),
ref AS (SELECT * FROM log WHERE created_at < TIMESTAMP '2024-01-21 00:00:00'),
rec_all AS (SELECT * FROM log WHERE created_at >= TIMESTAMP '2024-01-21 00:00:00')
"""


def reference_cte(g: str) -> str:
    """Reference dictionary ``ref_dict(g..., feature, kind, bins, categories, expected)`` grouped by ``g``."""
    return f"""
ref_num AS (
  SELECT {g}, 'value' AS feature, value AS v FROM ref
  UNION ALL SELECT {g}, 'k' AS feature, CAST(k AS DOUBLE) AS v FROM ref),
num_q AS (
  SELECT {g}, feature, min(v) AS mn, max(v) AS mx, quantile_cont(v, {DECILES_SQL}) AS q
  FROM ref_num WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY ALL),
num_edges AS (
  SELECT {g}, feature,
    CASE WHEN len(list_distinct(q)) >= 3 THEN list_sort(list_distinct(q))
         WHEN mn = mx THEN [mn - 0.5, mn + 0.5]
         ELSE list_transform(range(11), lambda i: CASE WHEN i = 10 THEN mx ELSE i * ((mx - mn) / 10) + mn END) END AS bins
  FROM num_q),
num_counts AS (
  SELECT {g}, feature, {sql_bin('r.v', 'e.bins')} AS b, count(*) AS n
  FROM ref_num r JOIN num_edges e USING ({g}, feature) GROUP BY ALL),
num_slots AS (SELECT {g}, feature, bins, unnest(range(len(bins) - 1)) AS b FROM num_edges),
num_ref AS (
  SELECT {g}, feature, 'numeric' AS kind, any_value(bins) AS bins, NULL::VARCHAR[] AS categories,
         list(coalesce(c.n, 0) ORDER BY b) AS expected
  FROM num_slots LEFT JOIN num_counts c USING ({g}, feature, b) GROUP BY ALL),
cat_counts AS (
  SELECT {g}, 'user_segment' AS feature, coalesce(user_segment, '__missing__') AS category, count(*) AS n
  FROM ref GROUP BY ALL),
cat_ref AS (
  SELECT {g}, feature, 'categorical' AS kind, NULL::DOUBLE[] AS bins,
         list(category ORDER BY n DESC, category) AS categories, list(n ORDER BY n DESC, category) AS expected
  FROM cat_counts GROUP BY ALL),
out_counts AS (
  SELECT {g}, {sql_bin('probability', PROB_EDGES_SQL)} AS b, count(*) AS n FROM ref GROUP BY ALL),
out_slots AS (SELECT DISTINCT {g}, unnest(range(10)) AS b FROM ref),
out_ref AS (
  SELECT {g}, '__output__' AS feature, 'output_probability' AS kind, {PROB_EDGES_SQL} AS bins,
         NULL::VARCHAR[] AS categories, list(coalesce(c.n, 0) ORDER BY b) AS expected
  FROM out_slots LEFT JOIN out_counts c USING ({g}, b) GROUP BY ALL),
ref_dict AS (SELECT * FROM num_ref UNION ALL SELECT * FROM cat_ref UNION ALL SELECT * FROM out_ref)
"""


def sql_chi2_tail(x: str, k: str, steps: int = 4000) -> str:
    """Upper tail of chi-square with ``k`` degrees of freedom: one less Simpson's rule over its density on [0, x]."""
    t = f"({x} * i / {steps})"
    density = (f"CASE WHEN i = 0 THEN 0.0 ELSE exp(({k} / 2.0 - 1) * ln({t}) - {t} / 2 - {k} / 2.0 * ln(2.0) "
               f"- lgamma({k} / 2.0)) END")
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return (f"(1 - {x} / {3 * steps} * list_sum(list_transform(range({steps} + 1), "
            f"lambda i: ({weight}) * ({density}))))")


def category_cte(features=("user_segment", "user_key")) -> str:
    """Whole recent period against the reference period by category: ``cmp`` (a row a category) and ``cat_feat``."""
    def counts(source, null):
        return " UNION ALL ".join(f"SELECT model_name, '{f}' AS feature, {null.format(f)} AS category, count(*) AS n "
                                  f"FROM {source} GROUP BY ALL" for f in features)
    return f"""
dict AS ({counts("ref", "coalesce({}, '__missing__')")}),
seen AS ({counts("rec_all", "{}")}),
cmp AS (
  SELECT coalesce(s.model_name, d.model_name) AS model_name, coalesce(s.feature, d.feature) AS feature,
         coalesce(s.category, d.category) AS category, coalesce(d.n, 0) AS reference_count,
         coalesce(s.n, 0) AS recent_count, d.n IS NOT NULL AS known
  FROM seen s FULL OUTER JOIN (SELECT * FROM dict WHERE model_name IN (SELECT model_name FROM rec_all)) d
    USING (model_name, feature, category)),
tot AS (
  SELECT model_name, feature, count(*) FILTER (WHERE known) AS k, sum(reference_count) AS e,
         sum(CASE WHEN known THEN recent_count ELSE 0 END) AS a,
         CAST(sum(CASE WHEN known THEN 0 ELSE recent_count END) AS BIGINT) AS unknown_count
  FROM cmp GROUP BY ALL),
term AS (
  SELECT model_name, feature, k, a, unknown_count, recent_count AS o, reference_count / e AS es,
         CASE WHEN a <= 0 THEN 1.0 / k ELSE recent_count / a END AS s
  FROM cmp JOIN tot USING (model_name, feature) WHERE known),
cat_feat AS (
  SELECT model_name, feature, any_value(k) AS n_categories, any_value(unknown_count) AS unknown_count,
         sum((greatest(s, 1e-6) - greatest(es, 1e-6)) * ln(greatest(s, 1e-6) / greatest(es, 1e-6))) AS score,
         sum(pow(o + 1e-6 - (es * greatest(a, 1) + 1e-6), 2) / (es * greatest(a, 1) + 1e-6)) AS chi
  FROM term GROUP BY ALL)
"""


def drift_cte(g: str, window: int | None = 200, min_samples: int = 30, rg: str | None = None,
              source: str = "rec_all") -> str:
    """Feature rows ``feat`` and per-group ``summary`` of the grouped drift check.

    ``g`` groups the recent rows; ``rg`` (default ``g``) keys the reference dictionary.
    """
    rg = rg or g
    if window is None:
        rec = f"rec AS (SELECT * FROM {source})"
    else:
        rec = (f"rec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {g} "
               f"ORDER BY created_at DESC, id DESC) AS rn FROM {source}) WHERE rn <= {window})")
    return f"""
{rec},
sizes AS (SELECT {g}, count(*) AS sample_size FROM rec GROUP BY ALL),
rec_long AS (
  SELECT {g}, 'value' AS feature, value AS v, NULL::VARCHAR AS s FROM rec
  UNION ALL SELECT {g}, 'k', CAST(k AS DOUBLE), NULL FROM rec
  UNION ALL SELECT {g}, 'user_segment', NULL, user_segment FROM rec
  UNION ALL SELECT {g}, '__output__', probability, NULL FROM rec),
rec_slots AS (
  SELECT {g}, feature,
    CASE WHEN d.kind = 'categorical' THEN
           (CASE WHEN r.s IS NULL THEN -1 ELSE coalesce(list_position(d.categories, r.s), 0) - 1 END)
         ELSE {sql_bin('r.v', 'd.bins')} END AS slot
  FROM rec_long r JOIN ref_dict d USING ({rg}, feature)),
slot_counts AS (SELECT {g}, feature, slot, count(*) AS n FROM rec_slots GROUP BY ALL),
unknowns AS (SELECT {g}, feature, sum(CASE WHEN slot = -1 THEN n ELSE 0 END) AS unknown_count
             FROM slot_counts GROUP BY ALL),
enough AS (SELECT {g} FROM sizes WHERE sample_size >= {min_samples}),
ref_g AS (SELECT {g}, feature, d.kind, d.expected FROM ref_dict d JOIN enough USING ({rg})),
act_slots AS (SELECT {g}, feature, unnest(range(len(expected))) AS slot FROM ref_g),
act AS (
  SELECT {g}, feature, list(coalesce(c.n, 0) ORDER BY slot) AS actual
  FROM act_slots LEFT JOIN slot_counts c USING ({g}, feature, slot) GROUP BY ALL),
feat_all AS (
  SELECT {g}, feature, x.kind, x.expected, a.actual, u.unknown_count,
         {sql_psi('x.expected', 'a.actual')} AS score
  FROM ref_g x JOIN act a USING ({g}, feature) LEFT JOIN unknowns u USING ({g}, feature)),
feat AS (SELECT f.*, {sql_sev('score')} AS severity FROM feat_all f),
best AS (
  SELECT {g}, max(score) AS mx,
         count(*) FILTER (WHERE feature <> '__output__') AS n_features,
         count(*) FILTER (WHERE feature <> '__output__' AND severity IN ('warning', 'critical')) AS n_drifted
  FROM feat GROUP BY ALL),
summary AS (
  SELECT {g}, s.sample_size, {min_samples} AS min_required_samples,
    CASE WHEN s.sample_size < {min_samples} THEN 'insufficient_data'
         ELSE {sql_sev('greatest(coalesce(b.mx, 0.0), 0.0)')} END AS severity,
    CASE WHEN s.sample_size < {min_samples} THEN 0.0 ELSE greatest(coalesce(b.mx, 0.0), 0.0) END AS overall_score,
    CASE WHEN s.sample_size < {min_samples} THEN 0 ELSE coalesce(b.n_features, 0) END AS n_features,
    CASE WHEN s.sample_size < {min_samples} THEN 0 ELSE coalesce(b.n_drifted, 0) END AS n_drifted
  FROM sizes s LEFT JOIN best b USING ({g}))
"""


WINDOWED_SRC = "(SELECT *, time_bucket(INTERVAL '1 day', created_at) AS window_start FROM log)"


def checks_cte() -> str:
    """Daily drift checks per model over the whole log: ``summary`` plus ``checks`` with ids and order."""
    return (f"{LOG_CTE}, {reference_cte('model_name')}, "
            f"{drift_cte('model_name, window_start', None, 30, 'model_name', WINDOWED_SRC)}, "
            "checks AS (SELECT *, model_name || '_' || strftime(window_start, '%Y%m%d%H%M%S') AS check_id, "
            "strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_label FROM summary)")


def events_cte() -> str:
    """Drift events (severity changes of the daily checks) with drifted features and output severity."""
    return checks_cte() + """,
ev0 AS (
  SELECT *, lag(severity) OVER (PARTITION BY model_name ORDER BY window_start) AS previous_severity
  FROM checks),
ev AS (
  SELECT 'drift_check_' || c.check_id || '_severity_changed' AS event_id, c.model_name, NULL::VARCHAR AS model_version,
         c.previous_severity, c.severity AS new_severity, c.overall_score, c.sample_size, c.window_start,
         coalesce((SELECT string_agg(f.feature, ', ' ORDER BY f.feature) FROM feat f
                   WHERE f.model_name = c.model_name AND f.window_start = c.window_start
                     AND f.feature <> '__output__' AND f.severity IN ('warning', 'critical')), '') AS drifted,
         (SELECT any_value(f.severity) FROM feat f WHERE f.model_name = c.model_name
            AND f.window_start = c.window_start AND f.feature = '__output__') AS output_drift_severity
  FROM ev0 c WHERE c.previous_severity IS NOT NULL AND c.previous_severity <> c.severity),
tri AS (
  SELECT *, 'inv_' || substr(sha256(event_id), 1, 12) AS investigation_id,
    CASE new_severity WHEN 'critical' THEN 'high' WHEN 'warning' THEN 'medium'
         WHEN 'insufficient_data' THEN 'unknown' ELSE 'low' END AS risk_level,
    CASE WHEN drifted <> '' AND output_drift_severity IN ('warning', 'critical') THEN 'feature_and_output_drift'
         WHEN drifted <> '' THEN 'feature_drift'
         WHEN output_drift_severity IN ('warning', 'critical') THEN 'output_drift'
         ELSE 'no_strong_drift_signal' END AS primary_issue
  FROM ev),
route AS (
  SELECT *,
    CASE WHEN new_severity = 'insufficient_data' THEN 'monitor'
         WHEN new_severity = 'normal' AND previous_severity IS NOT NULL AND previous_severity <> 'normal' THEN 'resolve'
         WHEN new_severity = 'normal' THEN 'monitor'
         WHEN new_severity = 'warning' THEN 'replay_test'
         WHEN new_severity = 'critical' AND (previous_severity = 'warning' OR output_drift_severity = 'critical')
           THEN 'rollback_production'
         WHEN new_severity = 'critical' THEN 'retrain' ELSE 'monitor' END AS recommended_action
  FROM tri),
act2 AS (
  SELECT *, recommended_action IN ('rollback_production', 'retrain') AS production_action_required,
         recommended_action = 'replay_test' AS queue_job_required,
         CASE recommended_action WHEN 'rollback_production' THEN 'production' WHEN 'retrain' THEN 'candidate' END
           AS target_environment
  FROM route)
"""
