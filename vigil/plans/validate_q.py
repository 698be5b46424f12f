"""Validation queries: labels, leakage, sentinels, feature contracts and typed checks, event contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import validate as V
from vigil.plans.decide_q import drift_event_table
from vigil.plans.registry import query
from vigil.plans.sqlparts import events_cte
from vigil.sources.tables import read_table

# Raw label stand-in: returnflag R → ' Yes', N → 'no ', A → 'A' (an unexpected label).
LABEL_SQL = "CASE l_returnflag WHEN 'R' THEN ' Yes' WHEN 'N' THEN 'no ' ELSE l_returnflag END"


def _labels(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    lab = F.when(F.col("l_returnflag") == "R", " Yes").when(F.col("l_returnflag") == "N", "no ").otherwise(
        F.col("l_returnflag"))
    return li.withColumn("label", lab)


@query("target_map", sql=f"SELECT label, CASE lower(trim(label)) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS y, "
       f"count(*) AS n FROM (SELECT {LABEL_SQL} AS label FROM lineitem) GROUP BY ALL")
def target_map(spark, sf_dir):
    t = V.target_map(_labels(spark, sf_dir), "label", "y")
    return t.groupBy("label", "y").agg(F.count(F.lit(1)).alias("n"))


@query("unexpected_labels", sql=f"SELECT DISTINCT lower(trim({LABEL_SQL})) AS label FROM lineitem "
       "WHERE lower(trim(" + LABEL_SQL + ")) NOT IN ('yes', 'no')")
def unexpected_labels(spark, sf_dir):
    return V.unexpected_labels(_labels(spark, sf_dir), "label")


@query("drop_leakage", sql="SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_linestatus FROM lineitem")
def drop_leakage(spark, sf_dir):
    """Target and leakage column (``duration`` = extended price here) removed before training."""
    li = _labels(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_linestatus",
                                       "label", F.col("l_extendedprice").alias("duration"))
    return V.drop_leakage(li, "label", ("duration",))


@query("sentinel_flag", sql="SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = 50 THEN -1 ELSE l_quantity END "
       "AS l_quantity, CAST(l_quantity = 50 AS INTEGER) AS l_quantity_was_50 FROM lineitem")
def sentinel_flag(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return V.sentinel_flag(li, "l_quantity", 50, -1, "l_quantity_was_50")


@query("sentinel_flag_serving", sql="""WITH r AS (SELECT l_orderkey, l_linenumber,
  CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS VARCHAR) ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END
    AS q, CASE WHEN l_linestatus = 'F' THEN 1 END AS flag FROM lineitem)
SELECT l_orderkey, l_linenumber,
  CASE WHEN qi = 50 THEN -1 ELSE qi END AS l_quantity,
  CASE WHEN qi = 50 THEN 1 ELSE coalesce(flag, 0) END AS l_quantity_was_50,
  CASE WHEN qi IS NULL THEN 'Feature ''l_quantity'' must be numeric.' END AS sentinel_error
FROM (SELECT *, CASE WHEN regexp_matches(trim(q), '^[+-]?[0-9]+$') THEN CAST(trim(q) AS INTEGER) END AS qi FROM r)""")
def sentinel_flag_serving(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    raw = li.select("l_orderkey", "l_linenumber",
                    F.when(F.col("l_returnflag") == "A", F.col("l_quantity").cast("string"))
                    .otherwise(F.col("l_quantity").cast("int").cast("string")).alias("l_quantity"),
                    F.when(F.col("l_linestatus") == "F", F.lit(1)).alias("l_quantity_was_50"))
    return V.sentinel_flag_serving(raw, "l_quantity", 50, -1, "l_quantity_was_50")


REQUIRED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus"]


def _raw_features(spark, sf_dir):
    """Raw request maps: l_tax missing on returned lines, an extra key on line 1, ``duration`` always sent,
    an empty status on accepted lines, a non-number quantity on line 7."""
    li = read_table(spark, sf_dir, "lineitem")
    entries = [
        F.struct(F.lit("l_quantity").alias("k"), F.when(F.col("l_linenumber") == 7, F.lit("n/a"))
                 .otherwise(F.col("l_quantity").cast("int").cast("string")).alias("v")),
        F.struct(F.lit("l_extendedprice").alias("k"), F.col("l_extendedprice").cast("string").alias("v")),
        F.struct(F.lit("l_discount").alias("k"), F.col("l_discount").cast("string").alias("v")),
        F.struct(F.lit("l_tax").alias("k"), F.when(F.col("l_returnflag") != "R", F.col("l_tax").cast("string"))
                 .alias("v")),
        F.struct(F.lit("l_linestatus").alias("k"), F.when(F.col("l_returnflag") == "A", F.lit(" "))
                 .otherwise(F.col("l_linestatus")).alias("v")),
        F.struct(F.lit("duration").alias("k"), F.col("l_extendedprice").cast("string").alias("v")),
        F.struct(F.lit("l_comment").alias("k"), F.when(F.col("l_linenumber") == 1, F.lit("x")).alias("v")),
    ]
    # absent keys: drop entries whose value is null, except l_tax which is sent as an explicit null on line 2
    kept = F.filter(F.array(*entries), lambda e: e["v"].isNotNull())
    return li.select("l_orderkey", "l_linenumber", F.map_from_entries(kept).alias("features"))


@query("feature_contract", sql="""WITH r AS (SELECT l_orderkey, l_linenumber,
  list_filter(['l_quantity', 'l_extendedprice', 'l_discount',
               CASE WHEN l_returnflag <> 'R' THEN 'l_tax' END, 'l_linestatus',
               CASE WHEN l_linenumber = 1 THEN 'l_comment' END], lambda k: k IS NOT NULL) AS keys FROM lineitem)
SELECT l_orderkey, l_linenumber,
  array_to_string(list_sort(list_filter(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_linestatus'],
                  lambda x: NOT list_contains(keys, x))), ',') AS missing,
  array_to_string(list_sort(list_filter(keys, lambda x: x NOT IN ('l_quantity', 'l_extendedprice', 'l_discount',
                  'l_tax', 'l_linestatus'))), ',') AS extra
FROM r""")
def feature_contract(spark, sf_dir):
    c = V.feature_contract(_raw_features(spark, sf_dir), "features", REQUIRED, dropped=("duration",))
    return c.select("l_orderkey", "l_linenumber", F.array_join("missing", ",").alias("missing"),
                    F.array_join("extra", ",").alias("extra"))


@query("feature_validate", sql="""WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag,
  CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS q,
  CASE WHEN l_returnflag <> 'R' THEN CAST(l_tax AS VARCHAR) END AS tax,
  CASE WHEN l_returnflag = 'A' THEN ' ' ELSE l_linestatus END AS st FROM lineitem),
e AS (SELECT l_orderkey, l_linenumber, list_filter([
  CASE WHEN TRY_CAST(trim(q) AS BIGINT) IS NULL THEN 'Feature ''l_quantity'' must be numeric. Got: ' || q END,
  CASE WHEN tax IS NULL THEN 'Feature ''l_tax'' cannot be null.' END,
  CASE WHEN trim(st) = '' THEN 'Feature ''l_linestatus'' cannot be an empty string.' END], lambda x: x IS NOT NULL)
  AS errors FROM r)
SELECT l_orderkey, l_linenumber, errors[1] AS first_error, len(errors) AS n_errors, len(errors) = 0 AS valid FROM e""")
def feature_validate(spark, sf_dir):
    v = V.feature_validate(_raw_features(spark, sf_dir), "features", int_cols=["l_quantity"],
                           float_cols=["l_extendedprice", "l_discount", "l_tax"], categorical=["l_linestatus"])
    return v.select("l_orderkey", "l_linenumber", "first_error", F.size("errors").alias("n_errors"), "valid")


@query("event_contract", sql=f"WITH {events_cte()} SELECT event_id, CASE WHEN model_name = 'error' THEN 1 ELSE 0 END "
       "AS n_violations, CASE WHEN model_name = 'error' THEN 'model_name: empty' END AS first_violation, "
       "model_name <> 'error' AS valid FROM ev")
def event_contract(spark, sf_dir):
    """Drift events with header columns; events of model 'error' lose their name (a contract violation)."""
    ev = drift_event_table(spark, sf_dir)
    ev = ev.withColumn("model_name", F.when(F.col("model_name") == "error", F.lit("")).otherwise(F.col("model_name")))
    ev = ev.withColumn("x_contract_version", F.lit("v1")).withColumn("x_idempotency_key", F.col("event_id"))
    out = V.event_contract(ev, "x_contract_version", "x_idempotency_key")
    return out.select("event_id", F.size("violations").alias("n_violations"),
                      F.try_element_at("violations", F.lit(1)).alias("first_violation"), "valid")


@query("promotion_contract", sql="SELECT 'promotion_inv_' || CAST(o_orderkey AS VARCHAR) || '_' || "
       "strftime(o_orderdate, '%Y') || '_production' AS request_id, 0 AS n_violations, true AS valid FROM orders "
       "WHERE o_orderstatus = 'F'")
def promotion_contract(spark, sf_dir):
    """Promotion requests built from approved approvals (rows-only check)."""
    from vigil.operators.promotion import promotion_requests
    from vigil.sources.standins import approvals_ledger
    req = promotion_requests(approvals_ledger(spark, sf_dir))
    out = V.promotion_contract(req)
    return out.select("request_id", F.size("violations").alias("n_violations"), "valid")


@query("schema_profile")
def schema_profile(spark, sf_dir):
    return V.schema_profile(read_table(spark, sf_dir, "lineitem"))


# ---- one violating row a rule, over the raw JSON text --------------------------------------------------------------
#: Rule -> what the event that is broken for it shows.
_EVENT_TEXTS = {
    "ok": "", "const": "contract_version: const;header x_contract_version: differs from contract_version",
    "min_length": "model_name: minLength", "null_name": "model_name: type", "null_version": "",
    "enum": "new_severity: enum", "minimum": "sample_size: minimum", "type": "overall_score: type",
    "format": "created_at: format", "unknown": "surprise: unknown", "no_features": "drift_report.features: required",
    "report_minimum": "drift_report.min_required_samples: minimum", "feature_kind": "drift_report.features[].kind: enum",
    "feature_details": "drift_report.features[].details: required", "feature_unknown": "drift_report.features[].more: unknown",
    "output": "drift_report.output_drift.kind: minLength;drift_report.output_drift.score: minimum",
    "header_version": "header x_contract_version: differs from contract_version",
    "header_key": "header x_idempotency_key: differs from event_id"}


def _event_changes():
    """Rule -> the change of the event's columns that breaks it."""
    rep = F.col("drift_report")

    def feature(change):
        return {"drift_report": rep.withField("features", F.transform(rep["features"], change))}
    bad_output = F.struct(F.lit("").alias("kind"), F.lit(-1.0).alias("score"), F.lit("normal").alias("severity"))
    return {
        "ok": {}, "const": {"contract_version": F.lit("v2")}, "min_length": {"model_name": F.lit("")},
        "null_name": {"model_name": F.lit(None).cast("string")}, "null_version": {"model_version": F.lit(None).cast("string")},
        "enum": {"new_severity": F.lit("loud")}, "minimum": {"sample_size": F.lit(-1)}, "type": {"overall_score": F.lit("high")},
        "format": {"created_at": F.lit("yesterday")}, "unknown": {"surprise": F.lit(1)},
        "no_features": {"drift_report": rep.dropFields("features")},
        "report_minimum": {"drift_report": rep.withField("min_required_samples", F.lit(-3))},
        "feature_kind": feature(lambda f: f.withField("kind", F.lit("other"))),
        "feature_details": feature(lambda f: f.dropFields("details")),
        "feature_unknown": feature(lambda f: f.withField("more", F.lit(1))),
        "output": {"drift_report": rep.withField("output_drift", bad_output)},
        "header_version": {"x_contract_version": F.lit("v9")}, "header_key": {"x_idempotency_key": F.lit("other")}}


def _broken(rows, changes, schema, key, headers):
    """Every row once for each rule, changed by it, as JSON text (an explicit null stays one), and checked."""
    from vigil.operators import contracts as CT
    own = [c for c in rows.columns if c not in headers]
    made = []
    for name, change in changes.items():
        fields = [*own, *[c for c in change if c not in own and c not in headers]]
        values = {c: change.get(c, F.col(c) if c in rows.columns else None).alias(c) for c in [*fields, *headers]}
        made.append(F.struct(F.lit(name).alias("rule"), *[values[h] for h in headers], F.to_json(
            F.struct(*[values[c] for c in fields]),
            {"ignoreNullFields": "false"} if name.startswith("null_") else {}).alias("payload")))
    # a file may be read by few tasks: the rows are dealt out before they are multiplied
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = dealt.select(F.col(key).alias("_key"), F.inline(F.array(*made)))
    checked = CT.check_json(out, "payload", schema, headers)
    return checked.select(F.col("_key").alias(key), "rule", F.array_join("violations", ";").alias("violations"), "valid")


def _texts_sql(texts) -> str:
    return "r(rule, text) AS (VALUES " + ", ".join(f"('{n}', '{t}')" for n, t in texts.items()) + ")"


@query("event_contract_rules", sql=f"WITH {events_cte()}, {_texts_sql(_EVENT_TEXTS)}, "
       "x AS (SELECT event_id, rule, CASE WHEN rule LIKE 'feature%' AND new_severity = 'insufficient_data' THEN '' ELSE text "
       "END AS violations FROM ev CROSS JOIN r) SELECT *, violations = '' AS valid FROM x")
def event_contract_rules(spark, sf_dir):
    """Every drift event as JSON text, once as it is and once broken for each rule of its contract and headers."""
    from vigil.operators import contracts as CT
    from vigil.streaming.runner import written
    ev = written(drift_event_table(spark, sf_dir).drop("payload"), "events")
    ev = ev.withColumn("x_contract_version", F.lit("v1")).withColumn("x_idempotency_key", F.col("event_id"))
    return _broken(ev, _event_changes(), CT.DRIFT_EVENT, "event_id",
                   {"x_contract_version": "contract_version", "x_idempotency_key": "event_id"})


_PROMOTION_TEXTS = {
    "ok": "", "not_approved": "human_approval.approved: const", "no_reason": "reason: required", "empty_id": "approval_id: minLength",
    "wrong_action": "requested_action: const", "source": "human_approval.approval_source: enum", "extra": "human_approval.extra: unknown",
    "context": "drift_context.severity: required", "not_json": "$: json"}


@query("promotion_contract_rules", sql="WITH o AS (SELECT 'promotion_inv_' || CAST(o_orderkey AS VARCHAR) || '_' || "
       "strftime(o_orderdate, '%Y') || '_production' AS request_id FROM orders WHERE o_orderstatus = 'F'), "
       + _texts_sql(_PROMOTION_TEXTS) + " SELECT request_id, rule, text AS violations, text = '' AS valid FROM o CROSS JOIN r")
def promotion_contract_rules(spark, sf_dir):
    """Every promotion request as JSON text, once as it is and once broken for each rule of its contract."""
    from vigil.operators import contracts as CT
    from vigil.operators.promotion import promotion_requests
    from vigil.sources.standins import approvals_ledger
    req = promotion_requests(approvals_ledger(spark, sf_dir)).drop("drift_context")
    ha = F.col("human_approval")
    rules = {"ok": {}, "not_approved": {"human_approval": ha.withField("approved", F.lit(False))},
             "no_reason": {"reason": F.lit(None).cast("string")}, "empty_id": {"approval_id": F.lit("")},
             "wrong_action": {"requested_action": F.lit("deploy")}, "source": {"human_approval": ha.withField("approval_source", F.lit("mail"))},
             "extra": {"human_approval": ha.withField("extra", F.lit(1))}, "context": {"drift_context": F.struct(F.lit("e").alias("event_id"))}}
    good = _broken(req, rules, CT.PROMOTION_REQUEST, "request_id", {})
    torn = CT.check_json(req.select("request_id", F.substring(F.to_json(F.struct(*req.columns)), 1, 40).alias("payload")), "payload",
                         CT.PROMOTION_REQUEST)
    return good.unionByName(torn.select("request_id", F.lit("not_json").alias("rule"), F.array_join("violations", ";").alias("violations"), "valid"))
