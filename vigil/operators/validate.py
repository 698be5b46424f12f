"""Contracts and feature validation as column rules.

Each rule is ``when(<broken>, message)``; ``violations`` compacts them into an
``array<string>`` so every row carries all its errors (the first one is the
error a row-at-a-time validator would raise). Valid and invalid rows are then
split by a filter — a quarantine side output instead of an exception.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contracts.
SEVERITIES = ["insufficient_data", "normal", "warning", "critical"]
FEATURE_KINDS = ["numeric", "categorical", "unknown"]
EVENT_CONST = {"contract_version": "v1", "event_type": "drift.severity_changed", "source_service": "model_service"}
PROMOTION_CONST = {"contract_version": "v1", "request_type": "promotion.production.requested",
                   "source_service": "agent", "requested_action": "promote_to_production",
                   "target_environment": "production"}
TARGET_LABELS = {"yes": 1, "no": 0}


def violations(*rules: Column) -> Column:
    return F.array_compact(F.array(*rules))


def _broken(cond: Column, message: str) -> Column:
    return F.when(F.coalesce(cond, F.lit(True)), F.lit(message))


def _present(c: Column, name: str) -> Column:
    return F.when(c.isNull(), F.lit(f"{name}: required"))


def _const(c: Column, name: str, value: str) -> Column:
    return F.when(c.isNull(), F.lit(f"{name}: required")).when(c != value, F.lit(f"{name}: must be '{value}'"))


def _min_len(c: Column, name: str) -> Column:
    return F.when(c.isNull(), F.lit(f"{name}: required")).when(F.length(c) < 1, F.lit(f"{name}: empty"))


def _non_neg(c: Column, name: str) -> Column:
    return F.when(c.isNull(), F.lit(f"{name}: required")).when(c < 0, F.lit(f"{name}: negative"))


def _enum(c: Column, name: str, values) -> Column:
    return F.when(c.isNull(), F.lit(f"{name}: required")).when(~c.isin(*values), F.lit(f"{name}: not allowed"))


def event_contract(df: DataFrame, header_version: str | None = None, header_key: str | None = None) -> DataFrame:
    """Drift event v1 rules (strict: a feature severity outside the enum is reported).

    Optional header columns must agree with the payload when present (a null header passes).
    Adds ``violations`` and ``valid``.
    """
    rules = [_const(F.col(k), k, v) for k, v in EVENT_CONST.items()]
    rules += [_min_len(F.col("event_id"), "event_id"), _present(F.col("created_at"), "created_at"),
              _min_len(F.col("model_name"), "model_name"),
              _enum(F.col("previous_severity"), "previous_severity", SEVERITIES),
              _enum(F.col("new_severity"), "new_severity", SEVERITIES),
              _non_neg(F.col("overall_score"), "overall_score"), _non_neg(F.col("sample_size"), "sample_size"),
              _non_neg(F.col("min_required_samples"), "min_required_samples"),
              _present(F.col("drift_report"), "drift_report")]
    rep = F.col("drift_report")
    rules += [_non_neg(rep["sample_size"], "drift_report.sample_size"),
              _non_neg(rep["min_required_samples"], "drift_report.min_required_samples"),
              _enum(rep["severity"], "drift_report.severity", SEVERITIES),
              _non_neg(rep["overall_score"], "drift_report.overall_score")]
    feats = F.coalesce(rep["features"], F.array())
    sev_ok = lambda f: f["severity"].isin(*SEVERITIES)
    rules += [
        F.when(F.exists(feats, lambda f: F.coalesce(F.length(f["feature"]), F.lit(0)) < 1),
               F.lit("drift_report.features.feature: empty")),
        F.when(F.exists(feats, lambda f: ~F.coalesce(f["kind"].isin(*FEATURE_KINDS), F.lit(False))),
               F.lit("drift_report.features.kind: not allowed")),
        F.when(F.exists(feats, lambda f: F.coalesce(f["score"] < 0, F.lit(True))),
               F.lit("drift_report.features.score: negative")),
        F.when(F.exists(feats, lambda f: ~F.coalesce(sev_ok(f), F.lit(False))),
               F.lit("drift_report.features.severity: not allowed")),
    ]
    out = rep["output_drift"]
    rules += [F.when(out.isNotNull() & (F.coalesce(F.length(out["kind"]), F.lit(0)) < 1),
                     F.lit("drift_report.output_drift.kind: empty")),
              F.when(out.isNotNull() & F.coalesce(out["score"] < 0, F.lit(True)),
                     F.lit("drift_report.output_drift.score: negative")),
              F.when(out.isNotNull() & ~F.coalesce(out["severity"].isin(*SEVERITIES), F.lit(False)),
                     F.lit("drift_report.output_drift.severity: not allowed"))]
    if header_version:
        rules.append(F.when(F.col(header_version).isNotNull() & (F.col(header_version) != F.col("contract_version")),
                            F.lit("header: contract version differs from payload")))
    if header_key:
        rules.append(F.when(F.col(header_key).isNotNull() & (F.col(header_key) != F.col("event_id")),
                            F.lit("header: idempotency key differs from event_id")))
    v = violations(*rules)
    return df.withColumn("violations", v).withColumn("valid", F.size("violations") == 0)


def promotion_contract(df: DataFrame) -> DataFrame:
    """Promotion request v1 rules: constants, non-empty ids, approved human approval from the dashboard."""
    rules = [_const(F.col(k), k, v) for k, v in PROMOTION_CONST.items()]
    rules += [_min_len(F.col(c), c) for c in ("request_id", "investigation_id", "approval_id", "model_name",
                                             "model_version", "reason")]
    rules.append(_present(F.col("created_at"), "created_at"))
    ha = F.col("human_approval")
    rules += [_present(ha, "human_approval"),
              F.when(ha.isNotNull() & ~F.coalesce(ha["approved"], F.lit(False)),
                     F.lit("human_approval.approved: must be true")),
              F.when(ha.isNotNull(), _min_len(ha["approved_by"], "human_approval.approved_by")),
              F.when(ha.isNotNull(), _present(ha["approved_at"], "human_approval.approved_at")),
              F.when(ha.isNotNull(), _enum(ha["approval_source"], "human_approval.approval_source", ["dashboard"]))]
    if "drift_context" in df.columns:
        dc = F.col("drift_context")
        rules += [F.when(dc.isNotNull(), _min_len(dc["event_id"], "drift_context.event_id")),
                  F.when(dc.isNotNull(), _enum(dc["severity"], "drift_context.severity", SEVERITIES))]
    return df.withColumn("violations", violations(*rules)).withColumn("valid", F.size("violations") == 0)


# ---- training-table preparation ---------------------------------------------------------------------------
def normalized_label(c) -> Column:
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def target_map(df: DataFrame, col: str, out: str = "y") -> DataFrame:
    """trim + lower, yes → 1, no → 0 (anything else null; see ``unexpected_labels``)."""
    n = normalized_label(col)
    return df.withColumn(out, F.when(n == "yes", 1).when(n == "no", 0).cast("int"))


def unexpected_labels(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct normalised labels outside {yes, no} (a distinct-except); a null label is ``nan``, as in text."""
    labels = df.select(F.coalesce(normalized_label(col), F.lit("nan")).alias("label")).distinct()
    allowed = df.sparkSession.createDataFrame([(k,) for k in TARGET_LABELS], "label string")
    return labels.subtract(allowed).orderBy("label")


def drop_leakage(df: DataFrame, target: str, leakage=("duration",)) -> DataFrame:
    return df.drop(target, *leakage)


def sentinel_flag(df: DataFrame, col: str, sentinel, replacement, flag: str) -> DataFrame:
    """Training-time sentinel: flag column = (value == sentinel), value replaced."""
    c = F.col(col)
    return df.withColumns({flag: (c == sentinel).cast("int"), col: F.when(c == sentinel, F.lit(replacement))
                           .otherwise(c)})


def sentinel_flag_serving(df: DataFrame, col: str, sentinel, replacement, flag: str) -> DataFrame:
    """Scoring-time sentinel on raw (string) input: int cast (``'3.7'`` fails, ``3.7`` truncates); sentinel →
    replacement with flag 1; otherwise the caller's flag is kept, defaulting to 0. ``sentinel_error`` marks
    values that are not integers, nulls included."""
    as_int = F.expr(f"try_cast(`{col}` AS BIGINT)")
    is_s = as_int == sentinel
    keep_flag = F.coalesce(F.col(flag).cast("int"), F.lit(0)) if flag in df.columns else F.lit(0)
    return df.withColumns({
        "sentinel_error": F.when(as_int.isNull(), F.lit(f"Feature '{col}' must be numeric.")),
        col: F.when(is_s, F.lit(replacement)).otherwise(as_int),
        flag: F.when(is_s, F.lit(1)).otherwise(keep_flag),
    })


# ---- serving-time feature checks on a map<string,string> of raw features ------------------------------------
def feature_contract(df: DataFrame, map_col: str, required, dropped=(), allow_extra: bool = False) -> DataFrame:
    """Drop trained-away keys, then list ``missing`` and ``extra`` feature names (sorted)."""
    req = F.array(*[F.lit(c) for c in required])
    m = F.map_filter(F.col(map_col), lambda k, v: ~k.isin(*dropped)) if dropped else F.col(map_col)
    df = df.withColumn(map_col, m)
    keys = F.map_keys(F.col(map_col))
    df = df.withColumn("missing", F.array_sort(F.array_except(req, keys)))
    df = df.withColumn("extra", F.array_sort(F.array_except(keys, req)))
    ok = (F.size("missing") == 0) & (F.size("extra") == 0 if not allow_extra else F.lit(True))
    return df.withColumn("contract_ok", ok)


def feature_validate(df: DataFrame, map_col: str, int_cols=(), float_cols=(), categorical=(), dtypes=None,
                     order=None) -> DataFrame:
    """Typed features from raw strings with every error collected, in the ``order`` of the input columns (default:
    integers, floats, categories, then ``dtypes``).

    Numeric: null → "cannot be null", no number → "must be numeric". Categorical: trimmed,
    empty → "cannot be an empty string". ``dtypes`` (name → type) has the columns of neither group: ``int*`` and
    ``float*`` are cast, others stay as they are. Adds a typed struct (``features``, or ``validated`` when the input map
    is itself called ``features``), ``errors``, ``first_error``, ``valid``.
    """
    m = F.col(map_col)
    vals, errs = {}, {}

    def number(c, kind, message):
        vals[c] = F.expr(f"try_cast(trim(`{map_col}`['{c}']) AS {kind})")
        errs[c] = F.when(vals[c].isNull(), message)

    for c, kind in [*[(c, "BIGINT") for c in int_cols], *[(c, "DOUBLE") for c in float_cols]]:
        number(c, kind, F.concat(F.lit(f"Feature '{c}' must be numeric. Got: "), m[c]))
    for c in categorical:
        v = F.trim(m[c])
        vals[c] = F.when(v != "", v)
        errs[c] = F.when(v == "", F.lit(f"Feature '{c}' cannot be an empty string."))
    for c, kind in (dtypes or {}).items():
        if kind.startswith("int"):
            number(c, "BIGINT", F.concat(F.lit("invalid literal for int() with base 10: '"), m[c], F.lit("'")))
        elif kind.startswith("float"):
            number(c, "DOUBLE", F.concat(F.lit("could not convert string to float: '"), m[c], F.lit("'")))
        else:
            vals[c], errs[c] = m[c], F.lit(None).cast("string")
    names = list(order) if order is not None else list(vals)
    errs = [F.when(m[c].isNull(), F.lit(f"Feature '{c}' cannot be null.")).otherwise(errs[c]) for c in names]
    vals = [vals[c].alias(c) for c in names]
    e = violations(*errs)
    out = "validated" if map_col == "features" else "features"
    return (df.withColumns({out: F.struct(*vals), "errors": e})
            .withColumn("first_error", F.try_element_at(F.col("errors"), F.lit(1)))
            .withColumn("valid", F.size("errors") == 0))


def _name_list(names: Column) -> Column:
    """Names as the error texts list them: ``['a', 'b']``."""
    return F.concat(F.lit("['"), F.array_join(names, "', '"), F.lit("']"))


def validate_features(df: DataFrame, map_col: str, input_cols, int_cols=(), float_cols=(), categorical=(), dtypes=None,
                      dropped=(), sentinel=None, allow_extra: bool = False) -> DataFrame:
    """A request's raw features (map<string,string>) checked in the scoring order: drop trained-away names, sentinel
    handling, missing names, extra names, then every input column in turn.

    ``sentinel``: (column, value, replacement, flag column); an absent column is left alone, a present null is not
    numeric. Adds the typed struct, ``first_error`` (the first in that order; null: none) and ``valid``. A null map
    has no features, so all are missing.
    """
    empty = F.create_map().cast("map<string,string>")
    m = F.coalesce(F.map_filter(F.col(map_col), lambda k, v: ~k.isin(*dropped)) if dropped else F.col(map_col), empty)
    df = df.withColumn("_m", m)
    sentinel_error = F.lit(None).cast("string")
    if sentinel is not None:
        c, value, replacement, flag = sentinel
        there = F.map_contains_key("_m", F.lit(c))
        number = F.expr(f"try_cast(trim(_m['{c}']) AS BIGINT)")
        hit = number == value
        sentinel_error = F.when(there & number.isNull(), F.lit(f"Feature '{c}' must be numeric."))
        kept = F.when(F.map_contains_key("_m", F.lit(flag)), F.col("_m")[flag]).otherwise(F.lit("0"))
        handled = F.map_concat(F.map_filter("_m", lambda k, v: ~k.isin(c, flag)), F.create_map(
            F.lit(c), F.when(hit, F.lit(str(replacement))).otherwise(number.cast("string")),
            F.lit(flag), F.when(hit, F.lit("1")).otherwise(kept)))
        df = df.withColumns({"_sentinel_error": sentinel_error, "_m": F.when(there, handled).otherwise(F.col("_m"))})
        sentinel_error = F.col("_sentinel_error")
    wanted, keys = F.array(*[F.lit(c) for c in input_cols]), F.map_keys("_m")
    missing, extra = F.array_except(wanted, keys), F.array_except(keys, wanted)
    df = feature_validate(df.withColumns({"_missing": missing, "_extra": extra}), "_m", int_cols, float_cols,
                          categorical, dtypes, input_cols)
    first = F.coalesce(
        sentinel_error, F.when(F.size("_missing") > 0, F.concat(F.lit("Missing required feature(s): "),
                                                                _name_list(F.col("_missing")))),
        F.when((F.size("_extra") > 0) & (not allow_extra), F.concat(F.lit("Unexpected extra feature(s): "),
                                                                     _name_list(F.col("_extra")))), F.col("first_error"))
    return (df.withColumn("first_error", first).withColumn("valid", F.col("first_error").isNull())
            .drop("_m", "_missing", "_extra", "_sentinel_error", "errors"))


def schema_profile(df: DataFrame) -> DataFrame:
    """One scan: per column its type, numeric/categorical group, null count and approximate distinct count."""
    numeric_types = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    cols = [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct", "binary"))]
    items = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in cols]
    long_df = df.select(F.inline(F.array(*items)))
    prof = long_df.groupBy("column").agg(F.count_if(F.col("v").isNull()).alias("nulls"),
                                         F.approx_count_distinct("v").alias("approx_distinct"))
    types = df.sparkSession.createDataFrame(
        [(c, t, "numeric" if t.startswith(numeric_types) else "categorical") for c, t in df.dtypes if c in cols],
        "column string, type string, feature_group string")
    return types.join(prof, "column", "left")
