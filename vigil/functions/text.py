"""Scalar helpers: ids and keys, text shaping, JSON access, status buckets, stamps.

All are ``Column`` expressions; none needs Python at run time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# UI status buckets, ellipsis, id length.
STATUS_BUCKETS = {
    "ok": ["healthy", "ok", "normal", "completed", "resolved", "approved", "passed", "true"],
    "waiting": ["warning", "pending", "waiting_for_approval", "waiting_for_job", "queued"],
    "bad": ["critical", "failed", "blocked", "promotion_blocked", "rejected", "dlq", "false"],
    "running": ["running", "processing", "in_progress"],
    "candidate": ["candidate", "promote_to_production", "retrain"],
}
ELLIPSIS = "…"
SHORT_ID_HEX = 12


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sigmoid(score) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(score)))


def predicted_class(prob, threshold) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (_c(prob) >= t).cast("int")


def threshold_fallback(selected, configured) -> Column:
    """``selected or configured or 0.5`` (0 counts as absent)."""
    return F.coalesce(F.nullif(_c(selected), F.lit(0.0)), F.nullif(_c(configured), F.lit(0.0)), F.lit(0.5))


def short_id(prefix: str, *key_cols) -> Column:
    """Deterministic ``prefix_`` + 12 hex of the key (a retried job gets the same id)."""
    key = F.concat_ws("|", *[_c(k).cast("string") for k in key_cols])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(key, 256), 1, SHORT_ID_HEX))


def job_key(action, investigation_id, version) -> Column:
    """``action:investigation:version`` with a missing version as ``unknown``."""
    v = F.coalesce(F.when(_c(version) != "", _c(version)), F.lit("unknown"))
    return F.concat_ws(":", _c(action), _c(investigation_id), v)


def promotion_request_id(investigation_id, version) -> Column:
    return F.concat(F.lit("promotion_"), _c(investigation_id), F.lit("_"),
                    F.coalesce(F.nullif(_c(version), F.lit("")), F.lit("unknown")), F.lit("_production"))


def last_chars(text, n: int) -> Column:
    return F.right(_c(text), F.lit(n))


def first_chars(text, n: int) -> Column:
    return F.left(_c(text), F.lit(n))


def truncate(text, n: int) -> Column:
    """Text longer than n → first n-1 characters + ``…``."""
    t = _c(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n - 1), F.lit(ELLIPSIS))).otherwise(t)


def fmt4(x) -> Column:
    return F.format_string("%.4f", _c(x))


def artifacts_path(log_text) -> Column:
    """Path after ``Artifacts saved to:`` in a training log (empty string when absent)."""
    return F.trim(F.regexp_extract(_c(log_text), r"Artifacts saved to:\s*(.+)", 1))


def comma_set(text) -> Column:
    """``'a, b,,c'`` → distinct trimmed non-empty items."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(_c(text), F.lit("")), ","), lambda x: F.trim(x)),
                                     lambda x: x != ""))


def status_bucket(status) -> Column:
    s = F.lower(F.coalesce(_c(status), F.lit("")))
    expr = None
    for bucket, values in STATUS_BUCKETS.items():
        expr = F.when(s.isin(*values), bucket) if expr is None else expr.when(s.isin(*values), bucket)
    return expr.otherwise("other")


def compact_stamp(ts) -> Column:
    return F.date_format(_c(ts), "yyyyMMdd'T'HHmmss'Z'")


def iso_stamp(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss")


def json_safe_double(x) -> Column:
    """NaN and infinities become null (JSON has no NaN)."""
    v = _c(x)
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None).cast("double")).otherwise(v)


def safe_get(json_text, path: str, default=None) -> Column:
    """Nested lookup in a JSON string with a default (``$.a.b``)."""
    v = F.get_json_object(_c(json_text), path)
    return v if default is None else F.coalesce(v, F.lit(default))


def merge_metadata(left, right) -> Column:
    """Map merge where the right side wins on a shared key."""
    l, r = _c(left), _c(right)
    return F.map_concat(F.map_filter(F.coalesce(l, F.create_map().cast("map<string,string>")),
                                     lambda k, v: ~F.array_contains(F.map_keys(F.coalesce(
                                         r, F.create_map().cast("map<string,string>"))), k)),
                        F.coalesce(r, F.create_map().cast("map<string,string>")))
