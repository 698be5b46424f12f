"""Contracts over raw JSON text: a schema compiled to column expressions.

The text is parsed once to a VARIANT, so an absent field and a null one differ, and a value's own type is known. Every
rule that is broken gives one text, ``path: rule``; rows are independent and nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: the contracts' fields, types and limits, in the order they are documented ----------------------
TEXT, NAME, COUNT = {"type": "string"}, {"type": "string", "minLength": 1}, {"type": "integer", "minimum": 0}
SCORE, TIME = {"type": "number", "minimum": 0}, {"type": "string", "format": "date-time"}
SEVERITY = {"type": "string", "enum": ["insufficient_data", "normal", "warning", "critical"]}
ANY_OBJECT = {"type": "object"}


def const(value) -> dict:
    return {"type": "boolean" if isinstance(value, bool) else "string", "const": value}


def closed(required: dict, optional: dict | None = None) -> dict:
    """An object with these fields and no others."""
    return {"type": "object", "required": list(required), "properties": {**required, **(optional or {})},
            "additionalProperties": False}


FEATURE = closed({"feature": NAME, "kind": {"type": "string", "enum": ["numeric", "categorical", "unknown"]}, "score": SCORE,
                  "severity": SEVERITY, "details": ANY_OBJECT})
OUTPUT_DRIFT = {"type": "object", "required": ["kind", "score", "severity"], "properties": {
    "kind": NAME, "score": SCORE, "severity": SEVERITY, "probability_bins": {"type": "array", "items": {"type": "number"}},
    "actual_distribution": {"type": "array", "items": COUNT}, "expected_distribution": {"type": "array", "items": COUNT}}}
DRIFT_REPORT = closed({"sample_size": COUNT, "min_required_samples": COUNT, "severity": SEVERITY, "overall_score": SCORE,
                       "features": {"type": "array", "items": FEATURE}}, {"output_drift": {"nullable": OUTPUT_DRIFT}})
DRIFT_EVENT = closed({
    "contract_version": const("v1"), "event_type": const("drift.severity_changed"), "event_id": NAME, "created_at": TIME,
    "source_service": const("model_service"), "model_name": NAME, "previous_severity": SEVERITY, "new_severity": SEVERITY,
    "overall_score": SCORE, "sample_size": COUNT, "min_required_samples": COUNT, "drift_report": DRIFT_REPORT},
    {"model_version": {"type": ["string", "null"]}, "metadata": ANY_OBJECT})
HUMAN_APPROVAL = closed({"approved": const(True), "approved_by": NAME, "approved_at": TIME,
                         "approval_source": {"type": "string", "enum": ["dashboard"]}})
DRIFT_CONTEXT = closed({"event_id": NAME, "severity": SEVERITY}, {"previous_model_version": {"type": ["string", "null"]}})
PROMOTION_REQUEST = closed({
    "contract_version": const("v1"), "request_type": const("promotion.production.requested"), "request_id": NAME,
    "created_at": TIME, "source_service": const("agent"), "investigation_id": NAME, "approval_id": NAME,
    "requested_action": const("promote_to_production"), "target_environment": const("production"), "model_name": NAME,
    "model_version": NAME, "human_approval": HUMAN_APPROVAL, "reason": NAME},
    {"drift_context": DRIFT_CONTEXT, "metadata": ANY_OBJECT})
# ---------------------------------------------------------------------------------------------------------------------

_NONE = "array<string>"
_TIME = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:?\d{2})?$"


def _is(kind: Column, value: Column, name: str) -> Column:
    number = kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE", "FLOAT")
    if name == "integer":  # 2.0 is one, 2.5 is none
        x = F.try_variant_get(value, "$", "double")
        return number & (x == F.floor(x))
    return {"string": kind == "STRING", "number": number, "boolean": kind == "BOOLEAN", "null": kind == "VOID",
            "object": kind.startswith("OBJECT"), "array": kind.startswith("ARRAY")}[name]


def _when(broken: Column, path: str, rule: str) -> Column:
    return F.when(F.coalesce(broken, F.lit(True)), F.array(F.lit(f"{path}: {rule}"))).otherwise(F.array().cast(_NONE))


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _field_rules(rule: dict, path: str, lacking: Column):
    return lambda field: F.when(field.isNull(), lacking).otherwise(broken_rules(rule, field, path))


def broken_rules(schema: dict, value: Column, path: str = "$") -> Column:
    """``array<string>`` of the rules of ``schema`` that a variant breaks; ``value`` is present (it may be JSON null).
    It is named by many rules, so it is a column or a bound value (``_let``), not an expression to be computed."""
    if "nullable" in schema:
        return F.when(F.is_variant_null(value), F.array().cast(_NONE)).otherwise(broken_rules(schema["nullable"], value, path))
    kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]

    def right(kind: Column) -> Column:
        ok = _is(kind, value, kinds[0])
        for k in kinds[1:]:
            ok = ok | _is(kind, value, k)
        return F.coalesce(ok, F.lit(False))
    found = []
    text = F.try_variant_get(value, "$", "string")
    if "const" in schema:
        found.append(_when(F.try_variant_get(value, "$", schema["type"]) != F.lit(schema["const"]), path, "const"))
    if "enum" in schema:
        found.append(_when(~text.isin(schema["enum"]), path, "enum"))
    if "minLength" in schema:
        found.append(_when(F.char_length(text) < schema["minLength"], path, "minLength"))
    if "minimum" in schema:
        found.append(_when(F.try_variant_get(value, "$", "double") < schema["minimum"], path, "minimum"))
    if schema.get("format") == "date-time":
        found.append(_when(~text.rlike(_TIME), path, "format"))
    if "items" in schema:
        items = F.try_variant_get(value, "$", "array<variant>")
        found.append(F.array_distinct(F.flatten(F.transform(items, lambda x: broken_rules(schema["items"], x, f"{path}[]")))))
    for name, rule in schema.get("properties", {}).items():
        there = f"{path}.{name}" if path != "$" else name
        lacking = _when(F.lit(True), there, "required") if name in schema.get("required", []) else F.array().cast(_NONE)
        found.append(_let(F.try_variant_get(value, f"$.{name}", "variant"), _field_rules(rule, there, lacking)))
    if schema.get("additionalProperties") is False:
        names = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
        strange = F.filter(names, lambda n: ~n.isin(list(schema["properties"])))
        prefix = "" if path == "$" else f"{path}."
        found.append(F.transform(strange, lambda n: F.concat(F.lit(prefix), n, F.lit(": unknown"))))
    whole = F.concat(*found) if found else F.array().cast(_NONE)
    return F.when(_let(F.schema_of_variant(value), right), whole).otherwise(F.array(F.lit(f"{path}: type")))


def check_json(df: DataFrame, json_col: str, schema: dict, headers: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``violations`` (all of them, in the schema's order) and ``valid``. Text that is null or no JSON breaks
    ``$: json`` alone. ``headers``: header column -> field of the text that it must equal where the header is given."""
    def rules(v: Column) -> Column:
        found = broken_rules(schema, v)
        for column, name in (headers or {}).items():
            differs = F.col(column).isNotNull() & ~F.col(column).eqNullSafe(F.try_variant_get(v, f"$.{name}", "string"))
            found = F.concat(found, F.when(differs, F.array(F.lit(f"header {column}: differs from {name}"))).otherwise(F.array().cast(_NONE)))
        return F.when(v.isNull(), F.array(F.lit("$: json"))).otherwise(found)
    return df.withColumn("violations", _let(F.try_parse_json(json_col), rules)).withColumn("valid", F.size("violations") == 0)
