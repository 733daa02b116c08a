"""Declarative validation (V1-V18, E1, E2) compiled to one projection.

A rule is ``{field, type, params, severity, message}``.  Every rule becomes a
``when(violated, struct(...))`` expression; a record's findings are the
non-NULL entries of one ``array(...)`` -- a single Project over the scan, no
Python per row.  NULL input passes every built-in rule except ``required``;
registered and record-level rules see it.
Uniqueness (V11) is the only rule that needs other rows: it is a grouped
count joined back (partial aggregation collapses a hot value before the
shuffle; AQE splits the skewed side of the join), never a window over a
possibly-huge partition.
"""

from collections.abc import Callable
from string import Formatter

import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import parse_date, to_float, to_int
from .rows import keep_rows

ERROR, WARNING, INFO = "error", "warning", "info"

# The built-in route rule set (13 rules, in order).
ROUTE_RULES = [
    {"field": "route_id", "type": "required", "params": {}, "severity": ERROR,
     "message": "Route ID is required"},
    {"field": "route_id", "type": "length", "params": {"min": 1, "max": 50}, "severity": ERROR,
     "message": "Route ID must be 1-50 characters"},
    {"field": "route_date", "type": "required", "params": {}, "severity": ERROR,
     "message": "Route date is required"},
    {"field": "route_date", "type": "type", "params": {"type": "date"}, "severity": ERROR,
     "message": "Route date must be a valid date"},
    {"field": "total_miles", "type": "type", "params": {"type": "float"}, "severity": WARNING,
     "message": "Total miles should be numeric"},
    {"field": "total_miles", "type": "positive", "params": {}, "severity": WARNING,
     "message": "Total miles should be positive"},
    {"field": "total_miles", "type": "range", "params": {"min": 0, "max": 5000}, "severity": WARNING,
     "message": "Total miles seems unusually high (over 5000 miles)"},
    {"field": "revenue", "type": "type", "params": {"type": "float"}, "severity": WARNING,
     "message": "Revenue should be numeric"},
    {"field": "revenue", "type": "positive", "params": {}, "severity": WARNING,
     "message": "Revenue should be positive"},
    {"field": "driver_name", "type": "length", "params": {"min": 2, "max": 100}, "severity": WARNING,
     "message": "Driver name should be 2-100 characters"},
    {"field": "email", "type": "email", "params": {}, "severity": WARNING,
     "message": "Invalid email format"},
    {"field": "phone", "type": "phone", "params": {}, "severity": WARNING,
     "message": "Invalid phone number format"},
    {"field": "status", "type": "choices",
     "params": {"choices": ["scheduled", "in_progress", "completed", "cancelled", "delayed"],
                "case_sensitive": False},
     "severity": WARNING,
     "message": "Status should be one of: scheduled, in_progress, completed, cancelled, delayed"},
]

# User-registered rule types: name -> f(value_column, params) -> (ok, suggestion)
CUSTOM_VALIDATORS: dict[str, Callable[[Column, dict], tuple[Column, Column]]] = {}


def register_validator(name: str, fn: Callable[[Column, dict], tuple[Column, Column]]) -> None:
    """Add a rule type; ``fn`` maps the value column (NULL included) and params
    to ``(ok, suggested)`` or ``(ok, suggested, error)`` columns; a NULL ``ok`` is a
    violation.  A plain Python predicate can be lifted with
    :func:`python_validator` (Arrow-batched pandas UDF, the slow path)."""
    CUSTOM_VALIDATORS[name] = fn


def python_validator(pred: Callable[[object, dict], bool]) -> Callable[[Column, dict], tuple[Column, Column]]:
    """Wrap a per-value Python predicate as a vectorised pandas UDF rule; an
    exception becomes the finding's error text."""

    def make(v: Column, params: dict):
        def one(x):
            try:
                return bool(pred(None if pd.isna(x) else x, params)), None
            except Exception as e:  # noqa: BLE001 -- the rule is the caller's
                return False, str(e)

        @F.pandas_udf("ok boolean, error string")
        def check(s: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([one(x) for x in s], columns=["ok", "error"])
        got = check(v.cast("string"))
        return got["ok"], v.cast("string"), got["error"]
    return make


def rules_from_config(cfg: dict) -> list[dict]:
    """Rules from ``{field: [{type, params?, severity?, message?}, ...]}``, or from
    ``{name?, rules: [{field_name, rule_type, parameters?, severity?, message}, ...]}``;
    severity defaults to warning.  An unknown severity or a missing part is an error."""
    if isinstance(cfg.get("rules"), list):
        out = [{"field": r["field_name"], "type": r["rule_type"], "params": r.get("parameters", {}),
                "severity": r.get("severity", WARNING), "message": r["message"]} for r in cfg["rules"]]
        unknown = {r["severity"] for r in out} - {ERROR, WARNING, INFO}
        if unknown:
            raise ValueError(f"unknown severity {sorted(unknown)}")
        return out
    out = []
    for field, specs in cfg.items():
        for s in specs:
            out.append({"field": field, "type": s["type"], "params": s.get("params", {}),
                        "severity": s.get("severity", WARNING),
                        "message": s.get("message", f"{field} failed {s['type']} validation")})
    return out


def _s(x: Column) -> Column:
    return x.cast("string")


def _num(df_cols: set, f: str, vs: Column) -> Column:
    return F.col(f"__num_{f}") if f"__num_{f}" in df_cols else to_float(vs)


def _date(df_cols: set, f: str, vs: Column) -> Column:
    return F.col(f"__date_{f}") if f"__date_{f}" in df_cols else parse_date(vs)


def _conversions(rules: list[dict], cols: set) -> dict[str, Column]:
    """Each field's number / date conversion, computed once per row as a
    column (rules then reference it instead of re-parsing the text)."""
    out = {}
    for r in rules:
        f, t, p = r["field"], r["type"], r.get("params", {})
        if f not in cols:
            continue
        vs = _s(F.col(f))
        if t in ("range", "positive") or (t == "type" and p.get("type") == "float"):
            out[f"__num_{f}"] = to_float(vs)
        if t == "date_range" or (t == "type" and p.get("type") == "date"):
            out[f"__date_{f}"] = parse_date(vs)
    return out


def rule_check(df_cols: set, rule: dict) -> tuple[Column, Column]:
    """(violated, suggested_value as text) of one rule."""
    f, t, p = rule["field"], rule["type"], rule.get("params", {})
    v = F.col(f) if f in df_cols else F.lit(None).cast("string")
    vs = _s(v)
    null = v.isNull()
    if t == "required":
        return null | (F.trim(vs) == ""), vs
    if t == "type":
        kind = p.get("type", "string")
        if kind == "int":
            conv = to_int(vs)
        elif kind == "float":
            conv = _num(df_cols, f, vs)
        elif kind == "date":
            conv = F.when(vs != "", _date(df_cols, f, vs))
        else:
            return F.lit(False), vs
        return ~null & conv.isNull(), _s(conv)
    if t == "range":
        x = _num(df_cols, f, vs)
        lo, hi = p.get("min"), p.get("max")
        bad, sug = x.isNull(), vs
        if lo is not None:
            bad, sug = bad | (x < lo), F.when(x < lo, F.lit(str(float(lo)))).otherwise(sug)
        if hi is not None:
            bad = bad | (x > hi)
            sug = F.when(x > hi, F.lit(str(float(hi)))).otherwise(sug)
        return ~null & bad, F.when(bad, sug).otherwise(_s(x))
    if t == "length":
        n = F.length(vs)
        lo, hi = p.get("min", 0), p.get("max")
        bad = n < lo
        sug = vs
        if hi is not None:
            sug = F.when(n > hi, F.substring(vs, 1, hi)).otherwise(vs)
            bad = bad | (n > hi)
        return ~null & bad, sug
    if t == "pattern":
        pat = p.get("pattern", "")
        if not pat:
            return F.lit(False), vs
        return ~null & ~vs.rlike(f"^(?:{pat})"), vs
    if t == "choices":
        ch = p.get("choices", [])
        if not ch:
            return F.lit(False), vs
        if p.get("case_sensitive", True):
            return ~null & ~vs.isin(ch), vs
        return ~null & ~F.lower(vs).isin([str(x).lower() for x in ch]), vs
    if t == "email":
        part = F.element_at(F.split(vs, "@"), 2)
        ok = F.coalesce(F.instr(vs, "@") > 0, F.lit(False)) & F.coalesce(F.instr(part, ".") > 0, F.lit(False))
        return ~null & ~ok, F.trim(vs)
    if t == "phone":
        ok = F.length(F.regexp_replace(vs, r"[^0-9]", "")) == 10
        return ~null & ~ok, F.trim(vs)
    if t == "date_range":
        d = _date(df_cols, f, vs)
        lo = parse_date(F.lit(p["min_date"])) if p.get("min_date") else None
        hi = parse_date(F.lit(p["max_date"])) if p.get("max_date") else None
        bad, sug = d.isNull(), vs
        if lo is not None:
            bad, sug = bad | (d < lo), F.when(d < lo, _s(lo)).otherwise(sug)
        if hi is not None:
            bad, sug = bad | (d > hi), F.when(d > hi, _s(hi)).otherwise(sug)
        return ~null & bad, F.when(bad, sug).otherwise(_s(d))
    if t == "positive":
        x = _num(df_cols, f, vs)
        return ~null & (x.isNull() | (x <= 0)), F.coalesce(_s(x), vs)
    if t == "unique":
        # resolved by with_findings via a grouped count; placeholder here
        return F.col(f"__dup_{f}"), vs
    raise ValueError(f"unknown rule type {t}")


def custom_check(df_cols: set, rule: dict) -> tuple[Column, Column, Column]:
    """(violated, suggested value, error text) of a registered (E1) or
    record-level (E2) rule.  The rule also sees NULL; a callable that raises while
    the expression is built is an error of every record, not of the job."""
    f, t, p = rule["field"], rule["type"], rule.get("params", {})
    v = F.col(f) if f in df_cols else F.lit(None).cast("string")
    none = F.lit(None).cast("string")
    try:
        # A callable that sees the whole record as a struct
        got = p["fn"](v, F.struct("*")) if t == "record" else CUSTOM_VALIDATORS[t](v, p)
    except Exception as e:  # noqa: BLE001 -- the rule is the caller's
        return F.lit(True), none, F.lit(str(e))
    ok, sug, error, *_ = (*got, none, none) if isinstance(got, tuple) else (got, _s(v), none)
    return ~F.coalesce(ok, F.lit(False)), _s(sug), error


def _message(rule: dict, v: Column, index: Column) -> Column:
    """The rule's message with ``{value}``, ``{record_index}`` and its parameters filled in."""
    filled = {"value": F.coalesce(_s(v), F.lit("None")), "record_index": _s(index),
              **{k: F.lit(str(x)) for k, x in rule.get("params", {}).items() if not callable(x)}}
    parts = []
    for text, name, _, _ in Formatter().parse(rule["message"]):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            if name not in filled:
                raise ValueError(f"message {rule['message']!r}: nothing fills {{{name}}}")
            parts.append(filled[name])
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else F.lit("")


def _finding(rule: dict, sug: Column, v: Column, index: Column, error: Column | None = None) -> Column:
    severity, message = F.lit(rule["severity"]), _message(rule, v, index)
    if error is not None:
        name = "Custom validator" if rule["type"] == "record" else f"Validator {rule['type']}"
        severity = F.when(error.isNotNull(), ERROR).otherwise(severity)
        message = F.when(error.isNotNull(), F.concat(F.lit(f"{name} error: "), error)).otherwise(message)
        sug = F.when(error.isNull(), sug)
    return F.struct(F.lit(rule["field"]).alias("field_name"), F.lit(rule["type"]).alias("rule_type"),
                    severity.alias("severity"), message.alias("message"),
                    _s(v).alias("value"), sug.alias("suggested_value"))


def with_findings(df: DataFrame, rules: list[dict] = ROUTE_RULES, out: str = "findings",
                  index: str | None = None) -> DataFrame:
    """Add ``findings array<struct<field_name, rule_type, severity,
    message, value, suggested_value>>`` in rule order.  ``index`` names the column
    that fills ``{record_index}`` in messages."""
    for f in {r["field"] for r in rules if r["type"] == "unique"}:
        dup = (df.filter(F.col(f).isNotNull()).groupBy(f).agg(F.count(F.lit(1)).alias("_n"))
               .filter("_n > 1").select(f, F.lit(True).alias(f"__dup_{f}")))
        df = df.join(dup, f, "left").withColumn(f"__dup_{f}", F.coalesce(f"__dup_{f}", F.lit(False)))
    conv = _conversions(rules, set(df.columns))
    if conv:
        df = df.withColumns(conv)
    cols = set(df.columns)
    items = []
    at = F.col(index) if index else F.lit(None).cast("string")
    for r in rules:
        own = r["type"] == "record" or r["type"] in CUSTOM_VALIDATORS
        bad, sug, *error = custom_check(cols, r) if own else rule_check(cols, r)
        v = F.col(r["field"]) if r["field"] in cols else F.lit(None).cast("string")
        items.append(F.when(F.coalesce(bad, F.lit(False)), _finding(r, sug, v, at, *error)))
    out_df = df.withColumn(out, F.array_compact(F.array(*items)))
    return out_df.drop(*[c for c in out_df.columns if c.startswith(("__dup_", "__num_", "__date_"))])


def has_errors(findings: str = "findings") -> Column:
    return F.exists(F.col(findings), lambda x: x["severity"] == ERROR)


def split_valid(df: DataFrame, findings: str = "findings") -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows) by any error-severity finding."""
    return keep_rows(df, ~has_errors(findings)), keep_rows(df, has_errors(findings))


def batch_summary(df: DataFrame, findings: str = "findings") -> DataFrame:
    """Totals, error and warning counts, passed flag -- one aggregate."""
    errs = F.size(F.filter(F.col(findings), lambda x: x["severity"] == ERROR))
    warns = F.size(F.filter(F.col(findings), lambda x: x["severity"] == WARNING))
    g = df.agg(F.count(F.lit(1)).alias("total_records"),
               F.count_if(~has_errors(findings)).cast("long").alias("valid_records"),
               F.count_if(has_errors(findings)).cast("long").alias("invalid_records"),
               F.coalesce(F.sum(errs), F.lit(0)).cast("long").alias("error_count"),
               F.coalesce(F.sum(warns), F.lit(0)).cast("long").alias("warning_count"))
    return g.withColumn("validation_passed", F.col("error_count") == 0)


def findings_report(df: DataFrame, key: str, findings: str = "findings") -> DataFrame:
    """One row per finding with its position in the record's list."""
    # inline() yields the columns directly: selecting fields of an exploded
    # struct would let nested-column pruning copy the findings expression
    # once per field below the generator.
    fields = ["field_name", "rule_type", "severity", "message", "value", "suggested_value"]
    rows = F.transform(F.col(findings), lambda x, i: F.struct(i.alias("position"), *[x[f].alias(f) for f in fields]))
    return df.select(key, F.inline(rows))


def post_transform_checks(routes: DataFrame, locations: DataFrame) -> DataFrame:
    """At least one route; every route has a date; routes exist only
    with at least one location.  One row: the checks and the verdict."""
    r = routes.agg(F.count(F.lit(1)).alias("route_count"),
                   F.count_if(F.col("route_date").isNull()).cast("long").alias("routes_without_date"))
    lc = locations.agg(F.count(F.lit(1)).alias("location_count")).scalar()
    j = r.withColumn("location_count", lc)
    return j.withColumn("passed", (F.col("route_count") > 0) & (F.col("routes_without_date") == 0)
                        & (F.col("location_count") > 0))
