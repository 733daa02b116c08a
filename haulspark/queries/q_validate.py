"""Validation over the collected records: V1-V18, E1, E2, A24."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import validate as V
from ..plans.collected_view import COLLECTED_SQL, collected
from .registry import register
from .sqlbase import with_routes

_NUM = "[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?"
_DATE_FMTS = ["%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y %H:%M:%S",
              "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f"]


def _sql_date(x: str) -> str:
    return "coalesce(" + ", ".join(f"try_strptime({x}, '{f}')" for f in _DATE_FMTS) + ")"


def _sql_float(x: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({x}), '{_NUM}') THEN cast(trim({x}) AS DOUBLE) END"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_rule(rule: dict) -> tuple[str, str]:
    """(violated, suggested text) of a rule in DuckDB SQL, from its definition."""
    f, t, p = rule["field"], rule["type"], rule.get("params", {})
    v = f
    if t == "required":
        return f"({v} IS NULL OR trim({v}) = '')", v
    if t == "type":
        kind = p["type"]
        if kind == "float":
            conv = _sql_float(v)
        elif kind == "int":
            conv = f"CASE WHEN regexp_full_match(trim({v}), '[+-]?[0-9]+') THEN cast(trim({v}) AS BIGINT) END"
        else:
            conv = f"CASE WHEN {v} <> '' THEN {_sql_date(v)} END"
        return f"({v} IS NOT NULL AND ({conv}) IS NULL)", f"cast(({conv}) AS VARCHAR)"
    if t == "range":
        x = _sql_float(v)
        lo, hi = p.get("min"), p.get("max")
        return (f"({v} IS NOT NULL AND (({x}) IS NULL OR ({x}) < {lo} OR ({x}) > {hi}))",
                f"CASE WHEN ({x}) < {lo} THEN '{float(lo)}' WHEN ({x}) > {hi} THEN '{float(hi)}' ELSE {v} END")
    if t == "length":
        lo, hi = p.get("min", 0), p.get("max")
        return (f"({v} IS NOT NULL AND (length({v}) < {lo} OR length({v}) > {hi}))",
                f"CASE WHEN length({v}) > {hi} THEN substr({v}, 1, {hi}) ELSE {v} END")
    if t == "pattern":
        return f"({v} IS NOT NULL AND NOT regexp_matches({v}, {_q('^(?:' + p['pattern'] + ')')}))", v
    if t == "choices":
        ch = ", ".join(_q(str(c).lower()) for c in p["choices"])
        return f"({v} IS NOT NULL AND lower({v}) NOT IN ({ch}))", v
    if t == "email":
        return (f"({v} IS NOT NULL AND NOT (position('@' IN {v}) > 0 AND position('.' IN split_part({v}, '@', 2)) > 0))",
                f"trim({v})")
    if t == "phone":
        return f"({v} IS NOT NULL AND length(regexp_replace({v}, '[^0-9]', '', 'g')) <> 10)", f"trim({v})"
    if t == "date_range":
        d = _sql_date(v)
        lo, hi = p["min_date"], p["max_date"]
        return (f"({v} IS NOT NULL AND (({d}) IS NULL OR ({d}) < TIMESTAMP '{lo}' OR ({d}) > TIMESTAMP '{hi}'))",
                f"CASE WHEN ({d}) < TIMESTAMP '{lo}' THEN '{lo} 00:00:00' "
                f"WHEN ({d}) > TIMESTAMP '{hi}' THEN '{hi} 00:00:00' ELSE {v} END")
    if t == "positive":
        x = _sql_float(v)
        return f"({v} IS NOT NULL AND (({x}) IS NULL OR ({x}) <= 0))", f"coalesce(cast(({x}) AS VARCHAR), {v})"
    if t == "unique":
        return f"({v} IS NOT NULL AND count(*) OVER (PARTITION BY {v}) > 1)", v
    raise ValueError(t)


def _findings_sql(rules, key="record_key", src="collected") -> str:
    """CTE body: one flag + suggestion per rule."""
    parts = []
    for i, r in enumerate(rules):
        bad, sug = sql_rule(r)
        parts.append(f"CASE WHEN {bad} THEN 1 ELSE 0 END AS b{i}, {sug} AS s{i}, "
                     f"cast({r['field']} AS VARCHAR) AS v{i}")
    return f"SELECT {key}, " + ", ".join(parts) + f" FROM {src}"


def _report_sql(rules, key="record_key") -> str:
    sels = []
    for i, r in enumerate(rules):
        pos = " + ".join([f"b{j}" for j in range(i)]) or "0"
        sels.append(f"SELECT {key}, cast({pos} AS INTEGER) AS position, {_q(r['field'])} AS field_name, "
                    f"{_q(r['type'])} AS rule_type, {_q(r['severity'])} AS severity, {_q(r['message'])} AS message, "
                    f"v{i} AS value, s{i} AS suggested_value FROM fl WHERE b{i} = 1")
    return " UNION ALL ".join(sels)


def _with_fl(rules, body, src="collected"):
    return with_routes(f", {COLLECTED_SQL.strip()}, fl AS ({_findings_sql(rules, src=src)})\n{body}")


def _errs(rules):
    return " + ".join(f"b{i}" for i, r in enumerate(rules) if r["severity"] == V.ERROR)


def _warns(rules):
    return " + ".join(f"b{i}" for i, r in enumerate(rules) if r["severity"] == V.WARNING)


R = V.ROUTE_RULES


def _found(spark, sf, rules=R):
    return V.with_findings(collected(spark, sf), rules)


# ---------------------------------------------------------------- V12 / V13 / V14 / V16 / V18
@register("V12_record_findings", _with_fl(R, f"""
SELECT record_key, cast({' + '.join(f'b{i}' for i in range(len(R)))} AS INTEGER) AS n_findings,
       cast({_errs(R)} AS INTEGER) AS n_errors, cast({_warns(R)} AS INTEGER) AS n_warnings,
       concat_ws('; ', {', '.join(f"CASE WHEN b{i} = 1 THEN {_q(r['message'])} END" for i, r in enumerate(R))}) AS messages
FROM fl"""))
def v12(spark, sf):
    f = _found(spark, sf)
    fi = F.col("findings")
    return f.select("record_key", F.size(fi).alias("n_findings"),
                    F.size(F.filter(fi, lambda x: x["severity"] == V.ERROR)).alias("n_errors"),
                    F.size(F.filter(fi, lambda x: x["severity"] == V.WARNING)).alias("n_warnings"),
                    F.array_join(F.transform(fi, lambda x: x["message"]), "; ").alias("messages"))


@register("V13_batch_validation", _with_fl(R, f"""
SELECT count(*) AS total_records, count(*) FILTER (WHERE {_errs(R)} = 0) AS valid_records,
       count(*) FILTER (WHERE {_errs(R)} > 0) AS invalid_records,
       cast(sum({_errs(R)}) AS BIGINT) AS error_count, cast(sum({_warns(R)}) AS BIGINT) AS warning_count,
       sum({_errs(R)}) = 0 AS validation_passed
FROM fl"""))
def v13(spark, sf):
    return V.batch_summary(_found(spark, sf))


@register("V18_findings_report", _with_fl(R, _report_sql(R)))
def v18(spark, sf):
    return V.findings_report(_found(spark, sf), "record_key")


@register("V14_route_rule_set", _with_fl(R, f"""
SELECT field_name, rule_type, severity, count(*) AS violations FROM ({_report_sql(R)}) GROUP BY 1, 2, 3"""))
def v14(spark, sf):
    rep = V.findings_report(_found(spark, sf), "record_key")
    return rep.groupBy("field_name", "rule_type", "severity").agg(F.count(F.lit(1)).alias("violations"))


@register("V16_valid_records", _with_fl(R, f"""
SELECT c.record_key, c.route_id, c.route_date, c.total_miles, c.status
FROM collected c JOIN fl ON c.record_key = fl.record_key WHERE {_errs(R)} = 0"""))
def v16(spark, sf):
    valid, _ = V.split_valid(_found(spark, sf))
    return valid.select("record_key", "route_id", "route_date", "total_miles", "status")


@register("A24_error_summary", _with_fl(R, f"""
, rep AS ({_report_sql(R)}),
g AS (SELECT rule_type AS error_type, count(*) AS error_count, count(DISTINCT message) AS distinct_messages,
             min(message) AS example_message FROM rep GROUP BY 1),
top AS (SELECT error_type FROM g ORDER BY error_count DESC, error_type LIMIT 1)
SELECT g.*, g.error_type = (SELECT error_type FROM top) AS is_most_common FROM g""".replace("\n, rep AS", ", rep AS", 1)))
def a24(spark, sf):
    rep = V.findings_report(_found(spark, sf), "record_key")
    return A.error_summary(rep, "rule_type", "message").withColumnRenamed("rule_type", "error_type")


@register("A24_error_messages", _with_fl(R, f"""
, rep AS ({_report_sql(R)})
SELECT rule_type AS error_type, message, count(*) AS message_count FROM rep GROUP BY 1, 2""".replace("\n, rep AS", ", rep AS", 1)))
def a24_messages(spark, sf):
    rep = V.findings_report(_found(spark, sf), "record_key")
    return A.error_messages(rep, "rule_type", "message").withColumnRenamed("rule_type", "error_type")


# ---------------------------------------------------------------- single-rule queries V1-V11
SINGLE = {
    "V1_required": {"field": "route_id", "type": "required", "params": {}, "severity": V.ERROR,
                    "message": "Route ID is required"},
    "V2_type_date": {"field": "route_date", "type": "type", "params": {"type": "date"}, "severity": V.ERROR,
                     "message": "Route date must be a valid date"},
    "V3_range": {"field": "total_miles", "type": "range", "params": {"min": 0, "max": 5000},
                 "severity": V.WARNING, "message": "Total miles out of range"},
    "V4_length": {"field": "route_id", "type": "length", "params": {"min": 1, "max": 50},
                  "severity": V.ERROR, "message": "Route ID must be 1-50 characters"},
    "V5_pattern": {"field": "email", "type": "pattern", "params": {"pattern": r"[a-z]+\d*@"},
                   "severity": V.WARNING, "message": "Email must start with a lower-case mailbox"},
    "V6_choices": {"field": "status", "type": "choices",
                   "params": {"choices": ["scheduled", "in_progress", "completed", "cancelled", "delayed"],
                              "case_sensitive": False}, "severity": V.WARNING, "message": "Unknown status"},
    "V7_email": {"field": "email", "type": "email", "params": {}, "severity": V.WARNING,
                 "message": "Invalid email format"},
    "V8_phone": {"field": "phone", "type": "phone", "params": {}, "severity": V.WARNING,
                 "message": "Invalid phone number format"},
    "V9_date_range": {"field": "route_date", "type": "date_range",
                      "params": {"min_date": "1996-01-01", "max_date": "1999-12-31"},
                      "severity": V.WARNING, "message": "Route date outside 1996-1999"},
    "V10_positive": {"field": "total_miles", "type": "positive", "params": {}, "severity": V.WARNING,
                     "message": "Total miles should be positive"},
}


def _single(name, rule):
    @register(name, _with_fl([rule], _report_sql([rule])))
    def q(spark, sf):
        return V.findings_report(_found(spark, sf, [rule]), "record_key")
    q.__name__ = name
    return q


for _n, _r in SINGLE.items():
    _single(_n, _r)

UNIQUE_RULE = {"field": "natural_key", "type": "unique", "params": {}, "severity": V.WARNING,
               "message": "Duplicate order line in batch"}


@register("V11_unique_in_batch", with_routes(f"""
, nk AS (SELECT route_key AS record_key, cast(order_key AS VARCHAR) || '-' || cast(line_no AS VARCHAR) AS natural_key
         FROM routes),
fl AS ({_findings_sql([UNIQUE_RULE], src='nk')})
{_report_sql([UNIQUE_RULE])}""".replace("\n, nk AS", ", nk AS", 1)))
def v11(spark, sf):
    """Uniqueness built for real: (order, line) repeats in lineitem."""
    from ..plans.routes_view import routes
    nk = routes(spark, sf, ("route_key", "order_key", "line_no")).select(
        F.col("route_key").alias("record_key"),
        F.concat_ws("-", F.col("order_key").cast("string"), F.col("line_no").cast("string")).alias("natural_key"))
    return V.findings_report(V.with_findings(nk, [UNIQUE_RULE]), "record_key")


# ---------------------------------------------------------------- V15 configured rules
CONFIG_RULES = {
    "customer_name": [{"type": "required"}, {"type": "length", "params": {"min": 3, "max": 40}}],
    "revenue": [{"type": "range", "params": {"min": 0, "max": 100000}, "severity": "error"}],
}
V15_RULES = V.rules_from_config(CONFIG_RULES)


@register("V15_configured_rules", _with_fl(V15_RULES, _report_sql(V15_RULES)))
def v15(spark, sf):
    return V.findings_report(_found(spark, sf, V15_RULES), "record_key")


V15_FILE = {"name": "route_data_validator", "rules": [
    {"field_name": "route_id", "rule_type": "required", "severity": "error", "message": "Route ID is required"},
    {"field_name": "total_miles", "rule_type": "range", "parameters": {"min": 0, "max": 500}, "message": "Miles out of range"}]}
V15_FILE_RULES = V.rules_from_config(V15_FILE)


@register("V15_rules_of_a_validator_file", _with_fl(V15_FILE_RULES, _report_sql(V15_FILE_RULES)))
def v15_file(spark, sf):
    """The same from the shape of a validator's configuration file."""
    return V.findings_report(_found(spark, sf, V15_FILE_RULES), "record_key")


# ---------------------------------------------------------------- E1 / E2 extension surface
V.register_validator("multiple_of", lambda v, p: (
    F.coalesce(F.pmod(v.try_cast("double"), F.lit(float(p["step"]))) == 0, F.lit(False)), v.cast("string")))
E1_RULE = {"field": "total_miles", "type": "multiple_of", "params": {"step": 40}, "severity": V.WARNING,
           "message": "Miles should be a multiple of {step}, not {value}"}
E2_RULE = {"field": "customer_name", "type": "record", "severity": V.WARNING,
           "message": "Record {record_index}: miles without a customer",
           "params": {"fn": lambda v, rec: (v.isNotNull() | rec["total_miles"].isNull(),
                                            F.concat(F.lit("Customer of "), rec["driver_name"]))}}


@register("E1_custom_validator", with_routes(f"""
, {COLLECTED_SQL.strip()}
SELECT record_key, 0 AS position, 'total_miles' AS field_name, 'multiple_of' AS rule_type,
       'warning' AS severity, 'Miles should be a multiple of 40, not ' || coalesce(total_miles, 'None') AS message,
       total_miles AS value, total_miles AS suggested_value
FROM collected
WHERE try_cast(total_miles AS DOUBLE) IS NULL
      OR try_cast(total_miles AS DOUBLE) - 40 * floor(try_cast(total_miles AS DOUBLE) / 40) <> 0""".replace(
    "\n, collected AS", ", collected AS", 1)))
def e1(spark, sf):
    return V.findings_report(_found(spark, sf, [E1_RULE]), "record_key")


@register("E2_record_rule", with_routes(f"""
, {COLLECTED_SQL.strip()}
SELECT record_key, 0 AS position, 'customer_name' AS field_name, 'record' AS rule_type,
       'warning' AS severity, 'Record ' || record_key || ': miles without a customer' AS message,
       customer_name AS value, 'Customer of ' || driver_name AS suggested_value
FROM collected WHERE customer_name IS NULL AND total_miles IS NOT NULL""".replace(
    "\n, collected AS", ", collected AS", 1)))
def e2(spark, sf):
    """The rule sees the NULL customer and the rest of its record."""
    return V.findings_report(V.with_findings(collected(spark, sf), [E2_RULE], index="record_key"), "record_key")
