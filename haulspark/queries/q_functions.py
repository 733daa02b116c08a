"""Scalar functions over whole tables: C1-C11, C19-C24."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as C
from ..operators.window import chunk_ids
from ..plans.routes_view import routes
from ..sources.tables import table
from .registry import register
from .sqlbase import with_routes


def _r(spark, sf, *cols):
    return routes(spark, sf, ("route_key",) + cols)


# ---------------------------------------------------------------- C1 phone
@register("C1_clean_phone", with_routes("""
SELECT route_key, raw_phone,
  CASE WHEN length(d) = 10 THEN '(' || substr(d, 1, 3) || ') ' || substr(d, 4, 3) || '-' || substr(d, 7, 4)
       WHEN length(d) = 11 AND substr(d, 1, 1) = '1'
         THEN '(' || substr(d, 2, 3) || ') ' || substr(d, 5, 3) || '-' || substr(d, 8, 4) END AS phone
FROM (SELECT route_key, raw_phone, regexp_replace(raw_phone, '[^0-9]', '', 'g') AS d FROM routes)"""))
def c1(spark, sf):
    return _r(spark, sf, "raw_phone").select("route_key", "raw_phone", C.clean_phone("raw_phone").alias("phone"))


# ---------------------------------------------------------------- C2 email
@register("C2_clean_email", with_routes("""
SELECT route_key, raw_email,
  CASE WHEN regexp_full_match(lower(trim(raw_email)), '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}')
       THEN lower(trim(raw_email)) END AS email
FROM routes"""))
def c2(spark, sf):
    return _r(spark, sf, "raw_email").select("route_key", "raw_email", C.clean_email("raw_email").alias("email"))


# ---------------------------------------------------------------- C3 zip
@register("C3_clean_zip", with_routes("""
SELECT route_key, raw_zip,
  CASE WHEN regexp_full_match(replace(trim(raw_zip), ' ', ''), '[0-9]{5}(-[0-9]{4})?')
       THEN replace(trim(raw_zip), ' ', '') END AS zip_code
FROM routes"""))
def c3(spark, sf):
    return _r(spark, sf, "raw_zip").select("route_key", "raw_zip", C.clean_zip("raw_zip").alias("zip_code"))


# ---------------------------------------------------------------- C4 state
_STATE_VALUES = ", ".join([f"('{v}', '{v}')" for v in sorted(set(C.US_STATES.values()))]
                          + [f"('{k}', '{v}')" for k, v in C.US_STATES.items()])


@register("C4_clean_state", with_routes(f"""
, st(k, code) AS (VALUES {_STATE_VALUES})
SELECT route_key, raw_state, st.code AS state
FROM routes LEFT JOIN st ON upper(trim(routes.raw_state)) = st.k"""))
def c4(spark, sf):
    return _r(spark, sf, "raw_state").select("route_key", "raw_state", C.clean_state("raw_state").alias("state"))


# ---------------------------------------------------------------- C5 / C9 / C10 / C11
def _title_sql(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '(\\p{{L}}+|[^\\p{{L}}]+)'), "
            f"lambda p: upper(p[1]) || lower(p[2:])), '')")


def _abbrev_sql(x: str) -> str:
    for full, abbr in C.ADDRESS_ABBREVIATIONS:
        x = f"regexp_replace({x}, '\\b{full}\\b', '{abbr}', 'gi')"
    return x


@register("C5_clean_address", with_routes(f"""
SELECT route_key, raw_address,
  CASE WHEN trim(raw_address) <> '' THEN
    {_abbrev_sql(_title_sql("regexp_replace(trim(raw_address), '\\s+', ' ', 'g')"))} END AS address
FROM routes"""))
def c5(spark, sf):
    return _r(spark, sf, "raw_address").select("route_key", "raw_address",
                                               C.clean_address("raw_address").alias("address"))


@register("C9_fold_whitespace", with_routes("""
SELECT route_key, coalesce(trim(regexp_replace(raw_address, '\\s+', ' ', 'g')), '') AS folded FROM routes"""))
def c9(spark, sf):
    return _r(spark, sf, "raw_address").select("route_key", C.fold_ws("raw_address").alias("folded"))


@register("C10_title_case_names", with_routes(f"""
SELECT route_key, raw_city, CASE WHEN trim(raw_city) <> '' THEN {_title_sql('trim(raw_city)')} END AS city
FROM routes"""))
def c10(spark, sf):
    return _r(spark, sf, "raw_city").select("route_key", "raw_city", C.clean_name("raw_city").alias("city"))


@register("C11_full_address", with_routes("""
SELECT route_key, concat_ws(', ',
  nullif(coalesce(trim(regexp_replace(raw_address, '\\s+', ' ', 'g')), ''), ''),
  nullif(coalesce(trim(regexp_replace(raw_city, '\\s+', ' ', 'g')), ''), ''),
  nullif(coalesce(trim(regexp_replace(raw_state, '\\s+', ' ', 'g')), ''), ''),
  nullif(coalesce(trim(regexp_replace(raw_zip, '\\s+', ' ', 'g')), ''), '')) AS full_address
FROM routes"""))
def c11(spark, sf):
    r = _r(spark, sf, "raw_address", "raw_city", "raw_state", "raw_zip")
    return r.select("route_key", C.full_address("raw_address", "raw_city", "raw_state", "raw_zip")
                    .alias("full_address"))


# ---------------------------------------------------------------- C6 / C7 dates
_C6_FORMATS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y %H:%M",
               "%m/%d/%Y", "%m-%d-%Y %H:%M:%S", "%m-%d-%Y %H:%M", "%m-%d-%Y", "%Y/%m/%d %H:%M:%S",
               "%Y/%m/%d %H:%M", "%Y/%m/%d"]
_C7_FORMATS = ["%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y %H:%M:%S",
               "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f"]


def _coalesce_parse(x, fmts):
    return "coalesce(" + ", ".join(f"try_strptime({x}, '{f}')" for f in fmts) + ")"


@register("C6_clean_datetime", with_routes(
    f"SELECT route_key, raw_date, {_coalesce_parse('raw_date', _C6_FORMATS)} AS parsed FROM routes"))
def c6(spark, sf):
    return _r(spark, sf, "raw_date").select("route_key", "raw_date", C.clean_datetime("raw_date").alias("parsed"))


@register("C7_parse_date", with_routes(
    f"SELECT route_key, raw_date, {_coalesce_parse('raw_date', _C7_FORMATS)} AS parsed FROM routes"))
def c7(spark, sf):
    return _r(spark, sf, "raw_date").select("route_key", "raw_date", C.parse_date("raw_date").alias("parsed"))


# ---------------------------------------------------------------- C8 numbers
_NUM = "[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?"


@register("C8_clean_numeric", with_routes(f"""
SELECT route_key, raw_amount,
  CASE WHEN regexp_full_match(regexp_replace(trim(raw_amount), '[,$%]', '', 'g'), '{_NUM}')
       THEN cast(regexp_replace(trim(raw_amount), '[,$%]', '', 'g') AS DOUBLE) END AS amount,
  CASE WHEN regexp_full_match(trim(raw_amount), '{_NUM}') THEN cast(trim(raw_amount) AS DOUBLE) END AS amount_plain,
  CASE WHEN regexp_full_match(trim(cast(line_no AS VARCHAR)), '[+-]?[0-9]+')
       THEN cast(trim(cast(line_no AS VARCHAR)) AS BIGINT) END AS line_int
FROM routes"""))
def c8(spark, sf):
    r = _r(spark, sf, "raw_amount", "line_no")
    return r.select("route_key", "raw_amount", C.to_number("raw_amount").alias("amount"),
                    C.to_float("raw_amount").alias("amount_plain"), C.to_int("line_no").alias("line_int"))


# ---------------------------------------------------------------- C19 / C20 formatting
@register("C19_format_values", with_routes("""
SELECT route_key, '$' || format('{:,.2f}', coalesce(revenue, 0.0)) AS revenue_text,
       format('{:.2f}', coalesce(empty_miles / total_miles * 100, 0.0)) || '%' AS deadhead_text,
       format('{:,.1f}', coalesce(total_miles, 0.0)) || ' mi' AS miles_text
FROM routes"""))
def c19(spark, sf):
    r = _r(spark, sf, "revenue", "empty_miles", "total_miles")
    return r.select("route_key", C.fmt_currency("revenue").alias("revenue_text"),
                    C.fmt_percentage(F.col("empty_miles") / F.col("total_miles") * 100).alias("deadhead_text"),
                    C.fmt_miles("total_miles").alias("miles_text"))


@register("C20_format_file_size", """
SELECT page_id, b AS size_bytes,
  CASE WHEN b = 0 THEN '0 B'
       WHEN b < 1024 THEN format('{:.1f}', cast(b AS DOUBLE)) || ' B'
       WHEN b < 1024 * 1024 THEN format('{:.1f}', b / cast(1024 AS DOUBLE)) || ' KB'
       WHEN b < 1024 * 1024 * 1024 THEN format('{:.1f}', b / cast(1024 AS DOUBLE) / 1024) || ' MB'
       ELSE format('{:.1f}', b / cast(1024 AS DOUBLE) / 1024 / 1024) || ' GB' END AS size_text
FROM (SELECT page_id, octet_length(encode(html)) * page_id AS b FROM pages)""")
def c20(spark, sf):
    p = table(spark, sf, "pages")
    b = (F.octet_length("html") * F.col("page_id")).alias("size_bytes")
    return p.select("page_id", b).select("page_id", "size_bytes", C.fmt_file_size("size_bytes").alias("size_text"))


# ---------------------------------------------------------------- C21-C24 dates and chunks
@register("C21_business_days", with_routes("""
SELECT route_key, route_date, cast(route_date + to_days(line_no * 4) AS DATE) AS until_date,
  cast(len(list_filter(generate_series(cast(route_date AS TIMESTAMP),
                                       cast(route_date + to_days(line_no * 4) AS TIMESTAMP),
                                       INTERVAL 1 DAY), lambda x: isodow(x) <= 5)) AS INTEGER) AS business_days,
  array_to_string(list_transform(list_filter(generate_series(
    cast(route_date AS TIMESTAMP), cast(route_date + to_days(line_no * 4) AS TIMESTAMP), INTERVAL 1 DAY),
    lambda x: isodow(x) <= 5), lambda x: strftime(x, '%Y-%m-%d')), ',') AS business_dates
FROM routes"""))
def c21(spark, sf):
    r = _r(spark, sf, "route_date", "line_no")
    until = F.date_add("route_date", F.col("line_no") * 4)
    return r.select("route_key", "route_date", until.alias("until_date"),
                    C.business_days(F.col("route_date"), until).alias("business_days"),
                    F.array_join(C.business_dates("route_date", until).cast("array<string>"), ",").alias("business_dates"))


@register("C22_duration_parts", with_routes("""
SELECT route_key, floor(s / 3600) AS hours, floor((s - 3600 * floor(s / 3600)) / 60) AS minutes,
       s - 60 * floor(s / 60) AS seconds, s AS total_seconds, s / 60 AS total_minutes, s / 3600 AS total_hours
FROM (SELECT route_key, (epoch_us(actual_end) - epoch_us(actual_start)) / 1e6 AS s FROM routes)"""))
def c22(spark, sf):
    r = _r(spark, sf, "actual_start", "actual_end")
    return r.select("route_key", C.duration_parts("actual_start", "actual_end").alias("d")).select("route_key", "d.*")


@register("C23_period_bounds", with_routes("""
SELECT DISTINCT route_date AS day, cast(date_trunc('week', route_date) AS DATE) AS week_start,
       cast(date_trunc('week', route_date) AS DATE) + 6 AS week_end,
       cast(date_trunc('month', route_date) AS DATE) AS month_start, last_day(route_date) AS month_end
FROM routes"""))
def c23(spark, sf):
    r = routes(spark, sf, ("route_date",)).select("route_date").distinct()
    return r.select(C.period_bounds("route_date").alias("p")).select("p.*")


CHUNK_SIZE = 1000


@register("C24_chunk_ids", with_routes(f"""
SELECT route_key, (row_number() OVER (ORDER BY route_key) - 1) // {CHUNK_SIZE} AS chunk_id FROM routes"""))
def c24(spark, sf):
    return chunk_ids(_r(spark, sf), ["route_key"], CHUNK_SIZE)
