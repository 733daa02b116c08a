"""Values of a record are computed once, and formats that cannot parse are not tried."""

import re

import __spark_entry__ as E
from haulspark.functions import clean as C
from haulspark.operators import standardize as P
from sf import SF_SMALL


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_members_of_a_built_struct_are_built_once(spark):
    raw = spark.range(3).selectExpr("named_struct('name', 'ann', 'phone', reverse(cast(id as string)), 'email', '') customer")
    assert _optimized(P.clean_nested_record(raw)).count("reverse(") == 1


def test_a_format_whose_fields_are_out_of_range_is_not_tried(spark):
    assert not re.match(C._shape("M/d/yyyy"), "25/12/2020") and re.match(C._shape("d/M/yyyy"), "25/12/2020")
    assert not re.match(C._shape("yyyy-M-d H:m"), "2020-01-01 24:00")


def test_words_abbreviations_and_phones_as_before(spark):
    rows = {"o'neil  5th STREET": "O'Neil 5Th St", "1 northeast parkway": "1 NE Pkwy", "étreet street": "Étreet St", "x_street a-road": "X_Street A-Rd"}
    df = spark.createDataFrame(list(rows.items()), "t string, w string")
    assert df.select(C.clean_address("t").eqNullSafe(df.w).alias("same")).filter("NOT same").count() == 0
    phones = spark.createDataFrame([("1 212 555 0100",), ("2125550100",), ("22125550100",), ("1555123456",)], "t string")
    assert [r[0] for r in phones.select(C.clean_phone("t")).collect()] == ["(212) 555-0100", "(212) 555-0100", None, "(155) 512-3456"]


def test_a_manual_document_is_parsed_once(spark):
    assert _optimized(E.queries()["P10_manual_type_checks"](spark, SF_SMALL)).count("parseJson") <= 1


def test_errors_are_found_once_for_their_summary(spark):
    assert "lineitem" not in _optimized(E.queries()["A24_error_summary"](spark, SF_SMALL))
