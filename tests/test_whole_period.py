"""The export and KPI queries over the whole fact reach every route."""

import pytest

import __spark_entry__ as E

from sf import SF_SMALL

NAMES = ["A18_kpi_metrics", "A19_formula_kpis", "E4_report_template", "S13_csv_export", "S14_json_export", "S15_multi_format_export"]


@pytest.mark.parametrize("name", NAMES)
def test_every_route_is_reached(spark, duck, name):
    rows = duck.execute("SELECT count(*) FROM lineitem").fetchone()[0]
    got = [r.asDict() for r in E.queries()[f"{name}_all"](spark, SF_SMALL).collect()]
    if name[0] == "S":
        assert {r["rows"] for r in got if r["section"] == "routes"} == {rows}
    else:
        assert [r["total_routes"] for r in got] == [rows]
