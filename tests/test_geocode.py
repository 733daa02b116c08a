"""Geocoding with a kept table of resolved addresses."""

from haulspark.operators import join as J
from haulspark.session import scratch_path
from haulspark.sources import store as ST

POINT = "id int, address string, city string, state string, zip_code string"


def test_levels_and_the_second_run(spark):
    gaz = spark.createDataFrame([(1, "1 Elm, Ames, IA, 50010", 1.0, 1.0), (2, "50010", 2.0, 2.0), (2, "50010", 2.5, 9.0),
                                 (3, "ames, ia", 3.0, 3.0)], "level int, key string, latitude double, longitude double")
    first = spark.createDataFrame([(1, "1 Elm", "Ames", "IA", "50010"), (2, "2 Oak", "Ames", "IA", "50010"), (3, "3 Ash", "Ames", "IA", None),
                                   (4, "4 Fir", "Boone", "IA", ""), (5, None, "Ames", "IA", "50010"), (6, "", None, None, None),
                                   (7, "1 Elm", "Ames", "IA", "50010")], POINT)
    store = ST.Store(spark, scratch_path(spark, "t-geocodes"))
    got = {r["id"]: (r["level"], r["latitude"]) for r in J.geocode_kept(first, gaz, store).collect()}
    assert got == {1: (1, 1.0), 2: (2, 2.0), 3: (3, 3.0), 4: (None, None), 5: (None, None), 6: (None, None), 7: (1, 1.0)}
    kept = {r["full_address"]: r["id"] for r in store.read("geocodes").collect()}
    assert set(kept) == {"1 Elm, Ames, IA, 50010", "2 Oak, Ames, IA, 50010", "3 Ash, Ames, IA"}
    # another gazetteer: what is resolved stays, the miss of the first run is asked again
    other = spark.createDataFrame([(3, "boone, ia", 7.0, 7.0), (3, "ames, ia", 8.0, 8.0)], "level int, key string, latitude double, longitude double")
    second = spark.createDataFrame([(1, "1 Elm", "Ames", "IA", "50010"), (4, "4 Fir", "Boone", "IA", ""), (8, "8 Yew", "Ames", "IA", None)], POINT)
    got = {r["id"]: (r["level"], r["latitude"]) for r in J.geocode_kept(second, other, store).collect()}
    assert got == {1: (1, 1.0), 4: (3, 7.0), 8: (3, 8.0)}
    assert {r["full_address"]: r["id"] for r in store.read("geocodes").collect()}.items() >= kept.items()


def test_no_match_at_all(spark):
    store = ST.Store(spark, scratch_path(spark, "t-geocodes-none"))
    points = spark.createDataFrame([(1, "1 Elm", "Ames", "IA", "50010")], POINT)
    gaz = spark.createDataFrame([], "level int, key string, latitude double, longitude double")
    assert [r["latitude"] for r in J.geocode_kept(points, gaz, store).collect()] == [None]


def test_notification_conditions(spark):
    import pytest
    alerts = spark.createDataFrame([(1, "e", "info", "3"), (2, "e", "ERROR", "5"), (3, "e", None, "9"), (4, "e", "odd", None), (5, "f", "CRITICAL", "1")],
                                   "alert_id int, alert_type string, severity string, n string")
    members = spark.createDataFrame([("g", "x@y"), ("h", "x@y"), ("h", "z@y")], "group_name string, email string")

    def routed(*conditions, enabled=True):
        rules = {"e": {"enabled": enabled, "recipients": ["g", "h"], "conditions": list(conditions)}}
        return sorted((r.alert_id, r.email) for r in J.route_alerts(alerts, rules, members).collect())

    assert routed("severity >= WARNING") == [(2, "x@y"), (2, "z@y")]
    assert {i for i, _ in routed("n > 4")} == {2, 3} and {i for i, _ in routed("n > 4", "severity = error")} == {2}
    assert {i for i, _ in routed()} == {1, 2, 3, 4} and routed(enabled=False) == [] and {i for i, _ in routed("severity != odd")} == {1, 2}
    with pytest.raises(ValueError, match="not understood"):
        J.condition("severity about WARNING")


def test_rules_of_a_validator_file():
    import pytest
    from haulspark.operators import validate as V
    rule = {"field_name": "a", "rule_type": "required", "message": "m"}
    assert V.rules_from_config({"name": "n", "rules": [rule]}) == [{"field": "a", "type": "required", "params": {}, "severity": "warning", "message": "m"}]
    with pytest.raises(ValueError, match="severity"):
        V.rules_from_config({"rules": [{**rule, "severity": "fatal"}]})
    with pytest.raises(KeyError):
        V.rules_from_config({"rules": [{"field_name": "a", "rule_type": "required"}]})
