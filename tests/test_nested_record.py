"""P18 cleans the whole nested record."""

import datetime

import __spark_entry__ as E
from haulspark.operators import standardize as P

from sf import SF_SMALL


def test_every_field_of_the_record_comes_out(spark):
    df = E.queries()["P18_clean_nested_record"](spark, SF_SMALL)
    fields = (*P.NESTED_LOCATIONS, *P.NESTED_PARTIES, *P.NESTED_NUMBERS, *P.NESTED_TIMES, *P.NESTED_TEXTS, "vehicle")
    assert set(df.columns) == {"route_key", *fields}
    types = dict(df.dtypes)
    assert all(types[c] == "double" for c in P.NESTED_NUMBERS) and all(types[c].startswith("timestamp") for c in P.NESTED_TIMES)
    rows = df.collect()
    for c in set(fields) - {"notes"}:
        assert any(r[c] is not None for r in rows), c
    assert not {r.status for r in rows if r.status != r.status.strip()}


def test_record_is_cleaned_and_the_rest_kept(spark):
    place = "named_struct('address', '1 main st', 'city', ' new york ', 'state', 'new york', 'zip_code', '10001', 'latitude', 1.5D)"
    person = "named_struct('name', 'ann lee', 'phone', '212-555-0100', 'email', 'A@B.COM', 'hourly_rate', 20)"
    r = P.clean_nested_record(spark.range(1).selectExpr(
        f"{place} start_location", f"{place} end_location", f"{person} driver", f"{person} customer", "'06/02/1997' route_date",
        "'$1,200.50' revenue", "'1997-06-02 08:00:00' actual_start_time", "' open ' status", "'' notes")).first()
    for s in (r.start_location, r.end_location):
        assert (s.city, s.state, s.latitude) == ("New York", "NY", 1.5)
    for p in (r.driver, r.customer):
        assert (p.name, p.phone, p.email, p.hourly_rate) == ("Ann Lee", "(212) 555-0100", "a@b.com", 20)
    assert str(r.route_date)[:10] == "1997-06-02" and r.actual_start_time == datetime.datetime(1997, 6, 2, 8)
    assert (r.revenue, r.status, r.notes) == (1200.5, "open", None)


def test_plain_texts_are_read_without_formats_or_stripping(spark):
    """ISO texts by a cast and plain numbers as they are; the others, and texts near the shape, as before."""
    from pyspark.sql import functions as F
    from haulspark.functions import clean as C
    ntz = lambda *t: datetime.datetime(*t)
    dates = {"1997-06-02 08:00:00": ntz(1997, 6, 2, 8), "1997-6-2 8:5:7": ntz(1997, 6, 2, 8, 5, 7), "2000-02-29": ntz(2000, 2, 29), "1999-02-29": None,
             "1997-06-02 24:00:00": None, "1997-13-02": None, "1997-06-02 08:00": ntz(1997, 6, 2, 8), "0999-01-02": ntz(999, 1, 2),
             "1997-06-02 08:00:00\n": None, " 1997-06-02": None, "1997-06-02 08:00:00Z": None, "1997-06-02 08:00:00.5": None, "06/02/1997": ntz(1997, 6, 2), "": None}
    numbers = {"1200.50": 1200.5, "$1,200.50": 1200.5, "7%": 7.0, " -1e3 ": -1000.0, "$": None, "1d": None, "NaN": None, "": None, "1,2,3": 123.0, ".5": 0.5}
    for values, clean in ((dates, C.clean_datetime), (numbers, C.to_number)):
        df = spark.createDataFrame([(v,) for v in values], "v string")
        assert {r.v: r.got for r in df.select("v", clean("v").alias("got")).collect()} == values
    plan = spark.range(1).select(C.clean_datetime(F.col("id").cast("string")), C.to_number("id"))._jdf.queryExecution().analyzed().toString()
    assert C.ISO_SHAPE in plan and plan.index("cast(trim") < plan.index("translate(")
