from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from newsloom.functions import dates as D


def day(spark, text, rule):
    return spark.createDataFrame([(text,)], "s string").select(rule("s")).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("2024-08-01T01:30:00+05:30", date(2024, 8, 1)),
        ("2024-08-01", date(2024, 8, 1)),
        ("Aug 2, 2024, 10:00 AM IST", date(2024, 8, 2)),
        ("Thu, 01 Aug 2024 23:59:59 GMT", date(2024, 8, 1)),
        ("sept. 3 2021", date(2021, 9, 3)),
        ("4 March 2020", date(2020, 3, 4)),
        ("December 25th, 2019", date(2019, 12, 25)),
        ("2/3/2024", date(2024, 2, 3)),
        ("2024/2/3", date(2024, 2, 3)),
        ("20240203", date(2024, 2, 3)),
        ("2024-02-30", None),
        ("Feb 30, 2024", None),
        ("marching 4 2020", None),
        ("soon", None),
        ("", None),
        (None, None),
    ],
)
def test_lenient(spark, text, want):
    assert day(spark, text, D.lenient_date) == want


def test_strict(spark):
    assert day(spark, "2024-03-04T23:10:00-08:00", D.strict_date) == date(2024, 3, 4)
    assert day(spark, None, D.strict_date) is None
    with pytest.raises(Exception, match="unreadable date"):
        day(spark, "soon", D.strict_date)


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata", "America/New_York"])
def test_utc_in_any_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert day(spark, "2024-08-01T01:30:00+05:30", D.utc_date) == date(2024, 7, 31)
        assert day(spark, "2024-12-31T22:00:00-05:00", D.utc_date) == date(2025, 1, 1)
        assert day(spark, "2024-12-31T22:00:00", D.utc_date) == date(2024, 12, 31)
        assert day(spark, "2024-12-31", D.utc_date) == date(2024, 12, 31)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    with pytest.raises(Exception, match="unreadable date"):
        day(spark, "soon", D.utc_date)


def test_ordinal(spark):
    assert day(spark, "Thu, Aug 1st, 2024", D.ordinal_date) == date(2024, 8, 1)
    with pytest.raises(Exception, match="unreadable date"):
        day(spark, "2024-08-01", D.ordinal_date)


def test_range_and_end(spark):
    days = [r[0] for r in D.date_range(spark, "2024-02-27", "2024-03-01").collect()]
    assert days == [date(2024, 2, 27), date(2024, 2, 28), date(2024, 2, 29), date(2024, 3, 1)]
    end = spark.range(1).select(D.newsletter_end(F.to_date(F.lit("2024-03-01")))).first()[0]
    assert end == date(2024, 2, 28)
