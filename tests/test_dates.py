"""Dates in text, in the shapes that files have them."""

import datetime as dt

import pytest

from tablewright.operators import prepare

MOMENT = dt.datetime(2024, 3, 5, 14, 7, 9)
CASES = {
    "2024-03-05": dt.datetime(2024, 3, 5),
    "2024-3-5": dt.datetime(2024, 3, 5),
    "  2024-03-05 ": dt.datetime(2024, 3, 5),
    "2024-03-05 14:07": dt.datetime(2024, 3, 5, 14, 7),
    "2024-03-05 14:07:09": MOMENT,
    "2024-03-05T14:07:09": MOMENT,
    "2024-03-05T14:07:09Z": MOMENT,
    "2024-03-05T14:07:09.25Z": MOMENT.replace(microsecond=250000),
    "2024-03-05T14:07:09.123456789Z": MOMENT.replace(microsecond=123456),
    "2024-03-05T16:07:09+02:00": MOMENT,
    "2024-03-05T16:07:09+0200": MOMENT,
    "2024-03-05 16:07:09.5 +02:00": MOMENT.replace(microsecond=500000),
    "2024/3/5 4:07": dt.datetime(2024, 3, 5, 4, 7),
    "2024.03.05": dt.datetime(2024, 3, 5),
    "3/5/2024": dt.datetime(2024, 3, 5),
    "03/05/2024 2:07 PM": dt.datetime(2024, 3, 5, 14, 7),
    "03/05/2024 02:07:09 pm": MOMENT,
    "12/31/2024 12:00 AM": dt.datetime(2024, 12, 31),
    "25/03/2024": dt.datetime(2024, 3, 25),
    "25-3-2024": dt.datetime(2024, 3, 25),
    "25.03.2024 14:07": dt.datetime(2024, 3, 25, 14, 7),
    "20240305": dt.datetime(2024, 3, 5),
    "20240305T140709Z": MOMENT,
    "5 Mar 2024": dt.datetime(2024, 3, 5),
    "05-MAR-2024": dt.datetime(2024, 3, 5),
    "5 march 2024 14:07": dt.datetime(2024, 3, 5, 14, 7),
    "March 5, 2024": dt.datetime(2024, 3, 5),
    "Mar 5 2024 2:07 PM": dt.datetime(2024, 3, 5, 14, 7),
    "May 5, 2024": dt.datetime(2024, 5, 5),
    "2024-Mar-05": dt.datetime(2024, 3, 5),
}
NONE = [
    "", " ", "2024", "12.5", "1.2.3", "3 May", "2024-13-40", "31/31/2024", "2024-02-30", "Mai 5, 2024", "20241399", "1234567",
    "2024-03-05 25:00", "2024-03-05x", "id-2024-03-05", "5 apples 2024", None, "2024-03-05 13:07 PM", "9" * 5000,
]


def test_shapes(spark):
    rows = [(t,) for t in [*CASES, *NONE]]
    frame = spark.createDataFrame(rows, "`a day` string")
    got = {r["a day"]: r["ts"] for r in frame.select("`a day`", prepare.parse_date("a day").alias("ts")).collect()}
    assert {t: got[t] for t in CASES} == CASES
    assert {t: got[t] for t in NONE} == dict.fromkeys(NONE)


@pytest.mark.parametrize("good, is_date", [(19, True), (18, False)])
def test_more_than_nine_tenths(spark, good, is_date):
    shapes = list(CASES)[:good]
    frame = spark.createDataFrame([(t,) for t in [*shapes, *["n/a"] * (20 - good)]], "c string")
    assert prepare.datetime_share(frame).first()["is_date"] is is_date
