import datetime as dt

import pytest

from cairnlog.functions.stamps import parser_of
from cairnlog.functions.zones import ZoneTable
from cairnlog.operators.timestamps import instants

UTC = dt.timezone.utc


def ms(*a, us=0):
    return int(dt.datetime(*a, tzinfo=UTC).timestamp()) * 1000 + us


def resolve(spark, stamps, logs):
    s = spark.createDataFrame([("t", i, c, x, "clash") for i, (c, x) in enumerate(stamps)], "src string, row_id long, case_id string, stamp string, zone string")
    d = spark.createDataFrame([(c, z, y) for c, z, y in logs], "case_id string, local_zone string, yearless_reference_year int")
    return {r.row_id: r.epoch_ms for r in instants(s, d).collect()}


@pytest.mark.parametrize("text,want", [
    ("2024-05-01T10:00:00Z", ms(2024, 5, 1, 10)), ("2024-05-01 10:00:00,123", ms(2024, 5, 1, 8, us=123)), ("2024-05-01T10:00:00.999999999Z", ms(2024, 5, 1, 10, us=999)),
    ("2024-05-01T10:00:00+02:00[Europe/Berlin]", ms(2024, 5, 1, 8)), ("[2024-05-01T10:00:00.5+0530]", ms(2024, 5, 1, 4, 30, us=500)), ("20240501T100000Z", ms(2024, 5, 1, 10)),
    ("01/May/2024:10:00:00 -0500", ms(2024, 5, 1, 15)), ("Wed, 01 May 2024 10:00:00 +0000", ms(2024, 5, 1, 10)), ("Wed May  1 10:00:00 2024", ms(2024, 5, 1, 8)),
    ("1. Mai 2024 10:00:00", ms(2024, 5, 1, 8)), ("2. Mär 2024 10:00:00", ms(2024, 3, 2, 9)), ("2024-05-01 12:00:00 AM", ms(2024, 4, 30, 22)), ("01.05.2024 10:00:00", ms(2024, 5, 1, 8)),
    ("2024-05-01 10:00:00 EDT", ms(2024, 5, 1, 14)), ("1714557600", ms(2024, 5, 1, 10)), ("1714557600123", ms(2024, 5, 1, 10, us=123)), ("1714557600123456", ms(2024, 5, 1, 10, us=123)),
    ("1714557600.5", ms(2024, 5, 1, 10, us=500)), ("1714557600123456789", ms(2024, 5, 1, 10, us=123)), (' "2024-05-01 10:00" ', ms(2024, 5, 1, 8)),
    ("2024-02-30 10:00:00", None), ("2024-05-01 10:61:00", None), ("2024-05-01 13:00:00 PM", None), ("0000-00-00 00:00:00", None), ("2024-13-01T10:00:00Z", None), ("Tue, 01 May 2024 10:00:00 +0000", None),
    ("2024-03-31 02:30:00", None), ("2024-10-27 02:30:00", None), ("May  1 10:00:00", None), ("-", None), ("", None), (None, None), ("n/a", None), ("x" * 5000, None), ("2024-05-01 10:00:00 QQQ", None), ("9" * 300, None),
])
def test_one_stamp(spark, text, want):
    assert resolve(spark, [("a", text)], [("a", "Europe/Berlin", None)]).get(0) == want


def test_order_of_day_and_month_is_the_logs(spark):
    got = resolve(spark, [("a", "03/04/2024 00:00:00"), ("a", "13/04/2024 00:00:00"), ("b", "03/04/2024 00:00:00"), ("b", "03/14/2024 00:00:00"), ("c", "03/04/2024 00:00:00"), ("d", "05/05/2024 00:00:00")], [])
    assert got == {0: ms(2024, 4, 3), 1: ms(2024, 4, 13), 2: ms(2024, 3, 4), 3: ms(2024, 3, 14), 5: ms(2024, 5, 5)}


def test_span_shows_the_order(spark):
    got = resolve(spark, [("a", "01/02/2024 00:00:00"), ("a", "12/02/2024 00:00:00")], [])
    assert got == {0: ms(2024, 2, 1), 1: ms(2024, 2, 12)}  # as month-day they would lie eleven months apart


def test_turn_of_the_year_and_leap_day(spark):
    got = resolve(spark, [("a", "Dec 31 23:00:00"), ("a", "Jan  1 01:00:00"), ("b", "Feb 29 00:00:00"), ("c", "Feb 29 00:00:00")], [("a", "UTC", 2025), ("b", "UTC", 2024), ("c", "UTC", 2025)])
    assert got == {0: ms(2024, 12, 31, 23), 1: ms(2025, 1, 1, 1), 2: ms(2024, 2, 29)}


def test_null_and_unknown_logs_repeats_and_empty(spark):
    got = resolve(spark, [(None, "2024-05-01 10:00:00"), ("a", "2024-05-01 10:00:00"), ("b", "2024-05-01 10:00:00")], [("a", None, None), ("b", "No/Where", None), ("b", "No/Where", None), (None, "Asia/Kolkata", 2020)])
    assert got == {0: ms(2024, 5, 1, 10), 1: ms(2024, 5, 1, 10)}
    assert resolve(spark, [], []) == {}
    s = spark.createDataFrame([("t", 1, "a", "1714557600")] * 2, "src string, row_id long, case_id string, stamp string")
    assert instants(s, spark.createDataFrame([], "case_id string, local_zone string, yearless_reference_year int")).count() == 1


def test_zone_table_agrees_with_zoneinfo():
    import zoneinfo

    import numpy as np

    t, tz = ZoneTable("Australia/Sydney"), zoneinfo.ZoneInfo("Australia/Sydney")
    local = np.array([ms(2024, m, d, h) for m in range(1, 13) for d in (1, 7, 15) for h in (0, 2, 3, 12)])
    utc, once = t.to_utc_ms(local)
    for u, l_, ok in zip(utc, local, once):
        if ok:
            back = dt.datetime.fromtimestamp(u / 1000, tz).replace(tzinfo=UTC)
            assert int(back.timestamp()) * 1000 == l_


def test_masks_have_one_parser():
    assert parser_of("9999-99-99a99:99:99a")[0] == "ymd" and parser_of("99/99/9999 99:99:99")[0] == "dm" and parser_of("aaa  9 99:99:99")[0] == "yl" and parser_of("hello") is None
