import time

import pytest

from cairnlog.operators import log_entries as le


def found(spark, lines, block=le.BLOCK):
    df = spark.createDataFrame([(c, n, x, "clash") for c, n, x in lines], "case_id string, line_no long, line string, level string")
    return {(r.case_id, r.first_line, r.last_line, r.level, r.component) for r in le.entries(df, block).collect()}


@pytest.mark.parametrize("line,level,component", [
    ("2024-03-01T00:00:03.572Z Info [mail_relay] GET /x", "INFO", "mail_relay"), ("W0703 04:48:03.804718     966 rate.limiter.cc:67] x", "WARN", "rate.limiter"),
    ("<150>1 2025-08-23T08:36:53.5Z h net-proxy 8338 ID38 - x", "INFO", "net-proxy"), ("<131>1 - h net-proxy 8338 ID38 - x", "ERROR", "net-proxy"), ("02-16 22:44:49.294  8413  8422 V thumbs      : x", "TRACE", "thumbs"),
    ('logger=sched.cron msg="level=error here" time=2024-02-02T00:44:46Z level=debug\r', "DEBUG", "sched.cron"), ("[pool-6-t3] notice 29/Mar/2025:19:06:38 +0100 img_resize - x", "INFO", "img_resize"),
    ("<31>Dec 30 14:51:47 basin21 net-proxy[4503]: x", "DEBUG", "net-proxy"), ("Dec  3 14:51:47 basin21 net-proxy[4503]: x", "", "net-proxy"), ("2025-07-30 19:30:34.647 | W | BlobGuard      | x", "WARN", "BlobGuard"),
    ("2024/06/01 00:19:46 - [Warning] - worker-8 sched.cron:52 x", "WARN", "sched.cron"), ("2025-10-25 13:32:24.951264+0200 thumbs[6743:18] <FATAL> x", "FATAL", "thumbs"), ("BlobGuard @ 2025-03-16T08:49:27.829Z (SEVERE) x", "ERROR", "BlobGuard"),
    ('{"t": "", "log_level": "crit", "source": "PaneRouter", "text": "x", "ctx": {"level": 2}}', "FATAL", "PaneRouter"), ("22/Apr/2025:19:25:56 +0000  retry", "", ""), ("2025-02-30 10:12:31 \x1b[33mWARN\x1b[0m [thumbs] x", "WARN", "thumbs"), ("1742968549904 | err | a | x", "ERROR", "a"),
])
def test_layouts(spark, line, level, component):
    assert found(spark, [("c", 1, line)]) == {("c", 1, 1, level, component)}


H = "2024-03-01 00:00:03 INFO [a] x"


def test_preamble_continuations_blank_and_repeated_lines(spark):
    lines = [("c", 1, "﻿starting"), ("c", 2, H), ("c", 3, "    2023-01-01 00:00:00 ERROR [b] replayed"), ("c", 4, ""), ("c", 5, None), ("c", 6, H), ("c", 6, H), ("c", 7, ""), ("d", 1, "nothing"), (None, 1, H), ("e", None, H)]
    assert found(spark, lines) == {("c", 2, 5, "INFO", "a"), ("c", 6, 7, "INFO", "a")}


def test_block_edges_change_nothing(spark):
    lines = [("c", n, H if n in (3, 4, 11, 29) else "more") for n in range(1, 41)] + [("d", n, H if n == 2 else "x" * 100_000) for n in range(1, 4)]
    want = {("c", 3, 3, "INFO", "a"), ("c", 4, 10, "INFO", "a"), ("c", 11, 28, "INFO", "a"), ("c", 29, 40, "INFO", "a"), ("d", 2, 3, "INFO", "a")}
    assert found(spark, lines) == want and found(spark, lines, 5) == want and found(spark, lines, 1) == want


def test_only_two_layouts_of_a_log_count(spark):
    two = [("c", i, H) for i in range(1, 4)] + [("c", i, "<31>Dec 30 14:51:47 h p[1]: x") for i in range(4, 7)]
    assert ("c", 7, 7, "DEBUG", "p") not in found(spark, [*two, ("c", 7, "2025-07-30 19:30:34.647 | D | p | x")])


def test_empty(spark):
    assert found(spark, []) == set()


def test_messages(spark):
    lines = [("c", 1, "pre"), ("c", 2, H), ("c", 3, "more"), ("c", 4, ""), ("c", 9, H), ("c", 10, "end")]
    df = spark.createDataFrame(lines, "case_id string, line_no long, line string")
    for block in (2, 65536):
        got = {r.first_line: (r.time, r.message) for r in le.with_messages(df, le.entries(df, block), block).collect()}
        assert got == {2: ("2024-03-01 00:00:03", "x\nmore\n"), 9: ("2024-03-01 00:00:03", "x\nend")}


@pytest.mark.parametrize("line,layout", [
    (H + "x" * 300_000, "bracket"), ('time=1 level=info logger=a msg="' + "y\\\"" * 100_000 + '"', "logfmt"), ('{"time":"1","level":"info","logger":"a","msg":"' + "z" * 300_000 + '"}', "json"),
    ("<31>1 - h a 1 I [a b=\"" + "\\]" * 100_000 + "\"] msg", "rfc5424"), (" " * 300_000, None), ("[" * 300_000, None), ("2024-03-01 00:00:03 | INFO | a | " + "| " * 100_000, "bar"), ("\r" * 300_000 + "x", None),
])
def test_very_long_lines(spark, line, layout):
    df = spark.createDataFrame([("c", 1, line)], "case_id string, line_no long, line string")
    assert [r.layout for r in le.entries(df).collect()] == ([layout] if layout else [])


@pytest.mark.parametrize("line", [
    'time=2024-02-02T00:44:46Z err="' + "e " * 5000 + '" level=error logger=db msg="short" stack="' + "s " * 5000 + '"', 'msg="short" time=2024-02-02T00:44:46Z err="' + "e " * 5000 + '" level=error logger=db stack="' + "s " * 5000 + '"',
    'time=2024-02-02T00:44:46Z err="' + "e\\\" " * 5000 + ' level=debug logger=x msg=no" level=error logger=db msg="short" stack="' + "s " * 5000 + '"', 'time=2024-02-02T00:44:46Z err="no level=debug logger=x msg=no" level="error" logger=db msg="short"',
])
def test_logfmt_is_read_whole(spark, line):
    df = spark.createDataFrame([("c", 1, "time=1 level=info logger=a msg=x"), ("c", 2, line), ("c", 3, "more")], "case_id string, line_no long, line string")
    got = {(r.first_line, r.last_line, r.time, r.level, r.component, r.message) for r in le.with_messages(df, le.entries(df)).collect()}
    assert got == {(1, 1, "1", "INFO", "a", "x"), (2, 3, "2024-02-02T00:44:46Z", "ERROR", "db", '"short"\nmore')}


@pytest.mark.parametrize("line", ['a="\\" ' * 150_000, "a=" + '"' * 500_000, "time=1 msg=" + "\U0001F64Fx " * 200_000 + " level=info logger=a", 'time=1 msg="' + '\\" msg="' * 60_000 + ' level=info'])
def test_long_logfmt_takes_no_long_time(spark, line):
    df = spark.createDataFrame([("c", 1, line)], "case_id string, line_no long, line string")
    start = time.perf_counter()
    le.entries(df).collect()
    assert time.perf_counter() - start < 20


@pytest.mark.parametrize("line,level,component", [
    ("<131>1 - h " + "c" * 9000 + " 8338 ID38 - x", "ERROR", "c" * 9000), ("2025-07-30 19:30:34.647 | W | " + "b" * 6000 + "      | x", "WARN", "b" * 6000), ("<31>1 - h " + "a" * 5000 + " 1 I [a b=\"" + "\\]" * 9000 + "\"] msg", "DEBUG", "a" * 5000),
    ("02-16 22:44:49.294  8413  8422 V " + "t" * 7000 + "   : x", "TRACE", "t" * 7000), ("2024-03-01 00:00:03 INFO [" + "m" * 20_000 + "] x", "INFO", "m" * 20_000),
])
def test_headers_of_any_length(spark, line, level, component):
    assert found(spark, [("c", 1, line)]) == {("c", 1, 1, level, component)}


@pytest.mark.parametrize("line", ["2025-07-30 19:30:34.647 | W | " + " " * 800_000, "02-16 22:44:49.294  8413  8422 V " + " :" * 400_000, "2024-03-01 00:00:03" + " " * 800_000 + "|", "a" * 800_000 + " @", "[" + "a" * 800_000 + "]", "2024-03-01 - [W] - a " + ":1" * 400_000, "<31>1 - h a 1 I " + "[" * 800_000, "<31>1 - h a 1 I " + "[]" * 400_000])
def test_long_headers_take_no_long_time(spark, line):
    df = spark.createDataFrame([("c", 1, line)], "case_id string, line_no long, line string")
    start = time.perf_counter()
    le.entries(df).collect()
    assert time.perf_counter() - start < 20


def test_long_entries_come_in_parts_and_layouts_may_be_unlimited(spark):
    lines = [("c", 1, H), *[("c", n, str(n)) for n in range(2, 12)], ("c", 12, "<31>Dec 30 14:51:47 h p[1]: y"), ("c", 13, "2025-07-30 19:30:34.647 | D | p | z")]
    df = spark.createDataFrame(lines, "case_id string, line_no long, line string")
    all_of = le.entries(df, layouts=None)
    assert sorted(r.first_line for r in all_of.collect()) == [1, 12, 13] and sorted(r.first_line for r in le.entries(df, layouts=1).collect()) == [13]
    got = le.with_messages(df, all_of, part=4).filter("first_line = 1").orderBy("part").collect()
    assert [r.part for r in got] == [0, 1, 2] and "\n".join(r.message for r in got) == "\n".join(["x", *map(str, range(2, 12))])
