import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from cairnlog import cli
from cairnlog.functions import families, masking
from cairnlog.operators import analytics, drain, fieldquery, filters, formats, ordered, profiles, records, select
from cairnlog.operators.embedded import analyze
from cairnlog.operators.filters import FilterSpec
from cairnlog.service import Session, serve
from cairnlog.sources import lines as src
from cairnlog.sources import stores


def doc(spark, texts, **cols):
    rows = [("d", i, t, *[c[i] for c in cols.values()]) for i, t in enumerate(texts)]
    kinds = {"ts_ms": "long", "template_id": "int", "is_header": "boolean", "header_ms": "long", "header_state": "string"}
    return spark.createDataFrame(rows, "doc_id string, line_no long, text string" + "".join(f", {k} {kinds[k]}" for k in cols))


def lines_of(df):
    return [r.line_no for r in df.orderBy("line_no").collect()]


def read(spark, path):
    return [r.text for r in src.read_lines(spark, str(path)).orderBy("line_no").collect()]


@pytest.mark.parametrize("raw,want", [(b"alpha\nbeta\ngamma", ["alpha", "beta", "gamma"]), (b"a\r\nb\r\n", ["a", "b"]), (b"a\rb\n\n", ["a\rb", ""]), (b"", [""]), (b"ok\xff\n", ["ok\ufffd"])])
def test_lines(spark, tmp_path, raw, want):
    (tmp_path / "x.log").write_bytes(raw)
    assert read(spark, tmp_path / "x.log") == want


def test_line_numbers_over_splits(spark, tmp_path):
    text = "".join(f"line {i} {'x' * (i % 97)}\n" for i in range(5000))
    (tmp_path / "x.log").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = src.read_lines(spark, str(tmp_path / "x.log")).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.text for r in rows] == text.split("\n")[:-1] and [r.line_no for r in rows] == list(range(5000))
    assert all(text.encode()[r.byte_start : r.byte_start + r.byte_len].decode() == r.text for r in rows[::500])


def test_zip_and_file_change(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/a.log", "x")
        z.writestr("__MACOSX/a", "x")
    assert [p.endswith("in/a.log") for p in src.extract_zip(str(tmp_path / "a.zip"))] == [True]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../evil", "x")
    with pytest.raises(ValueError):
        src.extract_zip(str(tmp_path / "b.zip"))
    f = tmp_path / "x"
    f.write_text("ab")
    before = src.file_state(str(f))
    assert src.file_change(before, str(f)) == "unchanged"
    f.write_text("abc")
    assert src.file_change(before, str(f)) == "appended"
    f.write_text("a")
    assert src.file_change(before, str(f)) == "shrunk"


def test_filters(spark):
    df = doc(spark, ["ERROR api timeout", "error api ok", "INFO api timeout"])
    e, t, x = FilterSpec("error"), FilterSpec("timeout"), FilterSpec("INFO", exclude=True)
    assert lines_of(df.filter(filters.combined([e, t, x]))) == [0, 1] and lines_of(df.filter(filters.combined([e, t, x], "all"))) == [0]
    assert lines_of(df.filter(filters.combined([x]))) == [0, 1] and lines_of(df.filter(filters.visible([x]))) == [0, 1]
    assert lines_of(df.filter(filters.matches(FilterSpec("  ")))) == [] and lines_of(df.filter(filters.visible([e, FilterSpec("INFO", active=False)]))) == [0, 1]
    d2 = doc(spark, ["WARN 42", "warn 7", "INFO 8", "É x"])
    assert lines_of(d2.filter(filters.matches(FilterSpec(r"warn \d+", regex=True)))) == [0, 1] and lines_of(d2.filter(filters.matches(FilterSpec("é")))) == []
    assert lines_of(d2.filter(filters.matches(FilterSpec("é", regex=True)))) == [3]
    with pytest.raises(ValueError):
        filters.matches(FilterSpec("(?=a)", regex=True))
    spans = filters.highlight_spans(doc(spark, ["ERROR DISK failure"]), [FilterSpec("err(or)?", regex=True), FilterSpec("disk")]).collect()
    assert {(r["filter"], r.start, r.end) for r in spans} == {(0, 0, 5), (1, 6, 10)}
    s = filters.FilterSet()
    assert s.add(e) == s.add(e) == 0 and e.same_matcher(FilterSpec("error", exclude=True)) and filters.parse_template_id("T{42}") == filters.parse_template_id("T42") == 42


def test_field_queries(spark):
    q = fieldquery.FieldQuery.parse('name contains "a b"')
    assert fieldquery.FieldQuery.parse(q.expression()) == q
    schema = {"pid": "number", "msg": "text", "at": "timestamp"}
    df = spark.createDataFrame([(0, "9007199254740993", "Ab", 1000), (1, "9.007199254740993e15", "x", None), (2, "-0", None, 5000), (3, None, "y", 1), (4, "1e400", "z", 2)], "line_no long, pid string, msg string, at long")

    def hits(expression, **kw):
        return lines_of(df.filter(fieldquery.FieldQuery.parse(expression, **kw).bind(schema).condition()))

    assert hits("pid = 9007199254740993") == [0, 1] and hits("pid > 9007199254740992") == [0, 1, 4] and hits("pid = 0") == [2] and hits("pid missing") == [3] and hits("pid >= 1e399") == [4]
    assert hits("msg = ab", case_sensitive=False) == [0] and hits("msg != x") == [0, 3, 4] and hits("msg exists") == [0, 1, 3, 4] and hits("at <= 1970-01-01 00:00:01") == [0, 3, 4]
    for bad in ("pid contains 1", "msg > a", "nope = 1", "pid = x"):
        with pytest.raises(ValueError):
            fieldquery.FieldQuery.parse(bad).bind(schema)
    with pytest.raises(ValueError):
        fieldquery.FieldQuery("pid", "=", "1", field_type="text").bind(schema)
    keys = [fieldquery.sort_key(x) for x in ("-1e500", "-12", "-1.5", "0", "1e-400", "0.01", "1", "9", "10", "10.5", "1e500")]
    assert keys == sorted(keys) and fieldquery.sort_key("x") is None and fieldquery.sort_key("1.0") == fieldquery.sort_key("10e-1")
    assert fieldquery.completion_context("pid >= 4") == ("value", "pid", "4") and fieldquery.completion_context("pi")[0] == "field"


def test_selection(spark):
    df = doc(spark, ["a", "b", "c", "d", "e"], ts_ms=[2000, 2000, 0, 0, 1000])
    assert lines_of(select.TimeBounds(1000, 2000).select(df)) == [0, 1, 4] and tuple(select.envelope(select.TimeBounds(1000, 2000).select(df)).first()) == (0, 5)
    assert select.nearest_record(df, 1500).first().line_no == 0 and [r.delta_ms for r in select.clock_deltas(df, ["doc_id"], block=2).orderBy("line_no").collect()] == [0, -2000, 0, 1000]
    assert lines_of(select.resolve(df, 2, 99)) == [1, 2, 3, 4] and select.trim_report(df, select.TimeBounds(1000, 2000).select(df)).first().intervening == 2
    with pytest.raises(ValueError):
        select.resolve(df, 0)
    laned = df.withColumn("l", F.col("line_no").isin(1, 3))
    assert [select.lane_step(laned, n, "l").first().line_no for n in (0, 1, 3)] == [1, 3, 1] and lines_of(select.occurrence_context(laned, 2, ["l"])) == [1, 3]


def test_ordered_scans_do_not_depend_on_blocks(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), i * 3, rnd.choice([None, 1, 2, 3])) for i in range(200)]
    df = spark.createDataFrame(rows, "p string, o long, v long")
    for f in (lambda b: ordered.number_rows(df, "o", ["p"], block=b), lambda b: ordered.with_previous(df, "o", ["p"], ["v"], block=b), lambda b: ordered.carry(df, "o", ["p"], "v", "c", b), lambda b: ordered.running_sum(df, "o", ["p"], "v", "s", b)):
        assert sorted(map(str, f(7).collect())) == sorted(map(str, f(1 << 20).collect()))


def test_record_state(spark):
    df = doc(spark, ["p", "H", "c", "M", "c", "I", "c"], is_header=[False, True, False, True, False, True, False], header_ms=[None, 5, None, None, None, None, None], header_state=[None, "explicit", None, "missing", None, "invalid", None])
    for block in (2, 100):
        got = [(r.record_id, r.owner_line, r.owner_ms, r.provenance) for r in records.record_state(df, ["doc_id"], block=block).orderBy("line_no").collect()]
        assert got == [(None, None, None, "unknown"), (0, 1, 5, "explicit"), (0, 1, 5, "inherited"), (1, 3, None, "missing"), (1, 3, None, "unknown"), (2, 5, None, "invalid"), (2, 5, None, "unknown")]
    assert records.invalid_times(records.record_state(df, ["doc_id"]), ["doc_id"]).first().first_lines == [5]


@pytest.mark.parametrize("token,want", [
    ("10.0.0.1:8080", "<IP>"), ("a@b.example", "<EMAIL>"), ("https://x.test/y", "<URL>"), ("14:30:22.123", "<TIME>"), ("fe80::1:2", "<IPV6>"), ("retry=5", "retry=<NUM>"), ("C:\\dir\\f", "<PATH>"), ("/var/log", "<PATH>"), ("3.5s", "<TIME>"),
    ("-12.5", "<NUM>"), ("deadbeef01", "<HEX>"), ("worker-12", "worker-<NUM>"), ("plain", "plain"), ("key=word", "key=word"), ('{"a":1}', "<JSON>"), ("123e4567-e89b-12d3-a456-426614174000", "<UUID>"),
])
def test_masks(spark, token, want):
    assert spark.createDataFrame([(token,)], "t string").select(masking.mask_token(F.col("t"))).first()[0] == want == masking.mask_word(token)


def test_mask_lines_and_slots(spark):
    df = spark.createDataFrame([("connect  10.0.0.1:8080 done",), ("keep   spaces",)], "t string")
    assert [r[0] for r in df.select(masking.mask_line(F.col("t"))).collect()] == ["connect <IP> done", "keep   spaces"]
    assert [r.t for r in masking.masked(df, "t").collect()] == ["connect <IP> done", "keep   spaces"]
    slots = masking.learn_header_slots([f"INFO [{i}] {1000 + i} msg" for i in range(20)])
    assert slots[0] is None and slots[2] == "NUM"


@pytest.mark.parametrize("few", [50_000, 0])
def test_miner_leaf_by_leaf_equals_one_pass(spark, monkeypatch, few):
    monkeypatch.setattr(drain, "FEW_ROUTES", few)
    rnd = random.Random(6)
    words = ["a", "b", "c", "*", "<NUM>", "x", "y"]
    for children in (1, 2, 100):
        config = drain.MinerConfig(children=children)
        texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 5))) for _ in range(150)]
        want = drain.mine_sequential(texts, config)
        got = drain.mine(spark.createDataFrame(list(enumerate(texts)), "line_no long, content string"), config)[0]
        assert [r.template_id for r in got.orderBy("line_no").collect()] == want


def mined_by_hand(texts, children):
    """Template ids by the plain rules, written apart from the miner: a dict of paths, a list of templates per path."""
    below, leaves, ids, out = {(): set()}, {}, 0, []
    for text in texts:
        words = text.split()
        if not words:
            out.append(0)
            continue
        path, full = (), False
        for depth, step in enumerate([f"#{len(words)}", words[0], words[1] if len(words) > 1 else "*"]):
            known = below.setdefault(path, set())
            if step not in known and step != "*" and len(known) >= children:
                step, full = "*", full or depth > 0
            known.add(step)
            path += (step,)
        group = leaves.setdefault(path, [])
        ranked = []
        for place, (_, pattern) in enumerate(group):
            if len(pattern) == len(words):
                points = sum(2 if p == w else 1 if p == "<*>" else 0 for p, w in zip(pattern, words)) / (2 * len(words))
                if not (pattern.count("<*>") > 0.7 * len(pattern) and points < 0.8):
                    ranked.append((-points, place))
        if ranked and (full or -min(ranked)[0] >= 0.5):
            number, pattern = group[min(ranked)[1]]
            pattern[:] = [p if p == w else "<*>" for p, w in zip(pattern, words)]
        else:
            ids += 1
            number = ids
            group.append((ids, words))
        out.append(number)
    return out


@pytest.mark.parametrize("seed,vocabulary,longest", [(1, "abcd", 4), (2, "ab<", 8), (3, "abcdefghij", 3)])
def test_miner_equals_the_plain_rules(spark, seed, vocabulary, longest):
    rnd = random.Random(seed)
    texts = [" ".join("<*>" if (c := rnd.choice(vocabulary)) == "<" else c for _ in range(rnd.choice([0, 1, 2, longest, longest]))) for _ in range(300)]
    for children in (2, 5, 100):
        got, templates = drain.mine(spark.createDataFrame(list(enumerate(texts)), "line_no long, content string"), drain.MinerConfig(children=children))
        want = mined_by_hand(texts, children)
        assert [r.template_id for r in got.orderBy("line_no").collect()] == want and drain.mine_sequential(texts, drain.MinerConfig(children=children)) == want
        assert {r.template_id: r.n for r in templates.collect()} == {t: want.count(t) for t in set(want)}


def test_miner_guards_templates_of_wildcards_in_overflow_leaves(spark):
    texts = ["x y " + " ".join(f"{i}{j}" for j in range(8)) for i in "abc"]
    config = drain.MinerConfig(children=1)
    got = drain.mine(spark.createDataFrame(list(enumerate(["z z " + " ".join("q" * 8), *texts])), "line_no long, content string"), config)[0]
    assert [r.template_id for r in got.orderBy("line_no").collect()] == mined_by_hand(["z z " + " ".join("q" * 8), *texts], 1)


def test_miner_merges_and_continues(spark):
    df = spark.createDataFrame([(0, "INFO request from alice to bob"), (1, "INFO request from charlie to dave"), (2, "")], "line_no long, content string")
    lines, templates = drain.mine(df)
    t = {r.template_id: (r.pattern, r.n) for r in templates.collect()}
    assert t == {1: ("INFO request from <*> to <*>", 2), 0: ("<EMPTY>", 1)}
    more = drain.mine(df, stored=[(0, ["<EMPTY>"], 0), (1, "INFO request from <*> to <*>".split(), 2)])[0]
    assert {r.template_id for r in more.collect()} == {0, 1}


def test_analytics(spark):
    df = doc(spark, list("abcde"), ts_ms=[0, 10, 10, 400_000, 400_010], template_id=[1, 1, 2, 2, 2])
    for bins in (1, 2, 5, 64):
        assert sum(r.n for r in analytics.density(df, 5, bins).collect()) == 5
    assert sum(r.n for r in analytics.histogram(df, "ts_ms").collect()) == 5 and analytics.histogram(df.filter("false"), "ts_ms").count() == 0
    assert [(r.line_no, r.gap_ms) for r in analytics.time_gaps(df, ["doc_id"], block=2).collect()][0] == (3, 399_990) and analytics.densest_minute(df).first().n == 3
    assert [(r.start_line, r.end_line, r.n) for r in analytics.run_lengths(df, ["doc_id"], block=2).orderBy("start_line").collect()] == [(0, 1, 2), (2, 4, 3)]
    assert analytics.sample_positions(10, 3, "first") == [0, 1, 2] and analytics.sample_positions(10, 3, "even") == [0, 4, 9]
    p = analytics.sample_positions(1000, 5)
    assert p == analytics.sample_positions(1000, 5) and p[0] == 0 and p[-1] == 999 and len(p) == 5
    steady = [0, 1] * 500
    ids = steady + [7] + [8] * 20 + [9]
    got = {r.template_id: set(r.reasons.split(",")) for r in analytics.anomalies(doc(spark, ["x"] * len(ids), ts_ms=[0] * len(ids), template_id=ids), ["doc_id"]).collect()}
    assert got == {7: {"rare", "first_seen_late"}, 8: {"first_seen_late", "bursty"}, 9: {"rare", "first_seen_late"}}


@pytest.mark.parametrize("layout,line,want", [
    ("{time} MyApp[{a}:{b:number}] <{level}> {log}", "2026-01-02 03:04:05 MyApp[12345:9] <FAULT> boom", {"a": "12345", "b": "9", "level": "FAULT", "log": "boom"}),
    ('{time} source="{source:path}" {log}', '2026-01-02 03:04:05 source="C:\\My Dir\\a.log" hi', {"source": "C:\\My Dir\\a.log", "log": "hi"}),
    ("{time} source={source:path} status={status:number} {log}", "2026-01-02 03:04:05 source=/var/log/My App/app.log status=500 hi", {"source": "/var/log/My App/app.log", "status": "500"}),
    ("{time} {{id={request_id}}} {log}", "2026-01-02 03:04:05 {id=req-7} hi", {"request_id": "req-7"}), ("{time} n={ignore:number} {log}", "2026-01-02 03:04:05 n=5 hi", {"log": "hi"}),
    ("{time} worker={worker:number} {log}", "2026-01-02 03:04:05 worker=abc hi", None), ("{time} {a:text} {b:text} {log}", "2026-01-02 03:04:05 x y z w", None), ("[{t}] {time} {log}", "\x1b[31m[w-1]   2026-01-02 03:04:05 hi", {"t": "w-1"}),
])
def test_profiles(layout, line, want):
    m = profiles.match(profiles.compile_layout(layout), line, profiles.Recognizer(families.FAMILIES))
    if want is None:
        assert m is None
    else:
        got = {k: line[a:b] for k, (a, b) in m["spans"].items()}
        assert want.items() <= got.items() and m["time_state"] == "explicit"


@pytest.mark.parametrize("bad", ["{log}", "{time}", "{time}{log}", "{time} {x}{y} {log}", "{time} {x} {x} {log}", "{time} {x:what} {log}", "{time} } {log}", "{log} {time}"])
def test_profiles_that_are_refused(bad):
    with pytest.raises(ValueError):
        profiles.compile_layout(bad)


def test_profile_times_and_advanced():
    p = profiles.compile_layout("{time} {log}")
    sample = ["2026-02-30 00:00:00 x", "2026-02-03 00:00:00 x"]
    r = profiles.Recognizer(families.FAMILIES)
    assert profiles.match(p, sample[0], r)["time_state"] == "invalid" and profiles.resolve_time(p, sample) == ("High", ["ISO-8601"])
    a = profiles.compile_advanced(r"\A\[(?<timestamp>[^\]]+)\] (?<log>.*)")
    assert profiles.match(a, "[2026-02-03 00:00:00] hi", r)["spans"]["log"] == (22, 24)
    assert [x["matched"] for x in profiles.preview(p, [*sample, "no"], r)] == [True, True, False]


def test_formats(spark):
    assert formats.detect_format(['{"a": 1}'] * 3) == "json" and formats.detect_format(["CEF:0|v|p|1|s|n|3|x"] * 2) == "cef" and formats.detect_format(["hello", "world"]) == "plain"
    df = spark.createDataFrame([(0, "CEF:0|Acme|fw|1.0|100|blocked|5|src=10.0.0.1 n=5")], "line_no long, text string")
    assert formats.normalised(df, "cef").first().content == "CEF Acme fw 100 blocked 5 src=<IP> n=<NUM>"
    j = spark.createDataFrame([(0, '{"ts": 1, "msg": "got 10.0.0.1", "n": 4, "b": null}')], "line_no long, text string")
    assert formats.normalised(j, "json").first().content == "b=<NULL> got <IP> n=<NUM>"
    assert families.detect(["2024-01-02 03:04:05 x"] * 3) == ("High", ["ISO-8601"]) and families.detect(["01-02-2024 03:04:05 x"] * 3)[0] == "Ambiguous" and families.parse_time_parameter("1700000000") == 1700000000000
    f = families.custom_family("mine", r"^(?P<year>\d{4})!(?P<month>\d\d)!(?P<day>\d\d) (?P<hour>\d\d)-(?P<min>\d\d)-(?P<sec>\d\d)")
    assert families.parse("2024!01!02 00-00-01", f)[2] == 1704153601000
    with pytest.raises(ValueError):
        families.custom_family("x", r"(?P<year>\d+)")


@pytest.mark.parametrize("text,want", [
    ('INFO user=42 status="ok" duration_ms=18', ["logfmt"]), ("user: 42, status: ok", ["fields"]), ("payload={ user = Ada; ok = true; }", ["foundation"]), ("payload={'user': 42, 'ok': True, 'error': None}", ["python"]), ("Bundle[{user=42, ok=true}]", ["jvm-debug"]),
    ("GET /s?q=Ada+L HTTP/1.1\nHost: x\nAccept: y", ["http"]), ('user { id: 42 name: "A" }', ["protobuf-text"]), ("a.BadException: x\n    at a.B.c(B.java:1)\n    at d.E(E.java:2)", ["stacktrace"]), ('x {"a": [1]} y', ["json"]), ("{ok: true}", []), ("{placeholder}", []), ("[INFO] [main] hello", []),
    ("<plist><dict><key>a</key><string>Ada &amp; G</string></dict></plist>", ["plist"]), ("<plist><dict><key>a</dict></plist>", []), ("propertyList = { a = b; c = (d, e); }", ["plist"]), ("payload=bplist00payload", ["binary-plist"]), ("see https://a.test/b", []), ("(foo, bar)", []), ("", []),
    ("-----BEGIN KEY-----\nQUJD\n-----END KEY-----", ["pem"]), ("x 0123456789abcdef0123 y", ["hex"]), ("ordinary prose with: a colon", []),
])
def test_detectors(text, want):
    assert [d.detector for d in analyze(text)] == want


def test_detections_keep_spans_and_numbers():
    (d,) = analyze('x {"a": 1.50, "a": 2} y')
    assert d.raw == 'x {"a": 1.50, "a": 2} y'[d.start : d.end] and [v for _, v in d.value] == ["1.50", "2"]


def test_merged_counts_equal_a_whole_run(spark):
    df = doc(spark, list("abcde"), ts_ms=[0, 10, 10, 400_000, 400_010], template_id=[1, 1, 2, 2, 2])
    a, b = (analytics.template_counts(df.filter(c)) for c in ("line_no < 2", "line_no >= 2"))
    assert sorted(analytics.merge_counts(a, b, ["template_id"]).collect()) == sorted(analytics.template_counts(df).collect())
    assert [r.t for r in df.select(analytics.density_tier(F.col("ts_ms")).alias("t")).collect()] == ["small", "medium", "medium", "dense", "dense"]


def test_registries(spark):
    from cairnlog.operators.embedded import detectors, model

    detectors.register(lambda t: [model.Detection("mine", 0, 1, model.Pairs(), t[:1])] if t.startswith("§") else [], first=True)
    assert [d.detector for d in analyze("§ x")] == ["mine"]
    detectors.REGISTRY.pop(0)
    f = families.custom_family("bang", r"^(?P<year>\d{4})!(?P<month>\d\d)!(?P<day>\d\d) (?P<hour>\d\d)-(?P<min>\d\d)-(?P<sec>\d\d)")
    families.register(f)
    assert families.detect(["2024!01!02 00-00-01"] * 3) == ("High", ["bang"])
    families.FAMILIES.remove(families.BY_NAME.pop("bang"))
    formats.register("pipe", r"^\|", lambda c: F.concat(F.lit("PIPE "), F.substring(c, 2, 100)))
    df = spark.createDataFrame([(0, "|x"), (1, "|y")], "line_no long, text string")
    assert formats.detect_format(["|x", "|y"]) == "pipe" and formats.normalised(df, "pipe").first().content == "PIPE x"
    formats.RECOGNIZERS.pop("pipe")


def test_stores(tmp_path):
    p = str(tmp_path / "s.json")
    assert stores.load_templates(p) == [(0, ["<EMPTY>"], 0)]
    stores.save_templates(p, [(0, ["<EMPTY>"], 1), (1, ["a", "<*>"], 2)])
    assert stores.load_templates(p)[1] == (1, ["a", "<*>"], 2)
    stores.write_atomically(p, {"schema_version": 1, "presets": [{"id": 1, "layout": "{time} {log}"}, {"id": 1, "layout": "{time} {log}"}, {"id": 2, "layout": "{log}"}]})
    good, bad = stores.load_presets(p)
    assert len(good) == 1 and len(bad) == 2
    log = tmp_path / "a.log"
    log.write_text("x")
    stores.save_sidecar(str(log), {"filters": []})
    assert stores.load_sidecar(str(log))[1] == "exact"
    log.write_text("xy")
    assert stores.load_sidecar(str(log))[1] == "changed"
    stores.save_filters(p, [FilterSpec("a", exclude=True)])
    assert stores.load_filters(p) == [FilterSpec("a", exclude=True)]


LOG = "".join(f"2024-01-01T00:00:{i:02d}Z {'ERROR' if i == 10 else 'INFO'} request {i} from 10.0.0.{i}\n" + ("  detail\n" if i == 5 else "") for i in range(21))


def test_session(spark, tmp_path):
    (tmp_path / "a.log").write_text(LOG)
    s = Session(spark)
    info = s.load_log(str(tmp_path / "a.log"))
    assert info["lines"] == 22 and info["time_format"] == "ISO-8601" and s.search("error")["matches"] == [[12, 1704067210000]]
    assert s.search("request", limit=5)["next_offset"] == 5 and s.search("request", after="2024-01-01 00:00:19")["total_matches"] == 2
    assert s.summarize_log()["largest_time_gaps"][0]["gap_ms"] == 1000 and sum(s.get_timeline_histogram()["counts"]) == 22
    assert s.raw_log(1, 3)["lines"][0].startswith("2024-01-01T00:00:00Z") and s.log_sequence(collapse=True)["collapsed"]
    s.filters_add(text="ERROR", case_sensitive=True)
    assert s.raw_log()["total"] == 1 and s.filters_get()["filter_count"] == 1
    s.filters_remove(0)
    assert s.trim("2024-01-01 00:00:02", "2024-01-01 00:00:04")["remaining_lines"] == 3 and s.stats()["lines"] == 3
    s.trim()
    top = s.get_template()["templates"]
    tid = next(i for i, t in top.items() if "INFO" in t["pattern"])
    assert len(s.get_template_samples(tid, 3)["samples"]) == 3 and "anomalies" in s.get_template_anomalies()
    out = io.StringIO()
    serve(s, io.StringIO('{"id": 1, "method": "tools/list"}\n{"id": 2, "method": "tools/call", "params": {"name": "find_occurrences", "arguments": {"text": "ERROR"}}}\n{"id": 3, "method": "x"}\n'), out)
    a = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(a[0]["result"]["tools"]) == 19 and a[1]["result"]["structuredContent"]["total_matches"] == 1 and "error" in a[2]
    assert list(s.documents["log_1"].times.seconds) == ["indexing", "detecting", "mining"]
    job = s.load_log_async(str(tmp_path / "a.log"))
    assert job.wait(120)["lines"] == 22 and job.progress()["running"] == 0
    assert s.close_log("log_1") == {"closed": "log_1"}


def test_session_with_a_declared_layout(spark, tmp_path):
    (tmp_path / "a.log").write_text("start\n" + "".join(f"2024-01-01 00:00:0{i} [{'net' if i % 2 else 'disk'}:{i}] did {i} things\n  more\n" for i in range(6)))
    s = Session(spark)
    info = s.load_log(str(tmp_path / "a.log"), profile="{time} [{module}:{n:number}] {log}")
    assert info["confidence"] == "High" and info["templates"] == 3
    assert [m[0] for m in s.search(field_query="n >= 4")["matches"]] == [10, 11, 12, 13] and s.search(field_query="module = NET")["total_matches"] == 6
    assert s.search(field_query="module = net", case_sensitive=True)["total_matches"] == 6 and s.search(field_query="time > 2024-01-01 00:00:04")["total_matches"] == 2
    assert s.field_values("module", "N")["values"] == [{"value": "net", "n": 3}]
    with pytest.raises(ValueError):
        s.search(field_query="nope = 1")


def test_extract_template_twice(spark, tmp_path):
    for name, text in (("a", "2024-01-01 00:00:00 user 1 in\n2024-01-01 00:00:01 user 2 in\n2024-01-01 00:00:02 stop now\n"), ("b", "2024-01-01 00:00:00 user 9 in\n2024-01-01 00:00:01 fresh one here ok\n")):
        (tmp_path / f"{name}.log").write_text(text)
    store = str(tmp_path / "s.json")
    one = cli.extract_template(spark, str(tmp_path / "a.log"), store, str(tmp_path / "a.json"))
    two = cli.extract_template(spark, str(tmp_path / "b.log"), store, str(tmp_path / "b.json"))
    assert one["new_templates"] == 2 and two["new_templates"] == 1
    ids = [json.load(open(tmp_path / f"{x}.json"))["template_ids"] for x in "ab"]
    assert ids[0][0] == ids[0][1] == ids[1][0] and {i: c for i, _, c in stores.load_templates(store)}[ids[0][0]] == 3


def test_mixed_bounds_reach_every_line(spark, sf):
    from cairnlog.plans import reference_queries as q

    sf = sf.replace("sf0.001", "sf0.01")
    lines = [(r.line_no, r.ts_ms) for r in src.event_lines(spark, sf).select("line_no", "ts_ms").collect()]
    want = {n for n, ms in lines if n >= 9 and ms <= families.parse_time_parameter("2024-01-08 00:00:00")}
    got = lines_of(q.QUERIES["mixed_bounds_all"](spark, sf))
    assert set(got) == want and len(got) == len(want) and max(want) >= 500


def test_profile_time_spans_leave_no_header_out(spark, sf):
    from cairnlog.plans import reference_queries as q

    o = spark.read.parquet(f"{sf}/oracle_lines.parquet").filter("row_id is not null and class = 'header' and time = 'explicit'")
    given = {r.row_id: (r.span_start, r.span_end) for r in o.collect()}
    got = q.QUERIES["profile_time_spans_all"](spark, sf).collect()
    assert len(got) == len(given) and {r.row_id for r in got} == set(given)
    assert all((r.verdict == "same") == ((r.found_start, r.found_end) == given[r.row_id]) and (r.verdict == "not recognised") == (r.found_start is None) for r in got)
    same = {r.row_id for r in got if r.verdict == "same"}
    assert same > {r.row_id for r in q.QUERIES["profile_time_spans"](spark, sf).collect()}


def test_miner_keeps_whole_what_a_cut_would_split(spark):
    texts = ["a" * 4095 + "é tail", "a" * 4094 + "é tail", "a" * 4096 + " tail", "a" * 4093 + "\U0001F64F tail", "é tail"]
    df = spark.createDataFrame(list(enumerate(texts)), "line_no long, content string")
    got = {r.line_no: r.content for r in drain.route(df).collect()}
    assert got == {0: texts[0], 1: "a" * 4094 + "é", 2: "a" * 4096, 3: texts[3], 4: texts[4]}


def test_append_equals_a_fresh_load(spark, tmp_path):
    lines = [f"2024-01-01T00:00:{i:02d}Z INFO request {i} from {w}" for i, w in enumerate(["anna", "bo", "cy"])]
    lines += ["  more of it", "", "2024-01-01T00:01:00Z ERROR disk full", "2024-01-01T00:01:05Z INFO request 9 from d\u00fc", "tail \u20ac of it"]
    whole = "\n".join(lines).encode()
    seen = lambda s, i: (
        [tuple(r)[1:] for r in s.documents[i].lines.orderBy("line_no").drop("fields").collect()], sorted(map(tuple, s.documents[i].templates.collect())), s.documents[i].total)
    cuts = [len("\n".join(lines[:2]).encode()) + 1, len("\n".join(lines[:3]).encode()), len("\n".join(lines[:6]).encode()) + 9, whole.index("\u00fc".encode()) + 1, len(whole)]
    p = tmp_path / "a.log"
    p.write_bytes(whole[: cuts[0]])
    s = Session(spark)
    s.load_log(str(p))
    assert s.search("request", log_id="log_1")["total_matches"] == 2
    s.trim(1, 2)
    assert s.append()["added_lines"] == 0
    for a, b in zip(cuts, cuts[1:]):
        before = s.documents["log_1"].total
        with p.open("ab") as f:
            f.write(whole[a:b])
        r = s.append()
        finished = whole[:a].count(b"\n")
        assert r["first_changed_line"] == finished + 1 and r["total_lines"] - before == r["added_lines"]
        fresh = Session(spark)
        fresh.load_log(str(p))
        assert seen(s, "log_1") == seen(fresh, "log_1")
    assert s.documents["log_1"].view(False).count() == len(lines)  # the open end of the trim followed
    s.trim()
    assert s.search("request", log_id="log_1")["total_matches"] == 4
    p.write_bytes(b"x")
    with pytest.raises(ValueError, match="shrunk"):
        s.append()


def test_marks_and_advanced_profiles_on_tables(spark, tmp_path):
    lines = [(0, "\ufeff[2024-01-01T00:00:00Z] one"), (1, "more"), (2, "[2024-01-01T00:00:05Z] two")]
    df = spark.createDataFrame(lines, "line_no long, text string")
    for layout, time in (("[{time}] {log}", "time"), (r"\A\[(?<timestamp>[^\]]+)\] (?<log>.*)", "timestamp")):
        m = {r.line_no: r for r in profiles.match_lines(df, layout, profiles.Recognizer(families.FAMILIES), ["line_no"], first=df.line_no == 0).collect()}
        assert [m[i].matched for i in range(3)] == [True, False, True] and m[0].fields[time].value == "2024-01-01T00:00:00Z" and m[0].fields["log"].value == "one"
    p = tmp_path / "a.log"
    p.write_text("\n".join(t for _, t in lines) + "\n")
    s = Session(spark)
    s.load_log(str(p), profile=r"\A\[(?<timestamp>[^\]]+)\] (?<log>.*)")
    got = [(r.record_id, r.ts_ms) for r in s.documents["log_1"].lines.orderBy("line_no").collect()]
    assert got == [(0, 1704067200000), (0, 1704067200000), (1, 1704067205000)]


def test_time_then_message_reads_as_the_search_does(monkeypatch):
    fast, slow = profiles.compile_layout("{time} {log}"), profiles.compile_layout("{time} {log}")
    slow.__dict__["time_then_message"] = False
    r = profiles.Recognizer(families.FAMILIES)
    stamps = ["2024-01-01T00:00:00Z", "2024-01-01 00:00:00.123", "Jan  2 03:04:05", "1704067200", "99:99", "", "2024-13-01T00:00:00Z", "\ufeff2024-01-01T00:00:00Z", "\x1b[31m2024-01-01T00:00:00Z"]
    lines = [a + b for a in stamps for b in ("", " ", " x", "\t \ty z", "x", " 00:00:01 z", "Z +01:00 q")]
    assert fast.time_then_message and not slow.time_then_message
    got = [profiles.match(fast, x, r, True) for x in lines]
    assert got == [profiles.match(slow, x, r, True) for x in lines] and any(got)
