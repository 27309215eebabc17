"""Queries of the log operators over the test tables, with the same in SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlog.functions import families, masking
from cairnlog.operators import analytics, drain, fieldquery, filters, formats, profiles, records, select
from cairnlog.operators.embedded import detections
from cairnlog.operators.filters import FilterSpec
from cairnlog.operators.ordered import number_rows
from cairnlog.session import shared_dir, stage, table
from cairnlog.sources.lines import event_lines, export_rows, split_text
from cairnlog.streaming import tail

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_L = """L AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS line_no, epoch_us(ts) // 1000 AS ts_ms, event_type,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z ' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || ' user=' || user_id
  || ' action=' || event_type || ' value=' || CAST(round(value * 100) AS BIGINT) || ' props=' || props AS text, user_id, value FROM events)"""
# The messages of the events, action first, have one template per action; ids are in order of first appearance.
_T = f"{_L}, I AS (SELECT event_type, CAST(row_number() OVER (ORDER BY min(line_no)) AS INT) AS template_id FROM L GROUP BY 1), T AS (SELECT L.*, template_id FROM L JOIN I USING (event_type))"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def _lines(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    return event_lines(spark, d, *extra)


_MINED_MESSAGES: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def _mined_messages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(line_no, template_id) and templates, mined from the events' messages written action first; mined once a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _MINED_MESSAGES:
        said = F.regexp_replace("text", r"^\S+ \S+ (user=\S+) action=(\S+) ", "$2 $1 ")
        _MINED_MESSAGES[key] = drain.mine(masking.masked(_lines(spark, d).select("line_no", said.alias("content")), "content"))
    return _MINED_MESSAGES[key]


def _typed(spark: SparkSession, d: str) -> DataFrame:
    """Event lines with the template that the miner found for their message."""
    return _lines(spark, d, "event_type").join(_mined_messages(spark, d)[0], "line_no")


# --- sources

@query(f"WITH {_L} SELECT line_no, ts_ms, text FROM L")
def lines_events(spark, d):
    return _lines(spark, d).select("line_no", "ts_ms", "text")


_D = r"""D AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL GROUP BY ALL),
 E AS (SELECT doc_id, CASE WHEN len(parts) > 1 AND parts[-1] = '' THEN parts[:-2] ELSE parts END AS parts FROM D),
 DL AS (SELECT doc_id, unnest(parts) AS raw, generate_subscripts(parts, 1) - 1 AS line_no FROM E),
 DT AS (SELECT doc_id, line_no, regexp_replace(raw, '\r+$', '') AS text FROM DL)"""


def _document_lines(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", "text").distinct()
    return split_text(docs, "doc_id", "text")


@query(f"WITH {_D} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, text FROM DT")
def lines_documents(spark, d):
    return _document_lines(spark, d)


@query(f"WITH {_L} SELECT line_no, CAST(line_no + 1 AS VARCHAR) || ': ' || text AS row FROM L")
def export_numbered(spark, d):
    return export_rows(_lines(spark, d), "numbered")


@query(f"WITH {_L} SELECT line_no, substring(text, 26) AS row FROM L")
def export_message(spark, d):
    return export_rows(_lines(spark, d).withColumn("message_start", F.lit(25)), "message", "message_start")


@query(f"WITH {_T} SELECT count(*) AS lines, CAST(sum(strlen(text)) AS BIGINT) AS text_bytes, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(DISTINCT template_id) AS templates FROM T")
def document_stats(spark, d):
    return analytics.stats(_typed(spark, d))


# --- filters

def _filter(name: str, spec: FilterSpec, sql: str):
    def run(spark, d):
        return _lines(spark, d).filter(filters.matches(spec)).select("line_no", "text")

    run.__name__ = name
    query(f"WITH {_L} SELECT line_no, text FROM L WHERE {sql}")(run)


_filter("filter_phrase", FilterSpec("action=click", case_sensitive=True), "contains(text, 'action=click')")
_filter("filter_phrase_folded", FilterSpec("error USER=4"), "contains(lower(text), 'error user=4')")
_filter("filter_regex", FilterSpec(r"user=\d{1,2} action=(view|error)", case_sensitive=True, regex=True), r"regexp_matches(text, 'user=\d{1,2} action=(view|error)')")
_filter("filter_regex_folded", FilterSpec(r"info USER=(1|2)\b", regex=True), r"regexp_matches(text, 'info USER=(1|2)\b', 'i')")

_SPECS = [FilterSpec("ERROR", case_sensitive=True), FilterSpec("user=4"), FilterSpec("value=1\\d+ ", regex=True, case_sensitive=True), FilterSpec("action=view", exclude=True)]
_LANE_SQL = ["contains(text, 'ERROR')", "contains(lower(text), 'user=4')", r"regexp_matches(text, 'value=1\d+ ')", "contains(lower(text), 'action=view')"]


@query(f"WITH {_L} SELECT line_no, {', '.join(f'{s} AS lane_{i}' for i, s in enumerate(_LANE_SQL))} FROM L")
def lanes_multi(spark, d):
    return filters.lanes(_lines(spark, d), _SPECS).select("line_no", *[f"lane_{i}" for i in range(4)])


@query(f"WITH {_L} SELECT line_no FROM L WHERE ({_LANE_SQL[0]} OR {_LANE_SQL[1]} OR {_LANE_SQL[2]}) AND NOT {_LANE_SQL[3]}")
def compose_any(spark, d):
    return _lines(spark, d).filter(filters.combined(_SPECS)).select("line_no")


@query(f"WITH {_L} SELECT line_no FROM L WHERE ({_LANE_SQL[0]} AND {_LANE_SQL[1]}) AND NOT {_LANE_SQL[3]}")
def compose_all(spark, d):
    return _lines(spark, d).filter(filters.combined([_SPECS[0], _SPECS[1], _SPECS[3]], "all")).select("line_no")


@query(f"WITH {_L} SELECT line_no FROM L WHERE NOT {_LANE_SQL[3]}")
def compose_exclude_only(spark, d):
    return _lines(spark, d).filter(filters.combined([_SPECS[3]])).select("line_no")


@query(f"WITH {_L} SELECT line_no FROM L WHERE ({_LANE_SQL[0]} AND NOT {_LANE_SQL[3]}) OR NOT ({_LANE_SQL[0]} OR {_LANE_SQL[1]} OR {_LANE_SQL[3]})")
def visible_lines(spark, d):
    specs = [_SPECS[0], FilterSpec("user=4", active=False), _SPECS[3]]
    return _lines(spark, d).filter(filters.visible(specs)).select("line_no")


@query(f"WITH {_L} SELECT line_no + 1 AS line, ts_ms FROM L WHERE contains(lower(text), 'purchase') ORDER BY line_no LIMIT 50 OFFSET 20")
def search_page(spark, d):
    hits = _lines(spark, d).filter(filters.matches(FilterSpec("purchase")))
    return filters.page(hits, ["line_no", "ts_ms"], 20, 50).select((F.col("line_no") + 1).alias("line"), "ts_ms")


_A, _B = 1704153600000, 1704672000000  # two instants inside the events


@query(f"WITH {_L} SELECT line_no, ts_ms FROM L WHERE contains(lower(text), 'error') AND ts_ms BETWEEN {_A} AND {_B}")
def search_time_bounded(spark, d):
    hits = _lines(spark, d).filter(filters.matches(FilterSpec("error")))
    return select.TimeBounds(_A, _B).select(hits).select("line_no", "ts_ms")


@query(f"WITH {_L} SELECT count(*) AS n FROM L WHERE contains(lower(text), 'signup') AND ts_ms <= {_B}")
def count_in_window(spark, d):
    hits = _lines(spark, d).filter(filters.matches(FilterSpec("signup")))
    return filters.time_bounded(hits, None, _B, unknown_as=-1).agg(F.count("*").alias("n"))


@query(f"WITH {_L} SELECT min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM L WHERE contains(lower(text), 'signup')")
def match_time_range(spark, d):
    return _lines(spark, d).filter(filters.matches(FilterSpec("signup"))).agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


@query(f"""WITH {_L} SELECT line_no, 0 AS filter, 25 AS start, 30 AS "end" FROM L WHERE event_type = 'error'
 UNION ALL SELECT line_no, 0, CAST(instr(text, 'action=error') + 6 AS INT), CAST(instr(text, 'action=error') + 11 AS INT) FROM L WHERE event_type = 'error'
 UNION ALL SELECT line_no, 1, CAST(instr(text, 'action') - 1 AS INT), CAST(instr(text, 'action') + 5 AS INT) FROM L""")
def highlight_spans(spark, d):
    return filters.highlight_spans(_lines(spark, d), [FilterSpec("err(or)?", regex=True), FilterSpec("action")])


@query(f"WITH {_T} SELECT line_no FROM T WHERE template_id = 3")
def filter_template(spark, d):
    return _typed(spark, d).filter(filters.matches(FilterSpec(template_id=filters.parse_template_id("T{3}")))).select("line_no")


# --- selection

@query(f"WITH {_L} SELECT line_no FROM L WHERE ts_ms BETWEEN {_A} AND {_B}")
def time_select(spark, d):
    return select.TimeBounds(_A, _B).select(_lines(spark, d)).select("line_no")


@query(f"WITH {_L} SELECT min(line_no) AS first_line, max(line_no) + 1 AS end_line FROM L WHERE ts_ms BETWEEN {_A} AND {_B}")
def time_envelope(spark, d):
    return select.envelope(select.TimeBounds(_A, _B).select(_lines(spark, d)))


@query(f"WITH {_L} SELECT line_no, ts_ms, abs(ts_ms - {_A}) AS distance FROM L ORDER BY distance, line_no LIMIT 1")
def nearest_record(spark, d):
    return select.nearest_record(_lines(spark, d), _A)


@query(f"WITH {_L} SELECT * FROM (SELECT line_no, ts_ms - lag(ts_ms) OVER (ORDER BY line_no) AS delta_ms FROM L) WHERE delta_ms IS NOT NULL")
def clock_deltas(spark, d):
    return select.clock_deltas(_lines(spark, d), ["doc_id"]).select("line_no", "delta_ms")


@query(f"WITH {_L} SELECT line_no FROM L WHERE line_no BETWEEN 9 AND 499 AND ts_ms <= {_B}")
def mixed_bounds(spark, d):
    return select.resolve(_lines(spark, d).filter("line_no < 500"), 10, "2024-01-08 00:00:00").select("line_no")


@query(f"WITH {_L} SELECT line_no FROM L WHERE line_no >= 9 AND ts_ms <= {_B}")
def mixed_bounds_all(spark, d):
    """As mixed_bounds, over all lines."""
    return select.resolve(_lines(spark, d), 10, "2024-01-08 00:00:00").select("line_no")


@query(f"WITH {_L} SELECT line_no - 100 AS line_no, line_no AS source_line, text FROM L WHERE line_no BETWEEN 100 AND 299")
def trim_range(spark, d):
    return select.trim(_lines(spark, d), 100, 299).select("line_no", "source_line", "text")


def _laned(spark, d):
    return filters.lanes(_lines(spark, d), _SPECS[:2])


@query(f"""WITH {_L} SELECT DISTINCT line_no FROM (
 SELECT max(line_no) AS line_no FROM L WHERE {_LANE_SQL[0]} AND line_no < 500 UNION ALL SELECT min(line_no) FROM L WHERE {_LANE_SQL[0]} AND line_no > 500
 UNION ALL SELECT max(line_no) FROM L WHERE {_LANE_SQL[1]} AND line_no < 500 UNION ALL SELECT min(line_no) FROM L WHERE {_LANE_SQL[1]} AND line_no > 500) WHERE line_no IS NOT NULL""")
def occurrence_context(spark, d):
    return select.occurrence_context(_laned(spark, d), 500, ["lane_0", "lane_1"])


@query(f"WITH {_L} SELECT coalesce(min(line_no) FILTER (line_no > 500), min(line_no)) AS line_no FROM L WHERE {_LANE_SQL[0]}")
def lane_next(spark, d):
    return select.lane_step(_laned(spark, d), 500, "lane_0")


@query(f"WITH {_L} SELECT coalesce(max(line_no) FILTER (line_no < 1), max(line_no)) AS line_no FROM L WHERE {_LANE_SQL[0]}")
def lane_previous(spark, d):
    return select.lane_step(_laned(spark, d), 1, "lane_0", forward=False)


@query(f"WITH {_L} SELECT line_no, abs(line_no - 777) AS distance FROM L WHERE {_LANE_SQL[0]} OR {_LANE_SQL[1]} ORDER BY distance, line_no LIMIT 1")
def nearest_occurrence(spark, d):
    return select.nearest_occurrence(_laned(spark, d), 777, ["lane_0", "lane_1"])


@query(f"WITH {_L} SELECT line_no, text FROM L WHERE line_no BETWEEN 490 AND 510")
def context_radius(spark, d):
    return select.neighbourhood(_lines(spark, d), 500, 10).select("line_no", "text")


@query(f"WITH {_L} SELECT line_no FROM L WHERE {_LANE_SQL[1]} AND ts_ms BETWEEN {_A} AND {_B}")
def lane_lines_in_range(spark, d):
    return select.lines_in_range(_laned(spark, d), "lane_1", _A, _B, "ts_ms").select("line_no")


@query(f"WITH {_L} SELECT max(line_no) AS line_no FROM L WHERE line_no <= 122")
def goto_line(spark, d):
    return select.goto(_lines(spark, d), "l:123")


# --- analytics

@query(f"""WITH {_L}, X AS (SELECT min(ts_ms) AS lo, greatest(max(ts_ms) - min(ts_ms), 1) AS span FROM L),
 B AS (SELECT (ts_ms - lo) * 49 // span AS bucket, count(*) AS n FROM L, X GROUP BY 1)
 SELECT CAST(r AS BIGINT) AS bucket, CAST(lo + span * r // 49 AS BIGINT) AS x, coalesce(n, 0) AS n FROM range(50) t(r), X LEFT JOIN B ON B.bucket = r""")
def histogram_time(spark, d):
    return analytics.histogram(_lines(spark, d), "ts_ms", 50)


@query(f"""WITH {_L}, X AS (SELECT min(line_no) AS lo, greatest(max(line_no) - min(line_no), 1) AS span FROM L WHERE {_LANE_SQL[0]}),
 B AS (SELECT (line_no - lo) * 31 // span AS bucket, count(*) AS n FROM L, X WHERE {_LANE_SQL[0]} GROUP BY 1)
 SELECT CAST(r AS BIGINT) AS bucket, CAST(lo + span * r // 31 AS BIGINT) AS x, coalesce(n, 0) AS n FROM range(32) t(r), X LEFT JOIN B ON B.bucket = r""")
def histogram_keyword(spark, d):
    return analytics.histogram(_lines(spark, d).filter(filters.matches(_SPECS[0])), "line_no", 32)


@query(f"""WITH {_L}, U AS (SELECT count(*) AS units FROM L), B AS (SELECT r AS b, units * r // 64 AS lo, units * (r + 1) // 64 AS hi FROM range(64) t(r), U)
 SELECT CAST(b AS BIGINT) AS bin, (SELECT count(*) FROM L WHERE line_no >= lo AND line_no < hi) AS n FROM B""")
def timeline_density(spark, d):
    lines = _lines(spark, d)
    return analytics.density(lines, lines.count(), 64)


@query(f"""WITH {_L}, X AS (SELECT min(ts_ms) AS lo, greatest(max(ts_ms) - min(ts_ms), 1) AS span FROM L)
 SELECT (ts_ms - lo) * 2047 // span AS bucket, 'lane_0' AS lane, count(*) AS n FROM L, X WHERE {_LANE_SQL[0]} GROUP BY 1
 UNION ALL SELECT (ts_ms - lo) * 2047 // span, 'lane_1', count(*) FROM L, X WHERE {_LANE_SQL[1]} GROUP BY 1""")
def timeline_lanes(spark, d):
    laned = _laned(spark, d)
    lo, hi = analytics.extent(laned, "ts_ms")
    return analytics.lane_counts(laned, ["lane_0", "lane_1"], "ts_ms", 2048, lo, hi)


@query(f"""WITH {_L}, X AS (SELECT min(line_no) AS lo, max(line_no) AS hi FROM L)
 SELECT (line_no - lo) * 999 // greatest(hi - lo, 1) AS "column", count(*) AS n, min(line_no) AS first_x, max(line_no) AS last_x, min(line_no) AS first_line, max(line_no) AS last_line,
 CASE WHEN count(*) = 1 THEN min(line_no) END AS sole_line FROM L, X WHERE {_LANE_SQL[0]} GROUP BY 1""")
def resolve_bins(spark, d):
    laned = _laned(spark, d)
    lo, hi = analytics.extent(laned, "line_no")
    return analytics.lane_bins(laned, "lane_0", 1000, lo, hi)


@query(f"WITH {_L} SELECT line_no, ts_ms, ts_ms - p AS gap_ms FROM (SELECT *, lag(ts_ms) OVER (ORDER BY line_no) AS p FROM L) WHERE ts_ms > p ORDER BY gap_ms DESC, line_no LIMIT 3")
def time_gaps(spark, d):
    return analytics.time_gaps(_lines(spark, d), ["doc_id"])


@query(f"WITH {_L}, X AS (SELECT min(ts_ms) AS lo FROM L) SELECT (ts_ms - lo) // 60000 * 60000 + lo AS window_start_ms, count(*) AS n FROM L, X GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1")
def densest_minute(spark, d):
    return analytics.densest_minute(_lines(spark, d))


@query(f"WITH {_T} SELECT template_id, count(*) AS n FROM T GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5")
def top_templates(spark, d):
    return analytics.top_templates(_typed(spark, d))


_P = """P AS (SELECT template_id, event_type || ' user=<NUM> value=<NUM> props={"k": <NUM>}' AS pattern FROM I UNION ALL SELECT 0, '<EMPTY>' UNION ALL SELECT 99, 'never seen, fatal')"""


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    """The mined templates, the one of blank lines and one that no line has."""
    more = spark.createDataFrame([(0, "<EMPTY>"), (99, "never seen, fatal")], "template_id int, pattern string")
    return _mined_messages(spark, d)[1].select("template_id", "pattern").unionByName(more)


@query(f"WITH {_T}, {_P} SELECT P.template_id, pattern, count(T.line_no) AS seen FROM P LEFT JOIN T USING (template_id) GROUP BY 1, 2")
def template_dictionary(spark, d):
    return analytics.template_dictionary(_patterns(spark, d), _typed(spark, d))


@query(f"WITH {_T}, {_P} SELECT template_id, pattern, count(*) AS n FROM P JOIN T USING (template_id) WHERE contains(lower(pattern), 'error') OR contains(lower(pattern), 'fatal') GROUP BY 1, 2")
def error_templates(spark, d):
    return analytics.error_templates(_patterns(spark, d), _typed(spark, d))


@query(f"WITH {_T}, {_P} SELECT template_id, pattern, count(*) AS n, min(line_no) AS first_line, max(line_no) AS last_line FROM P JOIN T USING (template_id) WHERE contains(pattern, 'i') GROUP BY 1, 2")
def template_browser(spark, d):
    return analytics.template_browser(_patterns(spark, d), _typed(spark, d), "i")


_VALUES = f"{_L}, T AS (SELECT line_no, ts_ms, CAST(round(value * 100) AS BIGINT) // 10 AS template_id FROM L)"


@query(f"""WITH {_VALUES}, M AS (SELECT count(*) AS m FROM T),
 B AS (SELECT template_id, least(line_no * 50 // m, 49) AS b, count(*) AS n, min(line_no) AS p FROM T, M GROUP BY 1, 2),
 S AS (SELECT template_id, CAST(sum(n) AS BIGINT) AS n, max(n) AS peak, min(p) AS first_line FROM B GROUP BY 1)
 SELECT * FROM (SELECT template_id, n, first_line, array_to_string(list_filter([CASE WHEN n <= greatest(m // 1000, 1) THEN 'rare' END, CASE WHEN first_line >= m * 9 // 10 THEN 'first_seen_late' END, CASE WHEN n >= 10 AND peak * 2 >= n THEN 'bursty' END], lambda x: x IS NOT NULL), ',') AS reasons,
 CAST(len(list_filter([n <= greatest(m // 1000, 1), first_line >= m * 9 // 10, n >= 10 AND peak * 2 >= n], lambda x: x)) AS INT) AS n_reasons FROM S, M) WHERE n_reasons > 0""")
def anomalies(spark, d):
    lines = _lines(spark, d, "value")
    t = F.floor(F.round(F.col("value") * 100).cast("long") / 10)
    return analytics.anomalies(lines.withColumn("template_id", t), ["doc_id"])


@query(f"""WITH {_T}, C AS (SELECT *, CASE WHEN lag(template_id) OVER (ORDER BY line_no) = template_id THEN 0 ELSE 1 END AS turn FROM T),
 N AS (SELECT *, sum(turn) OVER (ORDER BY line_no) AS run FROM C)
 SELECT min(line_no) AS start_line, max(line_no) AS end_line, count(*) AS n, any_value(template_id) AS template_id, arg_min(ts_ms, line_no) AS time_start, arg_max(ts_ms, line_no) AS time_end FROM N GROUP BY run""")
def run_length_sequence(spark, d):
    return analytics.run_lengths(_typed(spark, d), ["doc_id"]).drop("doc_id")


@query(f"WITH {_T} SELECT ts_ms, line_no + 1 AS line, template_id FROM T ORDER BY line_no LIMIT 2000")
def log_sequence(spark, d):
    return _typed(spark, d).orderBy("line_no").limit(2000).select("ts_ms", (F.col("line_no") + 1).alias("line"), "template_id")


@query(f"WITH {_L} SELECT line_no + 1 AS line, text FROM L WHERE line_no BETWEEN 9 AND 2008")
def raw_log_range(spark, d):
    return select.resolve(_lines(spark, d), 10, 2009).select((F.col("line_no") + 1).alias("line"), "text")


def _samples(name: str, strategy: str, sql: str):
    def run(spark, d):
        hits = _typed(spark, d).filter("template_id = 2")
        return analytics.samples(hits, ["doc_id"], 7, strategy).select("line_no", "text")

    run.__name__ = name
    query(f"WITH {_T}, S AS (SELECT line_no, text, row_number() OVER (ORDER BY line_no) - 1 AS p, count(*) OVER () AS m FROM T WHERE template_id = 2) SELECT line_no, text FROM S WHERE {sql}")(run)


_samples("samples_first", "first", "p < 7")
_samples("samples_even", "even", "list_contains([k * (m - 1) // 6 for k in range(7)], p) OR m <= 7")


@query()
def samples_spread(spark, d):
    return analytics.samples(_typed(spark, d).filter("template_id = 2"), ["doc_id"], 7).select("line_no", "text")


# --- records

def _oracle(spark, d):
    o = table(spark, d, "oracle_lines").filter("row_id is not null").dropDuplicates(["row_id"])
    header = F.col("class") == "header"
    return o.withColumn("is_header", header).withColumn("header_ms", F.when(header & (F.col("time") == "explicit"), F.col("row_id"))).withColumn("header_state", F.when(header, F.when(F.col("time") == "explicit", "explicit").otherwise("missing")))


@query("SELECT DISTINCT row_id, owner, CASE WHEN class = 'header' AND time <> 'explicit' THEN 'missing' ELSE time END AS provenance FROM oracle_lines WHERE row_id IS NOT NULL")
def record_ownership(spark, d):
    s = records.record_state(_oracle(spark, d).drop("owner"), ["case_id"])
    return s.select("row_id", F.col("owner_line").alias("owner"), "provenance")


@query("""WITH O AS (SELECT DISTINCT case_id, line_no, line, owner FROM oracle_lines WHERE owner IS NOT NULL)
 SELECT case_id, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY line_no) AS message FROM O GROUP BY case_id, owner""")
def record_messages(spark, d):
    s = records.record_state(_oracle(spark, d).drop("owner"), ["case_id"])
    return records.records(s, ["case_id"], text="line").select("case_id", "first_line", "last_line", "n_lines", "message")


@query("SELECT case_id, count(DISTINCT row_id) FILTER (class = 'header') AS records, count(DISTINCT row_id) AS lines FROM oracle_lines GROUP BY case_id")
def record_match_rate(spark, d):
    return records.match_rate(records.record_state(_oracle(spark, d).drop("owner"), ["case_id"]), ["case_id"])


@query("SELECT case_id, count(DISTINCT row_id) AS records FROM oracle_lines WHERE class = 'header' AND line_no BETWEEN 10 AND 49 GROUP BY case_id")
def record_count_by_range(spark, d):
    return records.count_records(records.record_state(_oracle(spark, d).drop("owner"), ["case_id"]), ["case_id"], 10, 50)


# --- timestamp families

def _family(name: str, family: str, render: str, sql_render: str, sql_ms: str = "epoch_us(date_trunc('second', ts)) // 1000"):
    def run(spark, d):
        e = table(spark, d, "events")
        stamp = F.expr(render)
        return e.select("event_id", families.time_of(stamp, families.BY_NAME[family], 1735603200000).alias("ms"), families.matched(stamp, families.BY_NAME[family]).alias("stamp"))

    run.__name__ = name
    query(f"SELECT event_id, CAST({sql_ms} AS BIGINT) AS ms, {sql_render} AS stamp FROM events")(run)


_family("family_iso", "ISO-8601", "concat('x ', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS\"), '+02:00 y')", "strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '+02:00'", "epoch_us(ts) // 1000 - 7200000")
_family("family_slash", "YYYY/MM/DD", "concat(date_format(ts, 'yyyy/MM/dd HH:mm:ss'), ' y')", "strftime(ts, '%Y/%m/%d %H:%M:%S')")
_family("family_us", "MM/DD/YYYY", "concat(date_format(ts, 'MM/dd/yyyy HH:mm:ss'), ' y')", "strftime(ts, '%m/%d/%Y %H:%M:%S')")
_family("family_us_dash", "MM-DD-YYYY", "concat(date_format(ts, 'MM-dd-yyyy HH:mm:ss'), ' y')", "strftime(ts, '%m-%d-%Y %H:%M:%S')")
_family("family_eu_dash", "DD-MM-YYYY", "concat(date_format(ts, 'dd-MM-yyyy HH:mm:ss'), ' y')", "strftime(ts, '%d-%m-%Y %H:%M:%S')")
_family("family_dots", "DD.MM.YYYY", "concat(date_format(ts, 'dd.MM.yyyy HH:mm:ss'), ' y')", "strftime(ts, '%d.%m.%Y %H:%M:%S')")
_family("family_dots_iso", "YYYY.MM.DD", "concat(date_format(ts, 'yyyy.MM.dd HH:mm:ss.SSS'), ' y')", "strftime(ts, '%Y.%m.%d %H:%M:%S.%g')", "epoch_us(ts) // 1000")
_family("family_apache", "Apache CLF", "concat('h - [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' -0500] y')", "strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' -0500'", "epoch_us(date_trunc('second', ts)) // 1000 + 18000000")
_family("family_epoch", "epoch", "concat(unix_millis(cast(ts as timestamp)), ' y')", "CAST(epoch_us(ts) // 1000 AS VARCHAR) || ' '", "epoch_us(ts) // 1000")
_family("family_rfc2822", "RFC 2822", "concat(date_format(ts, 'EEE, dd MMM yyyy HH:mm:ss'), ' +0000 y')", "strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' +0000'")
_family("family_12h", "ISO-8601 12h AM/PM", "concat(date_format(ts, 'yyyy-MM-dd hh:mm:ss a'), ' y')", "strftime(ts, '%Y-%m-%d %I:%M:%S %p')")
_family("family_syslog", "BSD syslog", "concat(date_format(ts, 'MMM dd HH:mm:ss'), ' y')", "strftime(ts, '%b %d %H:%M:%S')")
_family("family_logcat", "logcat threadtime", "concat(date_format(ts, 'MM-dd HH:mm:ss.SSS'), ' y')", "strftime(ts, '%m-%d %H:%M:%S.%g')", "epoch_us(ts) // 1000")
_family("family_glog", "glog", "concat('I', date_format(ts, 'MMdd HH:mm:ss.SSS'), ' y')", "strftime(ts, 'I%m%d %H:%M:%S.%g')", "epoch_us(ts) // 1000")


@query(f"WITH {_L} SELECT line_no, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d %H:%M:%S.%g') AS rendered FROM L")
def render_time(spark, d):
    return _lines(spark, d).select("line_no", families.format_ms(F.col("ts_ms")).alias("rendered"))


# --- masks and templates

@query(rf"""WITH {_L} SELECT line_no, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
 text, '^\S+ ', ''), 'user=\d+', 'user=<NUM>'), 'value=-?\d+', 'value=<NUM>'), '\{{"k": (\d+)\}}', '{{"k": <NUM>}}') AS content FROM L""")
def mask_lines(spark, d):
    return formats.normalised(_lines(spark, d).select("line_no", "text"), "plain", families.BY_NAME["ISO-8601"]).select("line_no", "content")


#: Words of each class that an event's numbers and words make, in Spark and in SQL alike, and what they are masked to.
_WORDS = [
    ("concat('10.0.', user_id % 256, '.1:8080')", "'<IP>'"), ("concat('u', user_id, '@b.example')", "'<EMAIL>'"), ("concat('https://x.test/', user_id)", "'<URL>'"), ("concat('123e4567-e89b-12d3-a456-', lpad(cast(event_id as string), 12, '0'))", "'<UUID>'"),
    ("concat('14:30:', lpad(cast(user_id % 60 as string), 2, '0'), '.123')", "'<TIME>'"), ("concat('fe80::1:', user_id % 10)", "'<IPV6>'"), ("concat('retry=', user_id)", "'retry=<NUM>'"), ("concat('/var/log/', event_type)", "'<PATH>'"), ("concat(user_id, '.5s')", "'<TIME>'"),
    ("concat('-', user_id, '.5')", "'<NUM>'"), ("concat('deadbeef', lpad(cast(user_id % 100 as string), 2, '0'))", "'<HEX>'"), ("concat('worker-', user_id)", "'worker-<NUM>'"), ("event_type", "event_type"), ("concat('key=', event_type)", "concat('key=', event_type)"), ("concat('{\"a\":', user_id, '}')", "'<JSON>'"),
]


@query(" UNION ALL ".join(f"SELECT event_id, {w} AS token, {m} AS masked FROM events WHERE user_id IS NOT NULL" for w, m in _WORDS))
def mask_tokens(spark, d):
    e = table(spark, d, "events").filter("user_id is not null")
    t = e.select("event_id", F.explode(F.array(*[F.expr(w) for w, _ in _WORDS])).alias("token"))
    return t.select("event_id", "token", masking.mask_token(F.col("token")).alias("masked"))


@query(rf"""WITH {_L}, W AS (SELECT unnest(string_split(text, ' ')[2:]) AS w FROM L)
 SELECT CASE WHEN regexp_matches(w, '^(user|value)=') THEN regexp_replace(w, '=-?\d+$', '=<NUM>') WHEN regexp_matches(w, '^\d+\}}$') THEN '<NUM>}}' ELSE w END AS masked, count(*) AS n FROM W GROUP BY 1""")
def mask_class_counts(spark, d):
    """All words of the event lines behind their stamp, masked one by one."""
    t = _lines(spark, d).select(F.explode(F.slice(F.split("text", " "), 2, 1_000_000)).alias("w")).select(masking.mask_token(F.col("w")).alias("masked"))
    return t.groupBy("masked").agg(F.count("*").alias("n"))


def _mined(spark, d):
    content = formats.normalised(_lines(spark, d).select("line_no", "text"), "plain", families.BY_NAME["ISO-8601"]).select("line_no", "content")
    return drain.mine(content)


_BOTH = """K AS (SELECT *, event_type = 'error' AS bad FROM L), B AS (SELECT bad, CAST(row_number() OVER (ORDER BY min(line_no)) AS INT) AS template_id,
 CASE WHEN bad THEN 'ERROR' ELSE 'INFO' END || ' user=<NUM> ' || CASE WHEN count(DISTINCT event_type) > 1 THEN '<*>' ELSE 'action=' || any_value(event_type) END || ' value=<NUM> props={"k": <NUM>}' AS pattern,
 count(*) AS n, min(line_no) AS example_line FROM K GROUP BY bad)"""


@query(f"WITH {_L}, {_BOTH} SELECT template_id, pattern, n, example_line FROM B")
def templates(spark, d):
    return _mined(spark, d)[1].select("template_id", "pattern", "n", "example_line")


@query(f"WITH {_T} SELECT template_id, event_type || ' user=<NUM> value=<NUM> props={{\"k\": <NUM>}}' AS pattern, count(*) AS n, min(line_no) AS example_line FROM T GROUP BY template_id, event_type")
def template_patterns(spark, d):
    return _mined_messages(spark, d)[1].select("template_id", "pattern", "n", "example_line")


@query(f"WITH {_L}, {_BOTH} SELECT line_no, template_id FROM K JOIN B USING (bad)")
def template_lines(spark, d):
    return _mined(spark, d)[0]


@query("""WITH W AS (SELECT p_partkey, lower(p_type) AS a, replace(p_name, ' ', '_') AS w FROM part), G AS (SELECT a, count(*) AS n, min(p_partkey) AS example_line, count(DISTINCT w) AS c, any_value(w) AS w FROM W GROUP BY a)
 SELECT CAST(row_number() OVER (ORDER BY example_line) AS INT) AS template_id, a || ' of brand#<NUM> ' || CASE WHEN c > 1 THEN '<*>' ELSE w END || ' costs size <NUM>' AS pattern, n, example_line FROM G""")
def templates_of_parts(spark, d):
    """Templates of a log that the parts write, one line each: a template per type, names are wildcards."""
    said = F.expr("concat_ws(' ', lower(p_type), 'of', lower(p_brand), replace(p_name, ' ', '_'), 'costs', 'size', cast(p_size as string))")
    lines = table(spark, d, "part").select(F.col("p_partkey").alias("line_no"), said.alias("content"))
    return drain.mine(masking.masked(lines, "content"))[1].select("template_id", "pattern", "n", "example_line")


# --- fields

_FIELDS = {"user": r"user=(\d+)", "action": r"action=(\w+)", "value": r"value=(-?\d+)", "k": r"\"k\": (\d+)"}
_SCHEMA = {"user": "number", "action": "token", "value": "number", "k": "number"}


def _fielded(name: str, expression: str, sql: str, case_sensitive: bool = True):
    def run(spark, d):
        q = fieldquery.FieldQuery.parse(expression, case_sensitive).bind(_SCHEMA)
        df = fieldquery.field_values(_lines(spark, d), _FIELDS)
        return df.filter(q.condition()).select("line_no")

    run.__name__ = name
    query(f"WITH {_L} SELECT line_no FROM L WHERE {sql}")(run)


_fielded("field_number", "value >= 950", "CAST(regexp_extract(text, 'value=(-?[0-9]+)', 1) AS BIGINT) >= 950")
_fielded("field_text", "action = Click", "event_type = 'click'", False)
_fielded("field_not_equal", "action != view", "event_type <> 'view'")
_fielded("field_contains", "action contains ur", "contains(event_type, 'ur')")
_fielded("field_matches", r"action matches ^(view|sign)", "regexp_matches(event_type, '^(view|sign)')")
_FIELDS["bought"], _SCHEMA["bought"] = r"action=(purchase)", "token"  # a field that only some lines have
_fielded("field_exists", "bought exists", "event_type = 'purchase'")
_fielded("field_missing", "bought missing", "event_type <> 'purchase'")


@query(f"WITH {_L} SELECT event_type AS value, count(*) AS n FROM L WHERE starts_with(event_type, 'p') OR starts_with(event_type, 's') GROUP BY 1 ORDER BY n DESC, 1 LIMIT 50")
def field_suggest(spark, d):
    df = fieldquery.field_values(_lines(spark, d), _FIELDS)
    return fieldquery.suggest_values(df, "action", "P").unionByName(fieldquery.suggest_values(df, "action", "s"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


# --- profiles and embedded values

@query("SELECT DISTINCT row_id, line, span_start, span_end FROM oracle_lines WHERE class = 'header' AND time = 'explicit' AND regexp_full_match(timestamp, '[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?')")
def profile_time_spans(spark, d):
    """Where the declared layout of each line finds its ISO time, in bytes of the line."""
    o = table(spark, d, "oracle_lines").filter("row_id is not null").dropDuplicates(["row_id"])
    iso = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"
    o = o.filter((F.col("class") == "header") & (F.col("time") == "explicit") & F.col("timestamp").rlike(iso))
    m = profiles.match_lines(o, "", profiles.Recognizer([families.BY_NAME["ISO-8601"]]), ["row_id", "line"], "line", "profile")
    return m.filter("matched").select("row_id", "line", F.expr("fields['time'].start").alias("span_start"), F.expr("fields['time'].end").alias("span_end"))


@query()
def profile_time_spans_all(spark, d):
    """Every header with an explicit time: the span given, the span its layout finds with all families, and whether they agree."""
    o = table(spark, d, "oracle_lines").filter("row_id is not null").dropDuplicates(["row_id"]).filter((F.col("class") == "header") & (F.col("time") == "explicit"))
    m = profiles.match_lines(o, "", profiles.Recognizer(families.FAMILIES), ["row_id", "line", "timestamp", "span_start", "span_end"], "line", "profile")
    m = m.withColumn("found_start", F.when(F.col("matched"), F.expr("fields['time'].start"))).withColumn("found_end", F.when(F.col("matched"), F.expr("fields['time'].end")))
    same = F.col("span_start").eqNullSafe(F.col("found_start")) & F.col("span_end").eqNullSafe(F.col("found_end"))
    shape = F.regexp_replace(F.regexp_replace("timestamp", r"\p{N}", "9"), r"\p{L}+", "A")
    verdict = F.when(~F.coalesce("matched", F.lit(False)), "not recognised").when(same, "same").otherwise("another span")
    return m.select("row_id", "line", shape.alias("shape"), "span_start", "span_end", "found_start", "found_end", verdict.alias("verdict"))


@query(f"WITH {_L} SELECT line_no, 'explicit' AS time_state, regexp_extract(text, '^[^ ]+') AS time, CAST(user_id AS VARCHAR) AS user_id, regexp_extract(text, '(action=.*)$', 1) AS log FROM L")
def profile_layout(spark, d):
    """Fields that a declared layout with a typed field reads from the event lines."""
    m = profiles.match_lines(_lines(spark, d), "{time} {level} user={user_id:number} {log}", profiles.Recognizer([families.BY_NAME["ISO-8601"]]), ["line_no"])
    return m.filter("matched").select("line_no", "time_state", *[F.expr(f"fields['{f}'].value").alias(f) for f in ("time", "user_id", "log")])


@query(f"WITH {_L} SELECT line_no, regexp_extract(text, '^[^ ]+') AS time, event_type AS action, regexp_extract(text, '(value=.*)$', 1) AS log, CAST(instr(text, 'action=') + 6 AS INT) AS action_start FROM L")
def profile_advanced(spark, d):
    """The same by an advanced profile: an expression with named groups."""
    m = profiles.match_lines(_lines(spark, d), r"\A(?<timestamp>\S+) [A-Z]+ user=\d+ action=(?<action>\w+) (?<log>.*)", profiles.Recognizer([families.BY_NAME["ISO-8601"]]), ["line_no"])
    return m.filter("matched").select("line_no", F.expr("fields['timestamp'].value").alias("time"), *[F.expr(f"fields['{f}'].value").alias(f) for f in ("action", "log")], F.expr("fields['action'].start").alias("action_start"))


@query()
def profile_fields(spark, d):
    """Fields that each declared layout reads from the lines of its log."""
    ic = table(spark, d, "inline_contract").filter("template is not null").select("line_id", "line", "template").dropDuplicates(["line_id"])
    m = profiles.match_lines(ic, "", profiles.Recognizer(families.FAMILIES), ["line_id"], "line", "template")
    return m.filter("matched").select("line_id", "time_state", *[F.expr(f"fields['{f}'].value").alias(f) for f in ("time", "loglevel", "log")])


@query()
def embedded_detections(spark, d):
    return detections(table(spark, d, "documents").filter("text is not null").select("doc_id", "text").dropDuplicates(["doc_id"]), ["doc_id"], "text")


@query("SELECT event_id, 'json' AS detector, 'object' AS root_kind, props AS raw FROM events WHERE props IS NOT NULL")
def embedded_json(spark, d):
    from cairnlog.operators.embedded.detectors import detect_json

    return detections(table(spark, d, "events"), ["event_id"], "props", [detect_json]).select("event_id", "detector", "root_kind", "raw")


@query("SELECT event_id, 'logfmt' AS detector, 3 AS fields FROM events")
def embedded_logfmt(spark, d):
    from cairnlog.operators.embedded.detectors import detect_logfmt

    e = table(spark, d, "events").select("event_id", F.concat(F.lit("INFO user="), "user_id", F.lit(" action="), "event_type", F.lit(" ok=true")).alias("t"))
    return detections(e, ["event_id"], "t", [detect_logfmt]).select("event_id", "detector", F.size(F.from_json("data", "map<string,string>")).alias("fields"))


@query()
def format_diagnostics(spark, d):
    lines = _lines(spark, d)
    x = formats.diagnose(lines, lines.count())
    return spark.createDataFrame([(x.format, x.time_format, x.confidence, x.sampled_lines)], "format string, time_format string, confidence string, sampled_lines int")


# --- streaming

@query(f"WITH {_L} SELECT ts_ms // 3600000 AS bucket, count(*) AS n FROM L WHERE {_LANE_SQL[0]} GROUP BY 1")
def stream_equals_batch(spark, d):
    """The events as a stream of files, filtered and counted by hour; the final counts equal a batch run."""
    source = stage(_lines(spark, d).select("line_no", "ts_ms", "text"), "stream-source")
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 4).parquet(source.inputFiles()[0].rsplit("/", 1)[0])
    counts = tail.time_counts(tail.filtered(stream, [_SPECS[0]]), 3_600_000)

    def publish(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/out")

    q = counts.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    updates = spark.read.schema("bucket long, n long, batch int").parquet(f"{folder}/out")
    return updates.groupBy("bucket").agg(F.max_by("n", "batch").alias("n"))


@query(f"WITH {_L} SELECT line_no, row_number() OVER (ORDER BY line_no) - 1 AS position FROM L WHERE {_LANE_SQL[0]}")
def positions_of_matches(spark, d):
    return number_rows(_lines(spark, d).filter(filters.matches(_SPECS[0])), "line_no", ["doc_id"]).select("line_no", "position")
