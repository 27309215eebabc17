"""Queries of the embedded-value detectors: each document's numbers and words written in a notation and read back.

The texts are made of documents' columns, one per document, so SQL can say what must be found: where, and as what.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlog.operators.embedded import detections
from cairnlog.operators.embedded import detectors as D
from cairnlog.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: What {u}, {k} ... stand for, in Spark and in SQL: characters of the text, kind of post, votes, a fixed-width number, base64.
_COLUMNS: dict[str, tuple[str, str]] = {
    "u": ("cast(n_chars as string)", "CAST(n_chars AS VARCHAR)"),
    "k": ("post_kind", "post_kind"),
    "v": ("cast(coalesce(votes, 0) as string)", "CAST(coalesce(votes, 0) AS VARCHAR)"),
    "w": ("lpad(cast(n_chars as string), 8, '0')", "lpad(CAST(n_chars AS VARCHAR), 8, '0')"),
    "b": ("base64(encode(concat('user=', lpad(cast(n_chars as string), 8, '0'), ';Kind=', post_kind), 'UTF-8'))", "to_base64(encode('user=' || lpad(CAST(n_chars AS VARCHAR), 8, '0') || ';Kind=' || post_kind))"),
    "c": ("cast(4 * ceil((19 + length(post_kind)) / 3) as string)", "CAST(4 * ((19 + length(post_kind) + 2) // 3) AS VARCHAR)"),
    "n": ("cast(19 + length(post_kind) as string)", "CAST(19 + length(post_kind) AS VARCHAR)"),
}


def _parts(pattern: str) -> list[tuple[bool, str]]:
    """Literals and columns of a pattern, columns written as <u>."""
    out, at = [], 0
    while (i := pattern.find("<", at)) >= 0:
        if pattern[i + 2 : i + 3] == ">" and pattern[i + 1] in _COLUMNS:
            out += [(False, pattern[at:i]), (True, pattern[i + 1])]
            at = i + 3
        else:
            j = i + 1
            out.append((False, pattern[at:j]))
            at = j
    return [p for p in [*out, (False, pattern[at:])] if p[1]]


def _spark(pattern: str) -> Column:
    return F.concat(*[F.expr(_COLUMNS[x][0]) if named else F.lit(x) for named, x in _parts(pattern)], F.lit(""))


def _sql(pattern: str) -> str:
    return " || ".join(_COLUMNS[x][1] if named else "'" + x.replace("'", "''") + "'" for named, x in _parts(pattern)) or "''"


def _query(name: str, found: list[tuple[str, str, str, str, str]], detectors: list | None, tail: str = "") -> None:
    """found: (text before, detector, root kind, raw, data) in order; the text is all of that and a tail."""
    text = "".join(before + raw for before, _, _, raw, _ in found) + tail

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "post_kind", "votes").dropDuplicates(["doc_id"])
        made = docs.filter("doc_id is not null and n_chars is not null and post_kind is not null").select("doc_id", _spark(text).alias("t"))
        return detections(made, ["doc_id"], "t", detectors).select("doc_id", "detector", "span_start", "root_kind", "raw", "data")

    run.__name__ = name
    rows, before = [], ""
    for lead, detector, kind, raw, data in found:
        before += lead
        rows.append(f"SELECT doc_id, '{detector}' AS detector, CAST(length({_sql(before)}) AS INT) AS span_start, '{kind}' AS root_kind, {_sql(raw)} AS raw, {_sql(data)} AS data FROM D")
        before += raw
    QUERIES[name] = run
    ORACLE[name] = "WITH D AS (SELECT DISTINCT doc_id, n_chars, post_kind, votes FROM documents WHERE doc_id IS NOT NULL AND n_chars IS NOT NULL AND post_kind IS NOT NULL) " + " UNION ALL ".join(rows)


_JSON = '{"user": <u>, "kind": "<k>", "votes": [<v>, true, null]}'
_query("embedded_json_array", [("seen <v> times: ", "json", "object", _JSON, _JSON), (" and ", "json", "array", '[<u>, {"kind": "<k>"}]', '[<u>, {"kind": "<k>"}]')], [D.detect_json], " end")
_query("embedded_plist_xml", [("dump ", "plist", "object", '<plist version="1.0"><dict><key>user</key><integer><u></integer><key>kind</key><string><k></string><key>votes</key><array><integer><v></integer><true/></array></dict></plist>', '{"user": <u>, "kind": "<k>", "votes": [<v>, true]}')], [D.detect_plist])
_query("embedded_plist_open_step", [("propertyList = ", "plist", "object", '{ user = <u>; kind = "<k>"; tags = ( a, YES ); }', '{"user": <u>, "kind": "<k>", "tags": ["a", true]}')], [D.detect_plist], " done")
_query("embedded_encoded", [("key ", "hex", "object", "deadbeef00<w>", '{"encoding": "hex", "characters": 18, "decoded_bytes": 9}'), (", body ", "base64", "object", "<b>", '{"encoding": "base64", "characters": <c>, "decoded_bytes": <n>}')], [D.detect_encoded], " end")
_query("embedded_http_request", [("> ", "http", "object", "GET /api/<k>?user=<u>&votes=<v> HTTP/1.1\nHost: h.test\nAccept: */*", '{"method": "GET", "path": "/api/<k>", "version": "HTTP/1.1", "query": {"user": "<u>", "votes": "<v>"}, "headers": {"Host": "h.test", "Accept": "*/*"}}')], [D.detect_http], "\n\nend")
_query("embedded_http_response", [("", "http", "object", "HTTP/1.1 404 Not Found\nServer: s-<k>\nX-Id: <u>", '{"version": "HTTP/1.1", "status": 404, "reason": "Not Found", "headers": {"Server": "s-<k>", "X-Id": "<u>"}}')], [D.detect_http])
_query("embedded_stack_jvm", [("failed: ", "stacktrace", "object", "java.lang.IllegalStateException: bad <u>\n\tat a.b.C.d(C.java:<u>)\n\tat a.b.C.<k>(C.java:43)", '{"language": "java", "type": "java.lang.IllegalStateException", "message": "bad <u>", "frames": ["a.b.C.d(C.java:<u>)", "a.b.C.<k>(C.java:43)"]}')], [D.detect_stacktrace])
_query("embedded_stack_python", [("", "stacktrace", "object", 'Traceback (most recent call last):\n  File "/a/<k>.py", line <u>, in run\nValueError: bad <v>', '{"language": "python", "type": "ValueError", "message": "bad <v>", "frames": [{"file": "/a/<k>.py", "line": <u>, "function": "run"}]}')], [D.detect_stacktrace])
_query("embedded_protobuf", [("", "protobuf-text", "object", 'user { id: <u> name: "<k>" votes: <v> }', '{"user": {"id": <u>, "name": "<k>", "votes": <v>}}')], [D.detect_protobuf])
_query("embedded_python", [("args ", "python", "object", "{'user': <u>, 'kind': '<k>', 'ok': True, 'none': None, 'votes': (<v>, 1)}", '{"user": <u>, "kind": "<k>", "ok": true, "none": null, "votes": [<v>, 1]}')], [D.detect_python])
_query("embedded_foundation", [("got ", "foundation", "object", "<Click: 0x600001; user = <u>; votes = <v>>", '{"type": "Click", "address": "0x600001", "user": <u>, "votes": <v>}')], [D.detect_foundation])
_query("embedded_swift", [("", "foundation", "object", 'Event(user: <u>, kind: "<k>")', '{"type": "Event", "user": <u>, "kind": "<k>"}')], [D.detect_foundation])
_query("embedded_jvm", [("", "jvm-debug", "object", "Event{user=<u>, kind=<k>, votes=<v>}", '{"type": "Event", "user": <u>, "kind": "<k>", "votes": <v>}'), (" then ", "jvm-debug", "object", "Event(user=<u>, kind=<k>)", '{"type": "Event", "user": <u>, "kind": "<k>"}')], [D.detect_jvm])
_query("embedded_logfmt_values", [("", "logfmt", "object", 'user=<u> kind=<k> votes=<v> msg="a b"', '{"user": <u>, "kind": "<k>", "votes": <v>, "msg": "a b"}')], [D.detect_logfmt])
_query("embedded_fields", [("", "fields", "object", "user: <u>, kind: <k>, votes: <v>", '{"user": <u>, "kind": "<k>", "votes": <v>}')], [D.detect_fields])
_query("embedded_arbitration", [("at 10 ", "json", "object", '{"user": <u>, "q": "a=1 b=2 c=3 d=<v>"}', '{"user": <u>, "q": "a=1 b=2 c=3 d=<v>"}')], None)
