"""A session over loaded logs: the calls a client makes, with JSON-ready answers; also served over stdio."""

from __future__ import annotations

import json
import os
import sys
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, TextIO

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlog.functions import families, masking
from cairnlog.jobs import Job, StageTimes
from cairnlog.operators import analytics, drain, fieldquery, filters, formats, profiles, records, select
from cairnlog.session import stage
from cairnlog.sources.lines import FileState, file_change, file_state, last_line_start, read_lines, read_range

LINE_BYTES, PAGE, CACHED = 1000, 2000, 128


@dataclass
class Document:
    """One loaded log; lines are persisted as they are used by every call."""

    log_id: str
    lines: DataFrame
    templates: DataFrame
    diagnostics: formats.Diagnostics
    total: int
    filters: filters.FilterSet = field(default_factory=filters.FilterSet)
    pins: list[dict] = field(default_factory=list)
    trimmed: tuple[int, int | None] | None = None
    path: str | None = None
    state: FileState | None = None
    partial: int | None = None  # where an unfinished last line begins
    settled: dict[int, tuple] = field(default_factory=dict)  # templates of the finished lines: id -> (pattern, count, example line)
    classify: Callable[[DataFrame], DataFrame] | None = None
    content: Callable[[DataFrame], DataFrame] | None = None
    appends: int = 0
    times: StageTimes = field(default_factory=StageTimes)
    schema: dict[str, str] = field(default_factory=dict)
    _matches: OrderedDict = field(default_factory=OrderedDict)

    def matching(self, spec: filters.FilterSpec) -> DataFrame:
        """Lines a matcher hits, kept for repeated calls; the least recently used of CACHED are let go."""
        key = (spec.text, spec.case_sensitive, spec.regex, spec.template_id)
        if key not in self._matches:
            self._matches[key] = self.lines.filter(filters.matches(spec)).select("doc_id", "line_no", "ts_ms", "text", "template_id").persist(StorageLevel.MEMORY_AND_DISK)
            if len(self._matches) > CACHED:
                self._matches.popitem(last=False)[1].unpersist()
        self._matches.move_to_end(key)
        return self._matches[key]

    def holding(self, expression: str, case_sensitive: bool = True) -> DataFrame:
        """All lines of the records whose declared field meets a query; lines before the first record never do."""
        q = fieldquery.FieldQuery.parse(expression, case_sensitive).bind(self.schema)
        kind = self.schema[q.field]
        value = F.col("header_ms") if kind == "timestamp" else F.col("fields")[q.field]
        hit = self.lines.filter(F.col("fields").isNotNull() & F.coalesce(q.condition(value), F.lit(False))).select("doc_id", "record_id")
        return self.view(False).join(hit, ["doc_id", "record_id"], "left_semi")

    def close(self) -> None:
        for df in (self.lines, self.templates, *self._matches.values()):
            df.unpersist()

    def view(self, filtered: bool) -> DataFrame:
        df = self.lines
        if self.trimmed is not None:
            lo, hi = self.trimmed
            df = df.filter(F.col("line_no") >= lo) if hi is None else df.filter(F.col("line_no").between(lo, hi))
        return self.filters.apply(df) if filtered and self.filters.specs else df


def cut(text: str | None, size: int = LINE_BYTES) -> str:
    raw = (text or "").encode()
    return text or "" if len(raw) <= size else raw[:size].decode("utf-8", "ignore") + "…"


class Session:
    """load, search, summarise: each method is a call of the tool catalogue."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.documents, self._next = spark, {}, 0

    def load_log(self, path: str, reference_ms: int | None = None, time_format: str | None = None, profile: str | None = None) -> dict:
        """Reads, indexes and mines a file; profile is a declared header layout."""
        state = file_state(path) if os.path.isfile(path) else None
        return self.load_lines(read_lines(self.spark, path), reference_ms, time_format, profile, path if state else None, state)

    def load_log_async(self, path: str, **options: Any) -> Job:
        """load_log in the background, with progress and cancellation."""
        return Job(self.spark, lambda: self.load_log(path, **options))

    def load_lines(self, raw: DataFrame, reference_ms: int | None = None, time_format: str | None = None, profile: str | None = None, path: str | None = None, state: FileState | None = None) -> dict:
        """raw: (doc_id, line_no, text) of one log; path and state: of the file, if it may grow."""
        times = StageTimes()
        with times.stage("indexing"):
            total = raw.count()
        with times.stage("detecting"):
            d = formats.diagnose(raw, total, time_format)
        family = families.BY_NAME.get(d.time_format) if d.time_format else None
        if profile:
            return self._load_declared(raw, total, d, profile, reference_ms, time_format, times, path, state)
        classify = lambda lines: _classified(lines, d, family, reference_ms)
        content = lambda df: formats.normalised(df.select("line_no", "text"), d.format, family).select("line_no", "content")
        return self._keep(raw, classify, content, d, total, times, {}, path, state)

    def _load_declared(self, raw: DataFrame, total: int, d: formats.Diagnostics, layout: str, reference_ms: int | None, named: str | None, times: StageTimes, path: str | None, state: FileState | None) -> dict:
        p = profiles.compile_profile(layout)
        time = "time" if p.regex is None else "timestamp"
        confidence, names = profiles.resolve_time(p, formats.sample_lines(raw, total), named)
        if len(names) != 1:
            raise ValueError(f"the time of the layout is {confidence.lower()}: {', '.join(names) or 'no family fits'}")
        family = families.BY_NAME[names[0]]

        def classify(lines: DataFrame) -> DataFrame:
            m = profiles.match_lines(lines, layout, profiles.Recognizer([family]), ["doc_id", "line_no", "text"], first=F.col("line_no") == 0)
            values = F.transform_values("fields", lambda _, v: v["value"])
            df = m.select("doc_id", "line_no", "text", F.col("matched").alias("is_header"), F.col("time_state").alias("header_state"), F.when(F.col("matched"), values).alias("fields"))
            return df.withColumn("header_ms", F.when(F.col("header_state") == "explicit", families.time_of(F.col("fields")[time], family, reference_ms)))

        content = lambda df: masking.masked(df.select("line_no", F.coalesce(F.col("fields")["log"], F.col("text")).alias("content")), "content")
        d = formats.Diagnostics("profile", family.name, confidence, (), d.sampled_lines, None)
        return self._keep(raw, classify, content, d, total, times, p.schema, path, state)

    def _keep(self, raw: DataFrame, classify: Callable, content: Callable, d: formats.Diagnostics, total: int, times: StageTimes, schema: dict[str, str], path: str | None, state: FileState | None) -> dict:
        empty = self.spark.createDataFrame([], _LINES)
        doc = Document("", empty, self.spark.createDataFrame([], _TEMPLATES), d, 0, times=times, schema=schema, path=path, state=state, classify=classify, content=content)
        if state is not None:
            start = last_line_start(path, state.size)
            doc.partial = start if start < state.size or state.size == 0 else None
        with times.stage("mining"):
            self._extend(doc, raw, 0, total)
        self._next += 1
        doc.log_id = f"log_{self._next}"
        self.documents[doc.log_id] = doc
        return self.stats(doc.log_id)

    def _extend(self, doc: Document, raw: DataFrame, first: int, total: int) -> None:
        """Puts lines from number `first` on in place of the document's; everything is published at the end at once.

        Record state goes on from the last header before, the miner from the templates of the finished lines. An
        unfinished last line is mined on top of them and forgotten when it is read again.
        """
        df = doc.classify(raw)
        if "fields" not in df.columns:
            df = df.withColumn("fields", F.lit(None).cast("map<string,string>"))
        before = doc.lines.filter(F.col("line_no") < first)
        headers = before.filter(F.col("provenance").isin("explicit", "missing", "invalid"))
        last = headers.agg(F.max_by(F.struct("doc_id", "line_no", "header_ms", "provenance", "record_id"), "line_no").alias("r")).first().r if first else None
        columns = ["doc_id", "line_no", "text", "is_header", "header_ms", "header_state", "fields"]
        df = df.select(columns)
        if last is not None:  # the open record's header goes along
            df = df.unionByName(self.spark.createDataFrame([(last.doc_id, last.line_no, None, True, last.header_ms, last.provenance, None)], df.schema))
        df = records.record_state(df.withColumn("log", F.lit(0)), ["log"]).filter(F.col("line_no") >= first)
        df = df.withColumn("ts_ms", F.col("owner_ms")).withColumn("record_id", F.col("record_id") + F.lit(last.record_id if last is not None else 0))
        df = stage(df, "document-lines")
        finished = total - (doc.partial is not None)
        content = doc.content(df)
        numbered, templates = drain.mine(content.filter(F.col("line_no") < finished), stored=_stored(doc.settled))
        settled = _merged(doc.settled, templates)
        shown = settled
        if doc.partial is not None:
            tail, more = drain.mine(content.filter(F.col("line_no") >= finished), stored=_stored(settled))
            numbered, shown = numbered.unionByName(tail), _merged(settled, more)
        new = df.join(numbered, "line_no", "left").select(*[f.split()[0] for f in _LINES.split(", ")]).persist(StorageLevel.MEMORY_AND_DISK)
        lines = before.unionByName(new) if first else new
        doc.appends += bool(first)
        if first and doc.appends % 16 == 0:  # a plan of many small parts is written as one
            lines = stage(lines, "document")
        old, matches = doc.templates, OrderedDict()
        for key, df in doc._matches.items():  # matchers are extended from the first changed line on
            spec = filters.FilterSpec(key[0], key[1], regex=key[2], template_id=key[3])
            matches[key] = df.filter(F.col("line_no") < first).unionByName(new.filter(filters.matches(spec)).select(df.columns)).persist(StorageLevel.MEMORY_AND_DISK)
        doc.lines, doc._matches, doc.settled, doc.total = lines.persist(StorageLevel.MEMORY_AND_DISK), matches, settled, total
        doc.templates = self.spark.createDataFrame([(i, *t) for i, t in sorted(shown.items())], _TEMPLATES).persist(StorageLevel.MEMORY_AND_DISK)
        old.unpersist()

    def append(self, log_id: str | None = None) -> dict:
        """Reads what a log's file has gained; says which line changed first and how many came."""
        d = self._doc(log_id)
        if d.state is None:
            raise ValueError("only a log of one file can grow")
        change = file_change(d.state, d.path)
        if change == "unchanged":
            return {"log_id": d.log_id, "first_changed_line": None, "added_lines": 0, "total_lines": d.total}
        if change != "appended":
            raise ValueError(f"{d.path} was {change}: load it again")
        now, was = file_state(d.path), d.total
        first = d.total - (d.partial is not None)
        raw = stage(read_range(self.spark, d.path, d.state.size if d.partial is None else d.partial, now.size, first), "appended")
        total = first + raw.count()
        start = last_line_start(d.path, now.size)
        d.partial, d.state = (start if start < now.size else None), now
        self._extend(d, raw, first, total)
        return {"log_id": d.log_id, "first_changed_line": first + 1, "added_lines": total - was, "total_lines": total}

    def _doc(self, log_id: str | None) -> Document:
        if log_id is None and len(self.documents) == 1:
            return next(iter(self.documents.values()))
        if log_id not in self.documents:
            raise KeyError(f"no such log: {log_id}")
        return self.documents[log_id]

    def session_info(self) -> dict:
        return {"logs": sorted(self.documents), "spark": self.spark.version}

    def list_logs(self) -> list[dict]:
        return [{"log_id": d.log_id, "lines": d.total, "format": d.diagnostics.format} for d in self.documents.values()]

    def close_log(self, log_id: str) -> dict:
        self.documents.pop(log_id).close()
        return {"closed": log_id}

    def stats(self, log_id: str | None = None) -> dict:
        d = self._doc(log_id)
        s = analytics.stats(d.view(False)).first().asDict()
        return {"log_id": d.log_id, **s, "format": d.diagnostics.format, "time_format": d.diagnostics.time_format, "confidence": d.diagnostics.confidence, "top_templates": _rows(analytics.top_templates(d.view(False)))}

    def filters_get(self, log_id: str | None = None) -> dict:
        f = self._doc(log_id).filters
        return {"filters": [{"id": i, "filter_text": s.text, "case_sensitive": s.case_sensitive, "regex": s.regex, "template_id": s.template_id, "exclude": s.exclude} for i, s in enumerate(f.specs)], "filter_count": len(f.specs), "join": f.join}

    def filters_add(self, log_id: str | None = None, join: str | None = None, **spec: Any) -> dict:
        f = self._doc(log_id).filters
        f.join = join or f.join
        return {"id": f.add(filters.FilterSpec(**spec))}

    def filters_remove(self, position: int, log_id: str | None = None) -> dict:
        self._doc(log_id).filters.remove(position)
        return self.filters_get(log_id)

    def field_values(self, name: str, prefix: str = "", rows: int = 50, log_id: str | None = None) -> dict:
        """The commonest values of a declared field that begin with a prefix."""
        d = self._doc(log_id)
        if name not in d.schema:
            raise ValueError(f"unknown field: {name}")
        held = d.view(False).filter("fields is not null").select(F.col("fields")[name].alias(name))
        return {"field": name, "type": d.schema[name], "values": _rows(fieldquery.suggest_values(held, name, prefix, rows))}

    def search(self, text: str | None = None, regex: bool = False, case_sensitive: bool = False, template_id: int | None = None, after: str | None = None, before: str | None = None, offset: int = 0, limit: int = 50, with_filtered_log: bool = False, field_query: str | None = None, log_id: str | None = None) -> dict:
        """A page of lines that hold a text, expression, template or field value, with their times."""
        d = self._doc(log_id)
        spec = filters.FilterSpec(text or "", case_sensitive, regex=regex, template_id=template_id)
        whole = d.trimmed is None and not (with_filtered_log and d.filters.specs)
        if field_query:
            hits = d.holding(field_query, case_sensitive)
        else:
            hits = d.matching(spec) if whole else d.view(with_filtered_log).filter(filters.matches(spec))
        a, b = (families.parse_time_parameter(x) if x else None for x in (after, before))
        if a is not None or b is not None:
            hits = select.TimeBounds(a, b).select(hits)
        total = hits.count()
        rows = filters.page(hits, ["line_no", "ts_ms"], offset, limit).collect()
        more = offset + len(rows) < total
        return {"matches": [[r.line_no + 1, r.ts_ms] for r in rows], "total_matches": total, "returned": len(rows), "offset": offset, "has_more": more, "next_offset": offset + len(rows) if more else None, "log_id": d.log_id}

    def find_occurrences(self, text: str, after: int | None = None, before: int | None = None, offset: int = 0, limit: int = 50, with_filtered_log: bool = True, log_id: str | None = None) -> dict:
        """The older search: a line of unknown time lies before everything."""
        hits = filters.time_bounded(self._doc(log_id).view(with_filtered_log).filter(filters.matches(filters.FilterSpec(text))), after, before, unknown_as=-1)
        total = hits.count()
        rows = filters.page(hits, ["line_no", "ts_ms", "text"], offset, limit).collect()
        return {"total_matches": total, "offset": offset, "returned": len(rows), "has_more": offset + len(rows) < total, "occurrences": [{"line": r.line_no + 1, "time": r.ts_ms, "text": cut(r.text)} for r in rows]}

    def summarize_log(self, start: int | str | None = None, end: int | str | None = None, with_filtered_log: bool = True, log_id: str | None = None) -> dict:
        d = self._doc(log_id)
        sel = select.resolve(d.view(with_filtered_log), start, end)
        errors = _rows(analytics.error_templates(d.templates.select("template_id", "pattern"), sel))
        return {**analytics.stats(sel).first().asDict(), "top_templates": _rows(analytics.top_templates(sel)), "error_templates": errors, "largest_time_gaps": _rows(analytics.time_gaps(sel, ["doc_id"])), "densest_minute": next(iter(_rows(analytics.densest_minute(sel))), None)}

    def get_timeline_histogram(self, domain: str = "auto", buckets: int = 50, text: str | None = None, template_id: int | None = None, with_filtered_log: bool = True, log_id: str | None = None) -> dict:
        sel = self._doc(log_id).view(with_filtered_log)
        if text or template_id is not None:
            sel = sel.filter(filters.matches(filters.FilterSpec(text or "", template_id=template_id)))
        timed = analytics.extent(sel, "ts_ms") is not None
        axis = "ts_ms" if domain == "time" or (domain == "auto" and timed) else "line_no"
        rows = analytics.histogram(sel, axis, buckets).orderBy("bucket").collect()
        return {"domain": "time" if axis == "ts_ms" else "line", "buckets": len(rows), "x": [r.x for r in rows], "counts": [r.n for r in rows], "total": sum(r.n for r in rows)}

    def get_template_anomalies(self, with_filtered_log: bool = True, log_id: str | None = None, offset: int = 0) -> dict:
        d = self._doc(log_id)
        found = analytics.anomalies(d.view(with_filtered_log), ["doc_id"]).join(d.templates.select("template_id", "pattern"), "template_id")
        return {"anomalies": _rows(found.orderBy(F.desc("n_reasons"), "n", "template_id").offset(offset).limit(PAGE))}

    def get_template(self, ids: list[int] | None = None, log_id: str | None = None) -> dict:
        d = self._doc(log_id)
        t = d.templates if ids is None else d.templates.filter(F.col("template_id").isin(ids))
        rows = _rows(analytics.template_dictionary(t, d.view(False)).orderBy("template_id").limit(PAGE))
        return {"template_count": len(rows), "templates": {r["template_id"]: {"pattern": r["pattern"], "count": r["seen"], "example_line": r["example_line"]} for r in rows}}

    def get_template_samples(self, template_id: int, n: int = 5, strategy: str = "first_last_random", log_id: str | None = None) -> dict:
        lines = self._doc(log_id).view(False).filter(F.col("template_id") == template_id)
        return {"template_id": template_id, "strategy": strategy, "samples": [{"line": r.line_no + 1, "time": r.ts_ms, "text": cut(r.text)} for r in analytics.samples(lines, ["doc_id"], n, strategy).orderBy("line_no").collect()]}

    def log_sequence(self, start: int | str | None = None, end: int | str | None = None, collapse: bool = False, with_filtered_log: bool = True, log_id: str | None = None) -> dict:
        sel = select.resolve(self._doc(log_id).view(with_filtered_log), start, end)
        total = sel.count()
        if collapse:
            rows = _rows(analytics.run_lengths(sel, ["doc_id"]).orderBy("start_line").limit(PAGE))
            return {"total_entries": total, "collapsed": True, "sequence": rows}
        rows = sel.orderBy("line_no").limit(PAGE).collect()
        return {"total_entries": total, "returned": len(rows), "truncated": total > len(rows), "collapsed": False, "sequence": [[r.ts_ms, r.line_no + 1, r.template_id] for r in rows]}

    def raw_log(self, start: int | str | None = None, end: int | str | None = None, with_filtered_log: bool = True, log_id: str | None = None) -> dict:
        sel = select.resolve(self._doc(log_id).view(with_filtered_log), start, end)
        total = sel.count()
        rows = sel.orderBy("line_no").limit(PAGE).collect()
        return {"total": total, "returned": len(rows), "truncated": total > len(rows), "lines": [cut(r.text) for r in rows], "line_numbers": [r.line_no + 1 for r in rows]}

    def trim(self, start: int | str | None = None, end: int | str | None = None, log_id: str | None = None) -> dict:
        d = self._doc(log_id)
        if start is None and end is None:
            d.trimmed = None
            return {"remaining_lines": d.total}
        sel = select.resolve(d.view(False), start, end)
        e = select.envelope(sel).first()
        if e.first_line is None:
            raise ValueError("a trim keeps at least one line")
        report = select.trim_report(d.view(False), sel).first().asDict()
        d.trimmed = (e.first_line, e.end_line - 1 if e.end_line < d.total else None)  # an open end follows what is appended
        return report

    def add_analysis(self, text: str, lines: list[int], log_id: str | None = None) -> dict:
        d = self._doc(log_id)
        d.pins.append({"text": text, "lines": sorted(set(lines))})
        return {"count": len(d.pins)}

    def get_analysis(self, log_id: str | None = None) -> dict:
        return {"analysis": self._doc(log_id).pins}


_LINES = "doc_id string, line_no bigint, text string, ts_ms bigint, header_ms bigint, provenance string, record_id bigint, fields map<string,string>, template_id int"
_TEMPLATES = "template_id int, pattern string, n bigint, example_line bigint"


def _classified(lines: DataFrame, d: formats.Diagnostics, family: families.Family | None, reference_ms: int | None) -> DataFrame:
    """Adds is_header, header_ms and header_state by the document's format."""
    line = F.col("text")
    if d.format == "json" and d.time_key:
        ms, header = formats.json_time(line, d.time_key), line.rlike(r"^\s*\{.*\}\s*$")
    elif d.format == "rfc5424":
        ms, header = families.time_of(F.regexp_extract(line, r"^<\d+>\d+ (\S+)", 1), families.BY_NAME["ISO-8601"]), line.rlike(formats.RECOGNIZERS["rfc5424"])
    elif family is not None:
        ms = families.time_of(line, family, reference_ms)
        stamp = families.matched(line, family)
        at = F.call_function("locate", stamp, line)
        header = (F.length(stamp) > 0) & ((at == 1) | ((at == 2) & line.rlike(r"^[\[IWEF]")) | (line.rlike(r"^\S+ \S+ \S+ \[") & F.lit(family.name == "Apache CLF")))
        header = header if family.recognizes_invalid else header & ms.isNotNull()
    else:
        ms, header = F.lit(None).cast("long"), F.lit(False)
    df = lines.withColumn("is_header", F.coalesce(header, F.lit(False))).withColumn("header_ms", F.when(F.col("is_header"), ms))
    return df.withColumn("header_state", F.when(~F.col("is_header"), None).when(F.col("header_ms").isNotNull(), "explicit").otherwise("invalid" if d.format == "plain" else "missing"))


def _stored(settled: dict[int, tuple]) -> list[tuple[int, list[str], int]]:
    return [(i, pattern.split(), n) for i, (pattern, n, _) in settled.items()]


def _merged(settled: dict[int, tuple], found: DataFrame) -> dict[int, tuple]:
    """Templates with what was mined since: counts add up, the first example stays."""
    out = dict(settled)
    for r in found.collect():
        _, n, example = out.get(r.template_id, (None, 0, r.example_line))
        out[r.template_id] = (r.pattern, n + r.n, example)
    return out


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


TOOLS = ["session_info", "load_log", "list_logs", "close_log", "search", "find_occurrences", "filters_get", "filters_add", "filters_remove", "summarize_log", "get_timeline_histogram", "get_template_anomalies", "get_template", "get_template_samples", "log_sequence", "raw_log", "trim", "add_analysis", "get_analysis"]


def serve(session: Session, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    """One JSON-RPC request per line: tools/list and tools/call."""
    for line in source:
        if not line.strip():
            continue
        request = json.loads(line)
        answer: dict = {"jsonrpc": "2.0", "id": request.get("id")}
        try:
            if request["method"] == "tools/list":
                answer["result"] = {"tools": [{"name": t, "description": (getattr(Session, t).__doc__ or t).strip()} for t in TOOLS]}
            elif request["method"] == "tools/call" and request["params"]["name"] in TOOLS:
                value = getattr(session, request["params"]["name"])(**request["params"].get("arguments", {}))
                answer["result"] = {"structuredContent": value, "content": [{"type": "text", "text": json.dumps(value, default=str)}]}
            else:
                answer["error"] = {"code": -32601, "message": "unknown method"}
        except Exception as e:  # noqa: BLE001
            answer["error"] = {"code": -32000, "message": str(e).split("\n")[0]}
        sink.write(json.dumps(answer, default=str) + "\n")
        sink.flush()
