"""Semi-structured log lines to entries with time, level, component and message.

An ordered cascade of layout expressions finds the lines that start an entry; a log keeps its one or two most
frequent layouts. Entries run to the line before the next start: starts are numbered within blocks of a log's
lines and the block edges are carried over, so no log, however large, is ever one task's work.

Defined results: lines before a log's first start belong to no entry; a log without starts has none; a null line
counts as a blank line; a null log id or line number gives no entry; repeated lines count once; a byte-order
mark and carriage returns are not part of a line; a time that is nil or impossible still starts an entry; other
columns are ignored, whatever their names; an empty table gives an empty result. Ties between layouts go to the
one earlier in the cascade.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairnlog.session import broadcast_if_small, small, stage

#: Lines of a log that one window partition holds at most, and lines of an entry that one row of its message holds.
BLOCK, PART = 65536, 1024

_ZONE = r"(?: ?(?:Z|[+-]\d{2}:?\d{2}|UTC|GMT|[A-Z]{1,3}[SD]?T))?"
_CLOCK = r"\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?"
_HALF = r"(?:[   ]?[AaPp][Mm]\b)?"
_NIL = r"-|n/a|N/A|unknown|null|nil"
_MON = r"\p{L}{3}"
TIME = (
    rf"(?:\d{{4}}([-/.])\d{{2}}\NN\d{{2}}[T ]{_CLOCK}{_HALF}{_ZONE}(?:\[[\w/+-]+\])?"
    rf"|\d{{8}}T\d{{6}}(?:[.,]\d+)?Z?|\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{4}},? {_CLOCK}{_HALF}{_ZONE}"
    rf"|\d{{1,2}}/{_MON}/\d{{4}}:\d{{2}}:\d{{2}}:\d{{2}}(?: [+-]\d{{4}})?"
    rf"|{_MON}, \d{{1,2}} {_MON} \d{{4}} {_CLOCK}{_ZONE}|{_MON} {_MON} [ \d]\d {_CLOCK} \d{{4}}|\d{{1,2}}\. {_MON} \d{{4}} {_CLOCK}"
    rf"|{_MON} [ \d]\d {_CLOCK}|\d{{10}}(?:\.\d{{1,9}}|\d{{3}}|\d{{6}}|\d{{9}})?|{_NIL})"
).replace(r"([-/.])\d{2}\NN", r"[-/.]\d{2}[-/.]")
_ANSI = r"(?:\u001B\[[0-9;]*m)?"
_LEVEL = rf"{_ANSI}([A-Za-z]{{1,9}}) *{_ANSI}"
_SYSTIME = rf"(?:{_MON} [ \d]\d \d{{2}}:\d{{2}}:\d{{2}}(?:\.\d+)?|{_NIL})"

#: name, expression, groups of (time, level, component, message); 0: the layout has none, -1: read as priority.
LAYOUTS: list[tuple[str, str, int, int, int, int]] = [
    ("unix", rf"^({TIME}) +([^\s\[]+)\[\d+(?::\d+)?\] <{_LEVEL}> (.*)$", 1, 3, 2, 4),
    ("bar", rf"^({TIME}) +\| +{_LEVEL}\| ([^|]*+)\| ?(.*)$", 1, 2, 3, 4),
    ("dash", rf"^({TIME}) - \[{_LEVEL}\] - \S+ (\S+?):\d+ (.*)$", 1, 2, 3, 4),
    ("bracket", rf"^({TIME}) +{_LEVEL} *\[([^\]]+)\] (.*)$", 1, 2, 3, 4),
    ("at", rf"^(\S+) @ ({TIME}) \({_LEVEL}\) (.*)$", 2, 3, 1, 4),
    ("pool", rf"^\[[^\]]+\] {_LEVEL} ({TIME}) (\S+) - (.*)$", 2, 1, 3, 4),
    ("glog", r"^([A-Z])(\d{4} \d{2}:\d{2}:\d{2}\.\d+) +\d+ (\S+?):\d+\] ?(.*)$", 2, 1, 3, 4),
    ("threadtime", r"^(\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}) +\d+ +\d+ ([A-Z]) (.*?): (.*)$", 1, 2, 3, 4),
    ("rfc5424", r"^<(\d{1,3})>\d{1,2} (\S+) \S+ (\S+) \S+ \S+ ?(?:(?:-|(?:\[(?:[^\]\\]|\\.)*+\])++) ?)?(.*)$", 2, -1, 3, 4),
    ("syslog_pri", rf"^<(\d{{1,3}})>({_SYSTIME}) \S+ ([^\s\[:]+)(?:\[\d+\])?: ?(.*)$", 2, -1, 3, 4),
    ("syslog", rf"^({_SYSTIME}) \S+ ([^\s\[:]+)(?:\[\d+\])?: ?(.*)$", 1, 0, 2, 3),
    ("json", r"^\{.*\}\s*$", 0, 0, 0, 0),
    ("logfmt", r"^(?=[A-Za-z_@]+=)(?=.*(?:^| )(?:time|ts|t|timestamp)=)(?=.*(?:^| )(?:msg|message|text|event)=).*$", 0, 0, 0, 0),
    ("plain", rf"^({TIME}) {{1,2}}(.*)$", 1, 0, 0, 2),
]

_TIME_KEYS, _LEVEL_KEYS = ("time", "timestamp", "@timestamp", "ts", "t"), ("level", "lvl", "severity", "log_level")
_COMPONENT_KEYS, _MESSAGE_KEYS = ("logger", "module", "component", "source"), ("msg", "message", "text", "event")
_SUFFIX = r"\.(?:cc|cpp|cxx|c|h|hpp|java|kt|scala|py|go|rs|js|ts|rb|cs|swift|php)$"

# Level words in use and the level each stands for.
_LEVELS = {
    "TRACE": "trace trc t verbose v finest finer", "DEBUG": "debug dbg d fine", "INFO": "info inf i information notice n config", "WARN": "warn wrn w warning",
    "ERROR": "error err e severe", "FATAL": "fatal ftl f critical crit c emerg panic alert a assert",
}
_PRIORITY = ["FATAL", "FATAL", "FATAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG"]


def clean(line: Column) -> Column:
    text = F.rtrim(F.coalesce(line, F.lit("")), F.lit("\r"))
    return F.when(text.startswith("\ufeff"), F.substring(text, 2, 2**31 - 1)).otherwise(text)


def level_of(raw: Column) -> Column:
    words = F.create_map(*[F.lit(x) for level, ws in _LEVELS.items() for w in ws.split() for x in (w, level)])
    return F.coalesce(words[F.lower(F.trim(raw))], F.lit(""))


def priority_level(pri: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, _PRIORITY)), (pri.cast("int") % 8 + 1).cast("int"))


def _json(line: Column) -> Column:
    keys = [*_TIME_KEYS, *_LEVEL_KEYS, *_COMPONENT_KEYS, *_MESSAGE_KEYS]
    return F.from_json(line, ", ".join(f"`{k}` string" for k in keys))


def _pair(line: Column, keys: tuple[str, ...]) -> Column:
    """The value, quotes and all, of the first of these keys that stands outside other values' quotes; one pass, no way back."""
    quoted, key = r'"(?:[^"\\]|\\.)*+"', f"(?:{'|'.join(keys)})="
    return F.regexp_extract(line, rf'^(?:(?!{key})(?:[^ "=]++={quoted})?+[^ ]*+ )*+{key}({quoted}|\S*)', 1)


def layout_of(line: Column) -> Column:
    """The name of the first layout in the cascade that the line is written in, or null."""
    c: Column | None = None
    for name, pattern, *_ in LAYOUTS:
        cond = line.rlike(pattern)
        if name == "json":
            j = _json(line)
            cond = line.startswith("{") & F.rtrim(line).endswith("}") & F.coalesce(*[j[k] for k in (*_LEVEL_KEYS, *_COMPONENT_KEYS)]).isNotNull() & F.coalesce(*[j[k] for k in _MESSAGE_KEYS]).isNotNull()
        c = F.when(cond, name) if c is None else c.when(cond, name)
    return F.when(F.length(F.trim(line)) > 0, c)  # blank lines skip the cascade


def _part(line: Column, layout: Column, which: int) -> Column:
    """Field `which` (0 time, 1 level, 2 component, 3 message) by the layout's own expression."""
    keys = (_TIME_KEYS, _LEVEL_KEYS, _COMPONENT_KEYS, _MESSAGE_KEYS)[which]
    c = F.when(layout == "json", F.coalesce(*[_json(line)[k] for k in keys]))
    pair = _pair(line, keys)
    c = c.when(layout == "logfmt", pair if which == 3 else F.regexp_replace(pair, '^"|"$', ""))
    for name, pattern, *groups in LAYOUTS:
        g = groups[which]
        if g > 0:
            c = c.when(layout == name, F.regexp_extract(line, pattern, g))
        elif g < 0:
            c = c.when(layout == name, F.regexp_extract(line, r"^<(\d+)>", 1))
    return F.coalesce(c, F.lit(""))


def starts(lines: DataFrame) -> DataFrame:
    """(case_id, line_no, layout, level, component, time): the lines written in a layout of the cascade."""
    line = F.col("line")
    at = lines.select("case_id", "line_no", clean(line).alias("line")).withColumn("layout", layout_of(line)).filter("layout is not null")
    raw, layout = _part(line, F.col("layout"), 1), F.col("layout")
    pri = [n for n, _, _, level, *_ in LAYOUTS if level == -1]
    level = F.when(layout.isin(*pri), priority_level(raw)).otherwise(level_of(raw))
    component = F.regexp_replace(F.trim(_part(line, layout, 2)), _SUFFIX, "")
    return at.select("case_id", "line_no", "layout", level.alias("level"), component.alias("component"), F.trim(_part(line, layout, 0)).alias("time"))


def foreign_layouts(at: DataFrame, keep: int) -> DataFrame:
    """(case_id, layout) of the layouts beyond a log's `keep` most frequent ones: lines in them are payload."""
    rank = {name: i for i, (name, *_) in enumerate(LAYOUTS)}
    order = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])[F.col("layout")]
    counts = at.groupBy("case_id", "layout").agg(F.count("*").alias("n")).withColumn("order", order)
    return counts.withColumn("place", F.row_number().over(W.partitionBy("case_id").orderBy(F.desc("n"), "order"))).filter(F.col("place") > keep).select("case_id", "layout")


def entries(lines: DataFrame, block: int = BLOCK, layouts: int | None = 2) -> DataFrame:
    """lines (case_id, line_no, line) -> (case_id, first_line, last_line, time, level, component, layout).

    layouts: how many a log may have, its most frequent ones; None: any number, every line written in one starts
    an entry.
    """
    lines = lines.select(F.col("case_id").cast("string").alias("case_id"), F.col("line_no").cast("long").alias("line_no"), F.col("line").cast("string").alias("line")).filter("case_id is not null and line_no is not null")
    at = stage(starts(lines), "entry-starts")
    foreign = None if layouts is None else stage(foreign_layouts(at, layouts), "foreign-layouts")
    if foreign is not None and not foreign.isEmpty():
        at = at.join(broadcast_if_small(foreign), ["case_id", "layout"], "left_anti")
    blk = F.floor(F.col("line_no") / block).alias("block")
    within = W.partitionBy("case_id", "block").orderBy("line_no")
    at = at.select("*", blk).withColumn("before", F.lag("line_no").over(within)).filter(F.col("before").isNull() | (F.col("before") != F.col("line_no"))).drop("before")
    edges = at.groupBy("case_id", "block").agg(F.min("line_no").alias("first"))
    ends = lines.groupBy("case_id").agg(F.max("line_no").alias("end"))
    edges = edges.withColumn("next_first", F.lead("first").over(W.partitionBy("case_id").orderBy("block"))).join(ends, "case_id")
    at = at.withColumn("next", F.lead("line_no").over(within)).join(edges.select("case_id", "block", "next_first", "end"), ["case_id", "block"])
    last = F.coalesce(F.col("next") - 1, F.col("next_first") - 1, F.col("end"))
    return at.select("case_id", F.col("line_no").alias("first_line"), last.alias("last_line"), "time", "level", "component", "layout")


def with_messages(lines: DataFrame, found: DataFrame, block: int = BLOCK, part: int = PART) -> DataFrame:
    """Entries with their message: the header's rest and, after line feeds, the continuation lines.

    A row holds at most `part` lines of an entry: longer ones have several, numbered by `part` from 0; joined by
    line feeds in that order they are the whole message.

    Each line finds its entry by carrying the last start along its block, and over the block's edge from the
    blocks before; only then are the lines of one entry gathered.
    """
    lines = lines.select(F.col("case_id").cast("string").alias("case_id"), F.col("line_no").cast("long").alias("line_no"), F.col("line").cast("string").alias("line")).filter("case_id is not null and line_no is not null")
    found = stage(found, "entries")
    marks = found.select("case_id", F.col("first_line").alias("line_no"), "layout")
    text = lines.select("case_id", "line_no", clean(F.col("line")).alias("line")).dropDuplicates(["case_id", "line_no"]).join(marks, ["case_id", "line_no"], "left")
    text = text.withColumn("block", F.floor(F.col("line_no") / block))
    start = F.when(F.col("layout").isNotNull(), F.col("line_no"))
    within = W.partitionBy("case_id", "block").orderBy("line_no")
    edges = marks.groupBy("case_id", F.floor(F.col("line_no") / block).alias("block")).agg(F.max("line_no").alias("edge"))
    held = lines.select("case_id", F.floor(F.col("line_no") / block).alias("block")).distinct().join(edges, ["case_id", "block"], "left")
    held = held.withColumn("carry", F.last("edge", ignorenulls=True).over(W.partitionBy("case_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)))
    text = text.withColumn("own", F.last(start, ignorenulls=True).over(within)).join(held.select("case_id", "block", "carry"), ["case_id", "block"])
    body = F.when(F.col("layout").isNotNull(), _part(F.col("line"), F.col("layout"), 3)).otherwise(F.col("line"))
    text = text.select("case_id", F.coalesce("own", "carry").alias("first_line"), "line_no", body.alias("body")).filter("first_line is not null")
    joined = text.withColumn("part", F.floor((F.col("line_no") - F.col("first_line")) / part).cast("int")).groupBy("case_id", "first_line", "part").agg(F.array_sort(F.collect_list(F.struct("line_no", "body"))).alias("b"))
    joined = joined.select("case_id", "first_line", "part", F.array_join(F.transform("b", lambda x: x["body"]), "\n").alias("message"))
    return found.join(joined, ["case_id", "first_line"])
