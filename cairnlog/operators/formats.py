"""Log formats: recognisers, header times and normalised content, as column expressions.

The format of a document is decided once, from a bounded sample; a tie or too few hits leave it plain.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlog.functions import families, masking

TIME_KEYS = ("time", "timestamp", "@timestamp", "ts", "datetime")
MESSAGE_KEYS = ("msg", "message", "log", "text", "event")
_OSLOG_LEVELS = "Default|Info|Debug|Error|Fault|Notice|Activity"

#: name -> expression a line of the format matches; order is the order of trial.
RECOGNIZERS: dict[str, str] = {
    "json": r"^\s*\{.*\}\s*$",
    "cef": r"^\s*CEF:",
    "rfc5424": r"^<\d{1,3}>\d+(?: \S+){5}",
    "os_log": rf"^\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}:\d{{2}}\S*\s+(?=(?:\S+\s+){{0,5}}0x[0-9a-fA-F]+)(?=(?:\S+\s+){{0,5}}(?:{_OSLOG_LEVELS})\b)",
    "logcat_brief": r"^[VDIWEF]/",
    "oslog_console": r"^\[[^\]:]+:[^\]]*\] (?:\w+)",
}


def recognizes(name: str, line: Column) -> Column:
    hit = line.rlike(RECOGNIZERS[name])
    return hit & F.call_function("try_parse_json", line).isNotNull() if name == "json" else hit


def detect_format(sample: list[str]) -> str:
    """The format with most hits: two at least (one in four lines or fewer); a tie is plain."""
    lines = [x for x in sample if x.strip()]
    hits = {}
    for name, pattern in RECOGNIZERS.items():
        n = sum(bool(re.match(pattern, x)) and (name != "json" or _is_object(x)) for x in lines)
        if n >= (1 if len(lines) <= 4 else 2):
            hits[name] = n
    if not hits:
        return "plain"
    best = max(hits.values())
    top = [n for n, h in hits.items() if h == best]
    return top[0] if len(top) == 1 else "plain"


def _is_object(x: str) -> bool:
    try:
        return isinstance(json.loads(x), dict)
    except ValueError:
        return False


def sample_lines(lines: DataFrame, total: int, head: int = 512, windows: int = 32, width: int = 128, most: int = 8192) -> list[str]:
    """The first lines and evenly spread windows of a document, blank ones left out: a bounded driver-side sample."""
    starts = [head + (total - head) * i // windows for i in range(windows)] if total > head else []
    cond = F.col("line_no") < head
    for s in starts:
        cond = cond | F.col("line_no").between(s, s + width - 1)
    return [r[0] for r in lines.filter(cond & (F.length(F.trim("text")) > 0)).select(F.substring("text", 1, 262_144)).limit(most).collect()]


def lock_time_key(sample: list[str]) -> str | None:
    """The JSON key that holds the time, fixed for the document: the first known key any sampled object has."""
    for x in sample:
        try:
            o = json.loads(x)
        except ValueError:
            continue
        if isinstance(o, dict) and (k := next((k for k in TIME_KEYS if k in o), None)):
            return k
    return None


def json_time(line: Column, key: str) -> Column:
    """Epoch ms of a JSON line's time key: a number in s or ms, or a text."""
    v = F.get_json_object(line, f"$['{key}']")
    n = v.try_cast("double")
    iso = families.time_of(v, families.BY_NAME["ISO-8601"])
    return F.when(n >= 1e12, n.cast("long")).when(n >= 1e9, (n * 1000).cast("long")).otherwise(iso)


def cef_content(line: Column) -> Column:
    parts = F.split(F.trim(line), r"(?<!\\)\|", 8)
    return F.concat_ws(" ", F.lit("CEF"), *[F.get(parts, F.lit(i)) for i in (1, 2, 4, 5, 6)], masking.mask_line(F.coalesce(F.get(parts, F.lit(7)), F.lit(""))))


_5424 = r"^<\d{1,3}>\d+ (\S+) (\S+) (\S+) (\S+) (\S+) ?((?:\[(?:[^\]\\]|\\.)*+\])++|-)? ?(.*)$"


def rfc5424_content(line: Column) -> Column:
    g = lambda i: F.regexp_extract(line, _5424, i)
    return F.concat_ws(" ", F.lit("RFC5424 <HOST>"), g(3), g(4), g(5), masking.mask_line(g(7)))


def rfc5424_state(line: Column) -> Column:
    t = F.regexp_extract(line, _5424, 1)
    ms = families.time_of(t, families.BY_NAME["ISO-8601"])
    return F.when(t == "-", "missing").when(ms.isNotNull(), "explicit").otherwise("invalid")


def oslog_content(line: Column) -> Column:
    level = F.regexp_extract(line, rf"\b({_OSLOG_LEVELS})\b", 1)
    body = F.regexp_replace(line, rf"^\S+ \S+\s+(?:0x[0-9a-fA-F]+\s+|\d+\s+|(?:{_OSLOG_LEVELS})\s+)*", "")
    return F.concat_ws(" ", F.lit("OSLOG"), level, masking.mask_line(body))


def logcat_brief_content(line: Column) -> Column:
    p = r"^([VDIWEF])/([^(:]*?)\s*(?:\(\s*\d+\))?: ?(.*)$"
    return F.concat_ws(" ", F.regexp_extract(line, p, 1), F.trim(F.regexp_extract(line, p, 2)), masking.mask_line(F.regexp_extract(line, p, 3)))


def oslog_console_content(line: Column) -> Column:
    p = r"^\[([^\]:]+):([^\]]*)\] (\w+) ?(.*)$"
    return F.concat(F.regexp_extract(line, p, 1), F.lit(":"), F.regexp_extract(line, p, 2), F.lit(" "), F.regexp_extract(line, p, 3), F.lit(" "), masking.mask_line(F.regexp_extract(line, p, 4)))


def plain_content(line: Column, family: families.Family | None) -> Column:
    """The line without its timestamp."""
    if family is None:
        return line
    stamp = families.matched(line, family)
    at = F.call_function("locate", stamp, line)
    rest = F.when(F.length(stamp) > 0, F.concat(F.substring(line, F.lit(1), at - 1), F.substring(line, at + F.length(stamp), F.length(line)))).otherwise(line)
    return F.trim(rest)


_CONTENT = {"cef": cef_content, "rfc5424": rfc5424_content, "os_log": oslog_content, "logcat_brief": logcat_brief_content, "oslog_console": oslog_console_content}


def _json_class(v: object) -> str:
    if v is None:
        return "<NULL>"
    if isinstance(v, bool):
        return "<BOOL>"
    if isinstance(v, (int, float)):
        return "<NUM>"
    return "<STR>" if isinstance(v, str) else "<JSON>"


def json_shape(line: str) -> str | None:
    """Sorted keys without time keys; message keys keep their text, others become key=<CLASS>."""
    try:
        o = json.loads(line)
    except ValueError:
        return None
    if not isinstance(o, dict):
        return None
    parts = [str(o[k]) if k in MESSAGE_KEYS and isinstance(o[k], str) else f"{k}={_json_class(o[k])}" for k in sorted(o) if k not in TIME_KEYS]
    return " ".join(parts) or "<EMPTY>"


def json_content(df: DataFrame, text: str = "text") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["content"] = [json_shape(x) if x else None for x in pdf[text]]
            yield pdf

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return masking.masked(df.mapInPandas(run, f"{kept}, content string").withColumn("content", F.coalesce("content", text)), "content")


def normalised(df: DataFrame, fmt: str, family: families.Family | None = None, text: str = "text") -> DataFrame:
    """Adds content: what template mining sees of each line in a format."""
    if fmt == "json":
        return json_content(df, text)
    line = F.col(text)
    if fmt in _CONTENT:
        return df.withColumn("content", F.when(line.rlike(RECOGNIZERS[fmt]), _CONTENT[fmt](line)).otherwise(masking.mask_line(line)))
    return masking.masked(df.withColumn("content", plain_content(line, family)), "content")


@dataclass(frozen=True)
class Diagnostics:
    """What was decided for a document, and on how much of it."""

    format: str
    time_format: str | None
    confidence: str
    conflicting: tuple[str, ...]
    sampled_lines: int
    time_key: str | None


def diagnose(lines: DataFrame, total: int, named: str | None = None) -> Diagnostics:
    sample = sample_lines(lines, total)
    fmt = detect_format(sample)
    key = lock_time_key(sample) if fmt == "json" else None
    confidence, names = ("Explicit", [named]) if named else families.detect(sample)
    return Diagnostics(fmt, names[0] if len(names) == 1 else None, confidence, tuple(names) if len(names) > 1 else (), len(sample), key)


def register(name: str, recognizer: str, content) -> None:  # noqa: ANN001
    """Adds a format: the expression its lines match, and a function from line column to content column."""
    RECOGNIZERS[name] = recognizer
    _CONTENT[name] = content
