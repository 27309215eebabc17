"""Filters over lines: phrases, expressions, templates and typed fields as boolean columns, and their composition."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_FILTERS = 20
MAX_PATTERN_BYTES = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class FilterSpec:
    """One matcher with its polarity. template_id and field_query take the place of the text."""

    text: str = ""
    case_sensitive: bool = False
    exclude: bool = False
    regex: bool = False
    template_id: int | None = None
    field_query: object | None = None
    active: bool = True

    def same_matcher(self, other: FilterSpec) -> bool:
        key = lambda f: (f.text, f.case_sensitive, f.regex, f.template_id, f.field_query)
        return key(self) == key(other)


def parse_template_id(text: str) -> int | None:
    """42, T42 or T{42}."""
    m = re.fullmatch(r"\s*(?:T\{(\d+)\}|T?(\d+))\s*", text)
    return int(m[1] or m[2]) if m else None


def java_pattern(pattern: str, case_sensitive: bool) -> str:
    """A linear-time expression in Java's syntax; look-around and back references are refused."""
    if len(pattern.encode()) > MAX_PATTERN_BYTES:
        raise ValueError("the expression is too long")
    if re.search(r"(?<!\\)(?:\\\\)*\((?:\?=|\?!|\?<=|\?<!|\?>)", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9k]", pattern):
        raise ValueError("look-around and back references are not supported")
    pattern = pattern.replace("(?P<", "(?<")
    return ("(?U)" if case_sensitive else "(?iu)(?U)") + pattern


def fold_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def matches(spec: FilterSpec, text: Column | None = None) -> Column:
    """The lines a filter matches, whatever its polarity. Blank phrases match nothing."""
    text = F.col("text") if text is None else text
    if spec.template_id is not None:
        return F.coalesce(F.col("template_id") == spec.template_id, F.lit(False))
    if spec.field_query is not None:
        return F.coalesce(spec.field_query.condition(), F.lit(False))
    if spec.regex:
        return F.coalesce(text.rlike(java_pattern(spec.text, spec.case_sensitive)), F.lit(False)) if spec.text.strip() else F.lit(False)
    needle = spec.text.strip()
    if not needle:
        return F.lit(False)
    if spec.case_sensitive:
        return F.coalesce(F.contains(text, F.lit(needle)), F.lit(False))
    folded = needle.translate(str.maketrans(_UPPER, _LOWER))
    return F.coalesce(F.contains(fold_ascii(text), F.lit(folded)), F.lit(False))


def lanes(df: DataFrame, specs: list[FilterSpec]) -> DataFrame:
    """One boolean column lane_0, lane_1, ... per filter, in a single pass."""
    return df.select("*", *[matches(s).alias(f"lane_{i}") for i, s in enumerate(specs)])


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def combined(specs: list[FilterSpec], join: str = "any", lane=None) -> Column:
    """Includes joined by any or all, then excludes taken away; without includes every line is a candidate."""
    lane = lane or matches
    includes = [lane(s) for s in specs if s.active and not s.exclude]
    excludes = [lane(s) for s in specs if s.active and s.exclude]
    keep = F.lit(True) if not includes else (_any(includes) if join == "any" else reduce(lambda a, b: a & b, includes))
    return keep & ~_any(excludes)


def visible(specs: list[FilterSpec], join: str = "any", everything_else: bool = True, lane=None) -> Column:
    """What a viewer shows: lines of active includes without excludes, and, if wished, lines that no filter matches.

    Lines matched only by inactive filters stay hidden; with excludes alone only the lines no filter matches show.
    """
    lane = lane or matches
    active = [s for s in specs if s.active]
    includes, excludes = [s for s in active if not s.exclude], [s for s in active if s.exclude]
    hit = _any([lane(s) for s in specs])
    shown = F.lit(False)
    if includes:
        parts = [lane(s) for s in includes]
        shown = (_any(parts) if join == "any" else reduce(lambda a, b: a & b, parts)) & ~_any([lane(s) for s in excludes])
    return shown | (~hit if everything_else else F.lit(False))


@dataclass
class FilterSet:
    """At most twenty distinct filters with positional ids and how they are joined."""

    specs: list[FilterSpec] = field(default_factory=list)
    join: str = "any"

    def add(self, spec: FilterSpec) -> int:
        if spec in self.specs:
            return self.specs.index(spec)
        if len(self.specs) >= MAX_FILTERS:
            raise ValueError(f"at most {MAX_FILTERS} filters")
        matches(spec)  # refuses what can't be compiled
        self.specs.append(spec)
        return len(self.specs) - 1

    def remove(self, position: int) -> FilterSpec:
        return self.specs.pop(position)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.filter(combined(self.specs, self.join))


def highlight_spans(df: DataFrame, specs: list[FilterSpec], key: str = "line_no", text: str = "text") -> DataFrame:
    """(key, filter, start, end): every match of every filter, in bytes of the UTF-8 text."""
    compiled = []
    for i, s in enumerate(specs):
        pattern = s.text.replace("(?P<", "(?P<") if s.regex else re.escape(s.text.strip())
        if pattern:
            flags = 0 if s.case_sensitive else re.IGNORECASE | (0 if s.regex else re.ASCII)
            compiled.append((i, re.compile(pattern, flags)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t in zip(pdf["k"], pdf["t"]):
                for i, p in compiled:
                    for m in p.finditer(t or ""):
                        if m.end() > m.start():
                            a = len(t[: m.start()].encode())
                            out.append((k, i, a, a + len(m[0].encode())))
            yield pd.DataFrame(out, columns=[key, "filter", "start", "end"])

    return df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInPandas(run, f"`{key}` long, `filter` int, `start` int, `end` int")


def page(df: DataFrame, columns: list[str], offset: int = 0, limit: int = 50, order: str = "line_no") -> DataFrame:
    """A page of matches in line order (top-k, no full sort)."""
    return df.select(*columns).orderBy(order).offset(offset).limit(max(1, min(limit, 2000)))


def time_bounded(df: DataFrame, after: int | None = None, before: int | None = None, unknown_as: int | None = None) -> DataFrame:
    """Inclusive bounds. Lines of unknown time are left out, or taken as unknown_as where that is given."""
    ts = F.col("ts_ms") if unknown_as is None else F.coalesce(F.col("ts_ms"), F.lit(unknown_as))
    cond = F.lit(True)
    if after is not None:
        cond = cond & (ts >= after)
    if before is not None:
        cond = cond & (ts <= before)
    return df.filter(cond)
