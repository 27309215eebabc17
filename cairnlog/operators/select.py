"""Selection by time and position: bounds, trims, nearest records, neighbours of a line in lanes of matches."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlog.functions.families import parse_time_parameter
from cairnlog.operators.ordered import BLOCK, with_previous


@dataclass(frozen=True)
class TimeBounds:
    """Inclusive; lines of unknown time never lie inside."""

    after: int | None = None
    before: int | None = None

    def __post_init__(self) -> None:
        if self.after is not None and self.before is not None and self.before < self.after:
            raise ValueError("the end lies before the start")

    def select(self, lines: DataFrame) -> DataFrame:
        """In source order, whatever the clocks did."""
        cond = F.col("ts_ms").isNotNull()
        if self.after is not None:
            cond = cond & (F.col("ts_ms") >= self.after)
        if self.before is not None:
            cond = cond & (F.col("ts_ms") <= self.before)
        return lines.filter(cond)


def envelope(selected: DataFrame) -> DataFrame:
    """(first_line, end_line): the half-open line range around a selection."""
    return selected.agg(F.min("line_no").alias("first_line"), (F.max("line_no") + 1).alias("end_line"))


def nearest_record(headers: DataFrame, at_ms: int) -> DataFrame:
    """The header whose time is nearest, the earliest line of equals (one row, by a map-side top-1)."""
    known = headers.filter("ts_ms is not null").select("line_no", "ts_ms", F.abs(F.col("ts_ms") - at_ms).alias("distance"))
    return known.orderBy("distance", "line_no").limit(1)


def clock_deltas(headers: DataFrame, part: list[str], block: int = BLOCK) -> DataFrame:
    """Signed ms between each header with a known time and the one before it."""
    known = headers.filter("ts_ms is not null").select(*part, "line_no", "ts_ms")
    return with_previous(known, "line_no", part, ["ts_ms"], block=block).select(*part, "line_no", (F.col("ts_ms") - F.col("prev_ts_ms")).alias("delta_ms")).filter("delta_ms is not null")


@dataclass(frozen=True)
class Bound:
    """A whole number is a 1-based line (0 is refused, beyond the end is clamped), a text a time."""

    line: int | None = None
    ms: int | None = None

    @staticmethod
    def of(value: int | str | None) -> Bound:
        if value is None:
            return Bound()
        if isinstance(value, int):
            if value < 1:
                raise ValueError("lines count from 1")
            return Bound(line=value)
        return Bound(ms=parse_time_parameter(value))


def resolve(lines: DataFrame, start: int | str | None = None, end: int | str | None = None) -> DataFrame:
    """Lines between two bounds, each a line number or a time."""
    a, b = Bound.of(start), Bound.of(end)
    if a.line is not None and b.line is not None and b.line < a.line:
        raise ValueError("the end lies before the start")
    cond = F.lit(True)
    if a.line is not None:
        cond = cond & (F.col("line_no") >= a.line - 1)
    if b.line is not None:
        cond = cond & (F.col("line_no") <= b.line - 1)
    return TimeBounds(a.ms, b.ms).select(lines.filter(cond)) if a.ms is not None or b.ms is not None else lines.filter(cond)


def trim(lines: DataFrame, first: int, last: int) -> DataFrame:
    """The closed 0-based range, with line numbers that count from its start; source_line keeps the old ones."""
    if last < first:
        raise ValueError("a trim keeps at least one line")
    kept = lines.filter(F.col("line_no").between(first, last))
    return kept.withColumn("source_line", F.col("line_no")).withColumn("line_no", F.col("line_no") - first)


def trim_report(lines: DataFrame, selected: DataFrame) -> DataFrame:
    """(remaining_lines, matched, intervening): a trim to the envelope of a selection keeps what lies between."""
    e = envelope(selected).first()
    matched = selected.count()
    remaining = 0 if e.first_line is None else lines.filter((F.col("line_no") >= e.first_line) & (F.col("line_no") < e.end_line)).count()
    return lines.sparkSession.createDataFrame([(remaining, matched, remaining - matched)], "remaining_lines long, matched long, intervening long")


def goto(lines: DataFrame, target: str) -> DataFrame:
    """`120`, `line 120`, `l:120` or a time such as `@1700000000` or `2024-01-01 00:00:00`: (line_no) of the place."""
    m = re.fullmatch(r"\s*(?:line\s+|l:)?(\d+)\s*", target, re.I)
    if m:
        return lines.filter(F.col("line_no") <= max(1, int(m[1])) - 1).agg(F.max("line_no").alias("line_no"))
    return nearest_record(lines, parse_time_parameter(target.strip().lstrip("@"))).select("line_no")


def occurrence_context(laned: DataFrame, line: int, lane_columns: list[str]) -> DataFrame:
    """Per lane the strict neighbours of a line among its matches, each line once: one aggregate, no sort."""
    aggs = []
    for c in lane_columns:
        aggs += [F.max(F.when(F.col(c) & (F.col("line_no") < line), F.col("line_no"))).alias(f"{c}_p"), F.min(F.when(F.col(c) & (F.col("line_no") > line), F.col("line_no"))).alias(f"{c}_n")]
    one = laned.agg(*aggs)
    names = [f"{c}_{x}" for c in lane_columns for x in "pn"]
    return one.select(F.explode(F.array_distinct(F.array_compact(F.array(*names)))).alias("line_no"))


def lane_step(laned: DataFrame, line: int, lane: str, forward: bool = True) -> DataFrame:
    """The next (or previous) match in a lane, wrapping around at the end."""
    m = laned.filter(F.col(lane))
    if forward:
        return m.agg(F.coalesce(F.min(F.when(F.col("line_no") > line, F.col("line_no"))), F.min("line_no")).alias("line_no"))
    return m.agg(F.coalesce(F.max(F.when(F.col("line_no") < line, F.col("line_no"))), F.max("line_no")).alias("line_no"))


def nearest_occurrence(laned: DataFrame, line: int, lanes: list[str], prefer_after: bool = False) -> DataFrame:
    """The match nearest to a line in any of the lanes: by distance, then the smaller line (or the one at or after)."""
    hit = F.lit(False)
    for c in lanes:
        hit = hit | F.col(c)
    d = laned.filter(hit).select("line_no", F.abs(F.col("line_no") - line).alias("distance"))
    return d.orderBy("distance", F.desc("line_no") if prefer_after else F.asc("line_no")).limit(1)


def neighbourhood(lines: DataFrame, line: int, radius: int) -> DataFrame:
    return lines.filter(F.col("line_no").between(line - radius, line + radius))


def lines_in_range(laned: DataFrame, lane: str, lo: int, hi: int, axis: str = "line_no") -> DataFrame:
    return laned.filter(F.col(lane) & F.col(axis).between(lo, hi))
