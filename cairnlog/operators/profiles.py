"""Declared header layouts: compiled, resolved to a time family, matched with a unique parse.

A layout such as `{time} [{module}:{n:number}] {ignore:path} {log}` has one time, one log at its end and fields of
kind token, number, path or text between them. A line matches if exactly one way to read it exists.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlog.functions.families import BY_NAME, FAMILIES, Family

MAX_LAYOUT_BYTES, MAX_FIELDS, MAX_HEADER, MAX_STEPS, MAX_COLOUR = 4096, 32, 4096, 65_536, 128
KINDS = ("token", "number", "path", "text")


@dataclass(frozen=True)
class Part:
    """A literal, or a field with name and kind; an ignored field has an empty name."""

    literal: str = ""
    name: str = ""
    kind: str = ""


@dataclass(frozen=True)
class Profile:
    parts: tuple[Part, ...]
    schema: dict[str, str] = field(hash=False, default_factory=dict)
    regex: re.Pattern | None = None
    indent: str = ""

    @cached_property
    def time_then_message(self) -> bool:
        """Whether the layout is a time, blanks and the message: read without a search."""
        return [p.kind for p in self.parts] == ["timestamp", "", "message"] and not self.parts[1].literal.strip(" \t")


def compile_layout(layout: str, indent: str = "") -> Profile:
    if len(layout.encode()) > MAX_LAYOUT_BYTES:
        raise ValueError("the layout is too long")
    parts: list[Part] = []
    literal, i = "", 0
    while i < len(layout):
        two, ch = layout[i : i + 2], layout[i]
        if two in ("{{", "}}"):
            literal, i = literal + ch, i + 2
        elif ch == "}":
            raise ValueError("a closing brace stands alone")
        elif ch == "{":
            end = layout.find("}", i)
            if end < 0:
                raise ValueError("a brace is not closed")
            name, _, kind = layout[i + 1 : end].partition(":")
            if literal:
                parts.append(Part(literal=literal))
                literal = ""
            parts.append(_field(name, kind))
            i = end + 1
        else:
            literal, i = literal + ch, i + 1
    if literal:
        parts.append(Part(literal=literal))
    fields = [p for p in parts if p.kind]
    names = [p.name for p in fields if p.name]
    if len(fields) > MAX_FIELDS:
        raise ValueError(f"more than {MAX_FIELDS} fields")
    if names.count("time") != 1 or names.count("log") != 1 or parts[-1].name != "log":
        raise ValueError("a layout has one {time} and ends with one {log}")
    if len(names) != len(set(names)):
        raise ValueError("field names repeat")
    if any(a.kind and b.kind for a, b in zip(parts, parts[1:])):
        raise ValueError("two fields need text between them")
    return Profile(tuple(parts), {p.name: p.kind for p in fields if p.name}, indent=indent)


def _field(name: str, kind: str) -> Part:
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise ValueError(f"no field name: {name!r}")
    if name == "time":
        return Part(name="time", kind="timestamp")
    if name == "log":
        return Part(name="log", kind="message")
    kind = kind or "token"
    if kind not in KINDS:
        raise ValueError(f"unknown kind: {kind}")
    return Part(name="" if name == "ignore" else name, kind=kind)


def compile_advanced(pattern: str) -> Profile:
    """A \\A-anchored expression with the named groups timestamp and log."""
    if not pattern.startswith(r"\A"):
        raise ValueError(r"the expression starts with \A")
    regex = re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern))
    if not {"timestamp", "log"} <= set(regex.groupindex):
        raise ValueError("groups timestamp and log are needed")
    return Profile((), {"timestamp": "timestamp", "log": "message"} | {n: "text" for n in regex.groupindex if n not in ("timestamp", "log")}, regex)


def compile_profile(text: str) -> Profile:
    r"""A layout, or an advanced profile if the text begins with \A."""
    return compile_advanced(text) if text.startswith(r"\A") else compile_layout(text)


_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
_PATH = re.compile(r"(?:[A-Za-z]:[\\/]|\\\\|/|\.{1,2}[\\/]|[A-Za-z][A-Za-z0-9+.-]*://).*|.*[/\\].*|.*\.[A-Za-z0-9]{1,8}")


def valid(kind: str, value: str) -> bool:
    if kind == "text":
        return True
    if not value:
        return False
    if kind == "token":
        return not re.search(r"\s", value)
    return bool((_NUMBER if kind == "number" else _PATH).fullmatch(value))


class Recognizer:
    """Where a time ends that starts at a position: the ends, with the state explicit, invalid or missing."""

    def __init__(self, families: list[Family], nil: tuple[str, ...] = ()) -> None:
        self.families = [(f, re.compile(f.pattern.lstrip("^").removeprefix(r"\s*"))) for f in families]
        self.nil = nil

    def ends(self, text: str, at: int) -> Iterator[tuple[int, str]]:
        from cairnlog.functions.families import parse

        seen = set()
        for f, pattern in self.families:
            m = pattern.match(text, at)
            if m:
                end = m.end() - (f.name == "epoch")
                if end in seen:
                    continue
                found = parse(text[at : m.end()], f)
                if found and found[2] is not None:
                    seen.add(end)
                    yield end, "explicit"
                elif f.recognizes_invalid:
                    seen.add(end)
                    yield end, "invalid"
        for n in self.nil:
            if text.startswith(n, at) and at + len(n) not in seen:
                yield at + len(n), "missing"


def match(profile: Profile, line: str, recognizer: Recognizer, first_line: bool = False) -> dict | None:
    """{name: (start, end)} in characters and time_state of the one way to read a line, else None."""
    at = 0
    if first_line and line.startswith("﻿"):
        at = 1
    while (m := re.compile(r"\x1b\[[0-9;]*m").match(line, at)) and m.end() <= MAX_COLOUR:
        at = m.end()
    if profile.indent:
        if not line.startswith(profile.indent, at):
            return None
        at += len(profile.indent)
    if profile.regex is not None:
        m = profile.regex.match(line[at:])
        if not m:
            return None
        spans = {n: (m.start(n) + at, m.end(n) + at) for n in profile.regex.groupindex if m.start(n) >= 0}
        s, e = spans["timestamp"]
        states = [state for end, state in recognizer.ends(line, s) if end == e]
        return {"spans": spans, "time_state": states[0]} if states else None
    limit, found, steps = min(len(line), at + MAX_HEADER), [], [0]
    parts = profile.parts
    if profile.time_then_message:
        ways = [(end, state, begin) for end, state in recognizer.ends(line, at) if (begin := _literal(parts[1].literal, line, end, limit)) is not None]
        return {"spans": {"time": (at, ways[0][0]), "log": (ways[0][2], len(line))}, "time_state": ways[0][1]} if len(ways) == 1 else None

    def walk(k: int, pos: int, spans: tuple, state: str) -> None:
        steps[0] += 1
        if steps[0] > MAX_STEPS or len(found) > 1:
            return
        if k == len(parts):
            found.append((dict(spans), state))
            return
        p = parts[k]
        if not p.kind:
            end = _literal(p.literal, line, pos, limit)
            if end is not None:
                walk(k + 1, end, spans, state)
        elif p.kind == "message":
            found.append((dict((*spans, ("log", (pos, len(line))))), state))
        elif p.kind == "timestamp":
            for end, s in recognizer.ends(line, pos):
                walk(k + 1, end, (*spans, ("time", (pos, end))), s)
        else:
            following = parts[k + 1].literal
            for end in _ends(p.kind, following, line, pos, limit):
                if valid(p.kind, line[pos:end]):
                    walk(k + 1, end, (*spans, (p.name, (pos, end))) if p.name else spans, state)

    walk(0, at, (), "explicit")
    if len(found) != 1 or steps[0] > MAX_STEPS:
        return None
    spans, state = found[0]
    return {"spans": spans, "time_state": state}


def _literal(literal: str, line: str, pos: int, limit: int) -> int | None:
    """Blanks match one or more blanks, everything else itself."""
    i = 0
    while i < len(literal):
        if literal[i] in " \t":
            j = i
            while j < len(literal) and literal[j] in " \t":
                j += 1
            start = pos
            while pos < limit and line[pos] in " \t":
                pos += 1
            if pos == start:
                return None
            i = j
        else:
            if pos >= limit or line[pos] != literal[i]:
                return None
            pos, i = pos + 1, i + 1
    return pos


def _ends(kind: str, following: str, line: str, pos: int, limit: int) -> list[int]:
    """Possible ends of a field, longest first: places where the text after it begins as the next literal does."""
    stop = limit
    loose = kind == "text" or (kind == "path" and (following.startswith('"') or re.match(r"[ \t]+\S", following)))
    if not loose:
        m = re.compile(r"\s").search(line, pos)
        stop = min(limit, m.start() if m else limit)
    head = following[:1]
    ok = (lambda c: c in " \t") if head in " \t" else (lambda c: c == head)
    return [e for e in range(min(stop, limit - 1), pos - 1, -1) if e < len(line) and ok(line[e])]


def resolve_time(profile: Profile, sample: list[str], named: str | None = None) -> tuple[str, list[str]]:
    """(confidence, family names): a named family is explicit; else the one whose times fit the slot most often."""
    if named:
        return "Explicit", [BY_NAME[named].name]
    score = {f.name: sum(match(profile, x, Recognizer([f])) is not None for x in sample) for f in FAMILIES}
    best = max(score.values(), default=0)
    names = [n for n, s in score.items() if s == best and best]
    return ("Unresolved" if not names else "Ambiguous" if len(names) > 1 else "High"), names


def preview(profile: Profile, lines: list[str], recognizer: Recognizer, most: int = 200) -> list[dict]:
    """The first lines with the spans a profile reads from them."""
    out = []
    for i, x in enumerate(lines[:most]):
        m = match(profile, x, recognizer, i == 0)
        out.append({"line": i, "matched": m is not None, "spans": m["spans"] if m else {}})
    return out


def match_lines(df: DataFrame, profile: str, recognizer: Recognizer, key: list[str], text: str = "text", named_profile: str | None = None, first: Column | None = None) -> DataFrame:
    """Adds to the key: matched, time_state, byte spans and values of the fields, by Arrow batches.

    profile: a layout or advanced profile, or with named_profile the column that holds each line's (compiled once per
    worker). first: whether a line is the first of its file, where a byte-order mark is no part of the header.
    """
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*key).schema)
    src = df.select(*key, F.col(text).alias("_text"), F.col(named_profile).alias("_layout") if named_profile else F.lit(profile).alias("_layout"), F.coalesce(first if first is not None else F.lit(False), F.lit(False)).alias("_first"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled: dict[str, Profile | None] = {}
        for pdf in batches:
            rows = []
            for line, layout, begins in zip(pdf["_text"], pdf["_layout"], pdf["_first"]):
                if layout not in compiled:
                    try:
                        compiled[layout] = compile_profile(layout) if layout else None
                    except ValueError:
                        compiled[layout] = None
                p = compiled[layout]
                m = match(p, line or "", recognizer, begins) if p else None
                if m is None:
                    rows.append((False, None, None))
                    continue
                size = lambda i, line=line: len(line[:i].encode())
                rows.append((True, m["time_state"], {n: {"start": size(a), "end": size(b), "value": line[a:b]} for n, (a, b) in m["spans"].items()}))
            out = pdf[key].copy()
            out["matched"], out["time_state"], out["fields"] = ([r[i] for r in rows] for i in range(3))
            yield out

    return src.mapInPandas(run, f"{kept}, matched boolean, time_state string, fields map<string,struct<start:int,`end`:int,value:string>>")
