"""Values, detections and the small parsers that the detectors share.

A value is a Python object; objects are lists of (key, value) pairs in source order, so repeated keys are kept.
Numbers stay as text in a Number.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

#: Bounds of one analysis: nesting, nodes and results.
MAX_DEPTH, MAX_NODES, MAX_RESULTS, MAX_BYTES, MAX_LINES = 128, 20_000, 64, 512 << 10, 1_000


class Pairs(list):
    """An object: (key, value) pairs."""


class Number(str):
    """A number as it was written."""


@dataclass(frozen=True)
class Detection:
    detector: str
    start: int
    end: int
    value: Any
    raw: str

    @property
    def kind(self) -> str:
        return kind_of(self.value)


def kind_of(v: Any) -> str:
    if isinstance(v, Pairs):
        return "object"
    if isinstance(v, list):
        return "array"
    if isinstance(v, Number):
        return "number"
    return {bool: "bool", str: "string", type(None): "null"}[type(v)]


def summary(v: Any) -> str:
    k = kind_of(v)
    return f"{k} · {len(v)} {'fields' if k == 'object' else 'items'}" if k in ("object", "array") else k


def plain(v: Any) -> Any:
    """For JSON: repeated keys keep the last value; numbers that JSON can hold are numbers."""
    if isinstance(v, Pairs):
        return {k: plain(x) for k, x in v}
    if isinstance(v, list):
        return [plain(x) for x in v]
    if isinstance(v, Number):
        try:
            return json.loads(v)
        except ValueError:
            return str(v)
    return v


def pretty(v: Any) -> str:
    return json.dumps(plain(v), indent=2, ensure_ascii=False)


_CLOSE = {"{": "}", "[": "]", "(": ")", "<": ">"}
_QUOTES = "\"'`"


def balanced_end(text: str, at: int, quotes: str = _QUOTES[:2], brackets: str = "{[(") -> int | None:
    """One past the bracket that closes the one at `at`, outside quotes."""
    stack, i = [], at
    while i < len(text):
        ch = text[i]
        if ch in quotes:
            i = quoted_end(text, i) or len(text)
            continue
        if ch in brackets:
            stack.append(_CLOSE[ch])
            if len(stack) > MAX_DEPTH:
                return None
        elif stack and ch == stack[-1]:
            stack.pop()
            if not stack:
                return i + 1
        elif ch in "}])" and ch in {_CLOSE[b] for b in brackets}:
            return None
        i += 1
    return None


def quoted_end(text: str, at: int) -> int | None:
    q, i = text[at], at + 1
    while i < len(text):
        if text[i] == "\\":
            i += 2
            continue
        if text[i] == q:
            return i + 1
        i += 1
    return None


def split_top(text: str, seps: str, quotes: str = _QUOTES[:2]) -> list[str]:
    """The parts between separators that stand outside brackets and quotes."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(text):
        ch = text[i]
        if ch in quotes:
            i = quoted_end(text, i) or len(text)
            continue
        if ch in "{[(<" and not (ch == "<" and ">" not in text[i:]):
            depth += 1
        elif ch in "}])>":
            depth = max(0, depth - 1)
        elif ch in seps and not depth:
            out.append(text[start:i])
            start = i + 1
        i += 1
    return [*out, text[start:]]


def find_top(text: str, needle: str, quotes: str = _QUOTES[:2]) -> int:
    depth, i = 0, 0
    while i < len(text):
        ch = text[i]
        if ch in quotes:
            i = quoted_end(text, i) or len(text)
            continue
        if not depth and text.startswith(needle, i):
            return i
        depth += (ch in "{[(") - (ch in "}])")
        i += 1
    return -1


_ESC = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}


def unquote(text: str) -> str:
    body = text[1:-1] if len(text) >= 2 and text[0] in _QUOTES and text[-1] == text[0] else text
    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else _ESC.get(m[1], m[1]), body, flags=re.S)


_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")


def scalar(text: str) -> Any:
    """A bare or quoted word as the value it names."""
    t = text.strip()
    if t[:1] in _QUOTES and t[:1] and quoted_end(t, 0) == len(t):
        return unquote(t)
    if t.lower() in ("true", "false"):
        return t.lower() == "true"
    if t in ("null", "None", "nil", "NULL", "<null>"):
        return None
    return Number(t) if _NUMBER.fullmatch(t) else t


def strict_json(text: str) -> Any:
    """A JSON value with pairs and numbers kept, ValueError unless it is strictly JSON."""
    def no(x: str) -> None:
        raise ValueError(x)

    return json.loads(text, object_pairs_hook=Pairs, parse_int=Number, parse_float=Number, parse_constant=no)


def count_nodes(v: Any) -> int:
    if isinstance(v, Pairs):
        return 1 + sum(count_nodes(x) for _, x in v)
    return 1 + sum(count_nodes(x) for x in v) if isinstance(v, list) else 1


Detector = Callable[[str], list[Detection]]
