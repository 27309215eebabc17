"""All detectors over a text, overlaps arbitrated; over a table, by Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlog.operators.embedded.detectors import REGISTRY
from cairnlog.operators.embedded.model import MAX_BYTES, MAX_LINES, MAX_NODES, MAX_RESULTS, Detection, Detector, count_nodes, plain, summary

# Which detector prevails where two overlap; smaller first.
PRIORITY = {"json": 0, "plist": 0, "binary-plist": 0, "jwt": 1, "base64": 1, "hex": 1, "pem": 1, "encoded": 1, "http": 2, "stacktrace": 3, "protobuf-text": 4, "python": 5, "foundation": 5, "jvm-debug": 5, "logfmt": 10, "fields": 10}


def _priority(d: Detection) -> int:
    return PRIORITY.get(d.detector, 20)


def _contains(a: Detection, b: Detection) -> bool:
    return a.start <= b.start and b.end <= a.end and (a.start, a.end) != (b.start, b.end)


def preferred(a: Detection, b: Detection, text: str) -> bool:
    """Whether a is kept rather than b: a container of equal or better standing, else rank, extent and place."""
    if _contains(a, b) != _contains(b, a):
        outer, inner = (a, b) if _contains(a, b) else (b, a)
        wins = outer.detector == inner.detector or (outer.detector, inner.detector) == ("foundation", "json") or _priority(outer) <= _priority(inner)
        return (a is outer) == wins
    key = lambda d: (_priority(d), -d.raw.count("\n"), -len(d.raw), d.start)
    return key(a) < key(b)


def arbitrate(found: list[Detection], text: str) -> list[Detection]:
    kept: list[Detection] = []
    for d in found:
        clash = [k for k in kept if d.start < k.end and k.start < d.end]
        if all(preferred(d, k, text) for k in clash):
            kept = [k for k in kept if k not in clash] + [d]
    return sorted(kept, key=lambda d: (d.start, d.end))


def analyze(text: str, detectors: list[Detector] | None = None, max_bytes: int = MAX_BYTES, max_lines: int = MAX_LINES) -> list[Detection]:
    """Detections of one text in order of place. Texts beyond the bounds are analysed window by window."""
    out: list[Detection] = []
    for offset, window in windows(text, max_bytes, max_lines):
        found = [d for detect in detectors or REGISTRY for d in detect(window) if count_nodes(d.value) <= MAX_NODES][:MAX_RESULTS]
        out += [Detection(d.detector, d.start + offset, d.end + offset, d.value, d.raw) for d in arbitrate(found, window)]
    return out


def windows(text: str, max_bytes: int, max_lines: int) -> Iterator[tuple[int, str]]:
    """Whole lines, as many as the bounds allow; a longer line is a window of its own."""
    if len(text) <= max_bytes and text.count("\n") < max_lines:
        yield 0, text
        return
    start = at = n = 0
    for line in text.splitlines(keepends=True):
        if n and (n >= max_lines or at + len(line) - start > max_bytes):
            yield start, text[start:at]
            start, n = at, 0
        at, n = at + len(line), n + 1
    yield start, text[start:at]


def detections(df: DataFrame, key: list[str], text: str, detectors: list[Detector] | None = None) -> DataFrame:
    """(key..., detector, span_start, span_end, root_kind, summary, raw, data): data is the value as JSON text."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*key).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*k, d.detector, d.start, d.end, d.kind, summary(d.value), d.raw, json.dumps(plain(d.value), ensure_ascii=False)) for *k, t in zip(*(pdf[c] for c in key), pdf["_text"]) if t for d in analyze(t, detectors)]
            yield pd.DataFrame(rows, columns=[*key, "detector", "span_start", "span_end", "root_kind", "summary", "raw", "data"])

    return df.select(*key, F.col(text).alias("_text")).mapInPandas(run, f"{kept}, detector string, span_start int, span_end int, root_kind string, summary string, raw string, data string")
