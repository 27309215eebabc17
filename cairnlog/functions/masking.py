"""Token masks: variable parts of a message become class names, in the JVM; a driver twin serves samples.

The classes are tried in a fixed order and the first hit wins; a line whose tokens all stay as they are keeps its
own spacing, any other is joined by single blanks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Mask classes and the expression of each, in order of trial. Expressions hold for whole tokens.
CLASSES: list[tuple[str, str]] = [
    ("URL", r"^.*://.*$"),
    ("EMAIL", r"^[^@]+@(?=.{3,}$).*\..*$"),
    ("JSON", r"^(?:\{.*:.*\}|\[.*\".*\])$"),
    ("UUID", r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"),
    ("TIME", r"^\d{1,2}(?:\.\d+)?(?::\d{1,2}(?:\.\d+)?){1,2}$"),
    ("IP", r"^\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?$"),
    ("IPV6", r"^(?=.*:.*:)[0-9A-Fa-f:]{6,}$"),
]
VALUE_CLASSES: list[tuple[str, str]] = [
    ("PATH", r"^(?:/(?=.*[/.]).+|\\\\.+|[A-Za-z]:\\.*)$"),
    ("TIME", r"^(?=.*[0-9.])(?=.*[mshd])[0-9.mshd]+$"),
    ("NUM", r"^[+-]?(?:\d+\.?\d*|\.\d+)$"),
    ("HEX", r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{8,64}$"),
]
_KEY = r"^([A-Za-z_][A-Za-z0-9_.\-]*)=(.+)$"
_NUM_RUN = r"(?<![A-Za-z0-9])\d+(?![A-Za-z0-9])"
_HEX_RUN = r"(?<![A-Za-z0-9])(?=[0-9A-Fa-f]*\d)(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{8,}(?![A-Za-z0-9])"


def enabled(off: frozenset[str]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    return [c for c in CLASSES if c[0] not in off], [c for c in VALUE_CLASSES if c[0] not in off]


def _first(x: Column, classes: list[tuple[str, str]], otherwise: Column) -> Column:
    c: Column | None = None
    for name, pattern in classes:
        hit = x.rlike(pattern)
        c = F.when(hit, f"<{name}>") if c is None else c.when(hit, f"<{name}>")
    return otherwise if c is None else c.otherwise(otherwise)


def mask_value(x: Column, off: frozenset[str] = frozenset()) -> Column:
    """Class of a bare value, null if it has none."""
    return _first(x, enabled(off)[1], F.lit(None).cast("string"))


def mask_token(x: Column, off: frozenset[str] = frozenset()) -> Column:
    whole, _ = enabled(off)
    key, value = F.regexp_extract(x, _KEY, 1), F.regexp_extract(x, _KEY, 2)
    pair = F.coalesce(F.concat(key, F.lit("="), F.coalesce(_first(value, whole, F.lit(None).cast("string")), mask_value(value, off))), x)
    inner = F.regexp_replace(F.regexp_replace(x, _NUM_RUN, "<NUM>"), _HEX_RUN, "<HEX>")
    return _first(x, whole, F.when(x.rlike(_KEY), pair).otherwise(F.coalesce(mask_value(x, off), inner)))


def mask_line(text: Column, off: frozenset[str] = frozenset()) -> Column:
    tokens = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    masked = F.array_join(F.transform(tokens, lambda t: mask_token(t, off)), " ")
    return F.when(masked == F.array_join(tokens, " "), text).otherwise(masked)


_COMPILED: dict[frozenset[str], tuple] = {}
_KEY_PY, _NUM_PY, _HEX_PY = re.compile(_KEY), re.compile(_NUM_RUN), re.compile(_HEX_RUN)
#: A token without any of these characters stays as it is.
_VARIABLE = re.compile(r"[0-9@/\\\[{:.]")
#: Distinct tokens whose masks a worker remembers.
MEMO = 65_536


def mask_word(token: str, off: frozenset[str] = frozenset()) -> str:
    """mask_token for one word, in Python."""
    if not _VARIABLE.search(token):
        return token
    if off not in _COMPILED:
        _COMPILED[off] = tuple([(f"<{n}>", re.compile(p)) for n, p in cs] for cs in enabled(off))
    whole, values = _COMPILED[off]
    for name, p in whole:
        if p.match(token):
            return name
    if m := _KEY_PY.match(token):
        return next((f"{m[1]}={name}" for name, p in (*whole, *values) if p.match(m[2])), token)
    hit = next((name for name, p in values if p.match(token)), None)
    return hit or _HEX_PY.sub("<HEX>", _NUM_PY.sub("<NUM>", token))


def masked(df: DataFrame, column: str, off: frozenset[str] = frozenset()) -> DataFrame:
    """mask_line of a column, by Arrow batches: each distinct token is masked once per worker and remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, str] = {}
        for b in batches:
            out = []
            for text in b.column(column).to_pylist():
                if text is None:
                    out.append(None)
                    continue
                words, changed = text.split(), False
                for i, w in enumerate(words):
                    m = memo.get(w)
                    if m is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        m = memo[w] = mask_word(w, off)
                    if m is not w and m != w:
                        words[i], changed = m, True
                out.append(" ".join(words) if changed else text)
            yield b.set_column(b.schema.get_field_index(column), column, pa.array(out, pa.string()))

    return df.mapInArrow(run, df.schema)


def class_of(token: str) -> str | None:
    """Driver twin: the class of a token, NUM etc. for its value if it is a pair, None if it stays as it is."""
    for name, pattern in CLASSES:
        if re.match(pattern, token):
            return name
    m = re.match(_KEY, token)
    if m:
        return class_of(m[2])
    return next((n for n, p in VALUE_CLASSES if re.match(p, token)), None)


def learn_header_slots(headers: list[str], positions: int = 8, least: int = 8) -> list[str | None]:
    """Per leading token position its mask class if a sample of headers shows one: 60 % of one dynamic class.

    A position that 80 % of the headers share as a constant, or whose eight commonest tokens make up 95 %, stays
    unmasked; fewer than `least` headers teach nothing.
    """
    rows = [h.split()[:positions] for h in headers if h.strip()]
    if len(rows) < least:
        return []
    out: list[str | None] = []
    for i in range(positions):
        at = [r[i] for r in rows if len(r) > i]
        if len(at) < 0.8 * len(rows):
            break
        counts: dict[str, int] = {}
        for t in at:
            counts[t] = counts.get(t, 0) + 1
        top = sorted(counts.values(), reverse=True)
        if top[0] >= 0.8 * len(at) or sum(top[:8]) >= 0.95 * len(at):
            out.append(None)
            continue
        classes = [c for t in at if (c := class_of(t))]
        best = max(set(classes), key=classes.count) if classes else None
        out.append(best if best and classes.count(best) >= 0.6 * len(at) else None)
    return out


def mask_with_slots(text: Column, slots: list[str | None], off: frozenset[str] = frozenset()) -> Column:
    """Header positions with a learned class are masked whatever they hold; brackets around them stay."""
    tokens = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    forced = F.array(*[F.lit(s).cast("string") for s in slots] or [F.lit(None).cast("string")])

    def one(t: Column, i: Column) -> Column:
        slot = F.get(forced, i)
        shaped = F.concat(F.regexp_extract(t, r"^[\[(<]*", 0), F.lit("<"), slot, F.lit(">"), F.regexp_extract(t, r"[\])>:,]*$", 0))
        return F.when((i < len(slots)) & slot.isNotNull(), shaped).otherwise(mask_token(t, off))

    masked = F.array_join(F.transform(tokens, one), " ")
    return F.when(masked == F.array_join(tokens, " "), text).otherwise(masked)
