"""Timestamp text to numbers: character-class masks, one parser per distinct mask, vectorised over code points."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: A longer text is no time stamp: no grammar below accepts as many characters.
MAX_LEN = 64

# Month names (English, German and other short forms in use), weekday names, zone abbreviations (minutes east of UTC).
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "mär": 3, "mrz": 3, "apr": 4, "may": 5, "mai": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "dez": 12}
WEEKDAYS = {"mon": 0, "tue": 1, "wed": 2, "thu": 3, "fri": 4, "sat": 5, "sun": 6}
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180, "ist": 330, "sgt": 480, "hkt": 480, "jst": 540, "kst": 540,
    "awst": 480, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}

_TIME = r"(?P<H>9{1,2}):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9{1,9}))?)?(?: ?(?P<w>a{1,5}))?(?: (?P<w2>a{2,5}))?(?: ?(?P<off>[+-]99:?(?:99)?))?"

#: (kind, mask pattern). kind: ymd has a date (with dots the day comes first); dm: order of day and month is the log's; yl: no year.
GRAMMARS = [
    ("ymd", re.compile(rf"(?P<y>9999)(?P<s>[-/.])(?P<m>9{{1,2}})(?P=s)(?P<d>9{{1,2}})[ a]{_TIME}")),
    ("ymd", re.compile(r"(?P<y>9999)(?P<m>99)(?P<d>99)[ a](?P<H>99)(?P<M>99)(?P<S>99)(?:[.,](?P<f>9{1,9}))?(?P<w>a)?(?P<off>[+-]99:?99)?")),
    ("ymd", re.compile(rf"(?P<d>9{{1,2}})\.(?P<m>9{{1,2}})\.(?P<y>9999),?[ a]{_TIME}")),
    ("dm", re.compile(rf"(?P<a>9{{1,2}})(?P<s>[-/])(?P<b>9{{1,2}})(?P=s)(?P<y>9999),?[ a]{_TIME}")),
    ("ymd", re.compile(r"(?P<d>9{1,2})/(?P<mon>aaa)/(?P<y>9999):(?P<H>99):(?P<M>99):(?P<S>99)(?: (?P<off>[+-]99:?99))?")),
    ("ymd", re.compile(rf"(?:(?P<wd>aaa), )?(?P<d>9{{1,2}})\.? (?P<mon>aaa)\.? (?P<y>9999) {_TIME}")),
    ("ymd", re.compile(r"(?:(?P<wd>aaa) )?(?P<mon>aaa) {1,2}(?P<d>9{1,2}) (?P<H>99):(?P<M>99):(?P<S>99)(?:[.,](?P<f>9{1,9}))?(?: (?P<w>a{2,5}))? (?P<y>9999)")),
    ("yl", re.compile(r"(?P<mon>aaa) {1,2}(?P<d>9{1,2}) (?P<H>99):(?P<M>99):(?P<S>99)(?:[.,](?P<f>9{1,9}))?")),
    ("yl", re.compile(r"(?P<m>99)-(?P<d>99) (?P<H>99):(?P<M>99):(?P<S>99)(?:[.,](?P<f>9{1,9}))?")),
    ("yl", re.compile(r"a?(?P<m>99)(?P<d>99) (?P<H>99):(?P<M>99):(?P<S>99)(?:[.,](?P<f>9{1,9}))?")),
    ("epoch", re.compile(r"(?P<e>9{9,19})(?:\.(?P<f>9{1,9}))?")),
]


@lru_cache(maxsize=65536)
def parser_of(mask: str) -> tuple[str, dict[str, tuple[int, int]]] | None:
    """kind and field places for a mask; every stamp with this mask has its fields there."""
    for kind, pattern in GRAMMARS:
        if m := pattern.fullmatch(mask):
            return kind, {k: m.span(k) for k, v in m.groupdict().items() if v is not None}
    return None


def days_from_civil(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    y = y - (m <= 2)
    era = np.floor_divide(y, 400)
    yoe = y - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


_DAYS = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])


def valid_date(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    inside = (m >= 1) & (m <= 12)
    length = _DAYS[np.where(inside, m, 0)] + (leap & (m == 2))
    return inside & (d >= 1) & (d <= length) & (y >= 1)


def _look(words: np.ndarray, table: dict[str, int], absent: int) -> np.ndarray:
    names, back = np.unique(words, return_inverse=True)
    return np.array([table.get(w.lower(), absent) for w in names], dtype=np.int64)[back]


NONE = -(1 << 62)


def parse_mask(kind: str, places: dict[str, tuple[int, int]], stamps: np.ndarray) -> dict[str, np.ndarray]:
    """stamps: texts of one mask. kind code, absolute or local ms, and the two readings of day and month.

    code 1: abs holds UTC ms; 2: one holds local ms; 3: one and two hold local ms read as day-month and
    month-day (NONE if impossible); 4: one holds local ms in the leap year 2000, its year is the log's; 0: no time.
    """
    n, width = len(stamps), len(stamps[0])
    points = stamps.view(np.uint32).reshape(n, -1)[:, :width].astype(np.int64)
    num = lambda k: (points[:, slice(*places[k])] - 48) @ (10 ** np.arange(places[k][1] - places[k][0] - 1, -1, -1, dtype=np.int64))
    word = lambda k: np.array([s[slice(*places[k])] for s in stamps])
    code, one, two = np.zeros(n, dtype=np.int64), np.full(n, NONE, dtype=np.int64), np.full(n, NONE, dtype=np.int64)
    frac = np.zeros(n, dtype=np.int64)
    if "f" in places:
        a, b = places["f"]
        digits = points[:, a : min(b, a + 3)] - 48
        frac = digits @ np.array([100, 10, 1])[: digits.shape[1]]
    if kind == "epoch":
        e, size = num("e"), places["e"][1] - places["e"][0]
        if size <= 11:
            one = e * 1000 + frac
        elif "f" in places and size > 14:
            return {"code": code, "one": one, "two": two}
        else:
            one = e if size <= 14 else e // (1000 if size <= 17 else 1_000_000)
        return {"code": code + 1, "one": one, "two": two}
    hour, minute, second = num("H"), num("M"), num("S") if "S" in places else np.zeros(n, dtype=np.int64)
    ok = (minute <= 59) & (second <= 59)
    zone, pm = np.full(n, NONE, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    for k in ("w", "w2"):
        if k in places:
            w = word(k)
            half, named = _look(w, {"am": 0, "pm": 1}, -1), _look(w, ZONES, NONE)
            ok &= (half >= 0) | (named != NONE)
            pm, zone = np.where(half >= 0, half, pm), np.where((half < 0) & (named != NONE), named, zone)
    if "off" in places:
        a, b = places["off"]
        sign = np.where(points[:, a] == 45, -1, 1)
        tail = [p for p in range(a + 1, b) if p - a != 3 or b - a != 6]
        d = points[:, tail] - 48
        minutes = d[:, 0] * 600 + d[:, 1] * 60 + (d[:, 2] * 10 + d[:, 3] if d.shape[1] == 4 else 0)
        ok &= (minutes <= 18 * 60) & ((d[:, 2] <= 5) if d.shape[1] == 4 else True)
        zone = sign * minutes
    twelve = pm >= 0
    ok &= np.where(twelve, (hour >= 1) & (hour <= 12), hour <= 23)
    hour = np.where(twelve, hour % 12 + 12 * pm, hour)
    clock = (hour * 3600 + minute * 60 + second) * 1000 + frac
    local = lambda y, m, d: np.where(ok & valid_date(y, m, d), days_from_civil(y, np.clip(m, 1, 12), d) * 86_400_000 + clock, NONE)
    if kind == "dm":
        a, b, y = num("a"), num("b"), num("y")
        one, two = local(y, b, a), local(y, a, b)
        same = (one == two) & (one != NONE)
        code = np.where((one != NONE) | (two != NONE), np.where(same, 2, 3), 0)
        if "off" in places or (zone != NONE).any():
            # an own zone fixes the clock but not the order: both readings are kept as UTC, marked by code 5
            z = np.where(zone == NONE, 0, zone) * 60_000
            one, two = np.where(one == NONE, NONE, one - z), np.where(two == NONE, NONE, two - z)
            code = np.where(zone != NONE, np.where(same, 1, np.where(code == 3, 5, 0)), code)
        return {"code": code, "one": one, "two": two}
    month = _look(word("mon"), MONTHS, 0) if "mon" in places else num("m")
    if kind == "yl":
        one = local(np.full(n, 2000, dtype=np.int64), month, num("d"))
        return {"code": np.where(one != NONE, 4, 0), "one": one, "two": two}
    y, d = num("y"), num("d")
    one = local(y, month, d)
    if "wd" in places:
        day = _look(word("wd"), WEEKDAYS, -1)
        fits = (day < 0) | ((days_from_civil(y, np.clip(month, 1, 12), d) + 3) % 7 == day)
        one = np.where(fits, one, NONE)
    own = zone != NONE
    one = np.where(own & (one != NONE), one - np.where(own, zone, 0) * 60_000, one)
    return {"code": np.where(one == NONE, 0, np.where(own, 1, 2)), "one": one, "two": two}


def parse_stamps(stamps: list[str | None], masks: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """code, one, two (see parse_mask) of each stamp; stamps are grouped by mask and parsed a mask at a time."""
    n = len(stamps)
    code, one, two = np.zeros(n, dtype=np.int64), np.full(n, NONE, dtype=np.int64), np.full(n, NONE, dtype=np.int64)
    groups: dict[str, list[int]] = {}
    for i, m in enumerate(masks):
        if m is not None:
            groups.setdefault(m, []).append(i)
    for mask, rows in groups.items():
        if not mask or (found := parser_of(mask)) is None:
            continue
        at = np.array(rows)
        got = parse_mask(*found, np.array([stamps[i] for i in rows], dtype=f"U{len(mask)}"))
        code[at], one[at], two[at] = got["code"], got["one"], got["two"]
    return code, one, two
