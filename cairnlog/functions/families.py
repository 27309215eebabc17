"""The timestamp families of log headers: one expression per family, usable in the JVM and on the driver."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Only this many characters of a line are searched.
WINDOW = 96

_MON = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_MONTHS = {m: i for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)}
_HMS = r"(\d{2}):(\d{2}):(\d{2})"
_FRAC = r"(?:[.,](\d+))?"


@dataclass(frozen=True)
class Family:
    """pattern: its capturing groups are named in order by parts.

    y m d mon H M S f(raction) z(one) p(am or pm) e(poch). recognizes_invalid: a token that looks right but is no
    date is a header with an invalid time, not a plain line.
    """

    name: str
    pattern: str
    parts: str
    recognizes_invalid: bool = False

    @property
    def yearless(self) -> bool:
        return "y" not in self.parts.split() and "e" not in self.parts.split()

    def group(self, part: str) -> int:
        parts = self.parts.split()
        return parts.index(part) + 1 if part in parts else 0


FAMILIES = [
    Family("ISO-8601", rf"(\d{{4}})-(\d{{2}})-(\d{{2}})[T ]{_HMS}{_FRAC}(?:\s?(Z|[+-]\d{{2}}:?\d{{2}}))?", "y m d H M S f z", True),
    Family("YYYY/MM/DD", rf"^(\d{{4}})/(\d{{2}})/(\d{{2}})[ T]{_HMS}{_FRAC}", "y m d H M S f"),
    Family("MM/DD/YYYY", rf"^\s*(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})[ T]{_HMS}{_FRAC}", "m d y H M S f"),
    Family("MM-DD-YYYY", rf"^\s*(\d{{1,2}})-(\d{{1,2}})-(\d{{4}})[ T]{_HMS}{_FRAC}", "m d y H M S f"),
    Family("DD-MM-YYYY", rf"^\s*(\d{{1,2}})-(\d{{1,2}})-(\d{{4}})[ T]{_HMS}{_FRAC}", "d m y H M S f"),
    Family("DD.MM.YYYY", rf"^\s*(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})[ T]{_HMS}{_FRAC}", "d m y H M S f"),
    Family("YYYY.MM.DD", rf"^\s*(\d{{4}})\.(\d{{2}})\.(\d{{2}})[ T]{_HMS}{_FRAC}", "y m d H M S f"),
    Family("BSD syslog", rf"^{_MON} {{1,2}}(\d{{1,2}}) {_HMS}", "mon d H M S"),
    Family("Apache CLF", rf"(\d{{2}})/{_MON}/(\d{{4}}):{_HMS} ([+-]\d{{4}})", "d mon y H M S z"),
    Family("epoch", r"^\s*(\d{13}|\d{10})[\s,|\]]", "e"),
    Family("logcat threadtime", r"^(\d{2})-(\d{2}) (\d{2}):(\d{2}):(\d{2})\.(\d{3})", "m d H M S f"),
    Family("glog", rf"^[IWEF](\d{{2}})(\d{{2}}) {_HMS}(?:\.(\d+))?", "m d H M S f"),
    Family("ISO-8601 12h AM/PM", rf"(\d{{4}})-(\d{{2}})-(\d{{2}})[T ](\d{{1,2}}):(\d{{2}}):(\d{{2}}){_FRAC}[   ]?([AaPp])[Mm]", "y m d H M S f p"),
    Family("RFC 2822", rf"(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), (\d{{1,2}}) {_MON} (\d{{4}}) {_HMS} ([+-]\d{{4}}|GMT|UTC)", "d mon y H M S z"),
]
BY_NAME = {f.name: f for f in FAMILIES}


def register(family: Family, first: bool = False) -> None:
    """Adds a family to those that detection tries."""
    FAMILIES.insert(0 if first else len(FAMILIES), family)
    BY_NAME[family.name] = family


def custom_family(name: str, pattern: str) -> Family:
    """A user's expression with groups named year, month, day, hour, min, sec and optionally ms, ampm."""
    names = {"year": "y", "month": "m", "day": "d", "hour": "H", "min": "M", "sec": "S", "ms": "f", "ampm": "p"}
    compiled = re.compile(pattern)
    missing = {"month", "day", "hour", "min", "sec"} - set(compiled.groupindex)
    if missing:
        raise ValueError(f"groups missing: {', '.join(sorted(missing))}")
    if unknown := set(compiled.groupindex) - set(names):
        raise ValueError(f"unknown groups: {', '.join(sorted(unknown))}")
    by_index = {i: names[n] for n, i in compiled.groupindex.items()}
    plain = re.sub(r"\(\?P<\w+>", "(", pattern)
    return Family(name, plain, " ".join(by_index.get(i, "_") for i in range(1, compiled.groups + 1)), True)


def _offset_minutes(z: Column) -> Column:
    digits = F.regexp_replace(z, ":", "")
    minutes = F.substring(digits, 2, 2).try_cast("int") * 60 + F.substring(digits, 4, 2).try_cast("int")
    return F.when(z.rlike(r"^[+-]"), F.when(z.startswith("-"), -minutes).otherwise(minutes)).otherwise(0)


def matched(line: Column, family: Family) -> Column:
    """The text a family's expression takes in the window, or an empty string."""
    return F.regexp_extract(F.substring(line, 1, WINDOW), family.pattern, 0)


def time_of(line: Column, family: Family, reference_ms: int | None = None) -> Column:
    """Epoch ms that a family reads at the head of a line, null if none or impossible; no own zone means UTC.

    reference_ms: the one clock a document's yearless stamps refer to; what lies more than a day beyond it belongs
    to the year before.
    """
    w = F.substring(line, 1, WINDOW)
    g = lambda p: F.regexp_extract(w, family.pattern, family.group(p))
    if family.group("e"):
        e = g("e")
        value = e.try_cast("long")
        return F.when(F.length(e) == 10, value * 1000).when(F.length(e) == 13, value)
    num = lambda p: g(p).try_cast("int")
    month = F.create_map(*[F.lit(x) for kv in _MONTHS.items() for x in kv])[g("mon")] if family.group("mon") else num("m")
    hour = num("H")
    if family.group("p"):
        hour = F.when((hour >= 1) & (hour <= 12), hour % 12 + F.when(F.lower(g("p")).startswith("p"), 12).otherwise(0))
    second = num("S")
    millis = F.rpad(F.substring(g("f"), 1, 3), 3, "0").try_cast("int") if family.group("f") else F.lit(0)
    sec = F.when(second <= 60, second)

    def at(year: Column) -> Column:
        day = F.call_function("try_make_timestamp", year, month, num("d"), F.when(hour <= 23, hour), F.when(num("M") <= 59, num("M")), F.lit(0).cast("decimal(16,6)"), F.lit("UTC"))
        ms = F.unix_millis(day) + sec.cast("long") * 1000 + F.coalesce(millis, F.lit(0)).cast("long")
        return ms - _offset_minutes(g("z")).cast("long") * 60_000 if family.group("z") else ms

    if not family.yearless:
        return at(num("y"))
    ref = reference_ms if reference_ms is not None else 0
    year = dt.datetime.fromtimestamp(ref / 1000, dt.timezone.utc).year
    now, before = at(F.lit(year)), at(F.lit(year - 1))
    return F.when(now > F.lit(ref + 86_400_000), before).otherwise(F.coalesce(now, before))


def parse(text: str, family: Family, reference_ms: int | None = None) -> tuple[int, int, int | None] | None:
    """Driver twin of time_of: (start, end, ms or None for an impossible date), None without a match."""
    m = re.search(family.pattern, text[:WINDOW])
    if not m:
        return None
    g = {p: m.group(i) for i, p in enumerate(family.parts.split(), 1)}
    if "e" in g:
        return m.start(), m.end(), int(g["e"]) * (1000 if len(g["e"]) == 10 else 1)
    try:
        hour, second = int(g["H"]), int(g["S"])
        if "p" in g:
            if not 1 <= hour <= 12:
                return m.start(), m.end(), None
            hour = hour % 12 + (12 if g["p"].lower().startswith("p") else 0)
        month = _MONTHS[g["mon"]] if "mon" in g else int(g["m"])
        ref = dt.datetime.fromtimestamp((reference_ms or 0) / 1000, dt.timezone.utc)
        year = int(g["y"]) if "y" in g else ref.year
        if second > 60:
            return m.start(), m.end(), None
        when = dt.datetime(year, month, int(g["d"]), hour, int(g["M"]), 0, tzinfo=dt.timezone.utc)
        if "y" not in g and when > ref + dt.timedelta(days=1):
            when = when.replace(year=year - 1)
    except ValueError:
        return m.start(), m.end(), None
    ms = int(when.timestamp()) * 1000 + second * 1000 + int(((g.get("f") or "") + "000")[:3])
    z = g.get("z") or ""
    if z[:1] in "+-" and z:
        sign, digits = (-1 if z[0] == "-" else 1), z[1:].replace(":", "")
        ms -= sign * (int(digits[:2]) * 60 + int(digits[2:])) * 60_000
    return m.start(), m.end(), ms


def detect(sample: list[str], families: list[Family] = FAMILIES, least: int = 2) -> tuple[str, list[str]]:
    """(confidence, names): the family most sampled lines show, by hits and covered characters; a tie is ambiguous."""
    score = {}
    for f in families:
        hits = [p for p in (parse(x, f) for x in sample) if p and p[2] is not None]
        if len(hits) >= min(least, max(1, len(sample))):
            score[f.name] = (len(hits), sum(b - a for a, b, _ in hits))
    if not score:
        return "Unresolved", []
    best = max(score.values())
    names = [n for n, s in score.items() if s == best]
    return ("Ambiguous" if len(names) > 1 else "High"), names


def parse_time_parameter(text: str) -> int:
    """A user's time: whole number (seconds up to 11 digits, else ms), RFC 3339, or a date with or without clock."""
    t = text.strip()
    if re.fullmatch(r"-?\d+", t):
        return int(t) * (1000 if len(t) <= 11 else 1)
    for pattern in (r"\d{4}-\d{2}-\d{2}", r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}"):
        if re.fullmatch(pattern, t):
            t += " 00:00:00" if len(t) == 10 else ":00"
    found = parse(t, BY_NAME["ISO-8601"])
    if found is None or found[2] is None:
        raise ValueError(f"no time: {text}")
    return found[2]


def format_ms(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss.SSS")
