"""Typed predicates over declared fields: `name op value` parsed, checked against the schema and compiled to a column."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlog.functions.families import parse_time_parameter
from cairnlog.operators.filters import java_pattern

OPERATORS = [">=", "<=", "!=", "=", ">", "<", "contains", "matches", "exists", "missing"]
_ORDERING = {">=", "<=", ">", "<"}
TYPES = ("timestamp", "message", "token", "number", "path", "text")


@dataclass(frozen=True)
class FieldQuery:
    field: str
    operator: str
    value: str = ""
    case_sensitive: bool = True
    field_type: str | None = None

    @staticmethod
    def parse(expression: str, case_sensitive: bool = True) -> FieldQuery:
        m = re.match(r"\s*([A-Za-z_]\w*)\s*(>=|<=|!=|=|>|<|\b(?:contains|matches|exists|missing)\b)\s*(.*?)\s*$", expression, re.S)
        if not m:
            raise ValueError("expected: field operator value")
        name, op, value = m.groups()
        if op in ("exists", "missing"):
            if value:
                raise ValueError(f"{op} takes no value")
        elif not value:
            raise ValueError("a value is missing")
        elif value.startswith('"'):
            value = json.loads(value)
        return FieldQuery(name, op, value, case_sensitive)

    def expression(self) -> str:
        if self.operator in ("exists", "missing"):
            return f"{self.field} {self.operator}"
        plain = re.fullmatch(r"[^\s\"][^\"]*(?<!\s)", self.value)
        return f"{self.field} {self.operator} {self.value if plain else json.dumps(self.value)}"

    def bind(self, schema: dict[str, str]) -> FieldQuery:
        """Checks the query against field types; a type that changed since it was saved is an error."""
        if self.field not in schema:
            raise ValueError(f"unknown field: {self.field}")
        kind = schema[self.field]
        if self.field_type and self.field_type != kind:
            raise ValueError(f"{self.field} was {self.field_type} and is {kind}")
        if self.operator in _ORDERING and kind not in ("number", "timestamp"):
            raise ValueError(f"{kind} fields have no order")
        if self.operator in ("contains", "matches") and kind in ("number", "timestamp"):
            raise ValueError(f"{kind} fields are compared, not searched")
        if self.operator == "matches":
            java_pattern(self.value, self.case_sensitive)
        if kind == "number" and self.operator not in ("exists", "missing"):
            try:
                Decimal(self.value)
            except InvalidOperation as e:
                raise ValueError(f"no number: {self.value}") from e
        return FieldQuery(self.field, self.operator, self.value, self.case_sensitive, kind)

    def condition(self, value: Column | None = None, is_record: Column | None = None) -> Column:
        """Boolean column over records; a missing field fails every operator but `missing`."""
        v = F.col(self.field) if value is None else value
        rec = F.lit(True) if is_record is None else is_record
        op = self.operator
        if op == "exists":
            return rec & v.isNotNull()
        if op == "missing":
            return rec & v.isNull()
        if self.field_type == "number":
            return rec & _number_condition(v, op, self.value)
        if self.field_type == "timestamp":
            return rec & _compare(v.cast("long"), op, F.lit(parse_time_parameter(self.value)))
        a, b = (v, F.lit(self.value)) if self.case_sensitive else (F.lower(v), F.lit(self.value.lower()))
        if op == "contains":
            return rec & F.contains(a, b)
        if op == "matches":
            return rec & v.rlike(java_pattern(self.value, self.case_sensitive))
        return rec & _compare(a, op, b)


def _compare(a: Column, op: str, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]


_SAFE = r"^[+-]?\d{1,18}(?:\.\d{1,18})?$"


def _number_condition(v: Column, op: str, value: str) -> Column:
    """Exact at any precision: numbers that fit a decimal are compared in the JVM, the rest by a sortable key."""
    fits = re.fullmatch(_SAFE, value.strip()) is not None
    key = _compare(decimal_key(v), op, F.lit(sort_key(value)))
    if not fits:
        return key
    return F.when(F.trim(v).rlike(_SAFE), _compare(F.trim(v).try_cast("decimal(38,18)"), op, F.lit(Decimal(value)).cast("decimal(38,18)"))).when(v.isNotNull(), key)


def sort_key(text: str | None) -> str | None:
    """Text whose byte order is the order of the numbers; None if it is no number. Exponents are unbounded."""
    m = re.fullmatch(r"\s*([+-]?)(\d*)(?:\.(\d*))?(?:[eE]([+-]?\d+))?\s*", text or "")
    if not m or not (m[2] or m[3]):
        return None
    digits, exponent = (m[2] or "") + (m[3] or ""), int(m[4] or 0) + len(m[2] or "")
    stripped = digits.lstrip("0")
    exponent -= len(digits) - len(stripped)
    stripped = stripped.rstrip("0")
    if not stripped:
        return "1"
    sign = exponent >= 0
    size = str(abs(exponent))
    scale = f"{len(size):05d}{size}"
    if not sign:
        scale = scale.translate(_NINES)
    body = ("1" if sign else "0") + scale + stripped
    return "2" + body if m[1] != "-" else "0" + body.translate(_NINES) + "~"


_NINES = str.maketrans("0123456789", "9876543210")


def decimal_key(v: Column) -> Column:
    return F.pandas_udf(lambda x: x.map(sort_key), "string")(v)


def field_values(lines: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """Adds one nullable column per field, read by an expression with one group."""
    cols = [F.when(F.col(text).rlike(p), F.regexp_extract(text, p, 1)).alias(n) for n, p in patterns.items()]
    return lines.select("*", *cols)


def suggest_values(df: DataFrame, name: str, prefix: str = "", rows: int = 50) -> DataFrame:
    """The commonest values that begin with a prefix (case folded): count descending, value ascending."""
    v = F.col(name)
    hit = df.filter(v.isNotNull() & F.startswith(F.lower(v), F.lit(prefix.lower())))
    return hit.groupBy(v.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(rows)


def completion_context(text: str) -> tuple[str, str, str]:
    """(what, field, typed): what is to be completed at the end of a half-typed query: field, operator or value."""
    m = re.match(r"\s*([A-Za-z_]\w*)?(\s*)(>=|<=|!=|=|>|<|contains\b|matches\b|exists\b|missing\b)?\s*(.*)$", text, re.S)
    name, gap, op, rest = m.groups()
    if op:
        return "value", name or "", rest
    return ("operator", name, rest) if name and gap else ("field", "", name or "")

