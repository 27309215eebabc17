"""Schemas that drift between records: one layout out of many, and a report of every change.

Bodies are JSON objects saved in unlike layouts. Columns are profiled over all bodies (types and a sketch of
value shapes per name), the names of each distinct layout version are matched to the fields that version lacks
by an optimal one-to-one assignment over name similarity, type fit and sketch similarity, and the matched
columns are unified.

Defined results: a null, empty, truncated or non-object body gives no row; a JSON null counts as present; a
repeated record_id is reported once; other columns of the input are ignored, whatever their names; an empty
table gives empty results. A filter list that isn't an array has no filter-level changes.
"""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairnlog.session import broadcast_if_small, stage

#: Value shapes in the sketch of a name: its commonest ones.
SKETCH = 256


@dataclass(frozen=True)
class Layout:
    """The layout to reach: field -> allowed JSON types, at the top and in the objects of one nested array."""

    top: dict[str, frozenset[str]]
    nested: dict[str, frozenset[str]]
    nested_field: str


def _types(**kw: str) -> dict[str, frozenset[str]]:
    return {k: frozenset(v.split("|")) for k, v in kw.items()}


CURRENT = Layout(
    top=_types(schema_version="integer", source="object", filters="array", everything_else_active="boolean", selected_filter="string|null", show_templates="boolean", log_font_size="integer|number", timeline_display_mode="string", pins="array"),
    nested=_types(text="string", active="boolean", case_sensitive="boolean", exclude="boolean", regex="boolean", template_id="integer|null", field_query="object|null"),
    nested_field="filters",
)

#: Weights of name, type and sketch similarity, and the least score at which two columns are one.
W_NAME, W_TYPE, W_SKETCH, MIN_SCORE = 0.5, 0.15, 0.35, 0.3

_FACTS = "record_id long, scope string, sig string, item int, fields array<struct<name:string,type:string,shape:string>>"


def json_type(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "integer"
    return {float: "number", str: "string", list: "array", dict: "object"}[type(v)]


def value_shape(v: object) -> str:
    """A coarse, bounded sketch of one value: magnitude of numbers, character classes of strings, keys of objects."""
    t = json_type(v)
    if t in ("integer", "number"):
        return f"{t}:{min(18, int(math.log10(abs(v) + 1)))}" if math.isfinite(v) else t
    if t == "string":
        mask = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"\d+", "9", v)))
        return f"string:{mask[:8]}"
    if t == "array":
        return f"array:{json_type(v[0]) if v else ''}"
    if t == "object":
        return "object:" + ",".join(sorted(map(str, v))[:4])[:40]
    return t


def _no_constant(name: str) -> None:
    raise ValueError(name)


def parse_body(body: str | None) -> dict | None:
    """The object a body holds, or None unless it is one complete JSON object."""
    if not body:
        return None
    try:
        value = json.loads(body, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def nested_items(obj: dict, layout: Layout) -> list[dict]:
    """The objects of the nested array, found by its name or by the fields its objects carry."""
    found = obj.get(layout.nested_field)
    if layout.nested_field not in obj:
        found = next((v for v in obj.values() if isinstance(v, list) and any(isinstance(x, dict) and len(x.keys() & layout.nested.keys()) >= 2 for x in v)), None)
    return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else []


def _facts(layout: Layout):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rid, body in zip(pdf["record_id"], pdf["body"]):
                obj = parse_body(body)
                if obj is None:
                    continue
                for i, (scope, item) in enumerate([("top", obj), *(("nested", x) for x in nested_items(obj, layout))]):
                    names = sorted(item)
                    out.append((rid, scope, "\x1f".join(names), i, [{"name": n, "type": json_type(item[n]), "shape": value_shape(item[n])} for n in names]))
            yield pd.DataFrame(out, columns=["record_id", "scope", "sig", "item", "fields"])

    return run


def name_tokens(name: str) -> list[str]:
    return [t for t in re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower().replace("-", "_").split("_") if t]


def name_similarity(a: str, b: str) -> float:
    """1 for equal names up to case style; else shared words and shared characters."""
    x, y = name_tokens(a), name_tokens(b)
    if x == y:
        return 1.0
    shared = len(set(x) & set(y))
    words = shared / max(1, min(len(set(x)), len(set(y)))) * 0.9 if shared else 0.0
    characters = SequenceMatcher(None, "".join(x), "".join(y))
    # beyond 256 characters the order of the characters is left out of account: linear time
    return max(words, (characters.ratio() if max(len(a), len(b)) <= 256 else characters.quick_ratio()) * 0.6)


def sketch_similarity(a: dict[str, float], b: dict[str, float]) -> float:
    """Cosine of two shape histograms; nulls say nothing."""
    a, b = ({k: v for k, v in x.items() if k != "null"} for x in (a, b))
    dot = sum(v * b.get(k, 0) for k, v in a.items())
    norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    return dot / norm if norm else 0.0


def assign(score: list[list[float]]) -> list[int]:
    """Optimal one-to-one assignment (Hungarian method): for each row the column, -1 if none is left."""
    n, m = len(score), len(score[0]) if score else 0
    if not n or not m:
        return [-1] * n
    k = max(n, m)
    cost = [[-(score[i][j] if i < n and j < m else 0.0) for j in range(k)] for i in range(k)]
    u, v, match = [0.0] * (k + 1), [0.0] * (k + 1), [0] * (k + 1)
    for i in range(1, k + 1):
        match[0], j0, best, used, way = i, 0, [math.inf] * (k + 1), [False] * (k + 1), [0] * (k + 1)
        while True:
            used[j0], i0, delta, j1 = True, match[j0], math.inf, 0
            for j in range(1, k + 1):
                if not used[j]:
                    cur = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if cur < best[j]:
                        best[j], way[j] = cur, j0
                    if best[j] < delta:
                        delta, j1 = best[j], j
            for j in range(k + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    best[j] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [-1] * n
    for j in range(1, k + 1):
        if match[j] and match[j] <= n and j <= m:
            out[match[j] - 1] = j - 1
    return out


def match_version(extras: dict[str, dict[str, float]], lacking: dict[str, dict[str, float]], allowed: dict[str, frozenset[str]]) -> dict[str, str]:
    """extras, lacking: name -> shape histogram. Which extra name stands for which lacking field."""
    names, fields = sorted(extras), sorted(lacking)
    score = []
    for n in names:
        row, total = [], sum(v for k, v in extras[n].items() if k != "null") or 1.0
        for f in fields:
            fit = sum(v for k, v in extras[n].items() if k != "null" and k.split(":")[0] in allowed[f]) / total
            row.append(W_NAME * name_similarity(n, f) + W_TYPE * fit + W_SKETCH * sketch_similarity(extras[n], lacking[f]))
        score.append([s if s >= MIN_SCORE else 0.0 for s in row])
    return {names[i]: fields[j] for i, j in enumerate(assign(score)) if j >= 0 and score[i][j] > 0}


def _match(layout: Layout):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        scope, sig = pdf["scope"].iloc[0], pdf["sig"].iloc[0]
        allowed = layout.top if scope == "top" else layout.nested
        extras: dict[str, dict[str, float]] = defaultdict(dict)
        lacking: dict[str, dict[str, float]] = defaultdict(dict)
        for name, role, sketch in zip(pdf["name"], pdf["role"], pdf["sketch"]):
            into = extras if role == "extra" else lacking
            into[name] = {x["shape"]: float(x["n"]) for x in sketch} if sketch is not None else {}
        pairs = match_version(extras, lacking, allowed)
        rows = [(scope, sig, n, f) for n, f in pairs.items()]
        return pd.DataFrame(rows, columns=["scope", "sig", "name", "field"])

    return run


def facts_of(df: DataFrame, key: str, body: str, layout: Layout = CURRENT) -> DataFrame:
    """One row per object: its scope, its sorted names as version signature, and name, type and shape of each field."""
    src = df.select(F.col(key).cast("long").alias("record_id"), F.col(body).cast("string").alias("body"))
    return src.mapInPandas(_facts(layout), _FACTS)


def _layout_rows(layout: Layout, scope: str) -> list[str]:
    return list(layout.top if scope == "top" else layout.nested)


def _fields_of_scope(layout: Layout) -> Column:
    return F.when(F.col("scope") == "top", F.array(*map(F.lit, layout.top))).otherwise(F.array(*map(F.lit, layout.nested)))


def version_mapping(facts: DataFrame, layout: Layout = CURRENT) -> DataFrame:
    """(scope, sig, renames map<name, field>) for each version in which a name stands for a field of the layout.

    Profiles and versions are aggregates over all objects; their number depends on the distinct names and layouts,
    not on the rows, and one group of the matcher holds the names of a single version.
    """
    profile = (
        facts.select("scope", F.explode("fields").alias("f"))
        .groupBy("scope", "f.name", "f.shape").agg(F.count("*").alias("n"))
        .withColumn("place", F.row_number().over(W.partitionBy("scope", "name").orderBy(F.desc("n"), "shape"))).filter(F.col("place") <= SKETCH)
        .groupBy("scope", "name").agg(F.collect_list(F.struct("shape", "n")).alias("sketch"))
    )
    versions = facts.groupBy("scope", "sig").agg(F.first(F.col("fields.name")).alias("names"))
    known = _fields_of_scope(layout)
    open_versions = versions.select("scope", "sig", F.array_except("names", known).alias("extra"), F.array_except(known, "names").alias("lacking")).filter((F.size("extra") > 0) & (F.size("lacking") > 0))
    roles = F.concat(
        F.transform("extra", lambda x: F.struct(x.alias("name"), F.lit("extra").alias("role"))),
        F.transform("lacking", lambda x: F.struct(x.alias("name"), F.lit("lacking").alias("role"))),
    )
    asked = open_versions.select("scope", "sig", F.inline(roles)).join(profile, ["scope", "name"], "left")
    pairs = asked.groupBy("scope", "sig").applyInPandas(_match(layout), "scope string, sig string, name string, field string")
    return pairs.groupBy("scope", "sig").agg(F.map_from_entries(F.collect_list(F.struct("name", "field"))).alias("renames"))


def _mapped(df: DataFrame, key: str, body: str, layout: Layout) -> DataFrame:
    facts = stage(facts_of(df, key, body, layout), "drift-facts")
    mapping = stage(version_mapping(facts, layout), "drift-map")  # its size is known once it is written
    none = F.create_map().cast("map<string,string>")
    return facts.join(broadcast_if_small(mapping), ["scope", "sig"], "left").withColumn("renames", F.coalesce("renames", none))


def schema_changes(df: DataFrame, key: str = "sidecar_id", body: str = "body", layout: Layout = CURRENT) -> DataFrame:
    """(record_id, field, kind) of every difference between a body and the layout, once per record."""
    m = _mapped(df, key, body, layout)
    nested = F.col("scope") == "nested"
    prefix = F.when(nested, F.lit(f"{layout.nested_field}.")).otherwise(F.lit(""))
    known = _fields_of_scope(layout)
    allowed = F.create_map(*[F.lit(x) for scope, fs in (("top", layout.top), ("nested", layout.nested)) for f, ts in fs.items() for x in (f"{scope}.{f}", "|".join(sorted(ts)))])
    f = F.col("f")
    target = F.coalesce(F.col("renames")[f["name"]], F.when(F.array_contains("known", f["name"]), f["name"]))
    each = m.withColumn("known", known).select("record_id", "scope", prefix.alias("prefix"), "known", "renames", F.explode("fields").alias("f")).withColumn("target", target)
    types = F.split(allowed[F.concat_ws(".", "scope", "target")], r"\|")
    kinds = F.array_compact(F.array(
        F.when(F.col("target").isNull(), F.lit("added")),
        F.when(F.col("target") != f["name"], F.lit("renamed")),
        F.when(F.col("target").isNotNull() & ~F.array_contains(types, f["type"]), F.lit("retyped")),
    ))
    seen = each.select("record_id", F.concat("prefix", F.coalesce("target", f["name"])).alias("field"), F.explode(kinds).alias("kind"))
    gone = m.select("record_id", prefix.alias("prefix"), F.explode(F.array_except(F.array_except(known, F.col("fields.name")), F.map_values("renames"))).alias("name"))
    removed = gone.select("record_id", F.concat("prefix", "name").alias("field"), F.lit("removed").alias("kind"))
    return seen.unionByName(removed).distinct()


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("field", "kind").agg(F.count("*").alias("records"))


def _bool(v: object) -> bool | None:
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return bool(v)
    return {"yes": True, "true": True, "on": True, "no": False, "false": False, "off": False}.get(str(v).strip().lower()) if isinstance(v, str) else None


def _int(v: object) -> int | None:
    """The integer a value of another type stands for: "T{42}", "5.1", 7.0, {"major": 4}, {"id": 3}, [9]."""
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, (int, float)):
        return int(v) if math.isfinite(v) else None
    if isinstance(v, str):
        m = re.search(r"-?\d+", v)
        return int(m[0]) if m and len(m[0]) < 21 and -(2**63) <= int(m[0]) < 2**63 else None
    if isinstance(v, dict):
        return next((_int(v[k]) for k in ("id", "major", "value") if k in v), None)
    return _int(v[0]) if isinstance(v, list) and v else None


def _number(v: object) -> float | None:
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, (int, float)):
        return float(v)
    m = re.search(r"-?\d+(?:\.\d+)?", v) if isinstance(v, str) else None
    return float(m[0]) if m else None


def _text(v: object) -> str | None:
    return v if isinstance(v, str) or v is None else json.dumps(v, sort_keys=True)


def _json(v: object) -> str | None:
    return None if v is None else json.dumps(v, sort_keys=True)


_COERCE = {"integer": _int, "number": _number, "boolean": _bool, "string": _text, "object": _json, "array": _json}


def _coerce(v: object, allowed: frozenset[str]) -> object:
    return _COERCE[next(t for t in ("number", "integer", "boolean", "string", "object", "array") if t in allowed)](v)


_SQL = {"integer": "bigint", "number": "double", "boolean": "boolean", "string": "string", "object": "string", "array": "string"}


def _sql_fields(fields: dict[str, frozenset[str]]) -> list[tuple[str, str]]:
    return [(f, _SQL[next(t for t in ("number", "integer", "boolean", "string", "object", "array") if t in ts)]) for f, ts in fields.items()]


def unify(df: DataFrame, key: str = "sidecar_id", body: str = "body", layout: Layout = CURRENT) -> DataFrame:
    """One row per record in the layout: every field under its own name and type, nested objects as an array of structs.

    Objects and arrays below that depth are canonical JSON text; a value that can't be read in the stated type is null.
    """
    m = _mapped(df, key, body, layout).select("record_id", "item", "renames")
    names = m.groupBy("record_id").agg(F.array_sort(F.collect_set(F.struct("item", F.map_entries("renames").alias("r")))).alias("maps"))
    src = df.select(F.col(key).cast("long").alias("record_id"), F.col(body).cast("string").alias("body")).groupBy("record_id").agg(F.max("body").alias("body"))
    top = [(f, t) for f, t in _sql_fields(layout.top) if f != layout.nested_field]
    nested = ",".join(f"{f}:{t}" for f, t in _sql_fields(layout.nested))
    schema = "record_id long, " + ", ".join(f"{f} {t}" for f, t in top) + f", {layout.nested_field} array<struct<{nested}>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def current(item: dict, renames: dict, fields: dict) -> dict:
            back = {f: n for n, f in renames.items()}
            return {f: _coerce(item.get(back.get(f, f)), ts) for f, ts in fields.items() if f != layout.nested_field}

        for pdf in batches:
            out = []
            for rid, text, maps in zip(pdf["record_id"], pdf["body"], pdf["maps"]):
                obj = parse_body(text)
                if obj is None:
                    continue
                by = {x["item"]: {e["key"]: e["value"] for e in x["r"]} for x in maps}
                row = {"record_id": rid} | current(obj, by.get(0, {}), layout.top)
                row[layout.nested_field] = [current(x, by.get(i, {}), layout.nested) for i, x in enumerate(nested_items(obj, layout), 1)]
                out.append(row)
            yield pd.DataFrame(out, columns=["record_id", *(f for f, _ in top), layout.nested_field]).astype({f: "Int64" for f, t in top if t == "bigint"})

    return src.join(names, "record_id").mapInPandas(run, schema)
