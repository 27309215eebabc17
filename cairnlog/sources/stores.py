"""Small JSON files beside a log: mined templates, presets, saved filters, custom time formats, sidecars."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import asdict
from typing import Any

from cairnlog.functions.families import custom_family
from cairnlog.operators.filters import FilterSpec
from cairnlog.operators.profiles import compile_advanced, compile_layout

SIDECAR_VERSION, STORE_VERSION, PRESET_VERSION = 4, 1, 1


def write_atomically(path: str, value: Any) -> None:
    folder = os.path.dirname(os.path.abspath(path))
    fd, part = tempfile.mkstemp(dir=folder, prefix=".part-")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False, indent=1)
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise


def _read(path: str, default: Any) -> Any:
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return default


def load_templates(path: str) -> list[tuple[int, list[str], int]]:
    """(id, tokens, count); ids are dense from 0 and id 0 is the blank line."""
    store = _read(path, {"schema_version": STORE_VERSION, "templates": [{"id": 0, "tokens": ["<EMPTY>"], "count": 0}]})
    if store.get("schema_version") != STORE_VERSION:
        raise ValueError("unknown store version")
    rows = sorted((t["id"], t["tokens"], t["count"]) for t in store["templates"])
    if [r[0] for r in rows] != list(range(len(rows))) or (rows and rows[0][1] != ["<EMPTY>"]):
        raise ValueError("template ids are not dense")
    return rows


def save_templates(path: str, rows: list[tuple[int, list[str], int]]) -> None:
    write_atomically(path, {"schema_version": STORE_VERSION, "templates": [{"id": i, "tokens": t, "count": c} for i, t, c in sorted(rows)]})


def load_presets(path: str) -> tuple[list[dict], list[str]]:
    """(valid presets, what was left out and why)."""
    data = _read(path, {"schema_version": PRESET_VERSION, "presets": []})
    if not isinstance(data, dict) or data.get("schema_version") != PRESET_VERSION:
        return [], ["unknown version"]
    good, bad, seen = [], [], set()
    for p in data.get("presets", []):
        try:
            if p["id"] in seen:
                raise ValueError("id repeats")
            (compile_advanced if p.get("advanced") else compile_layout)(p["layout"])
            seen.add(p["id"])
            good.append(p)
        except (KeyError, TypeError, ValueError) as e:
            bad.append(f"{p.get('id') if isinstance(p, dict) else p}: {e}")
    return good, bad


def save_presets(path: str, presets: list[dict]) -> None:
    if len({p["id"] for p in presets}) != len(presets):
        raise ValueError("id repeats")
    write_atomically(path, {"schema_version": PRESET_VERSION, "presets": presets})


def save_filters(path: str, specs: list[FilterSpec]) -> None:
    write_atomically(path, {"filters": [{k: v for k, v in asdict(s).items() if k != "field_query"} for s in specs]})


def load_filters(path: str) -> list[FilterSpec]:
    return [FilterSpec(**f) for f in _read(path, {"filters": []})["filters"]]


def load_time_formats(path: str) -> list:
    return [custom_family(f["name"], f["regex"]) for f in _read(path, [])]


def source_identity(path: str) -> dict:
    s = os.stat(path)
    return {"canonical_path": os.path.realpath(path), "file_size": s.st_size, "mtime_unix_nanos": s.st_mtime_ns}


def save_sidecar(log: str, state: dict) -> str:
    path = log + ".cairn.json"
    write_atomically(path, {"schema_version": SIDECAR_VERSION, "source": source_identity(log)} | state)
    return path


def load_sidecar(log: str) -> tuple[dict, str] | None:
    """(state, exact or changed), None without a sidecar of the current version."""
    state = _read(log + ".cairn.json", None)
    if not state or state.get("schema_version") != SIDECAR_VERSION:
        return None
    return state, "exact" if state.get("source") == source_identity(log) else "changed"
