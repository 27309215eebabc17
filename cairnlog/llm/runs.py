"""Repeated consecutive events in sequences, collapsed to one entry each with count and duration.

Boundary interval lookup: over a chunk of sequences the positions at which a run starts are gathered into a
sorted array, every event is assigned to its run by binary search in it, and the runs are aggregated.

Defined results: events of the blank id are skipped, they neither count nor end a run; a null event ends a run;
an id without pattern is like itself only; a sequence repeated under its id counts once; null or empty sequences
give no runs; a run whose events carry no time has a null duration; times that step back give a duration of at
least 0; columns other than those named are ignored; an empty table gives an empty result. If the times of a
sequence are fewer than its events, the missing ones are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlog.session import small

#: Catalogs up to this size travel to the workers; larger ones are joined.
CATALOG_LIMIT = 16 << 20
_RUN = "seq_id long, first_pos int, last_pos int, events int, event_class long, start_ts_ms long, duration_ms long"


def near_identical_form(pattern: Column) -> Column:
    """Equal for two patterns that differ only in placeholders, letter case or punctuation at the ends of words."""
    p = F.lower(F.regexp_replace(F.trim(pattern), r"<[^<>\s]*>", "\u0001"))
    words = F.transform(F.split(p, r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}\u0001]+|[^\p{L}\p{N}\u0001]+$", ""))
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def classes_of(catalog: DataFrame) -> DataFrame:
    """(id, cls): near-identical templates share a class, the least of their ids."""
    c = catalog.select(F.col("template_id").cast("long").alias("id"), near_identical_form(F.col("pattern")).alias("form")).filter("id is not null and form is not null")
    least = c.groupBy("form").agg(F.min("id").alias("cls"))
    return c.join(least, "form").groupBy("id").agg(F.min("cls").alias("cls"))


def runs_of_chunk(seq: np.ndarray, pos: np.ndarray, cls: np.ndarray, null: np.ndarray, blank: np.ndarray, ts: np.ndarray, ts_null: np.ndarray) -> dict[str, np.ndarray]:
    """All runs of a chunk of sequences laid end to end. seq: sequence number of each event."""
    breaks = np.cumsum(null)
    kept = np.flatnonzero(~null & ~blank)
    s, p, c, b, t, tn = seq[kept], pos[kept], cls[kept], breaks[kept], ts[kept], ts_null[kept]
    if not len(kept):
        return {k: np.array([], dtype=np.int64) for k in ("seq", "first", "last", "events", "cls", "start", "duration", "timed")}
    boundary = np.r_[True, (s[1:] != s[:-1]) | (c[1:] != c[:-1]) | (b[1:] != b[:-1])]
    starts = np.flatnonzero(boundary)
    run = np.searchsorted(starts, np.arange(len(kept)), side="right") - 1
    ends = np.r_[starts[1:], len(kept)] - 1
    timed = np.flatnonzero(~tn)
    at_run = run[timed]
    first_timed = np.searchsorted(at_run, np.arange(len(starts)), side="left")
    last_timed = np.searchsorted(at_run, np.arange(len(starts)), side="right") - 1
    has = last_timed >= first_timed
    clip = lambda i: np.clip(i, 0, max(0, len(timed) - 1))
    start = t[timed[clip(first_timed)]] if len(timed) else np.zeros(len(starts), dtype=np.int64)
    end = t[timed[clip(last_timed)]] if len(timed) else start
    return {"seq": s[starts], "first": p[starts], "last": p[ends], "events": ends - starts + 1, "cls": c[starts], "start": start, "duration": np.maximum(end - start, 0), "timed": has}


def _flat(a: pa.Array, kind: pa.DataType) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """values, nulls and lengths of a list column whose null lists count as empty."""
    lengths = np.array([0 if n is None else n for n in pc.list_value_length(a).to_pylist()], dtype=np.int64)
    flat = a.flatten().cast(kind)
    return flat.fill_null(0).to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False), lengths


def _align(values: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The second list column brought to the lengths of the first."""
    if np.array_equal(lengths, to):
        return values, nulls
    v, n = np.zeros(to.sum(), dtype=np.int64), np.ones(to.sum(), dtype=bool)
    offset, target = np.r_[0, np.cumsum(lengths)], np.r_[0, np.cumsum(to)]
    for i in range(len(to)):
        k = min(lengths[i], to[i])
        v[target[i] : target[i] + k], n[target[i] : target[i] + k] = values[offset[i] : offset[i] + k], nulls[offset[i] : offset[i] + k]
    return v, n


def _chunks(batches: Iterator[pa.RecordBatch], ids: np.ndarray, cls: np.ndarray, blank_id: int, joined: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v, null, lengths = _flat(b.column("events"), pa.int64())
        t, tnull, tlen = _flat(b.column("times"), pa.int64())
        t, tnull = _align(t, tnull, tlen, lengths)
        n = len(lengths)
        seq = np.repeat(np.arange(n), lengths)
        pos = np.arange(len(seq)) - np.repeat(np.r_[0, np.cumsum(lengths)[:-1]], lengths)
        if joined:
            k, knull, klen = _flat(b.column("classes"), pa.int64())
            k, knull = _align(k, knull, klen, lengths)
            known, found = ~knull, k
        elif len(ids):
            at = np.minimum(np.searchsorted(ids, v), len(ids) - 1)
            known, found = ids[at] == v, cls[at]
        else:
            known, found = np.zeros(len(v), dtype=bool), v
        c = np.where(known, found * 2, v * 2 + 1)  # an unknown id never equals a class
        r = runs_of_chunk(seq, pos, c, null, (v == blank_id) & ~null, t, tnull)
        untimed = ~r["timed"].astype(bool)
        yield pa.RecordBatch.from_arrays(
            [b.column("seq_id").take(pa.array(r["seq"])), pa.array(r["first"], pa.int32()), pa.array(r["last"], pa.int32()), pa.array(r["events"], pa.int32()), pa.array(r["cls"] >> 1), pa.array(r["start"], mask=untimed), pa.array(r["duration"], mask=untimed)],
            names=[f.split()[0] for f in _RUN.split(", ")],
        )


def collapse_runs(sequences: DataFrame, catalog: DataFrame, seq_id: str = "sequence_id", events: str = "template_ids", times: str = "line_ts_ms", blank_id: int = 0) -> DataFrame:
    """Each run of identical or near-identical events as one row: places, count, class, start and duration.

    One pass over the sequences without a shuffle of them; only the finished runs are made distinct, for
    sequences delivered twice. event_class is the least template id of the run's class.
    """
    src = sequences.select(F.col(seq_id).cast("long").alias("seq_id"), F.col(events).cast("array<bigint>").alias("events"), F.col(times).cast("array<bigint>").alias("times"))
    classes = classes_of(catalog)
    if small(catalog, CATALOG_LIMIT):
        pairs = sorted((r.id, r.cls) for r in classes.collect())
        ids, cls = (np.array([p[i] for p in pairs], dtype=np.int64) for i in (0, 1))
        joined = False
    else:
        each = src.select("seq_id", F.posexplode("events").alias("pos", "id")).dropDuplicates(["seq_id", "pos"]).join(classes, "id")
        found = each.groupBy("seq_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "cls"))).alias("m"))
        src = src.join(found, "seq_id", "left").withColumn("classes", F.transform("events", lambda _, i: F.col("m")[i])).drop("m")
        ids, cls, joined = np.array([], dtype=np.int64), np.array([], dtype=np.int64), True
    return src.mapInArrow(lambda it: _chunks(it, ids, cls, blank_id, joined), _RUN).distinct()
