"""A growing file as a stream, and streaming forms of the line operators.

Only lines that end in a line feed are given out, so a partial last line never has to be taken back; a file that
shrank or changed in place fails the stream. Disordered clocks are valid data: nothing is dropped as late.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairnlog.operators.filters import FilterSpec, combined

CHUNK = 64 << 20


class _Range(InputPartition):
    def __init__(self, path: str, lo: int, hi: int) -> None:
        self.path, self.lo, self.hi = path, lo, hi


class TailReader(DataSourceStreamReader):
    """Offsets are byte positions behind a line feed; a batch's byte range is read in chunks by the executors."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.flush = options["path"], options.get("flush", "false").lower() == "true"
        self.last: tuple[int, int] | None = None

    def initialOffset(self) -> dict:
        return {"bytes": 0, "size": 0}

    def latestOffset(self) -> dict:
        s = os.stat(self.path)
        if self.last is not None:
            size, mtime = self.last
            if s.st_size < size:
                raise ValueError(f"{self.path} shrank")
            if s.st_size == size and s.st_mtime_ns != mtime:
                raise ValueError(f"{self.path} changed in place")
        self.last = (s.st_size, s.st_mtime_ns)
        return {"bytes": s.st_size if self.flush else self._behind_last_feed(s.st_size), "size": s.st_size}

    def _behind_last_feed(self, size: int) -> int:
        with open(self.path, "rb") as f:
            end = size
            while end > 0:
                begin = max(0, end - (1 << 16))
                f.seek(begin)
                at = f.read(end - begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                end = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        lo, hi = start["bytes"], end["bytes"]
        if hi < lo:
            raise ValueError(f"{self.path} shrank")
        return [_Range(self.path, a, min(a + CHUNK, hi)) for a in range(lo, hi, CHUNK)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        """The lines that begin inside the range."""
        with open(partition.path, "rb") as f:
            at = partition.lo
            if at:
                f.seek(at - 1)
                if f.read(1) != b"\n":
                    at += len(f.readline())
            f.seek(at)
            while at < partition.hi:
                raw = f.readline()
                if not raw:
                    break
                yield partition.path, at, raw.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(raw)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """spark.dataSource.register(TailSource); readStream.format("cairn_tail").option("path", p)."""

    @classmethod
    def name(cls) -> str:
        return "cairn_tail"

    def schema(self) -> str:
        return "doc_id string, byte_start bigint, text string"

    def streamReader(self, schema) -> TailReader:  # noqa: ANN001
        return TailReader(self.options)


def tail(spark: SparkSession, path: str, flush: bool = False) -> DataFrame:
    spark.dataSource.register(TailSource)
    return spark.readStream.format("cairn_tail").option("path", path).option("flush", str(flush).lower()).load()


def filtered(lines: DataFrame, specs: list[FilterSpec], join: str = "any") -> DataFrame:
    """Stateless, append mode: each new line is tested once."""
    return lines.filter(combined(specs, join))


def time_counts(lines: DataFrame, width_ms: int) -> DataFrame:
    """Lines per time bucket, kept up to date as lines arrive (update or complete mode)."""
    return lines.filter("ts_ms is not null").groupBy(F.floor(F.col("ts_ms") / width_ms).alias("bucket")).agg(F.count("*").alias("n"))


def record_states(lines: DataFrame) -> DataFrame:
    """lines (doc_id, byte_start, text, is_header, header_ms, header_state) -> owner and provenance, continued over batches.

    The state of a document is its open record; a batch's lines are put in byte order before they are classified.
    """

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        owner, known, ms = state.get if state.exists else (-1, False, -1)
        pdf = pd.concat(list(chunks)).sort_values("byte_start", kind="stable")
        rows = []
        for at, header, hms, hstate in zip(pdf["byte_start"], pdf["is_header"], pdf["header_ms"], pdf["header_state"]):
            if header:
                owner, known = int(at), hstate == "explicit"
                ms = int(hms) if known else -1
                rows.append((key[0], at, owner, ms if known else None, hstate))
            else:
                rows.append((key[0], at, owner if owner >= 0 else None, ms if known else None, "inherited" if known else "unknown"))
        state.update((owner, known, ms))
        yield pd.DataFrame(rows, columns=["doc_id", "byte_start", "owner", "owner_ms", "provenance"]).astype({"owner": "Int64", "owner_ms": "Int64"})

    return lines.groupBy("doc_id").applyInPandasWithState(run, "doc_id string, byte_start long, owner long, owner_ms long, provenance string", "owner long, known boolean, ms long", "append", GroupStateTimeout.NoTimeout)
