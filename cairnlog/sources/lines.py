"""Text files and tables as numbered lines.

Lines end at line feeds only; trailing carriage returns are no part of a line; a final line feed begins no line;
an empty file has one blank line; bytes that are no UTF-8 become replacement characters. Line numbers count from 0.
"""

from __future__ import annotations

import os
import shutil
import stat
import tempfile
import zipfile
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairnlog.operators.ordered import number_rows
from cairnlog.session import table

_BOM = "﻿"


def line_text(raw: Column) -> Column:
    return F.regexp_replace(raw, r"\r+$", "")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, line_no, byte_start, byte_len, text) of the files under path, numbered per file.

    Rows are numbered inside each file split; the splits' counts, one small row each, give the offsets.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("mid")
    )
    size = (F.octet_length("value") + 1).alias("size")
    raw = raw.select("*", size)
    inside = W.partitionBy("doc_id", "split").orderBy("mid")
    sums = raw.groupBy("doc_id", "split").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    upto = W.partitionBy("doc_id").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("doc_id", "split", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n0"), F.coalesce(F.sum("bytes").over(upto), F.lit(0)).alias("b0"))
    rows = raw.withColumn("i", F.row_number().over(inside) - 1).withColumn("b", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).join(before, ["doc_id", "split"])
    text = line_text(F.call_function("make_valid_utf8", F.col("value")))
    rows = rows.select("doc_id", (F.col("n0") + F.col("i")).alias("line_no"), (F.col("b0") + F.col("b")).alias("byte_start"), F.octet_length("value").alias("byte_len"), text.alias("text"))
    blank = [(name, 0, 0, 0, "") for name in empty_files(spark, path)]
    return rows.unionByName(spark.createDataFrame(blank, rows.schema)) if blank else rows


def empty_files(spark: SparkSession, path: str) -> list[str]:
    """Files of size 0 under a path or pattern: Spark's scans leave them out."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in fs.globStatus(p) or []:
        files = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [f.getPath().toString() for f in files if f.isFile() and f.getLen() == 0]
    return found


def split_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, line_no, text): each text of a table as the lines of one document."""
    lines = F.split(F.col(text), "\n", -1)
    cut = F.when((F.size(lines) > 1) & (F.element_at(lines, -1) == ""), F.slice(lines, 1, F.greatest(F.lit(1), F.size(lines) - 1))).otherwise(lines)
    return df.select(F.col(key).alias("doc_id"), F.posexplode(cut).alias("pos", "raw")).select("doc_id", F.col("pos").cast("long").alias("line_no"), line_text(F.col("raw")).alias("text"))


def event_lines(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """The events table as one log: (doc_id, line_no, ts_ms, text, extra...)."""
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    text = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z "), level, F.lit(" user="), F.col("user_id").cast("string"), F.lit(" action="), F.col("event_type"), F.lit(" value="), F.round(F.col("value") * 100).cast("long").cast("string"), F.lit(" props="), F.col("props"))
    rows = e.select("event_id", F.lit("events").alias("doc_id"), F.unix_millis(ts).alias("ts_ms"), text.alias("text"), *extra)
    return number_rows(rows, "event_id", ["doc_id"], out="line_no").select("doc_id", "line_no", "ts_ms", "text", *extra)


#: Bytes of a growing file that one task reads.
CHUNK = 64 << 20


def read_range(spark: SparkSession, path: str, begin: int, end: int, first_line: int) -> DataFrame:
    """(doc_id, line_no, text) of the lines that begin in a byte range of a file; begin lies at the start of a line."""

    def read(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            for lo, hi in zip(pdf["lo"].tolist(), pdf["hi"].tolist()):
                with open(path, "rb") as f:
                    f.seek(max(0, lo - 1))
                    at = lo
                    if lo > begin and f.read(1) != b"\n":
                        at += len(f.readline())
                    f.seek(at)
                    rows = []
                    while at < hi and (raw := f.readline()):
                        rows.append((at, raw.rstrip(b"\n").rstrip(b"\r").decode("utf-8", "replace")))
                        at += len(raw)
                if rows:
                    yield pd.DataFrame(rows, columns=["byte_start", "text"])

    ranges = [(lo, min(lo + CHUNK, end)) for lo in range(begin, end, CHUNK)]
    rows = spark.createDataFrame(ranges, "lo long, hi long").repartition(max(1, len(ranges)), "lo").mapInPandas(read, "byte_start long, text string")
    numbered = number_rows(rows.withColumn("doc_id", F.lit(path)), "byte_start", ["doc_id"])
    return numbered.select("doc_id", (F.col("position") + first_line).alias("line_no"), "text")


def last_line_start(path: str, size: int) -> int:
    """Where the unfinished last line of a file begins; its size if every line is finished."""
    with open(path, "rb") as f:
        end = size
        while end > 0:
            begin = max(0, end - (1 << 16))
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return 0


@dataclass(frozen=True)
class FileState:
    size: int
    mtime_ns: int


def file_state(path: str) -> FileState:
    s = os.stat(path)
    return FileState(s.st_size, s.st_mtime_ns)


def file_change(before: FileState, path: str) -> str:
    """unchanged, appended, shrunk or modified (same size, other time)."""
    now = file_state(path)
    if now.size != before.size:
        return "appended" if now.size > before.size else "shrunk"
    return "unchanged" if now.mtime_ns == before.mtime_ns else "modified"


def extract_zip(path: str, into: str | None = None) -> list[str]:
    """Unpacks the regular files of an archive in a fresh folder; unsafe names or links refuse the whole archive."""
    target = tempfile.mkdtemp(prefix=os.path.basename(path) + ".", dir=into or os.path.dirname(os.path.abspath(path)))
    out = []
    try:
        with zipfile.ZipFile(path) as z:
            for info in z.infolist():
                name = info.filename
                if name.startswith("__MACOSX/") or os.path.basename(name) == ".DS_Store" or info.is_dir():
                    continue
                if name.startswith("/") or "\\" in name or ":" in name or ".." in name.split("/") or stat.S_ISLNK(info.external_attr >> 16):
                    raise ValueError(f"unsafe entry: {name}")
                out.append(z.extract(info, target))
        return out
    except BaseException:
        shutil.rmtree(target, ignore_errors=True)
        raise


def export_rows(lines: DataFrame, how: str = "full", message_start: str | None = None) -> DataFrame:
    """(line_no, row): full text, text without its header, or text after its 1-based line number."""
    row = {"full": F.col("text"), "numbered": F.concat((F.col("line_no") + 1).cast("string"), F.lit(": "), F.col("text"))}
    if how == "message":
        out = F.expr(f"substring(text, {message_start} + 1)")
    else:
        out = row[how]
    return lines.select("line_no", out.alias("row"))
