"""Lines to records: a header line opens a record, the lines up to the next header continue it.

A record's time is its header's; a header without usable time resets what its lines inherit. Lines before the
first header belong to no record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairnlog.operators.ordered import BLOCK, carry, running_sum


def record_state(lines: DataFrame, part: list[str], order: str = "line_no", block: int = BLOCK) -> DataFrame:
    """lines with is_header, header_ms, header_state ('explicit', 'missing', 'invalid') -> adds record_id,
    owner_line, owner_ms and provenance (explicit, inherited, missing, invalid, unknown)."""
    mark = F.when(F.col("is_header"), F.struct(F.col(order).alias("line"), F.col("header_ms").alias("ms"), F.col("header_state").alias("state")))
    df = carry(lines.withColumn("_mark", mark), order, part, "_mark", "_owner", block)
    df = running_sum(df.withColumn("_one", F.col("is_header").cast("long")), order, part, "_one", "_count", block)
    provenance = F.when(F.col("is_header"), F.col("header_state")).when(F.col("_owner.state") == "explicit", "inherited").otherwise("unknown")
    return df.select("*", F.when(F.col("_count") > 0, F.col("_count") - 1).alias("record_id"), F.col("_owner.line").alias("owner_line"), F.col("_owner.ms").alias("owner_ms"), provenance.alias("provenance")).drop("_mark", "_owner", "_one", "_count")


def records(state: DataFrame, part: list[str], order: str = "line_no", text: str = "text", piece: int | None = None) -> DataFrame:
    """One row per record: lines it spans, its time, and its text joined by line feeds.

    piece: a row holds so many lines at most, counted from the record's first; a longer record has several rows,
    which first_line tells apart, so a log with one header is never one row.
    """
    owned = state.filter("record_id is not null")
    if piece is not None:
        owned = owned.withColumn("_piece", F.floor((F.col(order) - F.col("owner_line")) / piece))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")
    keys = [*part, "record_id", *(["_piece"] if piece is not None else [])]
    return owned.groupBy(*keys).agg(F.min(order).alias("first_line"), F.max(order).alias("last_line"), F.count("*").alias("n_lines"), F.max("owner_ms").alias("ts_ms"), joined.alias("message")).drop("_piece")


def count_records(state: DataFrame, part: list[str], lo: int, hi: int, order: str = "line_no") -> DataFrame:
    """Records that begin in the half-open line range."""
    return state.filter(F.col("is_header") & (F.col(order) >= lo) & (F.col(order) < hi)).groupBy(*part).agg(F.count("*").alias("records"))


def match_rate(state: DataFrame, part: list[str]) -> DataFrame:
    return state.groupBy(*part).agg(F.count_if("is_header").alias("records"), F.count("*").alias("lines"))


def invalid_times(state: DataFrame, part: list[str], order: str = "line_no", shown: int = 64) -> DataFrame:
    """Headers with an impossible time: how many, and the first `shown` of their lines.

    The first lines are found per block of lines before they meet, so no log's headers are gathered.
    """
    bad = state.filter("provenance = 'invalid'").select(*part, F.col(order).alias("_o"), F.floor(F.col(order) / BLOCK).alias("_b"))
    counts = bad.groupBy(*part).agg(F.count("*").alias("invalid"))
    first = bad.withColumn("_r", F.row_number().over(W.partitionBy(*part, "_b").orderBy("_o"))).filter(F.col("_r") <= shown)
    first = first.withColumn("_r", F.row_number().over(W.partitionBy(*part).orderBy("_o"))).filter(F.col("_r") <= shown)
    return counts.join(first.groupBy(*part).agg(F.array_sort(F.collect_list("_o")).alias("first_lines")), part)
