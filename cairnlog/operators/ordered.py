"""Ordered scans over one long log without a single-partition window.

Order keys are whole numbers. Rows are cut in blocks of the key; windows run inside blocks, and a small table with
one row per block carries what crosses the edges. Every function takes the columns that name the log (`part`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Keys per block.
BLOCK = 1 << 16


def with_block(df: DataFrame, order: str, block: int = BLOCK) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / block))


def number_rows(df: DataFrame, order: str, part: list[str], out: str = "position", block: int = BLOCK, tie: list[str] | None = None) -> DataFrame:
    """Adds the 0-based position of each row in its log by `order` (and `tie`)."""
    df = with_block(df, order, block)
    within = W.partitionBy(*part, "_block").orderBy(order, *(tie or []))
    sums = df.groupBy(*part, "_block").agg(F.count("*").alias("_n"))
    upto = W.partitionBy(*part).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(*part, "_block", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    df = df.withColumn("_in", F.row_number().over(within)).join(before, [*part, "_block"])
    return df.withColumn(out, F.col("_before") + F.col("_in") - 1).drop("_block", "_in", "_before")


def with_previous(df: DataFrame, order: str, part: list[str], columns: list[str], prefix: str = "prev_", block: int = BLOCK) -> DataFrame:
    """Adds the values that `columns` have in the row before, null in the first row of a log."""
    df = with_block(df, order, block)
    within = W.partitionBy(*part, "_block").orderBy(order)
    row = F.struct(F.col(order).alias("_o"), *columns)
    last = df.groupBy(*part, "_block").agg(F.max_by(row, F.col(order)).alias("_last"))
    last = last.select(*part, "_block", F.lag("_last").over(W.partitionBy(*part).orderBy("_block")).alias("_edge"))
    df = df.withColumn("_lag", F.lag(row).over(within)).join(last, [*part, "_block"]).withColumn("_p", F.coalesce("_lag", "_edge"))
    return df.select("*", *[F.col(f"_p.{c}").alias(f"{prefix}{c}") for c in columns]).drop("_block", "_lag", "_edge", "_p")


def carry(df: DataFrame, order: str, part: list[str], mark: str, out: str, block: int = BLOCK) -> DataFrame:
    """Adds the last non-null value of `mark` at or before each row."""
    df = with_block(df, order, block)
    within = W.partitionBy(*part, "_block").orderBy(order)
    ends = df.groupBy(*part, "_block").agg(F.max_by(F.col(mark), F.when(F.col(mark).isNotNull(), F.col(order))).alias("_end"))
    before = W.partitionBy(*part).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*part, "_block", F.last("_end", ignorenulls=True).over(before).alias("_edge"))
    df = df.withColumn("_own", F.last(mark, ignorenulls=True).over(within)).join(ends, [*part, "_block"])
    return df.withColumn(out, F.coalesce("_own", "_edge")).drop("_block", "_own", "_edge")


def running_sum(df: DataFrame, order: str, part: list[str], value: str, out: str, block: int = BLOCK) -> DataFrame:
    """Adds the sum of `value` up to and including each row."""
    df = with_block(df, order, block)
    within = W.partitionBy(*part, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    sums = df.groupBy(*part, "_block").agg(F.sum(value).alias("_n"))
    upto = W.partitionBy(*part).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(*part, "_block", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    df = df.withColumn("_in", F.sum(value).over(within)).join(before, [*part, "_block"])
    return df.withColumn(out, F.coalesce("_in", F.lit(0)) + F.col("_before")).drop("_block", "_in", "_before")
