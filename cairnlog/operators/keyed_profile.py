"""Per-key results where a few keys hold most records.

Counts, sums and maxima are pre-aggregated per (key, value), which spreads a hot key over its values; exact
quantiles are then selected by refining value histograms: the values' ordered 64-bit codes are counted by one
base-256 digit at a time, each round keeps only the bucket that holds the wanted rank and counts only what lies in
it, and after the last digit the rank is resolved. No round gathers the values of a key; a key and quantile never
has more than 256 buckets in one. The keys that hold most rows are found by refining histograms of the keys alike.

Defined results: null keys form a group of their own; null values count as rows but not in sum, max or
quantiles, and a key with only null values has null there; repeated rows count as often as they occur; ties are
resolved by rank, so a quantile is always a value of the data (the least v with at least q of the values <= v);
an empty table gives no rows; columns other than key and value are ignored.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairnlog.session import broadcast_if_small, stage

_SIGN = -(1 << 63)


def value_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """(k, v, n): how often each value occurs under each key. Map-side combined; a hot key is spread by its values."""
    return df.select(F.col(key).alias("k"), F.col(value).cast("long").alias("v")).groupBy("k", "v").agg(F.count("*").alias("n"))


def _bucket(code: Column, digit: int) -> Column:
    return F.shiftrightunsigned(code, 8 * digit).bitwiseAND(F.lit(255))


def _above(code: Column, digit: int) -> Column:
    """The digits of a code above one."""
    return F.shiftrightunsigned(code, 8 * digit + 8) if digit < 7 else F.lit(0).cast("long")


def histogram(coded: DataFrame, state: DataFrame | None, digit: int) -> DataFrame:
    """(k, q, rank, top, bucket, m): counts by one digit, only of values below the prefixes that the state keeps.

    The state goes to the values before they are counted, so after the first round a (key, quantile) has at most
    256 buckets, and what a round shuffles is bounded by keys and quantiles.
    """
    bucket, top = _bucket(F.col("code"), digit).alias("bucket"), _above(F.col("code"), digit).alias("top")
    if state is None:
        return coded.groupBy("k", top, bucket).agg(F.sum("n").alias("m"))
    asked = state.select(F.col("k").alias("sk"), "q", "rank", "prefix")
    kept = coded.select("k", "n", top, bucket).join(asked, F.col("k").eqNullSafe(F.col("sk")) & (F.col("top") == F.col("prefix")))
    return kept.groupBy("k", "q", "rank", "top", "bucket").agg(F.sum("n").alias("m"))


def select_ranks(counts: DataFrame, quantiles: tuple[float, ...]) -> DataFrame:
    """(k, q, v): the exact quantiles of each key from (k, v, n), by iterated histogram refinement."""
    coded = counts.filter("v is not null").select("k", "n", F.col("v").bitwiseXOR(F.lit(_SIGN)).alias("code"))
    ends = counts.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    spark = counts.sparkSession
    if ends.lo is None:
        return spark.createDataFrame([], counts.select("k").schema.add("q", "double").add("v", "long"))
    differ = (ends.lo ^ ends.hi) & ((1 << 64) - 1)
    digits = max(1, (differ.bit_length() + 7) // 8)  # higher digits are the same in all values
    wanted = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("total") * F.lit(float(q)))).alias("rank")) for q in quantiles])).alias("w")
    state = None
    for d in reversed(range(digits)):
        hist = histogram(coded, state, d)
        if state is None:
            within = W.partitionBy("k")
            hist = hist.withColumn("total", F.sum("m").over(within)).select("k", "top", "bucket", "m", wanted).select("k", "w.q", "w.rank", "top", "bucket", "m")
        upto = F.sum("m").over(W.partitionBy("k", "q").orderBy("bucket"))
        hit = hist.withColumn("upto", upto).filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("m") < F.col("rank")))
        state = hit.select("k", "q", (F.col("rank") - F.col("upto") + F.col("m")).alias("rank"), (F.shiftleft("top", 8).bitwiseOR(F.col("bucket"))).alias("prefix"))
        if d:
            state = broadcast_if_small(stage(state, "ranks"))
    return state.select("k", "q", F.col("prefix").bitwiseXOR(F.lit(_SIGN)).alias("v"))


def heavy_keys(df: DataFrame, key: str, share: str = "0.02") -> DataFrame:
    """(k, rows): whole-number keys that hold at least `share` (a decimal) of all rows, by the same refinement.

    Here the histograms are of the keys themselves: a round counts rows by one more base-256 digit of the key, below
    the prefixes with enough rows alone. At most 1/share prefixes are kept, so a round's result has at most 256/share
    rows, the driver sees no more, and the counts of single keys are never shuffled.
    """
    codes = df.select(F.col(key).cast("long").bitwiseXOR(F.lit(_SIGN)).alias("code"))
    ends = df.agg(F.count("*").alias("n"), F.min(F.col(key).cast("long")).alias("lo"), F.max(F.col(key).cast("long")).alias("hi")).first()
    kind = "bigint" if df.schema[key].dataType.simpleString() == "bigint" else "int"
    spark = df.sparkSession
    if ends.lo is None:
        return spark.createDataFrame([], f"k {kind}, rows long")
    least = max(1, math.ceil(Decimal(share) * ends.n))
    digits = max(1, (((ends.lo ^ ends.hi) & ((1 << 64) - 1)).bit_length() + 7) // 8)
    kept: list[tuple[int, int]] = []
    for d in reversed(range(digits)):
        below = codes.filter("code is not null") if d == digits - 1 else codes.filter(_above(F.col("code"), d).isin([p for p, _ in kept]))
        counted = below.groupBy(F.shiftrightunsigned("code", 8 * d).alias("prefix")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
        kept = [(r.prefix, r.n) for r in counted.collect()]
        if not kept:
            break
    return spark.createDataFrame([(p ^ _SIGN, n) for p, n in kept], "k long, rows long").select(F.col("k").cast(kind).alias("k"), "rows")


def keyed_profile(df: DataFrame, key: str, value: str, quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(k, rows, total, largest, share, p<q>...) per key; share is of all rows of the table, null keys included."""
    counts = stage(value_counts(df, key, value), "value-counts")
    per_key = counts.groupBy("k").agg(F.sum("n").alias("rows"), F.sum(F.col("v") * F.col("n")).alias("total"), F.max("v").alias("largest"))
    all_rows = counts.agg(F.sum("n")).first()[0]
    out = per_key.withColumn("share", F.col("rows") / F.lit(all_rows))
    ranks = select_ranks(counts, quantiles).groupBy(F.col("k").alias("rk")).pivot("q", [float(q) for q in quantiles]).agg(F.first("v"))
    names = {str(float(q)): f"p{round(q * 100)}" for q in quantiles}
    for old, new in names.items():
        ranks = ranks.withColumnRenamed(old, new)
    return out.join(ranks, out["k"].eqNullSafe(ranks["rk"]), "left").drop("rk")
