"""Aggregates over lines: timelines, histograms, summaries, gaps, anomalies, runs, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlog.operators.ordered import BLOCK, number_rows, running_sum, with_previous

ERROR_WORDS = ("error", "fatal", "exception", "panic")


def bucket_of(value: Column, start: Column | int, span: Column | int, buckets: int) -> Column:
    """Whole-number bucket; the last one holds only the greatest value."""
    start, span = (F.lit(x) if isinstance(x, int) else x for x in (start, span))
    clamped = F.least(F.greatest(value - start, F.lit(0)), span)
    return _div(clamped * (buckets - 1), span)


def _div(a: Column, b: Column) -> Column:
    return F.floor((a - a % b) / b).cast("long")


def extent(df: DataFrame, axis: str) -> tuple[int, int] | None:
    r = df.agg(F.min(axis).alias("lo"), F.max(axis).alias("hi")).first()
    return None if r.lo is None else (r.lo, r.hi)


def histogram(df: DataFrame, axis: str, buckets: int = 50, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """(bucket, x, n) for every bucket: n lines whose value falls in it, x its place on the axis."""
    buckets = max(16, min(buckets, 1024))
    if lo is None or hi is None:
        found = extent(df, axis)
        if found is None:
            return df.sparkSession.createDataFrame([], "bucket long, x long, n long")
        lo, hi = found
    span = max(hi - lo, 1)
    counts = df.filter(F.col(axis).isNotNull()).groupBy(bucket_of(F.col(axis), lo, span, buckets).alias("bucket")).agg(F.count("*").alias("n"))
    bins = df.sparkSession.range(buckets).select(F.col("id").alias("bucket"), (F.lit(lo) + _div(F.lit(span) * F.col("id"), F.lit(buckets - 1))).alias("x"))
    return bins.join(counts, "bucket", "left").select("bucket", "x", F.coalesce("n", F.lit(0)).alias("n"))


def density(df: DataFrame, units: int, bins: int, axis: str = "line_no") -> DataFrame:
    """(bin, n): counts in the exact half-open bins [units*b/bins, units*(b+1)/bins)."""
    v = F.col(axis)
    b = _div((v + 1) * bins - 1, F.lit(units))  # the greatest b with units*b/bins <= v
    counts = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def lane_bins(laned: DataFrame, lane: str, columns: int, lo: int, hi: int, axis: str = "line_no") -> DataFrame:
    """Occupied columns of a lane: count, first and last place and line, and the sole line where there is one."""
    v = F.col(axis)
    hit = laned.filter(F.col(lane) & v.between(lo, hi))
    col = _div((v - lo) * (columns - 1), F.lit(max(hi - lo, 1)))
    n = F.count("*")
    return hit.groupBy(col.alias("column")).agg(n.alias("n"), F.min(axis).alias("first_x"), F.max(axis).alias("last_x"), F.min_by("line_no", axis).alias("first_line"), F.max_by("line_no", axis).alias("last_line"), F.when(n == 1, F.min("line_no")).alias("sole_line"))


def lane_counts(laned: DataFrame, lanes: list[str], axis: str, buckets: int, lo: int, hi: int) -> DataFrame:
    """(bucket, lane, n) of the occupied buckets of all lanes in one pass."""
    b = bucket_of(F.col(axis), lo, max(hi - lo, 1), buckets)
    wide = laned.groupBy(b.alias("bucket")).agg(*[F.count_if(c).alias(c) for c in lanes])
    pairs = F.array(*[F.struct(F.lit(c).alias("lane"), F.col(c).alias("n")) for c in lanes])
    return wide.select("bucket", F.inline(pairs)).filter("n > 0")


def template_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("template_id").agg(F.count("*").alias("n"))


def template_dictionary(templates: DataFrame, lines: DataFrame) -> DataFrame:
    """Every template with its count in the selection; templates without lines stay with 0."""
    return templates.join(template_counts(lines).withColumnRenamed("n", "seen"), "template_id", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))


def top_templates(lines: DataFrame, k: int = 5) -> DataFrame:
    return template_counts(lines).orderBy(F.desc("n"), "template_id").limit(k)


def error_templates(templates: DataFrame, lines: DataFrame, k: int = 20) -> DataFrame:
    low = F.lower("pattern")
    errs = templates.filter(F.greatest(*[F.contains(low, F.lit(w)).cast("int") for w in ERROR_WORDS]) == 1)
    return errs.join(template_counts(lines), "template_id").orderBy(F.desc("n"), "template_id").limit(k)


def time_gaps(lines: DataFrame, part: list[str], k: int = 3, block: int = BLOCK) -> DataFrame:
    """The largest positive gaps between consecutive selected lines of known time."""
    known = lines.filter("ts_ms is not null").select(*part, "line_no", "ts_ms")
    gaps = with_previous(known, "line_no", part, ["ts_ms"], block=block).select("line_no", "ts_ms", (F.col("ts_ms") - F.col("prev_ts_ms")).alias("gap_ms"))
    return gaps.filter("gap_ms > 0").orderBy(F.desc("gap_ms"), "line_no").limit(k)


def densest_minute(lines: DataFrame) -> DataFrame:
    """The tumbling 60 s window, counted from the first time, with most lines; the earliest of equals."""
    found = extent(lines, "ts_ms")
    if found is None:
        return lines.sparkSession.createDataFrame([], "window_start_ms long, n long")
    lo = found[0]
    w = lines.filter("ts_ms is not null").groupBy(_div(F.col("ts_ms") - lo, F.lit(60_000)).alias("w")).agg(F.count("*").alias("n"))
    return w.orderBy(F.desc("n"), "w").limit(1).select((F.col("w") * 60_000 + lo).alias("window_start_ms"), "n")


def stats(lines: DataFrame) -> DataFrame:
    """One row: lines, bytes of text, time range, distinct templates."""
    return lines.agg(F.count("*").alias("lines"), F.sum(F.octet_length("text")).alias("text_bytes"), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.countDistinct("template_id").alias("templates"))


def positions(lines: DataFrame, part: list[str], block: int = BLOCK) -> DataFrame:
    return number_rows(lines, "line_no", part, "position", block)


def anomalies(lines: DataFrame, part: list[str], total: int | None = None, block: int = BLOCK) -> DataFrame:
    """Rare, late and bursty templates: (template_id, n, first_line, reasons), most reasons first.

    Positions are counted in blocks; per template only fifty position buckets are kept, never its lines.
    """
    m = total if total is not None else lines.count()
    p = positions(lines, part, block)
    bucket = F.least(_div(F.col("position") * 50, F.lit(max(m, 1))), F.lit(49))
    per = p.groupBy("template_id", bucket.alias("b")).agg(F.count("*").alias("n"), F.min("position").alias("first_pos"), F.min("line_no").alias("first_line"))
    t = per.groupBy("template_id").agg(F.sum("n").alias("n"), F.max("n").alias("peak"), F.min("first_pos").alias("first_pos"), F.min("first_line").alias("first_line"))
    reasons = F.array_compact(F.array(
        F.when(F.col("n") <= max(m // 1000, 1), "rare"), F.when(F.col("first_pos") >= m * 9 // 10, "first_seen_late"), F.when((F.col("n") >= 10) & (F.col("peak") * 2 >= F.col("n")), "bursty"),
    ))
    return t.select("template_id", "n", "first_line", F.array_join(reasons, ",").alias("reasons"), F.size(reasons).alias("n_reasons")).filter("n_reasons > 0")


def template_browser(templates: DataFrame, lines: DataFrame, query: str = "") -> DataFrame:
    """Per template: lines, first and last line, and its pattern; optionally only patterns that hold a text."""
    seen = lines.groupBy("template_id").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))
    t = templates if not query else templates.filter(F.contains(F.lower("pattern"), F.lit(query.lower())))
    return t.join(seen, "template_id")


def run_lengths(lines: DataFrame, part: list[str], block: int = BLOCK) -> DataFrame:
    """Runs of equal templates among the selected lines: start, end, count, template, first and last time."""
    prev = with_previous(lines.select(*part, "line_no", "ts_ms", "template_id"), "line_no", part, ["template_id"], block=block)
    turn = (~F.col("template_id").eqNullSafe(F.col("prev_template_id")) | F.col("prev_template_id").isNull()).cast("long")
    numbered = running_sum(prev.withColumn("turn", turn), "line_no", part, "turn", "run", block)
    return numbered.groupBy(*part, "run").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.count("*").alias("n"), F.first("template_id").alias("template_id"), F.min_by("ts_ms", "line_no").alias("time_start"), F.max_by("ts_ms", "line_no").alias("time_end")).drop("run")


# Seed, factor and step of the sampler's 64-bit congruential generator.
_SEED, _FACTOR, _STEP = 0x9E3779B97F4A7C15, 6364136223846793005, 1442695040888963407


def sample_positions(n: int, k: int, strategy: str = "first_last_random") -> list[int]:
    """Which of n places to show: the first k, evenly spread, or both ends and seeded random ones between."""
    k = max(1, min(k, 10))
    if n <= k:
        return list(range(n))
    if strategy == "first":
        return list(range(k))
    even = [i * (n - 1) // (k - 1) for i in range(k)] if k > 1 else [0]
    if strategy == "even":
        return even
    picked, seed, mask = {0, n - 1} if k > 1 else {0}, _SEED ^ n, (1 << 64) - 1
    for _ in range(100):
        if len(picked) >= k:
            break
        seed = (seed * _FACTOR + _STEP) & mask
        picked.add((seed >> 33) % n)
    for i in even:
        if len(picked) >= k:
            break
        picked.add(i)
    return sorted(picked)


def samples(lines: DataFrame, part: list[str], k: int = 5, strategy: str = "first_last_random", block: int = BLOCK) -> DataFrame:
    """At most ten example lines; places depend only on the number of lines, so repeated calls agree."""
    n = lines.count()
    wanted = sample_positions(n, k, strategy)
    return positions(lines, part, block).filter(F.col("position").isin(wanted))


def merge_counts(base: DataFrame, added: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """Counts per key kept for a log so far, brought up to date with the counts of the lines appended since."""
    return base.select(*keys, value).unionByName(added.select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))


def density_tier(n: Column) -> Column:
    """small, medium or dense: how a viewer draws a bin of n matches."""
    return F.when(n >= 100, "dense").when(n >= 10, "medium").otherwise("small")
