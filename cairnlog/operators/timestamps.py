"""Mixed timestamp formats and time zones to one UTC instant per stamp.

Stamps become character-class masks (digits 9, letters a) in the JVM; each distinct mask is mapped to a parser
once per worker and its stamps are parsed together as arrays. Stamps with an own offset or zone, and numbers,
are instants at once. For the others the log decides: its zone (through versioned transition tables), its order
of day and month (shown by any of its stamps) and its reference year.

Defined results: null, empty, overlong or other text has no instant; impossible dates and times neither; a local
time that occurs twice or never has none; a yearless stamp of a log without reference year has none; a stamp
whose order of day and month no stamp of its log shows has none unless both readings agree; a null zone means
UTC, an unknown zone gives no instant; a null log id means a log with no facts; rows that repeat a row id count
once; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlog.functions.stamps import MAX_LEN, NONE, parse_stamps
from cairnlog.functions.zones import zone_table

_DAY = 86_400_000
#: A log spans less than this many days.
MAX_SPAN_DAYS = 90


def trimmed(stamp: Column) -> Column:
    """Without surrounding blanks, quotes and brackets, without a bracketed region, odd blanks made plain."""
    s = F.translate(stamp, "\u202f\u00a0", "  ")
    s = F.rtrim(F.ltrim(s, F.lit(" \t\r\n\"'[(<")), F.lit(" \t\r\n\"')>"))
    s = F.when(F.length(s) <= 4 * MAX_LEN, s)  # expressions see short texts only
    s = F.regexp_replace(s, r"\[[A-Za-z_+\-/0-9]*\]?\]?$", "")
    return F.regexp_replace(s, r"[\]\s]+$", "")


def shape_mask(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"[0-9]", "9"), r"\p{L}", "a")


def with_masks(df: DataFrame) -> DataFrame:
    """(src, row_id, case_id, stamp, mask) of the stamps that can be times at all."""
    s = df.withColumn("stamp", trimmed(F.col("stamp"))).filter((F.length("stamp") <= MAX_LEN) & (F.length("stamp") >= 9) & F.col("stamp").rlike("[0-9]"))
    return s.withColumn("mask", shape_mask(F.col("stamp")))


#: Stamps that need nothing of their log.
_ABSOLUTE = r"^[0-9]{9,19}(\.[0-9]+)?$|^[0-9]{4}.*[0-9][ ]?([+-][0-9]{2}:?[0-9]{2}|Z)$|^[0-9]{4}.*[0-9] [A-Z]{3,5}$|^[A-Z][a-z]{2}, .* ([+-][0-9]{4}|[A-Z]{3,5})$|^[0-9]{1,2}/[A-Za-z]{3}/[0-9]{4}:.* [+-][0-9]{4}$"
_ORDERED = r"^9{1,2}([-/])9{1,2}\19999"
_YEARLESS = r"^(aaa {1,2}9{1,2} 99:|99-99 99:|a?9999 99:)"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        code, one, two = parse_stamps(b.column("stamp").to_pylist(), b.column("mask").to_pylist())
        keep = [b.column(c) for c in b.schema.names if c not in ("stamp", "mask")]
        names = [c for c in b.schema.names if c not in ("stamp", "mask")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(code, pa.int32()), pa.array(one, mask=one == NONE), pa.array(two, mask=two == NONE)], names=[*names, "code", "one", "two"])


def parse(df: DataFrame) -> DataFrame:
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in ("stamp", "mask"))
    return df.mapInArrow(_parse, f"{kept}, code int, one long, two long")


def log_evidence(masked: DataFrame) -> DataFrame:
    """Per log: what its own stamps show of the order of day and month, and of a turn of the year."""
    p = parse(masked.filter(F.col("mask").rlike(_ORDERED) | F.col("mask").rlike(_YEARLESS)).select("case_id", "stamp", "mask"))
    ordered, yearless = F.col("code").isin(3, 5), F.col("code") == 4
    both = ordered & F.col("one").isNotNull() & F.col("two").isNotNull()
    day = lambda c: F.floor(F.col(c) / _DAY)
    span = lambda c: F.max(F.when(ordered | (F.col("code") == 2), day(c))) - F.min(F.when(ordered | (F.col("code") == 2), day(c)))
    p = p.withColumn("two", F.when(F.col("code") == 2, F.col("one")).otherwise(F.col("two")))
    return p.groupBy("case_id").agg(
        F.count_if(ordered & F.col("two").isNull()).alias("only_dm"), F.count_if(ordered & F.col("one").isNull()).alias("only_md"),
        F.count_if(both).alias("open_dm"), span("one").alias("span_dm"), span("two").alias("span_md"),
        F.min(F.when(yearless, F.col("one"))).alias("yl_first"), F.max(F.when(yearless, F.col("one"))).alias("yl_last"),
    )


def log_facts(masked: DataFrame, logs: DataFrame) -> DataFrame:
    """(case_id, zone, year, order_dm, turn): one row per log, from its declaration and its stamps."""
    e = log_evidence(masked)
    fits_dm, fits_md = F.col("span_dm") < MAX_SPAN_DAYS, F.col("span_md") < MAX_SPAN_DAYS
    order = (
        F.when(F.col("only_dm") > F.col("only_md"), True).when(F.col("only_md") > F.col("only_dm"), False)
        .when(fits_dm & ~fits_md, True).when(fits_md & ~fits_dm, False)
    )
    turn = (F.col("yl_last") - F.col("yl_first")) > 183 * _DAY
    e = e.filter("case_id is not null").select("case_id", order.alias("order_dm"), F.coalesce(turn, F.lit(False)).alias("turn"))
    d = logs.groupBy(F.col("case_id").cast("string").alias("case_id")).agg(F.max("local_zone").alias("zone"), F.max("yearless_reference_year").cast("int").alias("year"))
    return d.filter("case_id is not null").join(e, "case_id", "full_outer")


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        col = {c: b.column(c) for c in b.schema.names}
        code, one, two = parse_stamps(col["stamp"].to_pylist(), col["mask"].to_pylist())
        order, turn, year = col["order_dm"].to_pylist(), col["turn"].to_pylist(), col["year"].to_pylist()
        n = len(code)
        dm, md = np.array([x is True for x in order]), np.array([x is False for x in order])
        local = np.where(np.isin(code, (1, 2)), one, NONE)
        two_way = np.isin(code, (3, 5))
        single = np.where(one == NONE, two, np.where(two == NONE, one, NONE))  # only one reading is possible
        pick = np.where(dm, one, np.where(md, two, single))
        local = np.where(two_way, pick, local)
        yl = code == 4
        if yl.any():
            y = np.array([NONE if v is None else v for v in year], dtype=np.int64)
            late = np.array([bool(t) for t in turn]) & (((one // _DAY) - 10957) > 183)
            at = np.flatnonzero(yl & (y != NONE))
            for i in at:  # a leap day needs a leap year
                local[i] = _in_year(int(one[i]), int(y[i]) - int(late[i]))
        utc = np.where(np.isin(code, (1, 5)), local, NONE)
        naive = np.isin(code, (2, 3, 4)) & (local != NONE)
        zones = np.array([z or "UTC" for z in col["zone"].to_pylist()], dtype=object)
        for z in set(zones[naive]):
            table, at = zone_table(z), np.flatnonzero(naive & (zones == z))
            if table is not None:
                u, once = table.to_utc_ms(local[at])
                utc[at] = np.where(once, u, NONE)
        keep = np.flatnonzero(utc != NONE)
        yield pa.RecordBatch.from_arrays([col["src"].take(pa.array(keep)), col["row_id"].take(pa.array(keep)), pa.array(utc[keep])], names=["src", "row_id", "epoch_ms"])


def _in_year(ms_2000: int, year: int) -> int:
    """The same month, day and clock in another year; NONE if it has no such day."""
    from cairnlog.functions.stamps import days_from_civil, valid_date

    day, clock = divmod(ms_2000, _DAY)
    date = np.datetime64("1970-01-01") + np.timedelta64(day, "D")
    _, m, d = (int(x) for x in str(date).split("-"))
    y, m, d = (np.array([v], dtype=np.int64) for v in (year, m, d))
    return int(days_from_civil(y, m, d)[0]) * _DAY + clock if valid_date(y, m, d)[0] else NONE


def instants(stamps: DataFrame, logs: DataFrame) -> DataFrame:
    """stamps (src, row_id, case_id, stamp), logs (case_id, local_zone, yearless_reference_year) -> (src, row_id, epoch_ms).

    Stamps that need nothing of their log are never shuffled before the last step; the others meet their log's
    facts by an equi-join that adaptive execution broadcasts or splits by what it measures.
    """
    masked = with_masks(stamps.select("src", "row_id", F.col("case_id").cast("string").alias("case_id"), "stamp"))
    own = F.col("stamp").rlike(_ABSOLUTE)
    p = parse(masked.filter(own).select("src", "row_id", "stamp", "mask"))
    absolute = p.filter("code = 1").select("src", "row_id", F.col("one").alias("epoch_ms"))
    rest = masked.filter(~own).join(log_facts(masked, logs), "case_id", "left")
    local = rest.select("src", "row_id", "stamp", "mask", "zone", "year", "order_dm", "turn").mapInArrow(_resolve, "src string, row_id long, epoch_ms long")
    return absolute.unionByName(local).dropDuplicates(["src", "row_id"])
