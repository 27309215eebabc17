"""Queries of the preparation operators that belong to the core: problems 1, 3, 4 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlog.operators import keyed_profile as kp
from cairnlog.operators import log_entries as le
from cairnlog.operators import schema_drift as sd
from cairnlog.operators import timestamps as ts
from cairnlog.session import stage, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sd.schema_changes(table(spark, sf_dir, "investigation_states")).withColumnRenamed("record_id", "sidecar_id")


def p1_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sd.unify(table(spark, sf_dir, "investigation_states")).withColumnRenamed("record_id", "sidecar_id")


def p1_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sd.change_counts(sd.schema_changes(table(spark, sf_dir, "investigation_states")))


#: JSON types, by DuckDB's names, of the layout's fields at the top.
_TOP = {
    "schema_version": "UBIGINT BIGINT", "source": "OBJECT", "filters": "ARRAY", "everything_else_active": "BOOLEAN", "selected_filter": "VARCHAR NULL", "show_templates": "BOOLEAN",
    "log_font_size": "UBIGINT BIGINT DOUBLE", "timeline_display_mode": "VARCHAR", "pins": "ARRAY",
}


def p1_top_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of p1_found what SQL can tell too: fields at the top that lack their own name, and those of another type under it."""
    top = p1_found(spark, sf_dir).filter(F.col("field").isin(*_TOP) & F.col("kind").isin("renamed", "removed", "retyped"))
    lacking = F.max(F.col("kind") != "retyped")
    return top.groupBy("sidecar_id", "field").agg(F.when(lacking, "lacking").otherwise("retyped").alias("state"))


_P3 = (("stored_templates", "count"), ("log_clusters", "size"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [kp.heavy_keys(table(spark, sf_dir, t), "id", "0.02").select(F.lit(t).alias("tbl"), F.col("k").cast("int").alias("id")) for t, _ in _P3]
    return parts[0].unionByName(parts[1])


def p3_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, sum, largest and exact median and 95th percentile per id; re-delivered rows count once."""
    parts = []
    for t, v in _P3:
        once = table(spark, sf_dir, t).select("row_id", "id", v).distinct()
        p = kp.keyed_profile(once, "id", v)
        parts.append(p.select(F.lit(t).alias("tbl"), F.col("k").cast("int").alias("id"), "rows", F.col("total").cast("long").alias("total"), "largest", "p50", "p95"))
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    inline = table(spark, sf_dir, "inline_contract").select(F.lit("inline_contract").alias("src"), F.col("line_id").alias("row_id"), "case_id", F.col("fields.time").alias("stamp"))
    oracle = table(spark, sf_dir, "oracle_lines").filter(F.col("class") == "header").select(F.lit("oracle_lines").alias("src"), "row_id", "case_id", F.col("timestamp").alias("stamp"))
    return ts.instants(inline.unionByName(oracle).filter("stamp is not null"), table(spark, sf_dir, "detection_diagnostics"))


#: Stamps whose instant SQL can tell too: ISO dates and times with an offset.
_ZONED = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,6})?(Z|[+-][0-9]{2}:[0-9]{2})$"


def p4_zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instants of p4_found that ISO stamps with an offset denote."""
    found = p4_found(spark, sf_dir)
    inline = table(spark, sf_dir, "inline_contract").filter(F.col("fields.time").rlike(_ZONED)).select(F.lit("inline_contract").alias("src"), F.col("line_id").alias("row_id"))
    oracle = table(spark, sf_dir, "oracle_lines").filter((F.col("class") == "header") & F.col("timestamp").rlike(_ZONED)).select(F.lit("oracle_lines").alias("src"), "row_id")
    return found.join(inline.unionByName(oracle).distinct(), ["src", "row_id"], "left_semi").select("src", "row_id", "epoch_ms")


def _undeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "inline_contract").filter("template is null").select("case_id", "line_no", "line")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return le.entries(_undeclared(spark, sf_dir)).select("case_id", "first_line", "last_line", "level", "component")


def p5_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _undeclared(spark, sf_dir)
    return le.with_messages(lines, le.entries(lines))


def p5_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of p5_found: entries begin at lines there are, follow each other without gap or overlap, and the last ends with its log."""
    lines = _undeclared(spark, sf_dir)
    found = stage(p5_found(spark, sf_dir).select("case_id", "first_line", "last_line"), "entries-found")
    ends = lines.groupBy("case_id").agg(F.max("line_no").alias("end"))
    # an entry's end is another's beginning, or the end of its log
    after = found.select("case_id", (F.col("first_line") - 1).alias("last_line"), F.lit(True).alias("next"))
    chained = found.join(after, ["case_id", "last_line"], "left").join(ends, "case_id").agg(
        F.count_if(F.col("next").isNull() & (F.col("last_line") != F.col("end"))).alias("gaps"), F.count_if(F.col("next").isNotNull() & (F.col("last_line") >= F.col("end"))).alias("beyond"), F.count_if(F.col("last_line") < F.col("first_line")).alias("backwards"))
    known = found.join(lines.select("case_id", F.col("line_no").alias("first_line")).distinct(), ["case_id", "first_line"], "left_anti").agg(F.count("*").alias("without_line"))
    repeated = found.groupBy("case_id", "first_line").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    one = [x.withColumn("one", F.lit(1)) for x in (chained, known, repeated)]
    return one[0].join(one[1], "one").join(one[2], "one").drop("one")


QUERIES = {f.__name__: f for f in (p1_found, p1_states, p1_change_counts, p1_top_fields, p3_found, p3_profile, p4_found, p4_zoned, p5_found, p5_entries, p5_invariants)}

_PROFILE = """
SELECT '{t}' AS tbl, id, count(*) AS rows, CAST(sum(v) AS BIGINT) AS total, max(v) AS largest,
       CAST(quantile_disc(v, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(v, 0.95) AS BIGINT) AS p95
FROM (SELECT DISTINCT row_id, id, "{v}" AS v FROM {t}) GROUP BY id"""

_ZONED_ROWS = f"SELECT src, row_id, epoch_ms(TRY_CAST(stamp AS TIMESTAMPTZ)) AS epoch_ms FROM (QUERY) WHERE regexp_matches(stamp, '{_ZONED}') AND TRY_CAST(stamp AS TIMESTAMPTZ) IS NOT NULL"

_TOP_ROWS = " UNION ALL ".join(
    f"SELECT sidecar_id, '{f}' AS field, CASE WHEN json_type(body, '$.{f}') IS NULL THEN 'lacking' ELSE 'retyped' END AS state FROM B WHERE coalesce(json_type(body, '$.{f}'), '') NOT IN ({', '.join(repr(t) for t in types.split())})" for f, types in _TOP.items())

ORACLE = {
    "p5_invariants": "SELECT CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS beyond, CAST(0 AS BIGINT) AS backwards, CAST(0 AS BIGINT) AS without_line, CAST(0 AS BIGINT) AS repeated",
    "p1_top_fields": f"WITH B AS (SELECT DISTINCT sidecar_id, body FROM investigation_states WHERE json_valid(body) AND json_type(body) = 'OBJECT') SELECT DISTINCT * FROM ({_TOP_ROWS})",
    "p4_zoned": "SELECT DISTINCT * FROM (" + " UNION ALL ".join(_ZONED_ROWS.replace("QUERY", q) for q in (
        "SELECT 'inline_contract' AS src, line_id AS row_id, fields.time AS stamp FROM inline_contract", "SELECT 'oracle_lines' AS src, row_id, timestamp AS stamp FROM oracle_lines WHERE class = 'header'")) + ")",
    "p3_found": " UNION ALL ".join(f"SELECT '{t}' AS tbl, id FROM {t} WHERE id IS NOT NULL GROUP BY id HAVING count(*) >= 0.02 * (SELECT count(*) FROM {t})" for t, _ in _P3),
    "p3_profile": " UNION ALL ".join(_PROFILE.format(t=t, v=v) for t, v in _P3),
}
