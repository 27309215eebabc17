"""Queries of the operators in this subpackage and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlog.llm import mixing, packing, personal_data, runs, sequence_mining
from cairnlog.llm.tokens import with_token_counts
from cairnlog.session import stage, table


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.collapse_runs(table(spark, sf_dir, "template_sequences"), table(spark, sf_dir, "template_catalog")).withColumnRenamed("seq_id", "sequence_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).filter("events >= 3").select("sequence_id", "first_pos", "last_pos").distinct()


def p2_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_mining.frequent_subsequences(table(spark, sf_dir, "template_sequences")).select("pattern")


def p6_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_mining.frequent_subsequences(table(spark, sf_dir, "template_sequences"))


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p7_pack(spark, sf_dir))


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of p7_pack: each text placed once and whole, cut only if it alone is too long, no container too full, none too many."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = stage(packing.pack(packing.pieces(with_token_counts(docs, "doc_id", "text"), packing.CAPACITY)), "packed")
    size = F.col("token_end") - F.col("token_start")
    per_doc = packed.groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum(size).alias("tokens"), F.max("token_end").alias("end"), F.countDistinct("piece").alias("distinct"))
    wrong = per_doc.agg(
        F.count("*").alias("docs"), F.count_if((F.col("tokens") != F.col("end")) | (F.col("parts") != F.col("distinct"))).alias("not_whole"),
        F.count_if(F.col("parts") != F.greatest(F.lit(1), F.ceil(F.col("tokens") / packing.CAPACITY))).alias("cut_needlessly"), F.ceil(F.sum("tokens") / packing.CAPACITY).alias("bound"))
    per = packed.filter("container is not null").groupBy("container").agg(F.sum(size).alias("held")).agg(F.count_if(F.col("held") > packing.CAPACITY).alias("too_full"), F.count("*").alias("n"))
    return wrong.withColumn("one", F.lit(1)).join(per.withColumn("one", F.lit(1)), "one").select("docs", "not_whole", "cut_needlessly", "too_full", (F.col("n") - F.col("bound")).alias("above_bound"))


def p7_tight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three items per nation that together fill a container of 1,000, packed without knowing which belong together."""
    a, b = F.col("a"), F.col("b")
    k = F.col("n_nationkey").cast("long")
    made = table(spark, sf_dir, "nation").select("n_nationkey", (380 + (k * 37 + 11) % 111).alias("a"))
    made = made.withColumn("b", 250 + (k * 53 + 7) % (F.floor((1000 - a) / 2) - 249)).select("n_nationkey", F.posexplode(F.array(a, b, 1000 - a - b)).alias("i", "size"))
    items = made.select((k * 3 + F.col("i")).alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("token_start"), F.col("size").cast("long").alias("token_end"), F.col("size").cast("int").alias("size"))
    per = packing.pack(items, 1000).groupBy("container").agg(F.count("*").alias("items"), F.sum("token_end").alias("held"))
    return per.agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.min("held").alias("least_held"), F.max("held").alias("most_held"))


#: A curriculum: the first source fades out over the training time while the second comes in.
_FADES = {"stackyard": [(0.0, 1.5), (1.0, 0.5)], "querybarn": [(0.0, 0.5), (1.0, 1.5)]}


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"), _FADES)


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(p8_mix(spark, sf_dir), table(spark, sf_dir, "source_targets"))


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of p8_mix per source with a target: no text used more often than allowed; none from elsewhere."""
    docs, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets")
    mix = stage(p8_mix(spark, sf_dir), "mix")
    uses = mix.groupBy("source", "doc_id").agg(F.count("*").alias("uses")).groupBy("source").agg(F.max("uses").alias("most"))
    known = docs.select("doc_id", F.col("source").alias("own")).distinct()
    strange = mix.join(known, "doc_id", "left").groupBy("source").agg(F.count_if(~F.col("own").eqNullSafe(F.col("source"))).alias("strange"))
    return targets.join(uses, "source", "left").join(strange, "source", "left").select("source", (F.coalesce("most", F.lit(0)) > F.col("max_repeats")).alias("over_cap"), F.coalesce("strange", F.lit(0)).alias("of_other_sources"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find_personal_data(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_parts"))


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.redact(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_parts"))


QUERIES = {f.__name__: f for f in (p2_found, p2_collapsed, p6_found, p6_supports, p7_pack, p7_report, p7_invariants, p7_tight, p8_mix, p8_shares, p8_invariants, p9_found, p9_redacted)}

_CATALOG = r"""
forms AS (SELECT template_id, array_to_string(list_filter(list_transform(regexp_split_to_array(lower(regexp_replace(trim(pattern), '<[^<>\s]*>', chr(1), 'g')), '\s+'),
            lambda w: regexp_replace(w, '^[^\p{L}\p{N}' || chr(1) || ']+|[^\p{L}\p{N}' || chr(1) || ']+$', '', 'g')), lambda w: w <> ''), ' ') AS form FROM template_catalog),
classes AS (SELECT template_id, min(template_id) OVER (PARTITION BY form) AS cls FROM forms),
seqs AS (SELECT sequence_id, any_value(template_ids) AS ids, any_value(line_ts_ms) AS ts FROM template_sequences GROUP BY sequence_id),
events AS (SELECT sequence_id, unnest(ids) AS id, unnest(ts) AS t, generate_subscripts(ids, 1) - 1 AS pos FROM seqs),
marked AS (SELECT e.*, count(*) FILTER (id IS NULL) OVER (PARTITION BY sequence_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS part,
            coalesce(c.cls, -e.id - 1) AS cls FROM events e LEFT JOIN classes c ON c.template_id = e.id),
kept AS (SELECT * FROM marked WHERE id IS NOT NULL AND id <> 0),
turns AS (SELECT *, CASE WHEN lag(cls) OVER w = cls AND lag(part) OVER w = part THEN 0 ELSE 1 END AS turn FROM kept WINDOW w AS (PARTITION BY sequence_id ORDER BY pos)),
numbered AS (SELECT *, sum(turn) OVER (PARTITION BY sequence_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM turns),
found AS (SELECT sequence_id, CAST(min(pos) AS INT) AS first_pos, CAST(max(pos) AS INT) AS last_pos, CAST(count(*) AS INT) AS events,
            CAST(CASE WHEN any_value(cls) < 0 THEN -any_value(cls) - 1 ELSE any_value(cls) END AS BIGINT) AS event_class,
            arg_min(t, pos) FILTER (t IS NOT NULL) AS start_ts_ms,
            CAST(greatest(0, arg_max(t, pos) FILTER (t IS NOT NULL) - arg_min(t, pos) FILTER (t IS NOT NULL)) AS BIGINT) AS duration_raw
          FROM numbered GROUP BY sequence_id, run)
"""

# Frequent steps are joined end to end; a pattern's occurrences are its last positions.
_STEPS = """
seqs AS (SELECT row_number() OVER () AS s, f, ids FROM (SELECT DISTINCT source_file AS f, template_ids AS ids FROM template_sequences WHERE source_file IS NOT NULL)),
least AS (SELECT greatest(3, (count(DISTINCT f) * 12 + 99) // 100) AS n FROM seqs),
items AS (SELECT s, f, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM seqs),
steps AS (SELECT a.s, a.f, a.id AS x, b.id AS y, a.pos AS i, b.pos AS j FROM items a JOIN items b ON a.s = b.s AND b.pos BETWEEN a.pos + 1 AND a.pos + 4 WHERE a.id <> 0 AND b.id <> 0 AND a.id <> b.id),
fsteps AS (SELECT * FROM steps WHERE (x, y) IN (SELECT (x, y) FROM steps GROUP BY x, y HAVING count(DISTINCT f) >= (SELECT n FROM least))),
g2 AS (SELECT DISTINCT s, f, [x, y] AS p, j FROM fsteps)""" + "".join(f""",
g{n} AS (SELECT DISTINCT g.s, g.f, list_append(g.p, t.y) AS p, t.j FROM g{n - 1} g JOIN fsteps t ON t.s = g.s AND t.i = g.j WHERE NOT list_contains(g.p, t.y)),
h{n} AS (SELECT p, count(DISTINCT f) AS support FROM g{n} GROUP BY p HAVING count(DISTINCT f) >= (SELECT n FROM least))""" for n in (3, 4, 5))
_PATTERNS = "(" + " UNION ALL ".join(f"SELECT array_to_string(p, '-') AS pattern, support FROM h{n}" for n in (3, 4, 5)) + ")"

ORACLE = {
    "p8_invariants": "SELECT source, false AS over_cap, CAST(0 AS BIGINT) AS of_other_sources FROM source_targets",
    "p6_found": f"WITH {_STEPS} SELECT pattern FROM {_PATTERNS}",
    "p6_supports": f"WITH {_STEPS} SELECT pattern, support FROM {_PATTERNS}",
    "p7_invariants": "SELECT count(DISTINCT doc_id) AS docs, CAST(0 AS BIGINT) AS not_whole, CAST(0 AS BIGINT) AS cut_needlessly, CAST(0 AS BIGINT) AS too_full, CAST(0 AS BIGINT) AS above_bound FROM documents",
    "p7_tight": "SELECT count(*) AS containers, 3 * count(*) AS items, CAST(1000 AS BIGINT) AS least_held, CAST(1000 AS BIGINT) AS most_held FROM nation",
    "p2_found": f"WITH {_CATALOG} SELECT sequence_id, first_pos, last_pos FROM found WHERE events >= 3",
    "p2_collapsed": f"WITH {_CATALOG} SELECT sequence_id, first_pos, last_pos, events, event_class, start_ts_ms, CASE WHEN start_ts_ms IS NULL THEN NULL ELSE duration_raw END AS duration_ms FROM found",
}
