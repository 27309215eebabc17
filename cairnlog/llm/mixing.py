"""Records of several sources mixed to target shares, small sources repeated at most a capped number of times.

Each source has a weight schedule over the training time t in [0, 1]; its integral is the source's cumulative
demand of tokens. The mixture is as large as the scarcest source allows. Every copy of a record starts at a
cumulative token offset of its source; the demand curve inverted at that offset gives its training position, and
records are range-sorted by position. Offsets are prefix sums over hash ranges of a source, so no source, however
large, is ordered in one task.

Defined results: a source without target, a null source and a target without records give nothing, and the
targets of the sources present are scaled to sum 1; a record without tokens is never chosen; a copy is chosen if
its middle lies before its source's demand, so a source misses its share by half a record at most; a null or
non-positive cap means one use; a key delivered twice counts once; ties of the hash are ordered by key; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairnlog.llm.tokens import VOCABULARY, with_token_counts
from cairnlog.session import stage

#: Hash ranges in which the records of a source are summed.
PARTS = 1024
#: Points at which a weight schedule is integrated.
GRID = 1025


class Demand:
    """Cumulative demand of one source: the integral of its schedule, as a share of the whole mixture."""

    def __init__(self, schedule: list[tuple[float, float]]) -> None:
        t, w = zip(*sorted(schedule))
        self.t = np.linspace(0.0, 1.0, GRID)
        weight = np.interp(self.t, t, w)
        steps = (weight[1:] + weight[:-1]) / 2 * np.diff(self.t)
        self.share = np.r_[0.0, np.cumsum(steps)]

    @property
    def total(self) -> float:
        return float(self.share[-1])

    def position(self, share: np.ndarray) -> np.ndarray:
        """The time at which this much has been asked for; where the schedule is flat at 0, its end."""
        keep = np.r_[True, np.diff(self.share) > 0]
        return np.interp(share, self.share[keep], self.t[keep])


def mix(records: DataFrame, demands: dict[str, Demand], caps: dict[str, int], parts: int = PARTS) -> DataFrame:
    """records (doc_id, source, tokens) -> (position, doc_id, source, copy, tokens) in training order.

    demands and caps have one entry per target source; the list of targets is a parameter, not data that grows.
    """
    spark = records.sparkSession
    records = stage(records.filter((F.col("tokens") > 0) & F.col("source").isin(list(demands))).select("doc_id", "source", "tokens"), "mix-records")
    supply = {r["source"]: r["n"] for r in records.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    whole = sum(demands[s].total for s in supply)
    if not supply or not whole:
        return spark.createDataFrame([], "position double, doc_id long, source string, copy int, tokens long")
    caps = {s: max(1, caps.get(s) or 1) for s in supply}
    shares = {s: demands[s].total / whole for s in supply}
    size = min(supply[s] * caps[s] / shares[s] for s in supply if shares[s] > 0)
    want = {s: size * shares[s] for s in supply}
    limits = spark.createDataFrame([(s, supply[s], float(want[s]), caps[s]) for s in supply], "source string, supply long, want double, cap int")
    hashed = records.withColumn("h", F.xxhash64("doc_id"))
    hashed = hashed.withColumn("part", F.pmod(F.shiftright("h", 40), F.lit(parts)))
    sums = hashed.groupBy("source", "part").agg(F.sum("tokens").alias("n"))
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inner = F.sum("tokens").over(W.partitionBy("source", "part").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    at = hashed.withColumn("upto", inner).join(before, ["source", "part"]).join(F.broadcast(limits), "source")
    at = at.withColumn("offset", F.col("before") + F.col("upto") - F.col("tokens"))
    middle = F.col("offset") + F.col("tokens") / 2
    copies = F.least(F.col("cap"), F.ceil((F.col("want") - middle) / F.col("supply")).cast("int"))
    chosen = at.filter(middle < F.col("want")).select("doc_id", "source", "tokens", "offset", "supply", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), copies))).alias("copy"))
    chosen = chosen.select("doc_id", "source", "tokens", "copy", (F.col("offset") + (F.col("copy") - 1) * F.col("supply")).alias("start"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            position = np.zeros(len(pdf))
            for s in pdf["source"].unique():
                m = (pdf["source"] == s).to_numpy()
                position[m] = demands[s].position(pdf["start"].to_numpy()[m] / size * whole)
            yield pdf.assign(position=position)[["position", "doc_id", "source", "copy", "tokens"]]

    placed = chosen.mapInPandas(place, "position double, doc_id long, source string, copy int, tokens long")
    return placed.orderBy("position", "source", "doc_id", "copy")


def report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: records, most uses of one record, tokens, actual and target share."""
    per = mixed.groupBy("source").agg(F.countDistinct("doc_id").alias("texts"), F.max("copy").alias("uses"), F.sum("tokens").alias("tokens"))
    whole = per.agg(F.sum("tokens")).first()[0] or 1
    return targets.join(per, "source", "left").select("source", "target_share", F.coalesce(F.col("tokens") / F.lit(whole), F.lit(0.0)).alias("actual_share"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "max_repeats")


def mix_documents(docs: DataFrame, targets: DataFrame, schedules: dict[str, list[tuple[float, float]]] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Documents mixed to target_share; schedules may give a source a weight that changes over t in [0, 1].

    A schedule keeps the source's target as its mean: its weights are scaled to integrate to the target share.
    """
    rows = [r for r in targets.select("source", "target_share", "max_repeats").collect() if r["source"] is not None and (r["target_share"] or 0) > 0]
    demands = {}
    for r in rows:
        d = Demand((schedules or {}).get(r["source"]) or [(0.0, 1.0), (1.0, 1.0)])
        d.share = d.share / d.total * r["target_share"] if d.total else d.share
        demands[r["source"]] = d
    counted = with_token_counts(docs.filter("source is not null"), "doc_id", "text", keep=("source",), path=vocabulary)
    return mix(counted, demands, {r["source"]: r["max_repeats"] for r in rows})
