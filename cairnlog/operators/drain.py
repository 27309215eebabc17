"""Message templates mined from normalised lines, exactly as one pass in line order would, but leaf by leaf.

A line is routed by its number of tokens and its first tokens; only lines of one leaf can share a template. The
routing needs nothing but the order in which keys first appear, so it is done with aggregates; the leaves are then
mined independently, each content once wherever that gives the same, else as an ordered stream of lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairnlog.operators.ordered import number_rows
from cairnlog.session import broadcast_if_small, stage

WILDCARD, EMPTY = "<*>", "<EMPTY>"


@dataclass(frozen=True)
class MinerConfig:
    depth: int = 4
    similarity: float = 0.5
    children: int = 100
    scanned: int = 256
    max_bytes: int = 4096


@dataclass
class Cluster:
    tokens: list[str]
    birth: int
    count: int = 0
    stored: int = 0
    first: int | None = None


def similarity(template: list[str], tokens: list[str]) -> tuple[float, float]:
    """(score, share of wildcards): equal tokens count 1, other tokens at a wildcard a half."""
    if not tokens:
        return 1.0, 0.0
    exact = wild = half = 0
    for a, b in zip(template, tokens):
        wild += a == WILDCARD
        exact += a == b
        half += a == WILDCARD and a != b
    return (exact + half / 2) / len(tokens), wild / len(tokens)


@dataclass
class Leaf:
    """The templates of one leaf; lines must come in order."""

    config: MinerConfig
    clusters: list[Cluster] = field(default_factory=list)
    _seen: dict[str, int] = field(default_factory=dict)

    def add(self, content: str, line: int, overflow: bool, times: int = 1) -> int:
        """The position of the line's cluster in this leaf."""
        best = self._seen.get(content, -1)
        if best < 0:
            tokens = content.split()
            least = 0.0 if overflow else self.config.similarity
            best_score = -1.0
            for i, c in enumerate(self.clusters[: self.config.scanned]):
                if len(c.tokens) != len(tokens):
                    continue
                score, wild = similarity(c.tokens, tokens)
                if score > best_score and not (wild > 0.7 and score < 0.8):  # a template of wildcards draws only what is very like it
                    best, best_score = i, score
            if best < 0 or best_score < least:
                self.clusters.append(Cluster(tokens, line))
                best, changed = len(self.clusters) - 1, False
                self._seen.clear()
            else:
                c = self.clusters[best]
                merged = [a if a == b else WILDCARD for a, b in zip(c.tokens, tokens)]
                changed = merged != c.tokens
                if changed:
                    c.tokens = merged
                    self._seen.clear()
            if not changed and len(self._seen) < 65536:  # a line that changed its template may find another next time
                self._seen[content] = best
        c = self.clusters[best]
        c.count += times
        c.first = line if c.first is None else c.first
        return best


#: Distinct routing keys up to which the routes are worked out on the driver; beyond it they are on the cluster.
FEW_ROUTES = 50_000


def routes_of(keys: list[tuple], config: MinerConfig) -> list[tuple]:
    """(key..., leaf, overflow) of (first line, key...): in order of first appearance, as one pass would build the tree."""
    tree: dict = {}
    out = []
    for _, *path in sorted(keys):
        node, leaf, overflow = tree, "", False
        for level, key in enumerate(path):
            own = key != "*" and (key in node or len(node) < config.children)
            overflow |= bool(level) and key != "*" and not own
            leaf += "\x1f" + ("=" + key if own else "*")
            node = node.setdefault(key if own else "*", {})
        out.append((*path, leaf, overflow))
    return out


def level_keys(config: MinerConfig) -> list:
    """Routing keys of a line: its number of tokens, then its first tokens."""
    tokens = F.split(F.regexp_replace(F.col("content"), r"\s+", " "), " ")
    return [F.size(tokens).cast("string"), *[F.coalesce(F.get(tokens, F.lit(i)), F.lit("*")) for i in range(max(1, config.depth - 2))]]


def mined_content(config: MinerConfig) -> Column:
    """What of a line's content is mined: at most max_bytes of it."""
    content = F.col("content")
    encoded = F.encode(content, "UTF-8")
    splits = F.hex(F.substring(encoded, config.max_bytes + 1, 1)).between("80", "BF")  # a character lies over the edge: the whole line is mined
    return F.when(content.rlike(r"\S"), F.trim(F.when((F.octet_length(content) > config.max_bytes) & ~splits, F.substring(encoded, 1, config.max_bytes).cast("string")).otherwise(content))).otherwise("")


def route(lines: DataFrame, config: MinerConfig = MinerConfig()) -> DataFrame:
    """Adds leaf and overflow to (line_no, content), lines without tokens left out.

    Level keys beyond `children` in order of first appearance share a leaf; only a token level that overflows makes
    its lines join any template there. Routes are worked out on the distinct keys, not on the lines.
    """
    df = lines.withColumn("content", mined_content(config)).filter(F.length("content") > 0)
    names = [f"_k{i}" for i in range(len(level_keys(config)))]
    df = df.select("*", *[k.alias(n) for k, n in zip(level_keys(config), names)])
    keys = df.groupBy(*names).agg(F.min("line_no").alias("_first"))
    few = keys.limit(FEW_ROUTES + 1).collect()
    if len(few) <= FEW_ROUTES:
        made = routes_of([(r["_first"], *[r[n] for n in names]) for r in few], config)
        return df.join(F.broadcast(lines.sparkSession.createDataFrame(made, ", ".join(f"{n} string" for n in names) + ", leaf string, overflow boolean")), names).drop(*names)
    routes = stage(keys, "route-keys").withColumn("leaf", F.lit("")).withColumn("overflow", F.lit(False))
    for level, key in enumerate(names):
        first = routes.groupBy("leaf", key).agg(F.min("_first").alias("_f")).filter(F.col(key) != "*")
        rank = F.row_number().over(W.partitionBy("leaf").orderBy("_f", key))
        star = routes.filter(F.col(key) == "*").groupBy("leaf").agg(F.min("_first").alias("_star"))  # a short line's child counts from its first line on
        named = first.withColumn("_rank", rank).join(star, "leaf", "left").withColumn("_room", F.lit(config.children) - F.coalesce((F.col("_star") < F.col("_f")).cast("int"), F.lit(0)))
        named = named.filter(F.col("_rank") <= F.col("_room")).select("leaf", key, F.lit(True).alias("_own"))
        routes = routes.join(named, ["leaf", key], "left")
        own = F.coalesce("_own", F.lit(False))
        if level:
            routes = routes.withColumn("overflow", F.col("overflow") | ((F.col(key) != "*") & ~own))
        routes = routes.withColumn("leaf", F.concat("leaf", F.lit("\x1f"), F.when(own, F.concat(F.lit("="), F.col(key))).otherwise("*"))).drop("_own")
    routes = stage(routes.drop("_first"), "routes")
    return df.join(broadcast_if_small(routes), names).drop(*names)


_MINED = "leaf string, cluster int, line_no long, content string, pattern string, birth long, n long, example_line long, settled boolean"
_COLUMNS = [f.split()[0] for f in _MINED.split(", ")]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS).astype({"leaf": object, "content": object, "pattern": object, "cluster": "Int32", "line_no": "Int64", "birth": "Int64", "n": "Int64", "example_line": "Int64", "settled": "boolean"})


class Settled:
    """Whether each content of a leaf would have gone to one and the same cluster at all of its lines.

    Contents are mined once, at their first line. That equals a pass over all lines if at every later line of a
    content no other cluster born by then could have been liked better than its own at its worst: then repeated
    lines change nothing. What another cluster was at its best is bounded by its first and last tokens.
    """

    def __init__(self, config: MinerConfig) -> None:
        self.config, self.codes, self.rows, self.own, self.last, self.width = config, {WILDCARD: 0}, [], [], [], None

    def _coded(self, tokens: list[str]) -> list[int]:
        return [self.codes.setdefault(t, len(self.codes)) for t in tokens]

    def note(self, content: str, cluster: int, first: int, last: int) -> None:
        if last > first and len(self.rows) <= HELD:
            self.rows.append(self._coded(content.split()))
            self.own.append(cluster)
            self.last.append(last)

    def holds(self, clusters: list[Cluster], begun: list[list[str]], overflow: bool) -> bool:
        if not self.rows:
            return True
        if len(self.rows) > HELD or len(clusters) > self.config.scanned or any(len(c.tokens) != len(self.rows[0]) for c in clusters) or any(len(r) != len(self.rows[0]) for r in self.rows):
            return False
        final, first = (np.array([self._coded(t) for t in x], dtype=np.int32) for x in ([c.tokens for c in clusters], begun))
        born = np.array([c.birth for c in clusters])
        rows, own, last = np.array(self.rows, dtype=np.int32), np.array(self.own), np.array(self.last)
        n = rows.shape[1]
        for lo in range(0, len(rows), 65536):
            r, o, z = rows[lo : lo + 65536], own[lo : lo + 65536], last[lo : lo + 65536]
            mine = final[o]
            wild = (mine == 0).sum(1)
            score = 2 * (mine == r).sum(1) + ((mine == 0) & (r != 0)).sum(1)
            if ((wild * 10 > n * 7) & (score < 1.6 * n)).any() or (not overflow and (score < 2 * self.config.similarity * n).any()):
                return False
            for k in range(len(clusters)):
                best = 2 * (first[k] == r).sum(1) + ((final[k] == 0) & (first[k] != r)).sum(1)
                if ((o != k) & (born[k] < z) & ((best > score) | ((best == score) & (k < o)))).any():
                    return False
        return True


#: Repeated contents of a leaf that are looked at again; a leaf with more is mined line by line.
HELD = 1_000_000


def _mine(config: MinerConfig, seeds: dict[str, list[tuple[int, list[str], int]]], once: bool):
    """Rows come by leaf and line. Gives a row per line (or content) and, at a leaf's end, one per template (with a pattern).

    once: the rows are contents at their first line, with the last one and their number of lines.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaf, name, flag, check = Leaf(config), None, False, Settled(config)
        begun: list[list[str]] = []

        def templates() -> list[tuple]:
            good = not once or check.holds(leaf.clusters, begun, flag)
            return [(name, k, None, None, " ".join(c.tokens), c.birth, c.count - c.stored, c.first, good) for k, c in enumerate(leaf.clusters) if c.count > c.stored]

        for pdf in batches:
            done, ended = [], []
            last, times = (pdf["last"].tolist(), pdf["times"].tolist()) if once else (pdf["line_no"].tolist(), [1] * len(pdf))
            for n, line, content, overflow, z, m in zip(pdf["leaf"], pdf["line_no"].tolist(), pdf["content"], pdf["overflow"].tolist(), last, times):
                if n != name:
                    ended += templates()
                    leaf, name, flag, check = Leaf(config), n, overflow, Settled(config)
                    leaf.clusters = [Cluster(list(t), -1 - i, c, c) for i, t, c in seeds.get(n, [])]
                    begun = [list(c.tokens) for c in leaf.clusters]
                k = leaf.add(content, line, overflow, m)
                if once:
                    if k == len(begun):
                        begun.append(list(leaf.clusters[k].tokens))
                    check.note(content, k, line, z)
                done.append(k)
            nothing = pd.array([pd.NA] * len(pdf), dtype="Int64")
            yield pd.DataFrame({"leaf": pdf["leaf"], "cluster": np.array(done, dtype=np.int32), "line_no": pdf["line_no"], "content": pdf["content"] if once else None, "pattern": None, "birth": nothing, "n": nothing, "example_line": nothing, "settled": pd.array([pd.NA] * len(pdf), dtype="boolean")}, columns=_COLUMNS)
            if ended:
                yield _frame(ended)
        if leaf.clusters and (rest := templates()):
            yield _frame(rest)

    return run


def mine(lines: DataFrame, config: MinerConfig = MinerConfig(), stored: list[tuple[int, list[str], int]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines with template_id, templates) of (line_no, content); template 0 is the blank line.

    Contents are counted first, with their first and last lines, and mined once each; masks leave few of them, and
    a leaf that holds most lines is as small as its contents. Where a leaf's contents don't settle (see Settled) its
    lines are mined one by one, so the result is always that of one pass in line order. Ids follow the order in
    which templates were born. With stored templates (id, tokens, count) mining goes on from them: they are routed
    by their own tokens and keep their ids.
    """
    spark = lines.sparkSession
    seeds: dict[str, list[tuple[int, list[str], int]]] = {}
    for i, tokens, count in sorted(stored or []):
        if i and tokens:
            keys = [str(len(tokens)), *[tokens[k] if k < len(tokens) else "*" for k in range(max(1, config.depth - 2))]]
            name = "".join("\x1f" + ("*" if k == "*" else "=" + k) for k in keys)
            seeds.setdefault(name, []).append((i, tokens, count))
    lines = stage(lines.select(F.col("line_no").cast("long").alias("line_no"), F.coalesce(mined_content(config), F.lit("")).alias("content")), "content")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    contents = stage(lines.filter(F.length("content") > 0).groupBy("content").agg(F.min("line_no").alias("line_no"), F.max("line_no").alias("last"), F.count("*").alias("times")), "contents")
    routed = route(contents, config).select("leaf", "line_no", "content", "overflow", "last", "times")
    by_leaf = routed.repartition(parts, "leaf").sortWithinPartitions("leaf", "line_no")
    mined = stage(by_leaf.mapInPandas(_mine(config, seeds, True), _MINED), "mined")
    unsettled = mined.filter("not settled").select("leaf").distinct()
    held = mined.filter("pattern is null").select("leaf", "cluster", "content")
    per = mined.filter("pattern is not null")
    again = None
    if not mined.filter("not settled").isEmpty():
        unsettled = broadcast_if_small(stage(unsettled, "unsettled"))
        open_lines = lines.join(routed.join(unsettled, "leaf", "left_semi").select("leaf", "content", "overflow"), "content")
        again = stage(open_lines.repartition(parts, "leaf").sortWithinPartitions("leaf", "line_no").mapInPandas(_mine(config, seeds, False), _MINED), "mined-lines")
        held = held.join(unsettled, "leaf", "left_anti")
        per = per.join(unsettled, "leaf", "left_anti").unionByName(again.filter("pattern is not null"))
    after = max([i for i, _, _ in stored or []], default=0)
    per = stage(per.select("leaf", "cluster", "pattern", "birth", "n", "example_line"), "per")
    born = number_rows(per.filter("birth >= 0").select(F.lit(0).alias("log"), "birth"), "birth", ["log"])
    ids = born.select("birth", (F.col("position") + 1 + after).cast("int").alias("template_id"))
    known = per.join(ids, "birth", "left").withColumn("template_id", F.coalesce("template_id", (-1 - F.col("birth")).cast("int")))
    known = stage(known, "templates")
    of = broadcast_if_small(known.select("leaf", "cluster", "template_id"))
    held = stage(held.join(of, ["leaf", "cluster"]).select("content", "template_id"), "content-ids")
    numbered = lines.join(broadcast_if_small(held), "content").select("line_no", "template_id")
    if again is not None:
        numbered = numbered.unionByName(again.filter("pattern is null").select("leaf", "cluster", "line_no").join(of, ["leaf", "cluster"]).select("line_no", "template_id"))
    blank = lines.filter(F.length("content") == 0)
    zero = blank.agg(F.count("*").alias("n"), F.min("line_no").alias("example_line")).filter("n > 0").select(F.lit(0).alias("template_id"), F.lit(EMPTY).alias("pattern"), "n", "example_line")
    templates = known.select("template_id", "pattern", "n", "example_line").unionByName(zero)
    return numbered.unionByName(blank.select("line_no", F.lit(0).alias("template_id"))), templates


def mine_sequential(contents: list[str], config: MinerConfig = MinerConfig()) -> list[int]:
    """The same by one pass on the driver, for tests and samples: template ids line by line."""
    tree: dict = {}
    leaves: dict[tuple, Leaf] = {}
    births: dict[tuple, int] = {}
    out = []
    for i, text in enumerate(contents):
        tokens = text.split()
        if not tokens:
            out.append(0)
            continue
        keys = [str(len(tokens)), *[tokens[k] if k < len(tokens) else "*" for k in range(max(1, config.depth - 2))]]
        node, path, overflow = tree, [], False
        for level, key in enumerate(keys):
            own = key != "*" and (key in node or len(node) < config.children)
            overflow |= bool(level) and key != "*" and not own
            step = "=" + key if own else "*"
            node = node.setdefault(key if own else "*", {})
            path.append(step)
        leaf = leaves.setdefault(tuple(path), Leaf(config))
        k = leaf.add(" ".join(tokens), i, overflow)
        out.append(births.setdefault((tuple(path), k), len(births) + 1))
    return out
