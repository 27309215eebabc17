"""Frequent subsequences with gaps across many entities, by finite-state transducer mining.

The constraints (three to five distinct items, each at most max_gap positions after the one before) are compiled
into a transducer whose transitions are pruned by the steps that occur in enough sequences: every step of a frequent
pattern does. Run over a sequence it gives, for each pivot (the item of a pattern with the fewest steps), an acyclic
automaton of the candidate patterns with that pivot: its states are positions of the sequence with the number of
items taken and whether the pivot is among them, states of equal continuation are one. No pattern is spelled out. The
automata are shuffled by pivot, split further by a hash of the entity; those of one entity are united, equal ones
weighted, and patterns are grown over projections, the states that a beginning leads to in each automaton, as long
as enough weight is behind them. A part that holds e of all E entities need only keep patterns with e/E of the
support asked for: a frequent pattern has that in one part at least. If there is more than one part, what they kept
is counted in all of them.

Defined results: sequences without entity are ignored; null and blank items are in no pattern but keep their
positions; an entity counts once however many sequences or repeated rows it has; patterns with equal support are
all listed; null or empty sequences and an empty table give no pattern; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlog.session import stage

#: Entities of a part on average: a task holds the automata of one pivot and part at a time.
PER_PART = 20_000
#: Frequent steps that travel to the workers as arrays; beyond it sequences get theirs by joins.
MAX_PAIRS = 500_000
#: Patterns counted over the parts in one pass.
COUNTED = 200_000


def step_codes(items: np.ndarray, valid: np.ndarray, seq: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices i, j of all steps: j at most gap positions after i in the same sequence, unlike valid items."""
    left, right = [], []
    for d in range(1, gap + 1):
        i = np.arange(max(0, len(items) - d))
        ok = valid[i] & valid[i + d] & (seq[i] == seq[i + d]) & (items[i] != items[i + d])
        left.append(i[ok])
        right.append(i[ok] + d)
    return np.concatenate(left), np.concatenate(right)


def _arrays(b: pa.RecordBatch, blank: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    import pyarrow.compute as pc

    a = b.column("items")
    lengths = np.array([n or 0 for n in pc.list_value_length(a).to_pylist()], dtype=np.int64)
    flat = a.flatten()
    v = flat.fill_null(blank).to_numpy(zero_copy_only=False)
    return b.column("entity").to_pylist(), v, v != blank, np.repeat(np.arange(len(lengths)), lengths)


def _pairs(gap: int, blank: int):
    """Per batch: in how many sequences each step occurs, and the sum of it for a batch is one row per step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, v, ok, seq = _arrays(b, blank)
            i, j = step_codes(v, ok, seq, gap)
            items, code = np.unique(v, return_inverse=True)
            k = len(items)
            step = np.unique(seq[i] * (k * k) + code[i] * k + code[j]) % (k * k) if len(i) else np.zeros(0, dtype=np.int64)
            step, n = np.unique(step, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(items[step // max(k, 1)]), pa.array(items[step % max(k, 1)]), pa.array(n.astype(np.int64))], names=["a", "b", "n"])

    return run


def frequent_steps(src: DataFrame, least: int, gap: int, blank: int) -> DataFrame:
    """(a, b, n): steps that occur in n >= least sequences.

    A step has no more entities than sequences, so no step of a frequent pattern is left out; counting sequences
    needs no entity in the shuffle, and batches send one row per step.
    """
    seen = src.mapInArrow(_pairs(gap, blank), "a long, b long, n long")
    return seen.groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def automaton_of(items: list[int], moves: dict[int, list[int]], rank: dict[int, tuple], pivot: int, shortest: int, longest: int) -> str:
    """The automaton of one sequence's candidates with this pivot, as text; empty if there is none.

    items and moves: by position; rank: an item's place, the pivot of a pattern is the item of the greatest. Words of
    the automaton may hold an item twice, those are no patterns and never grown.
    """
    at = rank[pivot]
    allowed = {p: [q for q in nxt if rank[items[q]] <= at] for p, nxt in moves.items() if rank[items[p]] <= at}
    back: dict[int, list[int]] = defaultdict(list)
    for p, nxt in allowed.items():
        for q in nxt:
            back[q].append(p)
    near = {p for p in (*allowed, *back) if items[p] == pivot}
    edge = set(near)
    for _ in range(longest - 1):  # a pattern with the pivot begins at most so many steps before it
        edge = {p for q in edge for p in back.get(q, ())} - near
        near |= edge
    known: dict[tuple, int] = {}
    memo: dict[tuple[int, int, bool], int] = {}

    def state(p: int, depth: int, seen: bool) -> int:
        """The number of the state behind position p, or -1 if it leads nowhere."""
        key = (p, depth, seen)
        if key not in memo:
            out = set()
            if depth < longest:
                for q in allowed.get(p, ()):
                    t = state(q, depth + 1, seen or items[q] == pivot)
                    if t >= 0:
                        out.add((items[q], t))
            final = seen and depth >= shortest
            memo[key] = known.setdefault((final, tuple(sorted(out))), len(known)) if out or final else -1
        return memo[key]

    first = {(items[p], t) for p in near if (t := state(p, 1, items[p] == pivot)) >= 0}
    if not first:
        return ""
    return _text(known, first)


def _text(known: dict[tuple, int], first: set[tuple[int, int]]) -> str:
    """States in order of construction, each `final;label>state,...`; the start is the last."""
    return "|".join(f"{int(final)};" + ",".join(f"{x}>{t}" for x, t in out) for final, out in (*known, (False, sorted(first))))


def states_of(automaton: str) -> list[tuple[bool, list[tuple[int, int]]]]:
    states = []
    for text in automaton.split("|"):
        final, _, moves = text.partition(";")
        states.append((final == "1", [(int(x), int(t)) for x, _, t in (m.partition(">") for m in moves.split(",") if m)]))
    return states


def united(automata: list[str]) -> str:
    """One automaton for all words of several: states are shared, the starts' moves joined."""
    known: dict[tuple, int] = {}
    first = set()
    for text in automata:
        number: list[int] = []
        states = states_of(text)
        for final, moves in states[:-1]:
            number.append(known.setdefault((final, tuple(sorted((x, number[t]) for x, t in moves))), len(known)))
        first |= {(x, number[t]) for x, t in states[-1][1]}
    return _text(known, first)


def words_of(automaton: str) -> set[tuple[int, ...]]:
    """The patterns of an automaton, for tests: its words without those that hold an item twice."""
    out: set[tuple[int, ...]] = set()
    states = states_of(automaton)

    def go(s: int, word: tuple[int, ...]) -> None:
        final, moves = states[s]
        if final:
            out.add(word)
        for x, t in moves:
            if x not in word:
                go(t, (*word, x))

    go(len(states) - 1, ())
    return out


def grow(weights: dict[str, int], least: float, longest: int) -> dict[tuple[int, ...], int]:
    """Patterns of weighted automata with at least this weight, by projection: no infrequent beginning is followed."""
    autos = [(states_of(a), n) for a, n in weights.items()]
    out: dict[tuple[int, ...], int] = {}
    todo: list[tuple[tuple[int, ...], list[tuple[int, tuple[int, ...]]]]] = [((), [(k, (len(a) - 1,)) for k, (a, _) in enumerate(autos)])]
    while todo:
        word, held = todo.pop()
        leads: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
        for k, at in held:
            states = autos[k][0]
            if len(at) == 1:
                to = defaultdict(set)
                for x, t in states[at[0]][1]:
                    to[x].add(t)
            else:
                to = defaultdict(set)
                for s in at:
                    for x, t in states[s][1]:
                        to[x].add(t)
            for x, ts in to.items():
                if x not in word:
                    leads[x].append((k, tuple(ts)))
        for x, projected in leads.items():
            if sum(autos[k][1] for k, _ in projected) < least:
                continue
            grown = (*word, x)
            n = sum(autos[k][1] for k, ts in projected if any(autos[k][0][t][0] for t in ts))
            if n and n >= least:
                out[grown] = n
            if len(grown) < longest:
                todo.append((grown, projected))
    return out


def _build(src: DataFrame, codes: np.ndarray | None, often: dict[int, int] | None, gap: int, blank: int, shortest: int, longest: int) -> DataFrame:
    """(pivot, entity, automaton) of the sequences; with codes None the rows bring their steps and ranks along."""

    def rows(entity: str, v: list[int], moves: dict[int, list[int]], rank: dict[int, tuple]) -> Iterator[tuple]:
        for pivot in {v[p] for p in moves} | {v[q] for nxt in moves.values() for q in nxt}:
            a = automaton_of(v, moves, rank, pivot, shortest, longest)
            if a:
                yield pivot, entity, a

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.string())], names=["pivot", "entity", "automaton"])

    def by_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: (-n, x) for x, n in often.items()}
        for b in batches:
            entity, v, ok, seq = _arrays(b, blank)
            i, j = step_codes(v, ok, seq, gap)
            hit = np.isin(np.ascontiguousarray(np.stack([v[i], v[j]], 1)).view(codes.dtype).ravel(), codes)
            i, j = i[hit], j[hit]
            order = np.lexsort((j, i))
            moves: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
            for x, y, s in zip(i[order].tolist(), j[order].tolist(), seq[i[order]].tolist()):
                moves[s][x].append(y)
            items = v.tolist()
            yield batch([r for s, m in moves.items() for r in rows(entity[s], items, m, place)])

    def by_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for entity, v, steps in zip(b.column("entity").to_pylist(), b.column("items").to_pylist(), b.column("steps").to_pylist()):
                moves: dict[int, list[int]] = defaultdict(list)
                place: dict[int, tuple] = {}
                for s in sorted(steps, key=lambda s: (s["i"], s["j"])):
                    moves[s["i"]].append(s["j"])
                    place[v[s["i"]]], place[v[s["j"]]] = (-s["na"], v[s["i"]]), (-s["nb"], v[s["j"]])
                out += rows(entity, v, moves, place)
            yield batch(out)

    return src.mapInArrow(by_rows if codes is None else by_arrays, "pivot long, entity string, automaton string")


def _stepped(src: DataFrame, steps: DataFrame, gap: int, blank: int) -> DataFrame:
    """Sequences with their frequent steps and the ranks of the items, by joins: any number of steps."""
    src = stage(src.filter(F.size("items") > 1).withColumn("row", F.monotonically_increasing_id()), "numbered")
    items = steps.select(F.col("a").alias("x"), "n").unionAll(steps.select("b", "n")).groupBy("x").agg(F.sum("n").alias("n"))
    at = src.select("row", F.posexplode("items").alias("i", "a")).filter(F.col("a").isNotNull() & (F.col("a") != blank))
    pairs = at.select("row", "i", "a", F.explode(F.sequence(F.col("i") + 1, F.col("i") + gap)).alias("j")).join(at.select("row", F.col("i").alias("j"), F.col("a").alias("b")), ["row", "j"]).filter("a <> b")
    kept = pairs.join(steps.select("a", "b"), ["a", "b"], "left_semi")
    ranked = kept.join(items.select(F.col("x").alias("a"), F.col("n").alias("na")), "a").join(items.select(F.col("x").alias("b"), F.col("n").alias("nb")), "b")
    return src.join(ranked.groupBy("row").agg(F.collect_list(F.struct("i", "j", "na", "nb")).alias("steps")), "row").select("entity", "items", "steps")


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, Counter[str], int]]:
    """Rows come ordered by pivot, part and entity. Gives per pivot and part the weighted automata and their entities."""
    weights: Counter[str] = Counter()
    last = who = None
    held: list[str] = []
    for pdf in batches:
        for pivot, part, entity, automaton in zip(pdf["pivot"].tolist(), pdf["part"].tolist(), pdf["entity"], pdf["automaton"]):
            if (pivot, part, entity) != who:
                if held:
                    weights[held[0] if len(held) == 1 else united(held)] += 1
                    held = []
                if (pivot, part) != last:
                    if weights:
                        yield last[0], weights, sum(weights.values())
                    weights, last = Counter(), (pivot, part)
                who = (pivot, part, entity)
            held.append(automaton)
    if held:
        weights[held[0] if len(held) == 1 else united(held)] += 1
    if weights:
        yield last[0], weights, sum(weights.values())


def _mine(least: int, entities: int, longest: int, parts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pivot, weights, here in _groups(batches):
            found = grow(weights, least if parts == 1 else least * here / entities, longest)
            if found:
                yield pd.DataFrame({"pivot": pivot, "pattern": ["-".join(map(str, w)) for w in found], "n": list(found.values())}, columns=["pivot", "pattern", "n"])

    return run


def _count(asked: dict[int, list[tuple[int, ...]]]):
    """Partial supports of given patterns, by running each over the weighted automata of its pivot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pivot, weights, _ in _groups(batches):
            total: Counter[tuple[int, ...]] = Counter()
            for automaton, n in weights.items():
                states = states_of(automaton)
                for w in asked.get(pivot, ()):
                    at = {len(states) - 1}
                    for x in w:
                        at = {t for s in at for y, t in states[s][1] if y == x}
                        if not at:
                            break
                    if any(states[s][0] for s in at):
                        total[w] += n
            if total:
                yield pd.DataFrame({"pattern": ["-".join(map(str, w)) for w in total], "n": list(total.values())}, columns=["pattern", "n"])

    return run


def frequent_subsequences(sequences: DataFrame, entity: str = "source_file", items: str = "template_ids", share: float = 0.12, at_least: int = 3, gap: int = 4, shortest: int = 3, longest: int = 5, blank: int = 0) -> DataFrame:
    """(pattern, support): item sequences joined by '-', and the number of entities in which they occur."""
    src = sequences.select(F.col(entity).cast("string").alias("entity"), F.col(items).cast("array<bigint>").alias("items")).filter("entity is not null")
    spark = src.sparkSession
    entities = src.select("entity").distinct().count()
    least = max(at_least, -(-int(round(share * 1_000_000)) * entities // 1_000_000))
    steps = stage(frequent_steps(src, least, gap, blank), "steps")
    n_steps = steps.count()
    if not n_steps:
        return spark.createDataFrame([], "pattern string, support long")
    if n_steps <= MAX_PAIRS:
        found = steps.toPandas()
        codes = np.ascontiguousarray(found[["a", "b"]].to_numpy(np.int64)).view([("a", np.int64), ("b", np.int64)]).ravel()
        often = pd.concat([found[["a", "n"]].set_axis(["x", "n"], axis=1), found[["b", "n"]].set_axis(["x", "n"], axis=1)]).groupby("x")["n"].sum().to_dict()
        automata = _build(src, np.sort(codes), often, gap, blank, shortest, longest)
    else:
        automata = _build(_stepped(src, steps, gap, blank), None, None, gap, blank, shortest, longest)
    parts = max(1, -(-entities // PER_PART))
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    automata = automata.distinct().withColumn("part", F.pmod(F.xxhash64("entity"), F.lit(parts)))
    if parts > 1:
        automata = stage(automata, "automata")
    ordered = automata.repartition(tasks, "pivot", "part").sortWithinPartitions("pivot", "part", "entity", "automaton")
    kept = ordered.mapInPandas(_mine(least, entities, longest, parts), "pivot long, pattern string, n long")
    if parts == 1:
        return kept.select("pattern", F.col("n").alias("support"))
    kept = stage(kept.select("pivot", "pattern").distinct(), "kept")
    rounds = max(1, -(-kept.count() // COUNTED))
    out = None
    for r in range(rounds):  # any number of patterns, a bounded number at a time
        asked: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for pivot, pattern in kept.filter(F.pmod(F.xxhash64("pattern"), F.lit(rounds)) == r).collect():
            asked[pivot].append(tuple(map(int, pattern.split("-"))))
        counted = ordered.mapInPandas(_count(dict(asked)), "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("support")).filter(F.col("support") >= least)
        out = counted if out is None else out.unionAll(counted)
    return out
