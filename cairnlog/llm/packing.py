"""Fixed-capacity containers filled with items of varying length.

Sizes are whole numbers up to the capacity, so any number of items has a histogram of at most `capacity` sizes.
Bin completion works on it: around the largest size left, the undominated fillings are enumerated, a branch is
cut as soon as its waste can't beat the incumbent, and a best-fit solution is the first incumbent. A filling is
tried as often as its sizes last, then less often, so the plan is a short list of fillings with multiplicities,
whatever the number of items. Each item then takes its rank within its size, counted in parallel, and looks up its container.

Defined results: an item over the capacity is cut into full pieces and a rest, no other is cut; empty and null
texts have size 0 and go to the containers there are, in turn (a null container if there is none); items of
equal size are placed in order of a hash of their key, so repeated runs agree; a key delivered twice counts
once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import islice
from math import inf
from random import Random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairnlog.llm.tokens import VOCABULARY, with_token_counts
from cairnlog.session import stage

CAPACITY = 2048
#: Parts that the items of one size are ranked in.
RANK_PARTS = 256
#: Containers that are still to be filled when a node also looks for items that fit in no filling.
NEAR = 64
#: Fillings put in order at a time, and nodes after which the search first starts anew.
SORTED, FIRST = 128, 500
#: Steps the search for a better plan takes by default (a node takes one per size left), and sets of items left it
#: remembers at a time.
EFFORT, MET = 5_000_000, 1_000_000


@dataclass(frozen=True)
class Filling:
    """`times` containers that each hold these sizes: (size, how many)."""

    content: tuple[tuple[int, int], ...]
    times: int


def best_fit(hist: dict[int, int], capacity: int, largest_first: bool = True) -> list[Filling]:
    """Best-fit decreasing on a histogram: each new container takes the largest sizes that still fit."""
    left, plan = dict(hist), []
    sizes = sorted(left)
    while sizes:
        room, content = capacity, []
        k = len(sizes) - 1
        while k >= 0 and room:
            s = sizes[k]
            n = min(left[s], room // s)
            if n:
                content.append((s, n))
                room -= n * s
            k = min(k - 1, bisect_left(sizes, room + 1) - 1)
        times = min(left[s] // n for s, n in content)
        plan.append(Filling(tuple(content), times))
        for s, n in content:
            left[s] -= n * times
            if not left[s]:
                del left[s]
                sizes.remove(s)
    return plan


def lower_bound(hist: dict[int, int], capacity: int) -> int:
    """Containers that any solution needs: by volume, and by items too large to share one (Martello and Toth's L2)."""
    best = -(-sum(s * n for s, n in hist.items()) // capacity)
    for alpha in {s for s in hist if 2 * s <= capacity} | {0}:
        alone = sum(n for s, n in hist.items() if s > capacity - alpha)
        half = [(s, n) for s, n in hist.items() if capacity < 2 * s and s <= capacity - alpha]
        halves = sum(n for _, n in half)
        spare = halves * capacity - sum(s * n for s, n in half)
        best = max(best, alone + halves + max(0, -(-(sum(s * n for s, n in hist.items() if alpha <= s and 2 * s <= capacity) - spare) // capacity)))
    return best


def dominated(have: int, left: dict[int, int], content: tuple[tuple[int, int], ...], capacity: int) -> bool:
    """Whether another filling around the same largest item is never worse. Bit v of `have`: a size v is left.

    That is so if an item left out still fits, or if it can take the place of a smaller item or of several that
    together are no larger than it: what they leave free goes to the items outside.
    """
    room = capacity - sum(s * n for s, n in content)
    one = several = 0  # bit v: some single item, some two or more of them make v together
    for i, (s, n) in enumerate(content):
        if left[s] == n:
            have &= ~(1 << s)
        for _ in range(n - (i == 0)):  # the first size is the largest item, which stays
            several |= (several | one) << s
            one |= 1 << s
    swapped, width = several, 1  # sums up to room greater than those of two or more items
    while width <= room:
        step = min(width, room + 1 - width)
        swapped |= swapped << step
        width += step
    if room:  # single items: only larger ones are a gain
        grown = 0
        for s, n in content[1:] if content[0][1] == 1 else content:
            grown |= ((1 << room) - 1) << (s + 1)
        swapped |= grown | ((1 << room) - 1) << 1
    return bool(swapped & have)


def fillings(left: dict[int, int], sizes: list[int], capacity: int, waste: int, beyond: int = 0, work: list[float] | None = None) -> Iterator[tuple[tuple[int, int], ...]]:
    """The undominated fillings around the largest size that waste at most `waste` and at least `beyond`.

    They are made one at a time, larger sizes first, so that a search takes only as many as it needs. `left` may
    change between two of them if it is as before when the next is asked for. work: a counter of the steps taken
    and their limit; beyond it no more are made.
    """
    top, work = sizes[-1], work or [0, inf]
    upto, least = [0], sizes[0]  # upto[k]: volume of the k smallest sizes, the largest item itself left out
    for s in sizes:
        upto.append(upto[-1] + s * (left[s] - (s == top)))
    have = sum(1 << s for s in sizes)
    work[0] += len(sizes)

    def grow(room: int, k: int, content: tuple[tuple[int, int], ...], waste: int, have: int, one: int, several: int) -> Iterator[tuple[tuple[int, int], ...]]:
        work[0] += 1
        if work[0] > work[1]:
            return
        if room <= waste:
            yield content
        k = min(k, bisect_left(sizes, room + 1) - 1)
        low = bisect_left(sizes, room - waste) if room < 2 * least else 0  # only one more item fits: it fills the room
        while k >= low and room - waste <= upto[k + 1]:
            s = sizes[k]
            most = min(left[s] - (s == top), room // s)
            work[0] += most
            steps = []
            a, c = one, several
            for n in range(1, most + 1):
                a, c = a | 1 << s, c | (c | a) << s
                h = have & ~(1 << s) if n == left[s] - (s == top) else have
                if c & h:
                    break  # these stand for one larger item, and no smaller item added will change that
                steps.append((n, h, a, c))
            for n, h, a, c in reversed(steps):
                yield from grow(room - n * s, k - 1, (*content, (s, n)), waste, h, a, c)
            k -= 1

    for c in grow(capacity - top, len(sizes) - 1, (), waste, have if left[top] > 1 else have & ~(1 << top), 0, 0):
        whole = _joined(((top, 1), *c))
        if capacity - sum(s * n for s, n in whole) >= beyond and not dominated(have, left, whole, capacity):
            yield whole


def stuck(left: dict[int, int], sizes: list[int], capacity: int, slack: int) -> bool:
    """Whether some item can be in no filling that wastes at most `slack`: no sum of items comes near enough to its room."""
    reach = 1
    for s in sizes:
        for _ in range(min(left[s], capacity // s)):
            reach |= reach << s
    window = (1 << (slack + 1)) - 1
    return any(not (reach >> (capacity - s - slack) if s + slack <= capacity else reach << (s + slack - capacity)) & window for s in sizes)


def _joined(content: tuple[tuple[int, int], ...]) -> tuple[tuple[int, int], ...]:
    total: dict[int, int] = {}
    for s, n in content:
        total[s] = total.get(s, 0) + n
    return tuple(sorted(total.items(), reverse=True))


def bin_completion(hist: dict[int, int], capacity: int, effort: float = EFFORT) -> list[Filling]:
    """Branch and bound over fillings. The result never has more containers than best-fit decreasing.

    A node takes a filling around the largest item left and how often it is applied, most often first; what it
    wastes may not exceed what a better solution than the incumbent may waste, and a set of items left that was
    met before with no more containers used is not searched again. The search ends once the incumbent meets the
    lower bound or nothing is left to search: then it is optimal. effort: after so many steps the incumbent is
    returned as it is; infinity searches to the end. It bounds the solver's time, not the items: every item is placed.
    """
    hist = {s: n for s, n in hist.items() if n > 0}
    if not hist:
        return []
    incumbent = best_fit(hist, capacity)
    best = sum(f.times for f in incumbent)
    volume = sum(s * n for s, n in hist.items())
    bound = lower_bound(hist, capacity) if best > -(-volume // capacity) else best
    left, sizes = dict(hist), sorted(hist)
    code = {s: int.from_bytes(blake2b(str(s).encode(), digest_size=16).digest()) for s in hist}
    state = whole = sum(code[s] * n for s, n in hist.items())
    tie, work = Random(1), [0, effort]
    met: dict[int, int] = {}
    path: list[Filling] = []
    used = waste = visited = 0

    def apply(f: Filling, sign: int) -> int:
        for s, n in f.content:
            before = left.get(s, 0)
            left[s] = before - sign * n * f.times
            if left[s] == 0:
                sizes.remove(s)
                del left[s]
            elif before == 0:
                insort(sizes, s)
        return sign * f.times * sum(code[s] * n for s, n in f.content)

    def options(slack: int) -> Iterator[Filling]:
        most, beyond = 0, 0
        while beyond <= slack:  # little waste first
            made = fillings(left, sizes, capacity, most, beyond, work)
            while some := list(islice(made, SORTED)):  # items of which most are left are used first
                for *_, c in sorted((-min(left[s] / n for s, n in c), tie.random(), c) for c in some):
                    for times in range(min(left[s] // n for s, n in c), 0, -1):
                        yield Filling(c, times)
            most, beyond = min(slack, 2 * most + 1), most + 1

    spare = lambda: (best - 1) * capacity - volume - waste  # noqa: E731  waste that a better solution may still have
    stack = [options(spare())]
    turn, until = FIRST, FIRST
    while stack and best > bound and work[0] < effort:
        if visited >= until:  # an early choice may be wrong: start anew with other ties, for longer
            turn += turn // 2
            until = visited + turn
            for f in reversed(path):
                apply(f, -1)
            path.clear()
            met.clear()
            used, waste, state = 0, 0, whole
            stack = [options(spare())]
        f = next(stack[-1], None)
        if f is None:
            stack.pop()
            if path:
                f = path.pop()
                state -= apply(f, -1)
                used -= f.times
                waste -= f.times * (capacity - sum(s * n for s, n in f.content))
            continue
        lost = f.times * (capacity - sum(s * n for s, n in f.content))
        if lost > spare():
            continue  # bounded by waste
        visited += 1
        work[0] += len(sizes)
        state -= apply(f, 1)
        path.append(f)
        used, waste = used + f.times, waste + lost
        if not sizes:
            if used < best:
                best, incumbent = used, list(path)
            stack.append(iter(()))
        elif met.get(state, used + 1) <= used or (volume + waste - used * capacity < NEAR * capacity and stuck(left, sizes, capacity, spare())):
            stack.append(iter(()))
        else:
            if len(met) >= MET:
                met.clear()
            met[state] = used
            stack.append(options(spare()))
    return incumbent


def pieces(tokens: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, token_start, token_end, size): items cut only where they alone exceed the capacity."""
    n = F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity)).cast("long")
    cut = tokens.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("piece"))
    start = F.col("piece") * capacity
    return cut.select("doc_id", F.col("piece").cast("int").alias("piece"), start.alias("token_start"), F.least(start + capacity, F.col("tokens")).alias("token_end")).withColumn("size", (F.col("token_end") - F.col("token_start")).cast("int"))


def ranked(items: DataFrame, parts: int = RANK_PARTS) -> DataFrame:
    """Adds rank: the number of an item among those of its size, from 0. A size's items are ranked in many parts."""
    items = items.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    sums = items.groupBy("size", "part").agg(F.count("*").alias("n"))
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = F.row_number().over(W.partitionBy("size", "part").orderBy("doc_id", "piece"))
    return items.withColumn("within", within).join(before, ["size", "part"]).withColumn("rank", F.col("before") + F.col("within") - 1).drop("within", "before", "part")


def lookup_of(plan: list[Filling]) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """Per size: ranks at which a filling begins, its first container, its items per container; number of containers."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for f in plan:
        for s, n in f.content:
            rows.setdefault(s, []).append((taken.get(s, 0), first, n))
            taken[s] = taken.get(s, 0) + n * f.times
        first += f.times
    return {s: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for s, r in rows.items()}, first


def pack(items: DataFrame, capacity: int = CAPACITY, effort: float = EFFORT) -> DataFrame:
    """items (doc_id, piece, token_start, token_end, size) -> the same with their container.

    Only the histogram, at most `capacity` rows, comes to the driver; only the plan, a list of fillings bounded
    by the number of sizes, travels to the workers.
    """
    items = stage(items, "pieces")
    hist = {r["size"]: r["n"] for r in items.filter("size > 0").groupBy("size").agg(F.count("*").alias("n")).collect()}
    at, total = lookup_of(bin_completion(hist, capacity, effort))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size, rank = pdf["size"].to_numpy(), pdf["rank"].to_numpy()
            container = np.full(len(pdf), -1, dtype=np.int64)
            for s in np.unique(size):
                m = size == s
                if s == 0:
                    container[m] = rank[m] % total if total else -1
                else:
                    begin, first, per = at[int(s)]
                    k = np.searchsorted(begin, rank[m], side="right") - 1
                    container[m] = first[k] + (rank[m] - begin[k]) // per[k]
            pdf["container"] = pd.array(container, dtype="Int64")
            pdf.loc[container < 0, "container"] = pd.NA
            yield pdf[["doc_id", "piece", "token_start", "token_end", "container"]]

    return ranked(items).mapInPandas(run, "doc_id long, piece int, token_start long, token_end long, container long")


def pack_texts(docs: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    return pack(pieces(with_token_counts(docs, key, text, path=vocabulary), capacity), capacity)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, the least possible number by volume, tokens, share of space unused, fullest container."""
    per = packed.filter("container is not null").groupBy("container").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("held"))
    return per.agg(F.count("*").alias("containers"), F.ceil(F.sum("held") / capacity).alias("volume_bound"), F.sum("held").alias("tokens"), F.max("held").alias("fullest")).withColumn("unused", 1 - F.col("tokens") / (F.col("containers") * capacity))
