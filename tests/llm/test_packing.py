import random
from collections import Counter

import pytest

from cairnlog.llm import packing
from cairnlog.llm.tokens import count_tokens


def spend(plan):
    c = Counter()
    for f in plan:
        for s, n in f.content:
            c[s] += n * f.times
    return c


def optimum(sizes, cap):
    """Fewest containers by exhaustive search with symmetry breaking."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= sizes[i] and rooms[j] not in rooms[:j]:
                rooms[j] -= sizes[i]
                go(i + 1, rooms)
                rooms[j] += sizes[i]
        go(i + 1, [*rooms, cap - sizes[i]])

    go(0, [])
    return best[0]


def test_bin_completion_is_valid_and_near_the_optimum():
    rnd = random.Random(7)
    worse = 0
    for _ in range(60):
        cap = rnd.choice([10, 15, 20])
        sizes = [rnd.randint(1, cap) for _ in range(rnd.randint(1, 9))]
        plan = packing.bin_completion(Counter(sizes), cap)
        assert spend(plan) == Counter(sizes) and all(sum(s * n for s, n in f.content) <= cap for f in plan)
        bins, least = sum(f.times for f in plan), optimum(sizes, cap)
        assert bins <= sum(f.times for f in packing.best_fit(Counter(sizes), cap))
        worse += bins > least
    assert worse <= 1


def test_large_histogram_reaches_the_volume_bound():
    rnd = random.Random(8)
    hist = Counter(min(2048, int(rnd.lognormvariate(5, 1)) + 1) for _ in range(200_000))
    plan = packing.bin_completion(hist, 2048)
    assert spend(plan) == hist
    bound = -(-sum(s * n for s, n in hist.items()) // 2048)
    assert sum(f.times for f in plan) <= bound * 1.001 + 1


def triplets(n, seed):
    """Items that fill n containers of 1,000 by threes without waste."""
    rnd, out = random.Random(seed), []
    for _ in range(n):
        a = rnd.randint(380, 490)
        b = rnd.randint(250, (1000 - a) // 2)
        out += [a, b, 1000 - a - b]
    return Counter(out)


@pytest.mark.parametrize("n,seed,over", [(20, 1, 0), (20, 2, 0), (40, 1, 0), (40, 2, 1), (80, 1, 1), (200, 1, 1)])
def test_triplets_with_a_perfect_packing(n, seed, over):
    hist = triplets(n, seed)
    plan = packing.bin_completion(hist, 1000, effort=6_000_000)
    assert spend(plan) == hist and all(sum(s * k for s, k in f.content) <= 1000 for f in plan)
    assert sum(f.times for f in plan) <= n + over < sum(f.times for f in packing.best_fit(hist, 1000)) - 3 * (n < 200)


def test_search_to_the_end_is_optimal():
    rnd = random.Random(11)
    for _ in range(150):
        cap = rnd.choice([10, 13, 20, 31])
        sizes = [rnd.randint(1, cap) for _ in range(rnd.randint(1, 9))]
        plan = packing.bin_completion(Counter(sizes), cap, effort=float('inf'))
        assert spend(plan) == Counter(sizes) and sum(f.times for f in plan) == optimum(sizes, cap)


def test_dominated_fillings_are_left_out():
    left = Counter([7, 6, 5, 4, 3, 3, 2])
    made = list(packing.fillings(left, sorted(left), 16, 15))
    assert ((7, 1), (2, 1)) not in made and ((7, 1), (6, 1), (3, 1)) in made
    assert all(16 - sum(s * n for s, n in c) < 2 for c in made)  # nothing left out still fits
    assert ((9, 1), (4, 1), (3, 1)) not in list(packing.fillings(Counter([9, 7, 4, 3]), [3, 4, 7, 9], 16, 15))  # 7 stands for 4 and 3


def test_lower_bound_counts_items_that_cannot_share():
    assert packing.lower_bound({6: 3}, 10) == 3 and packing.lower_bound({5: 4}, 10) == 2 and packing.lower_bound({}, 10) == 0


def pack(spark, sizes, cap=10):
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, tokens long")
    return packing.pack(packing.pieces(df, cap), cap).collect()


def test_every_item_once_and_no_container_overfull(spark):
    rnd = random.Random(9)
    sizes = [rnd.choice([0, 1, 3, 3, 3, 7, 10, 11, 25]) for _ in range(500)]
    rows = pack(spark, sizes)
    held, whole = Counter(), Counter()
    for r in rows:
        held[r.container] += r.token_end - r.token_start
        whole[r.doc_id] += r.token_end - r.token_start
    assert max(held.values()) <= 10 and [whole[i] for i in range(500)] == sizes and len(held) == max(held) + 1
    assert all(len([r for r in rows if r.doc_id == i]) == max(1, -(-n // 10)) for i, n in enumerate(sizes))


def test_empty_and_blank(spark):
    assert pack(spark, []) == []
    assert [r.container for r in pack(spark, [0, 0])] == [None, None]
    docs = spark.createDataFrame([(1, "hello world", "x"), (1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 9000, "x")], "doc_id long, text string, size string")
    rows = packing.pack_texts(docs).collect()
    n = count_tokens("word " * 9000)
    assert sorted(r.doc_id for r in rows) == [1, 2, 3] + [4] * -(-n // 2048)
    r = packing.fill_report(packing.pack_texts(docs)).first()
    assert r.tokens == n + count_tokens("hello world") and r.fullest <= 2048
