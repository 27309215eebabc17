import random
from collections import defaultdict

from cairnlog.llm import sequence_mining as sm


def brute(rows, least, gap=4, lo=3, hi=5):
    seen = defaultdict(set)

    def grow(ids, path):
        if len(path) >= lo:
            seen["-".join(str(ids[p]) for p in path)].add(entity)
        if len(path) < hi:
            for q in range(path[-1] + 1, min(len(ids), path[-1] + gap + 1)):
                if ids[q] and ids[q] not in [ids[p] for p in path]:
                    grow(ids, [*path, q])

    for entity, ids in rows:
        if entity is not None:
            for p in range(len(ids or [])):
                if ids[p]:
                    grow(ids, [p])
    return {k: len(v) for k, v in seen.items() if len(v) >= least}


def mine(spark, rows, **kw):
    df = spark.createDataFrame([(e, i, "clash") for e, i in rows], "source_file string, template_ids array<int>, items string")
    return {r.pattern: r.support for r in sm.frequent_subsequences(df, **kw).collect()}


def data(seed, n=60):
    rnd = random.Random(seed)
    return [(rnd.choice([None, *"abcdefghij"]), [rnd.choice([0, None, 1, 2, 3, 4, 5]) for _ in range(rnd.randint(0, 14))]) for _ in range(n)]


def test_against_brute_force(spark):
    rows = data(1)
    assert mine(spark, rows, share=0.5) == brute(rows, 5)


def test_steps_by_joins_and_many_parts(spark, monkeypatch):
    rows = data(2, 60)
    want = brute(rows, 4)
    assert want and mine(spark, rows, share=0.4) == want
    monkeypatch.setattr(sm, "MAX_PAIRS", 0)
    assert mine(spark, rows, share=0.4) == want
    monkeypatch.setattr(sm, "PER_PART", 2)
    assert mine(spark, rows, share=0.4) == want
    monkeypatch.setattr(sm, "COUNTED", 3)
    monkeypatch.setattr(sm, "MAX_PAIRS", 10_000)
    assert mine(spark, rows, share=0.4) == want


def test_empty_null_repeated_hot(spark):
    assert mine(spark, []) == {} and mine(spark, [("a", None), ("b", [])]) == {} and mine(spark, [(None, [1, 2, 3])] * 5) == {}
    assert mine(spark, [("a", [1, 2, 3])] * 50 + [("b", [1, 0, None, 2, 3]), ("c", [1, 2, 9, 9, 9, 3])]) == {"1-2-3": 3}
    assert mine(spark, [("a", [1, 2, 3]), ("b", [1, 2, 3])]) == {}  # fewer than three


def test_an_automaton_has_the_patterns_of_its_pivot():
    rnd = random.Random(4)
    for _ in range(60):
        ids = [rnd.randint(1, 6) for _ in range(rnd.randint(3, 14))]
        rank = {x: (rnd.randint(0, 3), x) for x in range(1, 7)}
        moves = {p: [q for q in range(p + 1, min(len(ids), p + 5)) if ids[q] != ids[p]] for p in range(len(ids))}
        want = defaultdict(set)
        for w in brute([("e", ids)], 1):
            w = tuple(map(int, w.split("-")))
            want[max(w, key=rank.get)].add(w)
        for pivot in set(ids):
            a = sm.automaton_of(ids, moves, rank, pivot, 3, 5)
            assert (sm.words_of(a) if a else set()) == want[pivot]


def test_united_automata_and_growth_on_them():
    moves = lambda ids: {p: list(range(p + 1, min(len(ids), p + 5))) for p in range(len(ids))}
    rank = {x: (0, x) for x in range(9)}
    a, b = ([sm.automaton_of(ids, moves(ids), rank, 5, 3, 5) for ids in ([1, 2, 5, 3], [2, 5, 1, 4])])
    assert sm.words_of(sm.united([a, b])) == sm.words_of(a) | sm.words_of(b)
    grown = sm.grow({a: 2, b: 1}, 2, 5)
    assert grown == {w: 2 for w in sm.words_of(a) - sm.words_of(b)} | {w: 3 for w in sm.words_of(a) & sm.words_of(b)}


def test_equal_continuations_are_one_state():
    ids = [1, 2, 3, 9, 1, 2, 3]
    moves = {0: [1], 1: [2], 4: [5], 5: [6]}
    a = sm.automaton_of(ids, moves, {x: (0, x) for x in ids}, 3, 3, 5)
    assert sm.words_of(a) == {(1, 2, 3)} and a.count("|") == 3
