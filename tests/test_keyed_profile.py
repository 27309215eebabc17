import math
import random
from collections import Counter, defaultdict
from decimal import Decimal

from pyspark.sql import functions as F

from cairnlog.operators import keyed_profile as kp
from cairnlog.operators.keyed_profile import keyed_profile


def brute(rows, qs):
    by = defaultdict(list)
    for k, v in rows:
        by[k].append(v)
    out = {}
    for k, vs in by.items():
        known = sorted(v for v in vs if v is not None)
        pick = lambda q: known[max(1, math.ceil(len(known) * q)) - 1] if known else None  # noqa: E731, B023
        out[k] = (len(vs), sum(known) if known else None, max(known) if known else None, *[pick(q) for q in qs])
    return out


def run(spark, rows, qs=(0.5, 0.95)):
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "id int, v long, rows string, k int")
    return {r.k: (r.rows, r.total, r.largest, *[r[f"p{round(q * 100)}"] for q in qs]) for r in keyed_profile(df, "id", "v", qs).collect()}


def test_against_brute_force_with_a_hot_key(spark):
    rnd = random.Random(5)
    rows = [(7 if rnd.random() < 0.5 else rnd.randint(0, 40), rnd.choice([None, rnd.randint(-5, 5), rnd.randint(-(10**12), 10**12)])) for _ in range(3000)] + [(None, 3), (None, None), (99, None)]
    assert run(spark, rows) == brute(rows, (0.5, 0.95))


def test_extremes_ties_and_one_value(spark):
    rows = [(1, -(2**63)), (1, 2**63 - 1), (2, 5), (2, 5), (2, 5)]
    got = run(spark, rows, (0.5,))
    assert got[2] == (3, 15, 5, 5) and got[1][0] == 2 and got[1][3] == -(2**63)


def test_empty_and_all_null(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, None)]) == {1: (1, None, None, None, None)}


def test_rounds_count_only_what_a_quantile_still_needs(spark):
    counts = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") * 7).alias("v"), F.lit(1).cast("long").alias("n"))
    seen = []
    histogram = kp.histogram

    def counting(coded, state, digit):
        h = histogram(coded, state, digit)
        seen.append((state is None, h.count(), h.groupBy("k", *([] if state is None else ["q"])).count().agg(F.max("count")).first()[0]))
        return h

    kp.histogram = counting
    try:
        got = {r.q: r.v for r in kp.select_ranks(counts, (0.5, 0.95)).collect()}
    finally:
        kp.histogram = histogram
    assert got == {0.5: 9999 * 7, 0.95: 18999 * 7}
    assert len(seen) == 3 and seen[0][0] and all(most <= 256 and rows <= 512 for _, rows, most in seen)


def heavy(spark, keys, share):
    df = spark.createDataFrame([(k, "x") for k in keys], "id long, rows string")
    return {r.k: r.rows for r in kp.heavy_keys(df, "id", share).collect()}


def test_heavy_keys_against_counts(spark):
    rnd = random.Random(6)
    keys = [rnd.choice([None, -1, 0, 5, 5, 5, 2**63 - 1, -(2**63), rnd.randint(-(2**40), 2**40)]) for _ in range(2000)]
    for share in ("0.02", "0.1", "0.25"):
        assert heavy(spark, keys, share) == {k: n for k, n in Counter(keys).items() if k is not None and n >= Decimal(share) * len(keys)}
    assert heavy(spark, [], "0.02") == {} and heavy(spark, [None] * 5, "0.02") == {}
    assert heavy(spark, [3] * 50, "1") == {3: 50} and heavy(spark, [1] * 7 + list(range(100, 193)), "0.07") == {1: 7}  # exactly the share
