from collections import Counter

import pytest

from cairnlog.llm import mixing
from cairnlog.llm.mixing import Demand

FLAT = [(0.0, 1.0), (1.0, 1.0)]


def demand(share, schedule=FLAT):
    d = Demand(schedule)
    d.share = d.share / d.total * share
    return d


def mix(spark, rows, shares, caps, schedules=None):
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    return mixing.mix(df, {s: demand(x, (schedules or {}).get(s, FLAT)) for s, x in shares.items()}, caps).collect()


def test_shares_caps_and_order(spark):
    rows = [(i, "a", 10) for i in range(1000)] + [(5000 + i, "b", 5) for i in range(100)] + [(9000, "c", 7), (9001, None, 7), (9002, "a", 0)]
    got = mix(spark, rows, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3})
    tokens = Counter()
    for r in got:
        tokens[r.source] += r.tokens
    assert tokens["b"] == 1500 and abs(tokens["a"] - 1500) <= 10
    uses = Counter(r.doc_id for r in got)
    assert max(uses[d] for d in uses if d >= 5000) == 3 and max(uses[d] for d in uses if d < 5000) == 1
    assert [r.position for r in got] == sorted(r.position for r in got) and 0 <= got[0].position and got[-1].position <= 1
    half = [r for r in got if r.position < 0.5]
    assert abs(sum(r.tokens for r in half if r.source == "a") - 750) <= 20


def test_curriculum_moves_a_source_to_the_end(spark):
    rows = [(i, s, 10) for i, s in enumerate("ab" * 500)]
    got = mix(spark, rows, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}, {"a": [(0.0, 2.0), (1.0, 0.0)], "b": [(0.0, 0.0), (1.0, 2.0)]})
    early = Counter(r.source for r in got if r.position < 0.5)
    assert early["a"] == pytest.approx(375, abs=8) and early["b"] == pytest.approx(125, abs=8)


def test_hot_source_is_summed_in_parts(spark):
    rows = [(i, "a", 1 + i % 3) for i in range(3000)]
    assert sum(r.tokens for r in mix(spark, rows, {"a": 1.0}, {"a": 2})) == 2 * sum(r[2] for r in rows)


def test_empty_and_absent(spark):
    assert mix(spark, [], {"a": 1.0}, {"a": 1}) == []
    assert {r.source for r in mix(spark, [(1, "a", 3)], {"a": 0.4, "zz": 0.6}, {"a": None})} == {"a"}


def test_documents_and_report(spark):
    docs = spark.createDataFrame([(1, "one two three", "a"), (1, "one two three", "a"), (2, "four", "b"), (3, None, "b"), (4, "x", None)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.25, 4), ("q", 0.25, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mix_documents(docs, targets)
    assert {r.doc_id for r in got.collect()} <= {1, 2}
    rep = {r.source: r for r in mixing.report(got, targets).collect()}
    assert rep["q"].tokens == 0 and rep["b"].uses <= 4 and abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-9
