import random

from cairnlog.llm import runs

CATALOG = [(0, "<EMPTY>"), (1, "INFO opened <NUM> ms"), (2, "info: opened <*> ms!"), (3, "INFO opened file"), (None, "x"), (5, None)]


def catalog(spark, rows=CATALOG):
    return spark.createDataFrame(rows, "template_id int, pattern string")


def collapse(spark, rows, cat=None):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "sequence_id long, template_ids array<int>, line_ts_ms array<long>, events string")
    out = runs.collapse_runs(df, cat if cat is not None else catalog(spark)).collect()
    return sorted((r.seq_id, r.first_pos, r.last_pos, r.events, r.event_class, r.start_ts_ms, r.duration_ms) for r in out)


def test_near_identical_blank_and_null(spark):
    assert collapse(spark, [(1, [1, 2, 0, 1, None, 1, 3, 9, 9, 5], [10, 20, 25, 40, None, 50, 60, None, None, 5])]) == [
        (1, 0, 3, 3, 1, 10, 30), (1, 5, 5, 1, 1, 50, 0), (1, 6, 6, 1, 3, 60, 0), (1, 7, 8, 2, 9, None, None), (1, 9, 9, 1, 5, 5, 0),
    ]


def test_empty_null_repeated_and_clock_steps(spark):
    assert collapse(spark, []) == []
    assert collapse(spark, [(1, [], []), (2, None, None), (3, [0, None], [1, 2])]) == []
    assert collapse(spark, [(1, [3, 3], [50, 20]), (1, [3, 3], [50, 20])]) == [(1, 0, 1, 2, 3, 50, 0)]


def test_short_times_and_null_key(spark):
    got = [r for r in collapse(spark, [(1, [3, 3, 3], [5]), (2, [3], [7, 8])])]
    assert got == [(1, 0, 2, 3, 3, 5, 0), (2, 0, 0, 1, 3, 7, 0)]


def test_against_a_plain_loop_and_the_joined_way(spark, monkeypatch):
    rnd = random.Random(3)
    cls = {1: 1, 2: 1, 3: 3, 0: 0}
    rows = [(i, [rnd.choice([0, 1, 2, 3, 4, None]) for _ in range(rnd.randint(0, 30))], None) for i in range(60)]
    want = []
    for i, ids, _ in rows:
        run = None
        for p, x in enumerate(ids):
            if x is None:
                run = None
            elif x:
                c = cls.get(x, x)
                if run and run[4] == c:
                    run[2], run[3] = p, run[3] + 1
                else:
                    run = [i, p, p, 1, c, None, None]
                    want.append(run)
    assert collapse(spark, rows) == sorted(map(tuple, want))
    monkeypatch.setattr(runs, "CATALOG_LIMIT", -1)
    assert collapse(spark, rows) == sorted(map(tuple, want))


def test_form(spark):
    df = spark.createDataFrame([("ERROR: denied <IP>!",), ("error denied <IPV6>",), ("Error denied at",), ("",), (None,)], "p string")
    got = [r.f for r in df.select(runs.near_identical_form(df.p).alias("f")).collect()]
    assert got[0] == got[1] != got[2] and got[3] == "" and got[4] is None
