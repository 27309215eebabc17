import json

from cairnlog.operators import schema_drift as sd

FULL = {"schema_version": 4, "source": {}, "filters": [], "everything_else_active": True, "selected_filter": None, "show_templates": False, "log_font_size": 12.5, "timeline_display_mode": "bars", "pins": []}
FILTER = {"text": "a", "active": True, "case_sensitive": False, "exclude": False, "regex": False, "template_id": 12345, "field_query": None}


def changes(spark, bodies):
    rows = [(i, b if b is None or isinstance(b, str) else json.dumps(b), "x") for i, b in bodies]
    return {tuple(r) for r in sd.schema_changes(spark.createDataFrame(rows, "sidecar_id long, body string, field string")).collect()}


def test_current_layout_and_no_objects_give_nothing(spark):
    assert changes(spark, [(1, FULL | {"filters": [FILTER]}), (2, None), (3, ""), (4, "[1]"), (5, json.dumps(FULL)[:-5]), (6, "null"), (7, '{"a": NaN}')]) == set()


def test_empty_table(spark):
    assert changes(spark, []) == set()
    assert sd.unify(spark.createDataFrame([], "sidecar_id long, body string")).count() == 0


def test_rename_retype_remove_add(spark):
    old = {k: v for k, v in FULL.items() if k not in ("schema_version", "pins")} | {"schemaVersion": "3", "theme": "dark"}
    f = {k: v for k, v in FILTER.items() if k not in ("template_id", "regex")} | {"templateId": 7.0, "exclude": "no"}
    got = changes(spark, [(1, old | {"filters": [FILTER, f, f]}), (1, old | {"filters": [FILTER, f, f]}), (2, FULL | {"filters": [FILTER] * 3})])
    assert got == {
        (1, "schema_version", "renamed"), (1, "schema_version", "retyped"), (1, "theme", "added"), (1, "pins", "removed"),
        (1, "filters.template_id", "renamed"), (1, "filters.template_id", "retyped"), (1, "filters.exclude", "retyped"), (1, "filters.regex", "removed"),
    }


def test_unlike_names_meet_by_their_values(spark):
    f = {k: v for k, v in FILTER.items() if k != "template_id"}
    bodies = [(i, FULL | {"filters": [f | {"cluster": 10000 + i, "priority": i % 5}]}) for i in range(40)] + [(100 + i, FULL | {"filters": [FILTER | {"template_id": 11000 + i}]}) for i in range(40)]
    got = changes(spark, bodies)
    assert (3, "filters.template_id", "renamed") in got and (3, "filters.priority", "added") in got
    assert not any(kind == "removed" for _, _, kind in got)


def test_filters_that_are_no_array(spark):
    assert changes(spark, [(1, FULL | {"filters": {"a": 1}})]) == {(1, "filters", "retyped")}


def test_unify(spark):
    old = {k: v for k, v in FULL.items() if k != "schema_version"} | {"version": "2", "log_font_size": "12pt", "everything_else_active": "yes"}
    f = {k: v for k, v in FILTER.items() if k != "template_id"} | {"template": "T{42}"}
    df = spark.createDataFrame([(1, json.dumps(old | {"filters": [f]})), (1, json.dumps(old | {"filters": [f]})), (2, None)], "sidecar_id long, body string")
    (r,) = sd.unify(df).collect()
    assert (r.record_id, r.schema_version, r.log_font_size, r.everything_else_active) == (1, 2, 12.0, True)
    assert r.filters[0].template_id == 42 and r.filters[0].text == "a"


def test_assignment_is_optimal():
    import itertools
    import random

    rnd = random.Random(1)
    for _ in range(60):
        n, m = rnd.randint(1, 5), rnd.randint(1, 5)
        s = [[rnd.random() for _ in range(m)] for _ in range(n)]
        got = sum(s[i][j] for i, j in enumerate(sd.assign(s)) if j >= 0)
        cols = list(range(m)) + [None] * n
        best = max(sum(s[i][j] for i, j in enumerate(p) if j is not None) for p in itertools.permutations(cols, n))
        assert abs(got - best) < 1e-9
