import itertools

import pytest

from lodestar.operators import filters as f


def leaf(field, op, value):
    return {"field": field, "operator": op, "value": value}


def group(op, *conditions):
    return {"operator": op, "conditions": list(conditions)}


ROWS = [(1, "1.0", 5), (2, "2.0", None), (3, None, 7), (4, "3.0", 1)]


def ids(spark, tree):
    df = spark.createDataFrame(ROWS, "id int, x string, n int")
    return [r.id for r in f.where_tree(df, tree).orderBy("id").collect()]


@pytest.mark.parametrize(
    ("tree", "expected"),
    [
        (leaf("meta.x", "in", ["1.0"]), [1]),
        (leaf("x", "not in", ["1.0"]), [2, 4]),
        (leaf("x", "in", []), []),
        (group("AND", leaf("x", "==", "1.0"), leaf("n", "==", 5)), [1]),
        (group("OR", leaf("x", ">", "2.0"), leaf("n", "!=", 5)), [3, 4]),
        (group("NOT", leaf("x", ">", "1.0"), leaf("n", "!=", 5)), [1]),
        (group("NOT", group("NOT", leaf("n", ">=", 5))), [1, 3]),
        (group("NOT", group("AND", leaf("x", "==", "1.0"), leaf("n", "<", 9))), [2, 4]),
    ],
)
def test_trees(spark, tree, expected):
    assert ids(spark, tree) == expected


def test_double_not_is_the_filter(spark):
    for op, value in itertools.product(("==", "!=", ">", ">=", "<", "<="), (1, 5, 7)):
        tree = leaf("n", op, value)
        assert ids(spark, group("NOT", group("NOT", tree))) == ids(spark, tree)


@pytest.mark.parametrize("tree", [leaf("x", "~", 1), {"field": "x"}, leaf("x", ">", [1]), leaf("x", ">", True), leaf("x", "in", "a"), {"operator": "AND"}, {"operator": "XOR", "conditions": [leaf("x", "==", 1)]}])
def test_faulty_trees(spark, tree):
    with pytest.raises(ValueError):
        ids(spark, tree)


def test_empty_filter_is_refused(spark):
    with pytest.raises(ValueError):
        ids(spark, {})


def test_guard():
    pinned = leaf("meta.session_id", "==", "a")
    other = leaf("y", "==", 1)
    cases = [
        (pinned, True),
        (leaf("session_id", ">", "a"), False),
        (group("AND", pinned, other), True),
        (group("OR", pinned, other), False),
        (group("NOT", pinned), False),
        (group("OR", pinned, leaf("session_id", "in", ["a"])), True),
    ]
    assert [f.is_pinned(tree, "session_id") for tree, _ in cases] == [want for _, want in cases]
    with pytest.raises(ValueError):
        f.require_pinned(other, "session_id")


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame(ROWS, "id int, x string, n int").write.parquet(str(tmp_path / "t"))
    df = f.where_tree(spark.read.parquet(str(tmp_path / "t")), group("AND", leaf("x", "==", "1.0"), leaf("n", ">", 2))).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(x,1.0)" in plan and "GreaterThan(n,2)" in plan


# --- filters in text

TEXT_ROWS = [
    (1, "a&&b", 5, {"k": "v", "n": "3"}, '{"tags": ["t1", "t2"], "n": 1.5, "deep": {"x": "y"}}', ["p", "q"]),
    (2, "x in [q]", 7, {"k": "w"}, '{"tags": ["t2"], "n": 4, "ok": true}', []),
    (3, "it's || [1]", None, None, None, None),
    (4, None, 9, {}, '{"tags": [], "n": "many"}', ["q"]),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXT_ROWS, "id int, s string, n int, m map<string,string>, j string, tags array<string>")


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ('s == "a&&b"', [1]),
        ("s == 'x in [q]'", [2]),
        ('s == "it\'s || [1]"', [3]),
        ('s in ["a&&b", "x in [q]"] && n > 5', [2]),
        ('s in ["a&&b"] || n >= 9', [1, 4]),
        ('s not in ["a&&b"]', [2, 3]),
        ("s in []", []),
        ("s not in []", [1, 2, 3]),
        ("not (n == 5 || n == 7)", [4]),
        ('not (s == "a&&b" && n < 9)', [2, 3, 4]),
        ("5 < n", [2, 4]),
        ("n == 5 || n == 7 && s == 'nothing'", [1]),
        ("(n == 5 || n == 7) && s != 'a&&b'", [2]),
        ('s like "%&&%"', [1]),
        ('not s like "%&&%"', [2, 3]),
        ('m["k"] == "v"', [1]),
        ('m["k"] != "v"', [2]),
        ('j["n"] > 1', [1, 2]),
        ('j["ok"] == true', [2]),
        ('j["deep"]["x"] == "y"', [1]),
        ('json_contains(j["tags"], "t1")', [1]),
        ('not json_contains(j["tags"], "t1")', [2, 4]),
        ('json_contains_any(tags, ["p", "z"])', [1]),
        ('json_contains_all(j["tags"], ["t1", "t2"])', [1]),
        ("n + 1 > 7 && not (n - 9 = 0)", [2]),
        ("n is null", [3]),
        ("`n` >= 7 AND id IN (2, 4)", [2, 4]),
    ],
)
def test_filters_in_text(texts, text, expected):
    assert [r.id for r in f.where_raw(texts, text).orderBy("id").collect()] == expected


def test_text_and_tree_are_the_same(spark):
    tree = group("AND", leaf("x", "in", ["a", "b"]), group("OR", leaf("n", ">", 1.5), leaf("n", "==", -2), leaf("ok", "!=", True)))
    assert f.parse_filter(spark, "x in ['a', \"b\"] && (n > 1.5 || -2 == n or ok != true)") == tree
    assert f.parse_filter(spark, "meta.lang == 'en'") == leaf("meta.lang", "==", "en")


@pytest.mark.parametrize("text", ["", "  ", "x ==", "x in [1", "x == 1 ]", "x == 'a", "== 1", "x in ["])
def test_faulty_texts(spark, text):
    with pytest.raises(ValueError):
        f.parse_filter(spark, text)


@pytest.mark.parametrize(
    ("text", "pinned"),
    [
        ('session_id == "a"', True),
        ('session_id > "a"', False),
        ('session_id == "a" && y == 1', True),
        ('session_id == "a" || y == 1', False),
        ('not session_id == "a"', False),
        ('session_id == "a" or session_id in ["b"]', True),
        ('y == "session_id == 1"', False),
        ('session_id == other', False),
    ],
)
def test_guard_on_texts(spark, text, pinned):
    assert f.is_pinned(f.parse_filter(spark, text), "session_id") is pinned


def test_texts_reach_the_scan(spark, tmp_path):
    spark.createDataFrame(ROWS, "id int, x string, n int").write.parquet(str(tmp_path / "t"))
    df = f.where_raw(spark.read.parquet(str(tmp_path / "t")), 'x == "a&&b" && n in [1, 2] && x like "a%"').select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(x,a&&b)" in plan and "In(n, [1,2])" in plan and "StringStartsWith(x,a)" in plan
