import math

import pytest
from pyspark.sql import functions as F

from latticework.functions import values as V

SAMPLES = [None, True, False, 0, 1, -7, 1.0, -0.0, 0.0, 1e16, 1e-05, 0.1, float("inf"), float("nan"), "", "1", "it's", 'q"', "a\\b", "Zoë Δ", [1, 1.0, "x", [None]], {"b": 1, "a": [True]}, [], {}]


def test_round_trip():
    for value in SAMPLES:
        back = V.decode(*V.encode(value))
        assert back == value or (isinstance(value, float) and math.isnan(back))
        assert type(back) is type(value)


def test_refused_values():
    with pytest.raises(ValueError):
        V.encode((1, 2))
    deep = []
    for _ in range(40):
        deep = [deep]
    with pytest.raises(ValueError):
        V.encode(deep)
    assert V.encode(2**70)[0] == "float"


def strict(a, b):
    def plain(x):
        return (type(x).__name__, [plain(y) for y in x] if isinstance(x, list) else {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else x)

    return plain(a) == plain(b) if not (isinstance(a, float) and math.isnan(a)) else False


def test_three_equalities(spark):
    n = len(SAMPLES)
    df = spark.createDataFrame([(i, V.encode(v)) for i, v in enumerate(SAMPLES)], f"i int, x {V.VALUE_TYPE}")
    df = df.select("i", V.strict_key(F.col("x")).alias("s"), V.loose_key(F.col("x")).alias("l"), V.text_key(F.col("x")).alias("t"))
    rows = {r["i"]: r for r in df.collect()}
    for i in range(n):
        a = SAMPLES[i]
        assert rows[i]["t"] == V.python_text(*V.encode(a))
        for j in range(n):
            b = SAMPLES[j]
            assert (rows[i]["s"] is not None and rows[i]["s"] == rows[j]["s"]) == strict(a, b), (a, b)
            if not isinstance(a, (list, dict)) and not isinstance(b, (list, dict)):
                assert (rows[i]["l"] is not None and rows[i]["l"] == rows[j]["l"]) == (a == b), (a, b)


def test_present_null_differs_from_missing(spark):
    df = spark.createDataFrame([({"k": V.encode(None)},), ({},)], f"props {V.PROPS_TYPE}")
    assert [r[0] for r in df.select(F.map_contains_key("props", F.lit("k"))).collect()] == [True, False]
    assert [r[0] for r in df.select(V.identity_key(df, ["k"])).collect()] == ["k=None", None]


def test_overlay(spark):
    df = spark.range(1).select(V.props_lit({"a": 1, "b": 2}).alias("x"), V.props_lit({"b": 3, "c": None}).alias("y"))
    last, first = df.select(V.overlay(F.col("x"), F.col("y")), V.overlay(F.col("x"), F.col("y"), last_wins=False)).first()
    assert V.decode_props(last) == {"a": 1, "b": 3, "c": None}
    assert V.decode_props(first) == {"a": 1, "b": 2, "c": None}


def test_loose_equality_reaches_into_lists_and_maps(spark):
    from latticework.functions import values as V

    same = [([1], [1.0]), ([True], [1]), ({"x": 1}, {"x": 1.0}), ([[1, {"a": False}]], [[1.0, {"a": 0}]]), ([10**16], [1e16]), ([0.0], [-0.0]), (["1"], ["1"]), ([None], [None]), ([1.5, "a"], [1.5, "a"])]
    other = [([1], ["1"]), (['["int","1"]'], ['["float","1.0"]']), ([[1]], ['["int","1"]']), ([float("nan")], [float("nan")]), ([1, 2], [2, 1]), ([None], []), ([1.5], [1.25]), ({"x": 1}, {"y": 1})]
    rows = [(i, a, b) for i, (a, b) in enumerate(same + other)]
    df = spark.createDataFrame([(i, V.encode(a), V.encode(b)) for i, a, b in rows], "i int, a struct<t:string,v:string>, b struct<t:string,v:string>")
    got = {r["i"]: r["same"] for r in df.selectExpr("*").select("i", (V.loose_key(df["a"]) == V.loose_key(df["b"])).alias("same")).collect()}
    for i, a, b in rows:
        want = i < len(same)
        assert bool(got[i]) == want, (a, b)
        assert V.decode(*V.encode(a)) == a or a != a or "nan" in repr(a)


def test_strict_equality_of_nested_values(spark):
    from latticework.functions import values as V

    cases = [([1], [1.0], False), ([0.0], [-0.0], True), ([[float("nan")]], [[float("nan")]], False), ([1, "a"], [1, "a"], True)]
    df = spark.createDataFrame([(i, V.encode(a), V.encode(b)) for i, (a, b, _) in enumerate(cases)], "i int, a struct<t:string,v:string>, b struct<t:string,v:string>")
    got = {r["i"]: bool(r["same"]) for r in df.select("i", (V.strict_key(df["a"]) == V.strict_key(df["b"])).alias("same")).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(cases)}
