import json

import pytest
from pyspark.sql import functions as F

from hushframe.functions import schemas

SAMPLE = {
    "type": "object",
    "properties": {
        "query": {"type": "string", "minLength": 2},
        "count": {"type": "integer", "minimum": 1, "maximum": 10},
        "mode": {"type": "string", "enum": ["fast", "full"]},
        "meta": {"type": "object", "properties": {"tag": {"type": "string"}, "flags": {"type": "array", "items": {"type": "string"}}}, "required": ["tag"]},
    },
    "required": ["query", "count"],
}


def told(spark, schema, *values):
    df = spark.createDataFrame([(i, v if isinstance(v, str) or v is None else json.dumps(v)) for i, v in enumerate(values)], "i int, t string")
    return [r.told for r in df.select("i", schemas.violations(F.col("t"), schema).alias("told")).orderBy("i").collect()]


def cast(spark, schema, *values):
    df = spark.createDataFrame([(i, v if isinstance(v, str) or v is None else json.dumps(v)) for i, v in enumerate(values)], "i int, t string")
    return [r.c for r in df.select("i", schemas.cast(F.col("t"), schema).alias("c")).orderBy("i").collect()]


def test_messages(spark):
    got = told(
        spark, SAMPLE, {"query": "hi"}, {"query": "hi", "count": 0}, {"query": "hi", "count": "2"}, {"query": "h", "count": 2, "mode": "slow"},
        {"query": "hi", "count": 2, "meta": {"flags": [1, "ok"]}}, {"query": "hi", "count": 2, "extra": "x"}, {"query": "hi", "count": True}, {"query": None, "count": 11},
    )
    assert got == [
        ["missing required count"], ["count must be >= 1"], ["count should be integer"], ["query must be at least 2 chars", "mode must be one of ['fast', 'full']"],
        ["missing required meta.tag", "meta.flags[0] should be string"], [], ["count should be integer"], ["query should be string", "count must be <= 10"],
    ]
    assert told(spark, SAMPLE, "[1]", '"x"', "null", "1.5", "7", "true", "no json", None) == [[f"parameters must be an object, got {k}"] for k in ("list", "str", "NoneType", "float", "int", "bool", "no JSON", "no JSON")]
    with pytest.raises(ValueError):
        schemas.violations(F.lit("x"), {"type": "array"})


def test_nulls_and_unions(spark):
    schema = {"properties": {"path": {"type": ["string", "null"], "maxLength": 3}, "flag": {"type": "boolean", "nullable": True}, "any": {}}}
    assert told(spark, schema, {"path": None, "flag": None, "any": None}, {"path": "abcd", "flag": 1, "any": [1]}, {}) == [[], ["path must be at most 3 chars", "flag should be boolean"], []]
    assert schemas.type_of({"type": ["null"]}) == (None, True) and schemas.type_of({}) == (None, False) and schemas.type_of({"type": ["string", "null"]}) == ("string", True)


def test_enums_of_any_type(spark):
    schema = {"properties": {"x": {"enum": [1, "1", None, True, [1, 2]]}}}
    assert told(spark, schema, *({"x": v} for v in (1, 1.0, "1", None, True, [1, 2], False, 2, "x", [2, 1]))) == [[]] * 6 + [["x must be one of [1, '1', None, True, [1, 2]]"]] * 4


def test_arrays_within_arrays(spark):
    schema = {"properties": {"rows": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "array", "items": {"type": "object", "properties": {"n": {"type": "number", "minimum": 0}}, "required": ["n"]}}}}}
    assert told(spark, schema, {"rows": []}, {"rows": [[], [], []]}, {"rows": [[{"n": 1.5}, {"n": -1}], 5]}, {"rows": [[{}, {"n": "x"}]]}) == [
        ["rows must have at least 1 items"], ["rows must be at most 2 items"], ["rows[0][1].n must be >= 0", "rows[1] should be array"], ["missing required rows[0][0].n", "rows[0][1].n should be number"],
    ]


def test_odd_names(spark):
    schema = {"properties": {"a b": {"type": "integer"}, "c.d": {"type": "string"}, "e'f": {"type": "string"}}, "required": ["c.d"]}
    assert told(spark, schema, {"a b": "x", "c.d": "y", "e'f": 1}, {"a b": 1}) == [["a b should be integer", "e'f should be string"], ["missing required c.d"]]
    with pytest.raises(ValueError):
        schemas.violations(F.lit("{}"), {"properties": {'a"b': {"type": "string"}}})


def test_casts(spark):
    schema = {"type": "object", "properties": {"n": {"type": "integer"}, "x": {"type": "number"}, "b": {"type": "boolean"}, "s": {"type": "string"}, "l": {"type": "array", "items": {"type": "integer"}}, "o": {"type": "object", "properties": {"n": {"type": "integer"}}}}}
    one = lambda **v: json.loads(cast(spark, schema, v)[0])
    assert one(n="42", x="3.14", b="Yes", s=5, l=["1", 2, "x"], o={"n": "7", "other": "8"}, more=[1]) == {"n": 42, "x": 3.14, "b": True, "s": "5", "l": [1, 2, "x"], "o": {"n": 7, "other": "8"}, "more": [1]}
    assert one(n="4.2", x="abc", b="maybe", s=None, l="1", o="x") == {"n": "4.2", "x": "abc", "b": "maybe", "s": None, "l": "1", "o": "x"}
    assert one(n=True, x=None, b="0", s='quo"te\n', l=[], o={}) == {"n": True, "x": None, "b": False, "s": 'quo"te\n', "l": [], "o": {}}
    assert one(s=True, n=" -5 ", x="nan") == {"s": "True", "n": -5, "x": "nan"}
    assert cast(spark, schema, "no json", None, "[1]") == ["no json", None, "[1]"]
