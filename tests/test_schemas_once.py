from pyspark.sql import functions as F

from hushframe.functions import schemas


def test_arguments_are_parsed_once_however_many_properties_a_schema_has(spark):
    schema = {"type": "object", "properties": {f"p{i}": {"type": "integer", "minimum": 1, "maximum": 5} for i in range(4)}, "required": ["p0"]}
    rows = spark.createDataFrame([('{"p0": 0, "p1": "7", "p2": 9}',), ("[1]",), (None,)], "a string")
    for made in (schemas.violations(F.col("a"), schema), schemas.cast(F.col("a"), schema)):
        plan = rows.select(made.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson") == 1, plan
    got = [r.x for r in rows.select(schemas.violations(schemas.cast(F.col("a"), schema), schema).alias("x")).collect()]
    assert got == [["p0 must be >= 1", "p1 must be <= 5", "p2 must be <= 5"], ["parameters must be an object, got list"], ["parameters must be an object, got no JSON"]]
