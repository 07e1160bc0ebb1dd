import pytest
from pyspark.sql import functions as F

from hushframe.operators import observe


def test_stages_of_a_job(spark):
    seen, stages = [], None
    stages = observe.Stages([lambda r: 1 / 0, lambda r: seen.append((r["stage"], r["rows"]))])
    df = spark.range(100).repartition(4)
    kept = stages.watch(stages.watch(df, "all").filter("id % 10 = 0"), "tens", most=F.max("id"), mean=F.avg("id"))
    assert kept.count() == 10
    got = {r.stage: (r.rows, dict(r.metrics)) for r in stages.counts(spark).collect()}
    assert got == {"all": (100, {}), "tens": (10, {"most": 90.0, "mean": 45.0})} and seen == [("all", 100), ("tens", 10)]
    with pytest.raises(ValueError):
        stages.watch(df, "all")
    with pytest.raises(ValueError):
        observe.watch(df, "x", rows=F.sum("id"))


def test_stages_of_a_stream(spark, tmp_path):
    for i in range(3):
        spark.range(10 * i, 10 * i + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    heard = observe.StageListener([seen.append, lambda r: 1 / 0], keep=4)
    spark.streams.addListener(heard)
    stream = observe.watch(spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "read", total=F.sum("id"))
    query = observe.watch(stream.filter("id % 2 = 0"), "even").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert heard.wait(query.id) and not heard.wait("nothing", 0.1)
    spark.streams.removeListener(heard)
    batches = [r for r in seen if r["rows"]]
    assert sum(r["rows"] for r in batches if r["stage"] == "read") == 30 and sum(r["rows"] for r in batches if r["stage"] == "even") == 15
    assert sum(r["metrics"].get("total", 0) for r in batches) == sum(range(30)) and {r["batch"] for r in batches} == {0, 1, 2}
    assert heard.counts(spark).count() == 4 and heard.counts(spark, "nothing").count() == 0
    total = {r.stage: r.batches for r in observe.totals(heard.counts(spark, query.id)).collect()}
    assert total == {"read": 2, "even": 2}
