import pytest
from pyspark.sql import functions as F

from hushframe.operators import calc, compaction
from hushframe.plans import registry


@pytest.mark.parametrize("name", ["math_snippets", "argument_checks"])
def test_rows_of_one_small_file_go_to_many_tasks(spark, name):
    rows = registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert rows.select(F.spark_partition_id()).distinct().count() >= 4


def test_names_give_way_in_resolved_expressions():
    assert calc.resolved("max(FINANCE_1, VALUE_1) + CALC_2 * 2", {"FINANCE_1": 1.5, "VALUE_1": 2.0}) == "max(1.5, 2) + CALC_2 * 2"
    assert calc.resolved("1e5 + x1 + 2x", {"x1": -0.0, "x": 3.0, "e5": 4.0}) == "1e5 + -0 + 2x" and calc.resolved("", {}) == ""


def test_summaries_are_judged_after_a_shuffle_and_without_a_window_too(spark):
    said = [("s", 1, "<<A_1>> and <<A_2>> with <<B_9>>"), ("s", None, "<<A_2>> <<B_9>> <<B_8>>"), (None, 1, "<<A_2>>"), ("r", 1, "<<A_2>> <<A_2>>"), ("r", 2, None), ("s", 3, "<<A_1>>")]
    rows = [(*x, ["<<A_1>>"]) for x in said] + [("s", 4, "<<A_2>>", None)]
    summaries = spark.createDataFrame(rows, "session string, window int, summary string, allowed array<string>")
    vault = spark.createDataFrame([("s", "<<A_2>>"), ("s", "<<A_2>>"), ("s", "<<B_8>>"), (None, "<<A_2>>")], "session string, placeholder string")
    out = compaction.verdict(summaries, vault)
    got = {(r.session, r.window): (r.accepted, r.repaired, r.foreign, r.renumbered) for r in out.collect()}
    assert got == {
        ("s", 1): (False, None, ["<<B_9>>"], ["<<A_2>>"]), ("s", None): (False, None, ["<<B_9>>"], ["<<A_2>>", "<<B_8>>"]), (None, 1): (False, None, [], ["<<A_2>>"]),
        ("r", 1): (True, "", ["<<A_2>>"], []), ("r", 2): (True, None, [], []), ("s", 3): (True, "<<A_1>>", [], []), ("s", 4): (True, "<<A_2>>", [], []),
    }
    # A broadcast vault would have a scan's whole share of the summaries gathered by window at once.
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
