"""Filings' facts: how often they are dealt and put in order, and marks that are no JSON."""

import pytest
from pyspark.sql import functions as F

from tickforge.operators import reported
from tickforge.plans.catalogue import QUERIES


@pytest.mark.parametrize("name", ["financial_record", "per_share_facts", "filing_headers"])
def test_facts_are_dealt_and_sorted_once(name, spark, sf):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert [plan.count(step) for step in ("FileScan", "Exchange hashpartitioning", "Sort [", "ObjectHashAggregate")] == [1, 1, 1, 0]


def test_scopes_are_read_from_members_and_axes(spark):
    axis, other = '[["x:ResultForecastAxis","y:ForecastMember"]]', '[["DividendAxis","AnnualMember"]]'
    annual = '[["AnnualDividendPaymentScheduleAxis","a:AnnualMember"]]'
    contexts = ["Current", "A_ResultMember", "A_ResultMember_ForecastMember", "A_AnnualMember", "A_", "A_ResultMember\n", "_ResultMember"]
    dims = ["", None, axis, other, annual, "broken", " [] ", "[null]", '[["ResultForecastAxis"]]', '{"a": 1}']
    frame = spark.createDataFrame([(c, "") for c in contexts] + [("Current", d) for d in dims], "c string, d string")
    wide = lambda dividend: [r.w for r in frame.select(reported.company_wide(F.col("c"), F.col("d"), F.lit(dividend)).alias("w")).collect()]
    assert wide(False) == [True, True, True, False, False, False, True] + [True, True, True, False, False, False, True, False, False, False]
    assert wide(True) == [True, True, True, True, False, False, True] + [True, True, True, False, True, False, True, False, False, False]


def test_numbers_and_days(spark):
    texts = [" 1,200 ", "△350", "(45)", "▲7", "（5）", "(注1)", "(注)5", "-3", "3.5e2", ".5", "5.", "", "－", "1 2", "△-4", "5\n"]
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(reported.numeric(F.col("t")).alias("v")).collect()]
    assert got == [1200.0, -350.0, -45.0, -7.0, None, None, None, -3.0, 350.0, 0.5, 5.0, None, None, None, 4.0, 5.0]
    days = ["2024-6-3", "2024-02-30", "2024-06-30T00", "2024-06", "n/a", ""]
    got = [str(r.d) for r in spark.createDataFrame([(t,) for t in days], "t string").select(reported.day(F.col("t")).alias("d")).collect()]
    assert got == ["2024-06-03", "None", "2024-06-30", "None", "None", "None"]
