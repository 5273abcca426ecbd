"""Queries against their SQL on small tables of the kind that only large ones hold: keys over four digits, lists of bad items alone, ties."""

import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import functions as F
from test_catalogue import bag

from tickforge.functions.columns import implied_volatility
from tickforge.plans.catalogue import ORACLE_SQL, QUERIES
from tickforge.plans.technical import decimal_sum


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(folder):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{folder}/{file}/*.parquet'")
    got = con.execute(ORACLE_SQL[name])
    df, columns = QUERIES[name](spark, folder), [c[0] for c in got.description]
    have, want = bag(df.columns, [tuple(r) for r in df.collect()]), bag(columns, got.fetchall())
    assert want and have == want


@pytest.mark.parametrize("name", ["chart_documents", "daily_object_bars", "daily_objects", "supply_pages"])
def test_stocks_that_share_a_code_are_documents_of_their_own(name, spark, tmp_path):
    # Codes are cut to four digits: 1234 and 12340 to 12345 share one.
    keys, days = [7, 1234, *range(12340, 12346)], [dt.datetime(2000, 5, 1) + dt.timedelta(days=2 * i) for i in range(31)]
    rows = [(i, i, k, 1, 10.0 + i % 3, 900.0 + 13 * i, day) for i, (k, day) in enumerate((k, day) for k in keys for day in days)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    same_as_sql(spark, str(tmp_path), name)


def test_a_list_of_bad_items_alone_is_null(spark, tmp_path):
    rows = [(i, k, "signup") for k, ids in {1: [5, 10], 2: [15, 3, 21, 4, 7], 3: [20]}.items() for i in ids]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    same_as_sql(spark, str(tmp_path), "codecs")
    assert {r.k: r.decoded for r in QUERIES["codecs"](spark, str(tmp_path)).collect()} == {1: None, 2: "21|3|4", 3: None}


@pytest.mark.parametrize("name", ["implied_vol", "disclosure_sides"])
def test_rows_of_one_small_file_are_dealt_over_tasks(name, spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/part.parquet").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() >= 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_no_volatility_where_none_has_the_price_or_a_value_is_missing(spark):
    rows = [(10.45, 100.0, 100.0, 1.0), (0.001, 100.0, 90.0, 1.0), (101.0, 100.0, 100.0, 1.0), (None, 100.0, 100.0, 1.0), (10.0, 100.0, 100.0, 0.0)]
    frame = spark.createDataFrame(rows, "p double, s double, x double, t double")
    got = [r.v for r in frame.select(implied_volatility(F.col("p"), F.col("s"), F.col("x"), F.col("t"), F.lit(0.05)).alias("v")).collect()]
    assert abs(got[0] - 0.2) < 1e-3 and got[1:] == [None] * 4


def test_a_sum_of_rounded_values_is_that_of_decimals(spark):
    assert spark.createDataFrame([([0.1] * 10,)], "vs array<double>").select(decimal_sum("vs")).first()[0] == 1.0
