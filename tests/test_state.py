"""Versions, replaced documents, refreshed projections, deferred tails, search by postings, merged ranges: against plain loops and under failures."""

import datetime as dt
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from tickforge.operators import coverage
from tickforge.operators.search import TextIndex
from tickforge.sources.versions import Conflict, Versions
from tickforge.streaming import deferred


def files(path):
    return {os.path.join(d, f): hashlib.sha256(open(os.path.join(d, f), "rb").read()).hexdigest() for d, _, fs in os.walk(path) for f in fs}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# Versions


def test_readers_see_a_version_whole_and_writers_conflict(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "v"))
    one, two = spark.range(5).withColumn("x", F.lit(1)), spark.range(7).withColumn("x", F.lit(2))
    assert store.publish({"a": one, "b": one}) == 1
    reader = store.read("a")
    base = store.version()
    assert store.publish({"a": two, "b": two}) == 2
    assert reader.count() == 5 and store.read("a").count() == store.read("b").count() == 7 and store.read("b", 1).count() == 5
    with pytest.raises(Conflict):
        store._commit(base, {"a": {"schema": one.schema.json(), "parts": {}}})
    assert store.version() == 2 and store.read("a").count() == 7


def test_a_failed_snapshot_changes_no_table(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "v"))
    good = spark.range(4).select(F.col("id").alias("k"), F.lit(1).alias("x"))
    store.upsert({"a": (good, ["k"]), "b": (good, ["k"])})
    bad = good.withColumn("x", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        store.upsert({"a": (good.withColumn("x", F.lit(9)), ["k"]), "b": (bad, ["k"])})
    assert store.version() == 1 and {r.x for r in store.read("a").collect()} == {1}
    newer = spark.createDataFrame([(3, 5), (8, 5)], "k long, x int")
    store.upsert({"a": (newer, ["k"]), "b": (newer, ["k"])})
    assert rows(store.read("a")) == rows(store.read("b")) == [(0, 1), (1, 1), (2, 1), (3, 5), (8, 5)]


def test_replaced_documents_leave_other_buckets_byte_for_byte(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "v"))
    lines = spark.range(400).select((F.col("id") % 100).alias("doc"), F.col("id").alias("line"))
    store.replace_documents("t", lines, lines.select("doc"), "doc", 16)
    before, parts = files(tmp_path / "v" / "data"), store.manifest()["tables"]["t"]["parts"]
    batch = spark.createDataFrame([(3, 1000), (3, 1001), (500, 1002), (77, 1003)], "doc long, line long")
    asked = spark.createDataFrame([(3,), (4,), (500,)], "doc long")  # 4 has no row any more; 77 was not asked for
    want = sorted([r for r in rows(lines) if r[0] not in (3, 4)] + [(3, 1000), (3, 1001), (500, 1002)], key=repr)
    for _ in range(2):
        store.replace_documents("t", batch, asked, "doc", 16)
        assert rows(store.read("t")) == want
    after = store.manifest()["tables"]["t"]["parts"]
    assert sum(after[b] == parts[b] for b in parts) >= 12
    now = files(tmp_path / "v" / "data")
    assert all(now[f] == x for f, x in before.items())
    assert store.vacuum(1) >= 1 and rows(store.read("t")) == want
    store.replace_documents("t", batch, asked.limit(0), "doc", 16)
    assert rows(store.read("t")) == want


def test_a_refresh_sweeps_what_the_run_did_not_touch(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "v"))
    made = lambda keys, run: spark.createDataFrame([(k, run, None) for k in keys], "k long, at long, day string")
    first = store.refresh("p", made(range(5), 10), "k", "at", F.lit(10), ("day", F.lit("d1")))
    assert first == {"fresh": 5, "removed": 0, "version": 1}
    assert store.refresh("p", made(range(3), 10), "k", "at", F.lit(20))["version"] == 1  # only stale rows: nothing changes
    done = store.refresh("p", made([1, 2, 9], 20), "k", "at", F.lit(20), ("day", F.lit("d2")))
    assert done == {"fresh": 3, "removed": 3, "version": 2}
    assert rows(store.read("p")) == [(1, 20, "d2"), (2, 20, "d2"), (9, 20, "d2")]
    assert rows(store.read("p", 1))[0] == (0, 10, "d1")


# Deferred tails

SCHEMA = "id long, ts timestamp, v long"


def stamped(spark, made):
    return spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), v) for i, s, v in made], SCHEMA)


def test_runs_over_split_input_settle_what_one_run_does(spark, tmp_path):
    draw = random.Random(3)
    made = [(i, draw.randrange(600), i) for i in range(300)]
    cuts = [0, 90, 95, 210, 300]
    one, many = tmp_path / "one", tmp_path / "many"
    stamped(spark, made).write.parquet(f"{one}/in")
    deferred.run(spark.readStream.schema(SCHEMA).parquet(f"{one}/in"), f"{one}/runs", "id", "ts")
    for a, b in zip(cuts, cuts[1:], strict=False):
        stamped(spark, made[a:b]).write.mode("append").parquet(f"{many}/in")
        deferred.run(spark.readStream.schema(SCHEMA).parquet(f"{many}/in"), f"{many}/runs", "id", "ts")
    schema = stamped(spark, []).schema
    whole = lambda p: rows(deferred.closed(spark, schema, f"{p}/runs").drop("batch"))
    assert whole(one) == whole(many) == rows(stamped(spark, made))
    settled = rows(deferred.settled(spark, schema, f"{one}/runs"))
    last = max(s for _, s, _ in made) // 60 * 60
    assert sorted(r[0] for r in settled) == sorted(i for i, s, _ in made if s < last)
    # A run without new rows is none.
    before = files(many)
    deferred.run(spark.readStream.schema(SCHEMA).parquet(f"{many}/in"), f"{many}/runs", "id", "ts")
    assert {f: x for f, x in files(many).items() if "/state/" not in f} == {f: x for f, x in before.items() if "/state/" not in f}


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path)
    deferred.settle(stamped(spark, [(1, 10, 1), (2, 70, 1), (3, 75, 1)]), 0, path, "id", "ts")
    for _ in range(3):
        deferred.settle(stamped(spark, [(3, 75, 1), (4, 100, 1), (5, 130, 1)]), 1, path, "id", "ts")
    schema = stamped(spark, []).schema
    assert [(r.id, r.batch) for r in sorted(deferred.closed(spark, schema, path).collect(), key=lambda r: r.id)] == [(1, 0), (2, 1), (3, 1), (4, 1), (5, 2)]


def test_rows_without_a_time_wait_for_the_close(spark, tmp_path):
    none = spark.createDataFrame([(1, None, 1)], SCHEMA)
    deferred.settle(none, 0, str(tmp_path), "id", "ts")
    assert rows(deferred.closed(spark, none.schema, str(tmp_path)).select("id", "batch")) == [(1, 1)]


# Search


def test_search_equals_contains(spark, tmp_path):
    draw = random.Random(5)
    words = ["alpha", "alphabet", "beta", "abet", "日本", "東京都", "株式会社", "b", "Ünder", "x1", "don't", "a-b"]
    texts = [(i, draw.choice(["", " ", "、"]).join(draw.choice(words) for _ in range(draw.randrange(0, 12)))) for i in range(400)] + [(400, None), (401, ""), (401, "alpha TWICE")]
    index = TextIndex(spark, str(tmp_path / "i"), span=50, buckets=4).build(spark.createDataFrame(texts, "id long, text string"))
    assert index.table("postings").where("size(ids) > 50").count() == 0  # a hot term has a row for each range
    strings = ["alpha", "ALPHABET", "pha", "alpha beta", "beta、alpha", "日", "日本", "本東", "京", "株式会社日本", "t a", "-", " ", "、", "", None, "nowhere", "alpha nowhere", "b", "ünder", "n't", "a-b", "x1 x1", "1 x", "都b", "twice"]
    got = rows(index.found(spark.createDataFrame(list(enumerate(strings)), "q long, string string")))
    want = sorted({(q, i) for q, s in enumerate(strings) if s for i, t in texts if t is not None and s.lower() in t.lower()}, key=repr)
    assert got == want


def test_search_reads_postings_of_its_buckets_alone(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), buckets=8).build(spark.createDataFrame([(i, f"common w{i}") for i in range(100)], "id long, text string"))
    needs = rows(index.needs(spark.createDataFrame([(1, "x common w5 y")], "q long, string string")).select("term", "how"))
    assert needs == [("common", "exact"), ("w5", "exact"), ("x", "end"), ("y", "start")]
    assert index.found(spark.createDataFrame([], "q long, string string")).count() == 0


# Ranges


def test_merged_ranges_equal_sets_of_days(spark):
    draw = random.Random(11)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    spans = [(k, a, a + draw.randrange(-2, 12)) for k in range(12) for a in [draw.randrange(0, 90) for _ in range(draw.randrange(0, 14))]] + [(99, 0, 30), (99, 3, 5), (99, 31, 40), (99, 42, 43)]
    ranges = spark.createDataFrame([(k, day(a), day(b)) for k, a, b in spans], "k long, first date, last date")
    held = {}
    for k, a, b in spans:
        held.setdefault(k, set()).update(range(a, b + 1))
    islands = lambda days: [(a, next(b for b in range(a, 1000) if b + 1 not in days)) for a in sorted(days) if a - 1 not in days]
    want = sorted((k, day(a), day(b)) for k, days in held.items() for a, b in islands(days))
    assert sorted(map(tuple, coverage.merged_ranges(ranges, "k", "first", "last").select("k", "first", "last").collect())) == want
    windows = [(k, a, a + draw.randrange(0, 15)) for k in (*range(13), 99) for a in range(0, 90, 3)]
    frame = spark.createDataFrame([(k, day(a), day(b)) for k, a, b in windows], "k long, first date, last date")
    got = coverage.contained(frame, ranges, "k", "first", "last", "ok").select("k", "first", "last", "ok").collect()
    assert sorted(map(tuple, got)) == sorted((k, day(a), day(b), set(range(a, b + 1)) <= held.get(k, set())) for k, a, b in windows)


def test_a_batch_that_breaks_a_rule_commits_nothing(spark, tmp_path):
    from tickforge.operators import facts

    store = Versions(spark, str(tmp_path / "v"))
    store.publish({"m": spark.createDataFrame([(1, "a", "prime", True, None), (2, "b", "prime", True, None)], "k long, name string, market string, active boolean, last_event string")})
    events = spark.createDataFrame([(1, "x", "delist", "none"), (3, "c", "listing", "growth"), (4, "d", "transfer", "growth")], "k long, new string, kind string, to string")
    with pytest.raises(Exception, match="k is there twice: 3"):
        facts.overlay(store, "m", facts.checked_once(events.union(events.where("k = 3")), "k"))
    assert store.version() == 1 and store.tables() == ["m"]
    facts.overlay(store, "m", facts.checked_once(events, "k"))
    assert rows(store.read("m")) == [(1, "a", "prime", False, "delist"), (2, "b", "prime", True, None), (3, "c", "growth", True, "listing")]
    assert store.read("m_events").count() == 3


def test_one_scope_of_the_last_end(spark):
    from tickforge.operators import facts

    day = lambda y: dt.date(y, 3, 31)
    made = [(1, day(2022), "b", 1), (1, day(2023), "a", 2), (1, day(2023), "b", 3), (1, day(2099), "b", 4), (2, day(2023), "c", 5), (2, day(2022), "a", 6), (3, day(2023), "?", 7)]
    got = facts.one_scope(spark.createDataFrame(made, "k long, end date, scope string, v long"), "k", "end", "scope", ["a", "b", "c"], F.lit("2024-01-01").cast("date"))
    assert sorted((r.k, r.v) for r in got.collect()) == [(1, 2), (2, 5)]
