"""Hot keys in blocks and days give what whole keys give."""

import random

from pyspark.sql import functions as F

from tickforge.operators import prose


def test_a_key_in_blocks_joins_like_a_whole_one(spark):
    rows = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("key"))
    asked = spark.createDataFrame([(i, i % 5) for i in range(20)], "q long, key long")
    want = sorted(map(tuple, rows.join(asked, "key").select("id", "q").collect()))
    assert sorted(map(tuple, prose.in_blocks(rows, asked, "key", "id", 7).select("id", "q").collect())) == want
    assert prose.in_blocks(rows.limit(0), asked, "key", "id").count() == 0


def test_revisions_by_days_equal_one_stream(spark):
    import datetime as dt

    from tickforge.operators.facts import revisions

    draw = random.Random(6)
    made = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=draw.randrange(0, 300)), i, draw.choice(["a", "b", None, "a"])) for i, k in enumerate(draw.randrange(0, 5) for _ in range(400))]
    want = []
    for k in range(5):
        own = sorted((r for r in made if r[0] == k), key=lambda r: (r[1], r[2]))
        kept = [r for i, r in enumerate(own) if not i or r[3] != own[i - 1][3]]
        want += [(r[2], r[3], n, kept[n][1] if n < len(kept) else None) for n, r in enumerate(kept, 1)]
    got = revisions(spark.createDataFrame(made, "k long, ts timestamp, id long, v string"), "k", ["ts", "id"], "v").select("id", "v", "revision", "valid_to")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
