import random

from pyspark.sql import functions as F

from stelwerk.operators import hotkeys as H

SCHEMA = "k string, r string, v double, at timestamp_ntz, rec bigint, m string, n int, total string"


def table(spark, data):
    return spark.createDataFrame([(*d, 7, "x") for d in data], SCHEMA)


def test_report_against_brute_force_with_a_hot_key(spark):
    import datetime as dt

    rnd = random.Random(3)
    t0 = dt.datetime(2030, 1, 1)
    data = [(rnd.choice(["hot"] * 6 + ["a", "b", None, "c"]), rnd.choice(["R", "S", None]), rnd.choice([None, 0.25, 0.5, 0.75]), rnd.choice([None, t0 + dt.timedelta(hours=rnd.randint(0, 50))]), i, rnd.choice([None, "x", "y", "z"])) for i in range(700)]
    got = {(r.grouping, r.k, r.r): r for r in H.key_report(table(spark, data), [["k"], ["r"], ["k", "r"]], "v", "at", "rec", "m").collect()}
    keys = {(0, d[0], None) for d in data} | {(1, None, d[1]) for d in data} | {(2, d[0], d[1]) for d in data}
    assert set(got) == keys
    for (g, k, r), row in got.items():
        own = [d for d in data if (g == 1 or d[0] == k) and (g == 0 or d[1] == r)]
        values = [d[2] for d in own if d[2] is not None]
        last = max(own, key=lambda d: (d[3] is not None, d[3] or t0, d[4]))
        assert row.n == len(own) and row.n_distinct == len({d[5] for d in own} - {None})
        assert row.mean_value == (round(sum(values) / len(values), 6) if values else None) and row.max_value == (max(values) if values else None)
        assert row.latest_rec == last[4]


def test_splits_don_t_matter(spark, rows):
    data = [("a" if i % 3 else "b", "R", float(i), None, i, "m") for i in range(50)]
    df = table(spark, data)
    whole = rows(H.dense_aggregate(df, [["k"]], "v", "at", "rec"))
    assert whole == rows(H.dense_aggregate(df, [["k"]], "v", "at", "rec", split=7)) and len(whole) == 2
    many = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', cast(id % 500 as string)) as k", "cast(id % 7 as string) as r", "id * 0.5 as v", "timestamp_micros(id) as at", "id as rec")
    want = rows(many.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"), F.max("rec").alias("rec")))
    for split, blocks in ((10, 1), (64, 7), (1 << 17, 1024)):
        got = H.dense_aggregate(many, [["k"], ["k", "r"]], "v", "at", "rec", split, blocks)
        assert rows(got.where("grouping = 0").select("k", "n", "top", F.col("last_rec").alias("rec"))) == want
        assert got.where("grouping = 1").agg(F.sum("n"), F.count("*")).collect()[0] == (3000, many.select("k", "r").distinct().count())
    assert rows(H.dense_aggregate(many, [["k"]]).select("k", "n")) == [w[:2] for w in want]


def test_arrays_move_in_blocks(spark):
    plan = H.dense_aggregate(spark.range(10).selectExpr("cast(id as string) as k"), [["k"]])._jdf.queryExecution().toString()
    assert "RepartitionByExpression [grouping" in plan and ", block" in plan


def test_heavy_keys_count_repeats_and_leave_null_out(spark, rows):
    data = [("a", "R", None, None, 1, None)] * 3 + [("b", None, None, None, 1, None)] * 47 + [(None, "R", None, None, 1, None)] * 50
    df = table(spark, data)
    assert rows(H.heavy_keys(df, ["k", "r"], 3)) == [("a", "R", 3), ("b", None, 47)]
    assert rows(H.heavy_keys(df, ["k", "r"], 3.5)) == [("b", None, 47)]
    assert H.heavy_keys(df.limit(0), ["k", "r"], 3).count() == 0
    assert H.key_report(df.limit(0), [["k"]], "v", "at", "rec", "m").count() == 0
