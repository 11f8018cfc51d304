import datetime as dt
import random

from stelwerk.operators import orphans as O

T = lambda n: dt.datetime(2030, 1, 1) + dt.timedelta(days=n)
REFS = "src_table string, rec_id bigint, key string, t timestamp_ntz, ingested_at int"
PARENTS = "key string, ingested_at timestamp_ntz, deleted_at timestamp_ntz, t int"


def brute(refs, parents):
    out = []
    for s, i, k, t in refs:
        if k is None or not k.strip():
            continue
        own = [(a or dt.datetime.min, d) for kk, a, d in parents if kk == k]
        by = [(a, d) for a, d in own if t is not None and a <= t]
        reason = None
        if not own:
            reason = "missing"
        elif t is None:
            continue
        elif not by:
            reason = "late"
        elif all(d is not None and d <= t for _, d in by):
            reason = "deleted"
        if reason:
            out.append((s, t and t.strftime("%Y-%m"), i, reason))
    return sorted(out, key=str)


def run(spark, refs, parents):
    return O.orphans(spark.createDataFrame([(*r, 1) for r in refs], REFS), spark.createDataFrame([(*p, 1) for p in parents], PARENTS))


def test_against_brute_force_with_a_hot_key(spark):
    rnd = random.Random(5)
    key = lambda: rnd.choice(["hot"] * 10 + [f"k{rnd.randint(0, 30)}", None, " ", "gone"])
    refs = [("e", i, key(), rnd.choice([T(rnd.randint(0, 90))] * 9 + [None])) for i in range(600)]
    parents = [(rnd.choice(["hot", f"k{rnd.randint(0, 25)}"]), rnd.choice([T(a := rnd.randint(0, 80))] * 9 + [None]), rnd.choice([None, T(a + rnd.randint(0, 20)), T(a)])) for _ in range(60)]
    refs += refs[:5]
    parents += parents[:5] + [(None, T(0), None)]
    assert sorted(map(tuple, run(spark, refs, parents).collect()), key=str) == brute(refs, parents)


def test_keys_compare_as_stored_and_tables_may_be_empty(spark, rows):
    refs, parents = [("p", 1, "A", T(5)), ("p", 2, "a ", T(5)), ("p", 3, "a", T(5)), ("p", 4, "a", T(-1))], [("a", T(0), T(4)), ("a", T(5), None)]
    assert rows(run(spark, refs, parents)) == [("p", "2029-12", 4, "late"), ("p", "2030-01", 1, "missing"), ("p", "2030-01", 2, "missing")]
    assert run(spark, [], parents).count() == 0
    assert rows(run(spark, refs[:1], [])) == [("p", "2030-01", 1, "missing")]
    assert rows(O.orphan_report(run(spark, refs, parents))) == [("p", "2029-12", "late", 1), ("p", "2030-01", "missing", 2)]


def test_the_filter_never_loses_a_key(spark, monkeypatch):
    few = spark.range(200).selectExpr("concat('k', id) as key")
    assert spark.range(5000, 6000).selectExpr("concat('k', id) as key").where(O.maybe_in(O.bloom(few, "key", 200), "key")).count() < 200
    monkeypatch.setattr(O, "MAX_BITS", 1 << 12)
    parents = spark.range(3000).selectExpr("concat('k', id) as key")
    f = O.bloom(parents, "key", 3000)  # far too small: false positives only
    assert parents.where(~O.maybe_in(f, "key")).count() == 0


def test_filters_by_range_stay_sharp(spark, monkeypatch):
    monkeypatch.setattr(O, "MAX_BITS", 1 << 12)
    parents = spark.range(3000).selectExpr("concat('k', id) as key")
    refs = spark.range(6000).selectExpr("concat('k', id) as key", "id as rec_id", "'e' as src_table", "timestamp_ntz'2030-01-01 00:00:00' as t")
    known = O.tried(refs, parents)
    assert known.count() == 6000 and known.where("not maybe and rec_id < 3000").count() == 0
    assert known.where("maybe and rec_id >= 3000").count() < 600
    assert O.tried(refs.limit(0), parents).count() == 0
    test_against_brute_force_with_a_hot_key(spark)


def test_sides_are_apart(spark, rows):
    refs = spark.createDataFrame([("a", "x", 1, "k", T(5)), ("b", "y", 2, "k", T(5)), ("b", "y", 3, " ", T(5))], "src_table string, side string, rec_id bigint, key string, t timestamp_ntz")
    parents = spark.createDataFrame([("x", "k", T(0), None), ("y", "K", T(0), None)], "side string, key string, ingested_at timestamp_ntz, deleted_at timestamp_ntz")
    assert rows(O.orphans(refs, parents, side="side")) == [("b", "2030-01", 2, "missing")]
