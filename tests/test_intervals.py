import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stelwerk.operators import intervals as I

SCHEMA = "bwb_id string, geldigheidsperiode_startdatum string, geldigheidsperiode_einddatum string, key string, s int"


def blocks(s, e):
    out = []
    for k in range(I.HEIGHT + 1):
        lo, hi, top = (s + (1 << k) - 1) >> k, e >> k, 1 << (I.HEIGHT - k)
        out += [top + lo] * (lo < hi and lo & 1) + [top + hi - 1] * (lo < hi and hi & 1)
    return out


@given(st.lists(st.tuples(st.integers(0, 500), st.integers(1, 90)), max_size=12))
@settings(max_examples=200, deadline=None)
def test_block_runs_cover_the_same_days(pairs):
    spans = [(s, s + n) for s, n in pairs]
    runs = I.block_runs([b for s, e in spans for b in blocks(s, e)])
    assert {d for s, e in runs for d in range(s, e)} == {d for s, e in spans for d in range(s, e)}
    assert all(a[1] < b[0] for a, b in zip(runs, runs[1:]))


def test_decomposition_in_spark_is_canonical(spark):
    cases = [(0, 1), (5, 6), (3, 17), (0, 1 << 22), (1234, 3652059)]
    df = spark.createDataFrame([(f"{s} {e}", s, e) for s, e in cases], "key string, s int, e int")
    got = {}
    for r in I.dyadic_blocks(df).collect():
        got.setdefault(r.key, []).append(r.block)
        assert r.level == I.HEIGHT + 1 - r.block.bit_length()
    for s, e in cases:
        b = got[f"{s} {e}"]
        assert sorted(b) == sorted(blocks(s, e)) and len(b) <= 44
        assert I.block_runs(b) == [(s, e)]


def test_dates_in_all_notations(spark):
    good = {"2020-02-29": "2020-02-29", " \t2020-02-29 ": "2020-02-29", "29-02-2020": "2020-02-29", "20200229": "2020-02-29", "2020-02-29T23:59:59Z": "2020-02-29", "2020-02-29+02:00": "2020-02-29", "29/02/2020": "2020-02-29", "31-12-9999": "9999-12-31", "1-2-2020": "2020-02-01"}
    bad = ["2021-02-29", "onbekend", "", None, "2020-13-01", "00000101", "2020-02", "20200230"]
    df = spark.createDataFrame([(x,) for x in [*good, *bad]], "x string")
    got = {r.x: r.d for r in df.select("x", I.parse_day(df.x).cast("string").alias("d")).collect()}
    assert got == good | dict.fromkeys(bad)


def test_periods_gaps_and_bad_rows(spark, rows):
    data = [
        (" bwbr1 ", "2000-01-01", "2000-01-10"), ("BWBR1", "2000-01-05", "2000-01-20"), ("BWBR1", "2000-01-05", "2000-01-20"), ("BWBR1", "2000-01-21", "2000-01-31"),
        ("BWBR1", "2000-03-01", None), ("BWBR1", "2000-02-10", "2000-02-01"), ("BWBR1", None, "2000-02-05"), ("BWBR1", "2000-02-30", "2000-03-05"), ("BWBR1", "2000-02-05", "onbekend"),
        ("BWBR2", "01-01-2001", "  "), (None, "2000-01-01", "2000-01-02"), ("", "2000-01-01", "2000-01-02"), ("BWBR3", "2000-01-01", "1999-01-01"),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in data], SCHEMA)
    assert rows(I.periods_and_gaps(df)) == [
        ("BWBR1", "gap", "2000-02-01", "2000-02-29"), ("BWBR1", "period", "2000-01-01", "2000-01-31"), ("BWBR1", "period", "2000-03-01", "9999-12-31"), ("BWBR2", "period", "2001-01-01", "9999-12-31"),
    ]
    assert I.periods_and_gaps(df.limit(0)).count() == 0


@given(st.lists(st.tuples(st.sampled_from("AB"), st.integers(0, 9000), st.integers(0, 5000)), min_size=1, max_size=25))
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_against_brute_force(spark, data):
    zero = dt.date(1990, 1, 1)
    day = lambda n: (zero + dt.timedelta(n)).isoformat()
    df = spark.createDataFrame([(k, day(s), day(s + n), None, None) for k, s, n in data], SCHEMA)
    want = set()
    for k in {k for k, _, _ in data}:
        covered = sorted({d for kk, s, n in data if kk == k for d in range(s, s + n + 1)})
        runs = []
        for d in covered:
            if runs and runs[-1][1] == d - 1:
                runs[-1][1] = d
            else:
                runs.append([d, d])
        want |= {(k, "period", day(a), day(b)) for a, b in runs} | {(k, "gap", day(a[1] + 1), day(b[0] - 1)) for a, b in zip(runs, runs[1:])}
    assert {tuple(r) for r in I.periods_and_gaps(df).collect()} == want
