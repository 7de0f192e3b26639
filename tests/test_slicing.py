import datetime as dt
import random

from pyspark.sql import functions as F

from spanloom.operators import slicing

SCHEMA = "arrival_seq long, started_at timestamp, observed_at timestamp, pane_start long"
T0 = dt.datetime(2020, 1, 1)


def brute(rows):
    clock, out = None, []
    for a, s, o, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        same = [r[2] for r in rows if r[0] is not None and r[0] <= a and r[2] is not None]
        clock = max(same) if same else None
        if s is None:
            continue
        start = s.replace(minute=0, second=0, microsecond=0)
        out.append((a, int((start - dt.datetime(1970, 1, 1)).total_seconds()), clock is not None and clock >= start + dt.timedelta(hours=7)))
    return sorted(out)


def data(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        at = T0 + dt.timedelta(minutes=7 * i)
        rows.append((i * 1000 + r.randrange(900), at - dt.timedelta(hours=r.choice([0, 0, 1, 6, 7, 30])), at + dt.timedelta(minutes=r.randrange(-300, 60)) if r.random() > 0.1 else None, 1))
    return rows


def test_late_rows_match_brute_force(spark):
    rows = data(300, 4) + [(None, T0, T0, 1), (5, None, T0, 1), (301000, T0, None, 1), (301000, T0 + dt.timedelta(hours=40), T0, 1)]
    got = slicing.assign_panes(spark.createDataFrame(rows, SCHEMA)).select("arrival_seq", "pane_start", "late").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_exact_cutoff_and_no_clock(spark):
    end = T0 + dt.timedelta(hours=7)
    rows = [(1, T0, None, 0), (2, T0, end - dt.timedelta(microseconds=1), 0), (3, T0, end, 0), (4, T0 + dt.timedelta(hours=1), None, 0)]
    got = slicing.assign_panes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.arrival_seq: r.late for r in got} == {1: False, 2: False, 3: True, 4: False}


def test_counts_and_revisions_agree(spark):
    panes = slicing.assign_panes(spark.createDataFrame(data(200, 9), SCHEMA)).cache()
    counts = {r.pane_start: r.n_rows for r in slicing.pane_counts(panes).collect()}
    final = slicing.revisions(panes).groupBy("window_start").agg(F.max_by("n_rows", "version").alias("n")).collect()
    for r in final:
        assert r.n == sum(counts.get(r.window_start + 3600 * k, 0) for k in range(3))
    versions = slicing.revisions(panes).orderBy("window_start", "version").collect()
    assert all(b.n_rows > a.n_rows for a, b in zip(versions, versions[1:]) if a.window_start == b.window_start)


def test_empty(spark):
    assert slicing.revisions(slicing.assign_panes(spark.createDataFrame([], SCHEMA))).count() == 0
