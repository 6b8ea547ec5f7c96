import datetime as dt
import random

from dealweave.operators.as_known import as_known

D = dt.date
T = lambda *a: dt.datetime(*a)
EVENTS = "eid long, who string, at timestamp, tps string"
VERSIONS = "vid long, who string, from_ date, seen timestamp, tier boolean, score double, at string"


def run(spark, events, versions, **kw):
    e, v = spark.createDataFrame(events, EVENTS), spark.createDataFrame(versions, VERSIONS)
    out = as_known(e, v, event_id="eid", event_time="at", entity="who", version_id="vid", valid_from="from_", visible_at="seen", attributes=["tier", "score"], **kw)
    return sorted(map(tuple, out.collect()), key=repr)


def brute(events, versions):
    out = []
    for eid, who, at, _ in events:
        ok = [
            v
            for v in versions
            if who is not None and at is not None and v[1] == who and v[0] is not None and v[2] is not None and v[3] is not None
            and dt.datetime.combine(v[2], dt.time()) <= at and v[3] <= at
        ]
        best = max(ok, key=lambda v: (v[2], v[3], -v[0]), default=(None,) * 6)
        out.append((eid, best[0], best[4], best[5]))
    return sorted(out, key=repr)


def test_matches_brute_force_with_nulls_ties_repeats_and_salting(spark):
    rnd = random.Random(1)
    day = lambda: D(2020, 1, 1) + dt.timedelta(days=rnd.randrange(700))
    versions = []
    for i in range(300):
        f = day()
        seen = dt.datetime.combine(f, dt.time()) + dt.timedelta(days=rnd.choice([-5, 0, 3, 90, 200]))
        versions.append((i, rnd.choice(["a", "b", "hot", "hot", None]), rnd.choice([f, f, None]), rnd.choice([seen, seen, None]), rnd.choice([True, None]), float(i), "x"))
    versions += versions[:40]
    versions += [(900 - k, "hot", D(2020, 5, 5), T(2020, 6, 1), True, 1.0, None) for k in range(5)]
    events = [(i, rnd.choice(["a", "b", "hot", "hot", "nobody", None]), rnd.choice([dt.datetime.combine(day(), dt.time(rnd.randrange(24)))] * 9 + [None]), "y") for i in range(400)]
    events += events[:30] + [(999, "hot", T(2020, 6, 1), "edge"), (998, "hot", T(2019, 1, 1), "before")]
    for kw in ({}, {"salt_rows": 10, "period_days": 30}, {"period_days": 1}):
        assert run(spark, events, versions, **kw) == brute(events, versions)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a", D(2020, 1, 1), T(2020, 1, 1), True, 1.0, "")]) == []
    assert run(spark, [(1, "a", T(2020, 1, 1), "")], []) == [(1, None, None, None)]


def test_kept_snapshots_brought_up_to_date(spark):
    from dealweave.operators.as_known import snapshot_table

    rnd = random.Random(2)
    versions = [(i, rnd.choice("abc"), D(2020, 1, 1) + dt.timedelta(days=rnd.randrange(300)), T(2020, 1, 1) + dt.timedelta(days=i), True, float(i), "x") for i in range(200)]
    events = [(i, rnd.choice("abcd"), T(2020, 1, 1) + dt.timedelta(days=rnd.randrange(400)), "y") for i in range(200)]
    of = dict(entity="who", version_id="vid", valid_from="from_", visible_at="seen", attributes=["tier", "score"], period_days=20)
    part = lambda rows: spark.createDataFrame(rows, VERSIONS)
    kept = snapshot_table(part(versions[120:]), before=snapshot_table(part(versions[:120]), **of), **of)
    assert sorted(map(tuple, kept.select("_k", "_p", "_s.vid").collect())) == sorted(map(tuple, snapshot_table(part(versions), **of).select("_k", "_p", "_s.vid").collect()))
    assert run(spark, events, versions, period_days=20, snapshots=kept) == brute(events, versions)
