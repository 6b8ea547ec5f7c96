import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest

from dealweave.operators.trailing import block_sums, trailing_totals


@pytest.mark.parametrize("w", [1, 2, 7, 30, 60, 100])
def test_block_sums(w):
    x = np.random.default_rng(w).integers(0, 9, (5, 60)).astype(float)
    want = np.array([[r[max(0, i - w + 1) : i + 1].sum() for i in range(60)] for r in x])
    assert np.array_equal(block_sums(x, w), want)


def brute(rows, until):
    by = defaultdict(list)
    for e, d, v in rows:
        if e is not None and d is not None:
            by[e].append((d, v))
    out = set()
    for e, xs in by.items():
        lo, hi = min(d for d, _ in xs), max(d for d, _ in xs)
        for k in range((hi - lo).days + (30 if until == "active" else 1)):
            day = lo + dt.timedelta(days=k)
            vals = lambda w: [v for d, v in xs if 0 <= (day - d).days < w and v is not None]  # noqa: B023, E731
            near = [d for d, _ in xs if 0 <= (day - d).days < 30]
            if near or until == "span":
                r = [e, day]
                for w in (7, 30):
                    x = vals(w)
                    r += [float(sum(x)), len(x), sum(x) / len(x) if x else None]
                out.add(tuple(r))
    return out


@pytest.mark.parametrize("until", ["active", "last", "span"])
def test_matches_brute_force(spark, until):
    rnd = random.Random(3)
    rows = []
    for _ in range(120):
        d = dt.date(1969, 12, 1) + dt.timedelta(days=rnd.choice([0, 5, 40, 41, 43, 47, 90, 200]) + rnd.randrange(4))
        rows.append((rnd.choice(["a", "b", None]), rnd.choice([d, d, None]), rnd.choice([1.0, 2.0, 5.0, None])))
    rows += rows[:20] + [("single", dt.date(2020, 2, 29), 4.0)]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "e string, d date, v double, _b int, total_7 string")
    got = {tuple(r) for r in trailing_totals(df, entity=["e"], day="d", value="v", until=until).collect()}
    assert got == brute(rows, until)


def test_empty_and_two_entity_columns(spark):
    df = spark.createDataFrame([], "e string, d date, v double")
    assert trailing_totals(df, entity=["e"], day="d").collect() == []
    df = spark.createDataFrame([("a", "x", dt.date(2020, 1, 1))], "e string, day string, d date")
    out = trailing_totals(df, entity=["e", "day"], day="d", windows=[2], until="last")
    assert [tuple(r)[:2] for r in out.collect()] == [("a", "x")]
