import csv
import io
import json
import random

import pytest

from dealweave.operators.packed_lists import unpack_lists

NAMES = ["Alder Ventures", "Alder Ventures Fund II", "Kafi/Caravan Capital", "Devi, Meadow & Partners", 'James "Jim" Mo', "Ka and Signal Capital", "Ühler Growth", "Mo"]


def run(spark, rows, names=NAMES, **kw):
    t = spark.createDataFrame(rows, "id long, x string, pos string, val string")
    v = spark.createDataFrame([(n, 1) for n in names], "name string, x int")
    out = {}
    for i, pos, val, known in unpack_lists(t, v, row_id="id", text="x", value="name", **kw).collect():
        out.setdefault(i, {})[pos] = (val, known)
    return {i: [m[k] for k in sorted(m)] for i, m in out.items()}


def packed(rnd, values):
    kind = rnd.randrange(6)
    if kind == 0:
        return json.dumps(values, ensure_ascii=rnd.random() < 0.3)
    if kind == 1:
        f = io.StringIO()
        csv.writer(f, delimiter=rnd.choice(",;|")).writerow(values)
        return f.getvalue().strip("\r\n")
    if kind == 2:
        return "{" + ",".join(json.dumps(v, ensure_ascii=False) for v in values) + "}"
    d = rnd.choice(["|", " | ", "; ", " ;", "\t", "\r\n", " • ", ", ", "||"])
    return rnd.choice(["", " ", d]) + d.join(values) + rnd.choice(["", " ", d])


@pytest.mark.parametrize("kw", [{}, {"dictionary_bytes": 20}])
def test_round_trip_of_any_packing(spark, kw):
    rnd = random.Random(5)
    want, rows = {}, []
    for i in range(150):
        values = [rnd.choice(NAMES) for _ in range(rnd.randint(1, 5))]
        want[i] = [(v, True) for v in values]
        rows.append((i, packed(rnd, values), "p", "v"))
    assert run(spark, rows, **kw) == want


def test_unknown_values_nulls_blanks_and_long_texts(spark):
    rows = [(1, None, "", ""), (2, "", "", ""), (3, " ; | ", "", ""), (4, 'Nobody Knows|Mo|"a; b"', "", ""), (5, "|".join(["Mo"] * 5000), "", ""), (6, "[", "", ""), (7, "Mo and Ühler Growth", "", ""), (8, "Mo, Alder Ventures Fund III", "", "")]
    got = run(spark, rows)
    assert set(got) == {4, 5, 7, 8}
    assert got[4] == [("Nobody Knows", False), ("Mo", True), ("a; b", False)]
    assert got[5] == [("Mo", True)] * 5000
    assert got[7] == [("Mo", True), ("Ühler Growth", True)]
    assert got[8] == [("Mo", True), ("Alder Ventures Fund III", False)]


def test_empty_dictionary_and_table(spark):
    assert run(spark, [(1, "a, b ;c", "", "")], names=[None, " "]) == {1: [("a", False), ("b", False), ("c", False)]}
    assert run(spark, []) == {}
