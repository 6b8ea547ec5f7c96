import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from dealweave.operators.components import components
from dealweave.llm.linkage import estimate, link_companies
from dealweave.llm.names import alike, core, edits, numerals, similarity, tokens
from dealweave.llm.repeats import Deliveries, entity_keys, points, round_key, slug_name
from dealweave.llm.variants import spelling_pairs


def test_names():
    assert tokens("The Bihuhîgax Tundra Partners (BTP)") == ["bihuhigax", "tundra", "partners"]
    assert tokens("Harbor, Inc.") == ["harbor"] and tokens("Inc.") == ["inc"] and tokens("  ") == []
    assert tokens("FotesijorPebble S.A.") == ["fotesijor", "pebble"]
    assert numerals(tokens("Alder Fund III")) == "iii" and numerals(tokens("V. Smith")) == ""
    assert edits("abcd", "abdc", 2) == 1 and edits("abc", "xyz", 1) == 2
    assert alike("bob", "robert") > 0.9 and alike("lntrn", "lantern") > 0.8 and alike("r", "robert") > 0 and alike("lantern", "pebble") == 0
    assert core("Kate Dofa") == core("Katherine Dofa") == core("Dofa, Katherine")
    assert similarity(["a"], [], [1.0], []) == 0.0
    assert slug_name("https://x.example/2015/02/alder-anvil-secures-series-a-1023227") == "alder anvil"
    assert slug_name("https://x.example/roundup/2015-w06") is None and slug_name(None) is None


def test_components_of_chains_stars_and_rings(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(200, 201), (201, 202), (202, 200), (7, 7)] + [(200, 201)] * 3
    rnd.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame([(a, b) if rnd.random() < 0.5 else (b, a) for a, b in links], "a long, b long"), "a", "b").collect()}
    want = {i: 0 for i in range(61)} | {100 + k: 100 for k in range(50)} | {200: 200, 201: 200, 202: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


SPELLINGS = {
    "f:1": ["Velmorrin Lantern Partners", "VELMORRIN LANTERN PARTNERS", "Velmortin Lantern Partners", "The Velmorrin  Lantern Prtnrs.", "Partners, Velmorrin Lantern", "Velmorrin Lntrn Partners (VLP)"],
    "f:2": ["Dojavetuth Ember Fund II", "Dojavetuth Ember Fund II LP"],
    "f:3": ["Dojavetuth Ember Fund III", "DOJAVETUTH EMBER FUND III"],
    "p:1": ["Robert Vobredanor", "Bob Vobredanor", "R. Vobredanor", "Vobredanor, Rob", "Robert Vobreddanor"],
    "p:2": ["James Fatuhifim", "Fatuhifim J", "Jim Fatuhifim"],
    "f:4": ["Kihofadi/Canyon Growth", "Kihofadi-Canyon Growth", "KihofadiCanyon Growth"],
}


@pytest.mark.parametrize("with_ids", [True, False])
def test_all_spellings_of_an_entity_meet(spark, with_ids):
    rnd = random.Random(3)
    noise = [(f"n:{i}", f"{''.join(rnd.choice('bdgkmnrtvz') + rnd.choice('aeiou') for _ in range(4)).title()} {rnd.choice(['Lantern', 'Ember', 'Canyon'])} {rnd.choice(['Partners', 'Growth', 'Capital'])}") for i in range(300)]
    rows = [("k", s, e if with_ids and n % 3 else None, 1) for e, names in SPELLINGS.items() for n, s in enumerate(names)] + [("k", s, e, 1) for e, s in noise]
    rows += rows[:5] + [("k", None, "x", 1), (None, "Nobody", "x", 1), ("k", "", None, 1), ("k", "  ", None, 1), ("k", "...", None, 1), ("k", "z" * 20_000, None, 1), ("other", "Velmorrin Lantern Partners", None, 1)]
    got = {tuple(r) for r in spelling_pairs(spark.createDataFrame(rows, "kind string, name string, e string, id int"), kind="kind", name="name", entity_id="e").collect()}
    want = {("k", *sorted(p)) for names in SPELLINGS.values() for p in itertools.combinations(names, 2)}
    assert want <= got
    known = {s: e for e, s in [(e, s) for e, names in SPELLINGS.items() for s in names] + noise}
    assert not [p for p in got if known.get(p[1]) != known.get(p[2]) and p[1] in known and p[2] in known]


def test_no_mentions(spark):
    assert spelling_pairs(spark.createDataFrame([], "kind string, name string, e string"), kind="kind", name="name", entity_id="e").collect() == []


DAY = 86_400_000_000
COLUMNS = "id long, batch int, company string, ci string, investor string, vi string, round string, url string, t long, arrived timestamp"


def delivery(i, company, ci, investor, vi, rnd, t, url=None, batch=0):
    return (i, batch, company, ci, investor, vi, rnd, url, t, dt.datetime(2020, 1, 1) + dt.timedelta(hours=i))


NEWS = [
    delivery(1, "Budrofifu Tundra", "c:1", "Velmorrin Lantern Partners", "f:1", "series-a", 10 * DAY),
    delivery(2, "Budrofifu Tundra", None, "Velmorrin Lantern Prtnrs.", None, " Series  A ", 11 * DAY),
    delivery(3, "Budroiffu Tundra", None, "Velmorrin Lantern Partners", "f:1", "A round", 12 * DAY),
    delivery(4, "Budrofifu Tundra", "c:1", "Other Pebble Growth", "f:2", "series-a", 11 * DAY),  # another investor
    delivery(5, "Budrofifu Tundra", "c:1", "Velmorrin Lantern Partners", "f:1", "series-b", 11 * DAY),  # another round
    delivery(6, "Budrofifu Tundra", "c:1", "Velmorrin Lantern Partners", "f:1", "series-a", 60 * DAY),  # an extension
    delivery(7, "Budrofifu Tundra", "c:1", None, None, "series-a", 11 * DAY),  # nobody named
    delivery(8, "budrofifu tundra", None, None, None, "series-a", 12 * DAY),
    delivery(9, "Kazihena Compass", None, "Velmorrin Lantern Partners", "f:1", "series-a", 11 * DAY),  # another company
    delivery(10, "Budrofifu Tundra", None, "VELMORRIN LANTERN PARTNERS", None, "series-a", None),  # no time
    delivery(11, None, None, None, None, None, None),
    delivery(12, "", None, "", None, "", 11 * DAY),
    delivery(13, "x" * 5000, None, "y" * 5000, None, "seed", 11 * DAY),
] + [delivery(100 + k, "Hollow Gimokus", None, "Tandem Fetrubi Capital", "f:9", "seed", 20 * DAY + k * 1000, batch=1 + k % 2) for k in range(300)]
WANT = {(1, 2), (1, 3), (7, 8), (6, 10)} | {(100, 100 + k) for k in range(1, 300)}


def repeats(spark, parts, names=(), **kw):
    entities = entity_keys(spark.createDataFrame(list(names), "id string, name string"), entity_id="id", name="name")
    run = Deliveries(spark, **kw)
    for rows in parts:
        df = spark.createDataFrame(rows, COLUMNS)
        run.accept(*points(df, entities, row_id="id", company="company", company_id="ci", investor="investor", investor_id="vi", round_type="round", url="url", time_us="t", arrived="arrived"))
    return sorted(tuple(r) for r in run.repeats().collect())


def test_repeats_in_one_go_batch_by_batch_and_split(spark):
    assert set(repeats(spark, [NEWS])) == WANT
    order = sorted(NEWS, key=lambda r: (r[1], r[0]))
    renumbered = [(i, *r[1:]) for i, r in enumerate(order, 1)]
    whole = repeats(spark, [renumbered])
    by_batch = repeats(spark, [[r for r in renumbered if r[1] == k] for k in (0, 1, 2)])
    assert whole == by_batch and len(whole) == len(WANT)
    assert repeats(spark, [NEWS], split_rows=2) == repeats(spark, [NEWS])


def test_ids_name_companies_and_investors(spark):
    names = [("c:1", "Budrofifu Tundra"), ("c:1", "Budrofifu Tundra"), ("f:1", "Velmorrin Lantern Partners"), (None, "x"), ("c:2", None)]
    rows = [
        delivery(1, None, "c:1", None, "f:1", "seed", 10 * DAY), delivery(2, "Budrofifu Tundra Inc", None, "Velmorrin Lantern", None, "seed", 11 * DAY),
        delivery(3, "Budrofifu Tundra", "c:2", "Velmorrin Lantern", None, "seed", 11 * DAY), delivery(4, "Budrofifu Tundra", None, "Velmorrin Lantern", "f:2", "seed", 11 * DAY),
    ]
    got = repeats(spark, [rows], names)
    assert (1, 2) in got and (1, 3) in got  # an id that isn't known speaks by its row's name; 2 joins 1 and 3


def test_no_deliveries_and_round_names(spark):
    assert repeats(spark, [[]]) == [] and repeats(spark, [[], NEWS[:3], []]) == [(1, 2), (1, 3)]
    df = spark.createDataFrame([(x,) for x in (" Series  A ", "A round", "seriesa", "series_a", None, "Seed Round", "pre-seed")], "r string")
    assert [r[0] for r in df.select(round_key(F.col("r"))).collect()] == ["series-a"] * 4 + ["", "seed", "pre-seed"]


def test_estimate_separates_matches():
    counts = {(4, 2): 900, (4, 1): 90, (4, 0): 10, (1, 0): 400, (1, 1): 300, (0, 2): 30, (0, 0): 270}
    share, m, u = estimate(counts, [5, 3])
    assert 0.4 < share < 0.6 and m[0][4] > 0.9 and u[0][4] < 0.1 and m[1][2] > u[1][2]


def test_linkage(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("bdgkmnrtvz") + rnd.choice("aeiou") for _ in range(4)).title()
    objects = [(f"c:{i}", f"{word()} {rnd.choice(['Tundra', 'Ember', 'Ledger', 'Harbor'])}", rnd.choice(["software", "biotech"]), rnd.choice(["USA", "DEU"]), "2010-05-01", 1e7, "x") for i in range(300)]
    objects += [("c:900", "Twin Lagoon", "software", "USA", None, None, ""), ("c:901", "Twin Lagoon", "biotech", "DEU", None, None, "")] + objects[:10] + [("c:999", None, None, None, None, None, None), (None, "No Id", None, None, None, None, None)]
    country, sector = {"USA": "US", "DEU": "de"}, {"software": "IGV", "biotech": "XBI"}
    events, want = [], {}
    for i in range(600):
        o = objects[i % 300]
        name = o[1]
        if i % 4 == 1:
            k = rnd.randrange(2, 6)
            name = name[:k] + name[k + 1] + name[k] + name[k + 2 :]
        if i % 4 == 2:
            name = name.upper() + ", Inc."
        events.append((i, name, None, "f:1", "seed", 10**6, sector[o[2]], rnd.choice([country[o[3]], None]), None, 17_000 * DAY))
        want[i] = o[0]
    events += [(1000, "Twin Lagoon", None, None, "seed", None, "XBI", "DE", None, None), (1001, "Twin Lagoon", None, None, "seed", None, "IGV", "US", None, None)]
    want |= {1000: "c:901", 1001: "c:900"}
    events += [(2000 + k, f"{word()} Quarry", None, None, "seed", None, "IGV", "US", None, None) for k in range(100)]
    events += [(3000, None, None, None, None, None, None, None, None, None), (3001, "", None, None, None, None, None, None, None, None), (3002, "q" * 3000, None, None, None, None, None, None, None, None), (3003, objects[0][1], "c:0", "f:1", "seed", 1, "IGV", "US", None, 17_000 * DAY)]
    events += [events[0]]
    e = spark.createDataFrame(events, "event_id long, company_name string, company_id string, investor_id string, round string, amount_usd long, sector string, country string, source_url string, epoch_us long")
    o = spark.createDataFrame(objects, "id string, name string, category_code string, country_code string, founded_at string, funding_total_usd double, country string")
    s = spark.createDataFrame([("software", "IGV"), ("biotech", "XBI")], "crunchbase_category string, etf_primary string")
    for kw in ({}, {"block_rows": 1}):
        got = {r.event_id: r.object_id for r in link_companies(e, o, s, **kw).collect()}
        assert {1000, 1001} & set(got) and all(got[i] == want[i] for i in got if i in want)
        assert not [i for i in got if i not in want]
        if not kw:
            assert len(set(got) & set(want)) >= 0.97 * len(want)
    assert link_companies(e.limit(0), o, s).collect() == [] and link_companies(e, o.limit(0), s).collect() == []
