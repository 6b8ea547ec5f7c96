import random

import pytest

from dealweave.llm.encoding import CHAINS, NAMES, restore_encoding, undo

CLEAN = [
    "Le marché reste très sélectif, malgré l’intérêt marqué de fonds étrangers à Orléans.",
    "Für das dritte Jahr führte der Geschäftsführer Gespräche über größere Anteile.",
    "A decisão será anunciada em março, após reuniões; há também pressão. « Nous préférons » dit-il.",
    "Zarząd w Łodzi twierdzi, że środki wystarczą na dziewięć miesięcy działalności.",
    "The fund’s counsel said “no” — twice. Let α denote the intercept; √n·α/σ ≥ 24. ├── seed ★★★☆☆",
    "Выручка выросла на сорок процентов, но расходы увеличились ещё сильнее.",
    "同社は今後の資金を確保している。関係者によると、評価額は高すぎる。",
]


def garble(text, write, read):
    out = []
    for b in text.encode(write):
        try:
            out.append(bytes([b]).decode(read))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.mark.parametrize("chain", [(("utf_8", "cp1252"),), (("utf_8", "cp437"),), (("utf_8", "cp1252"), ("utf_8", "cp1252"))])
def test_undo_is_the_inverse(chain):
    s = t = "éß’Łódź"
    for write, read in chain:
        t = garble(t, write, read)
    assert undo(t, CHAINS.index(chain)) == s


def test_finds_and_restores_planted_garbling(spark):
    rnd = random.Random(2)
    rows, bad = [], {}
    for i in range(1500):
        text = " ".join(rnd.choice(CLEAN[:5]) for _ in range(4)) if i % 5 else rnd.choice(CLEAN[5:])
        if i % 40 == 0:
            bad[i] = text
            text = garble(text, "utf_8", ["cp1252", "latin_1", "mac_roman"][i % 3])
        elif i % 120 == 1:
            cut = rnd.choice(CLEAN[:3])
            bad[i] = text + " " + cut
            text = text + " " + garble(cut, "cp1252", "mac_roman")
        rows.append((i, text, ["a", "b", None][i % 3], "q"))
    rows += [(5000, None, "a", ""), (5001, "", "a", ""), (5002, "plain ascii", "a", ""), (5003, "lost � here", "a", ""), (5003, "lost � here", "a", "")]
    df = spark.createDataFrame(rows, "id long, t string, s string, chain string")
    got = restore_encoding(df, row_id="id", text="t", source="s").collect()
    assert sorted(r.id for r in got) == sorted([*bad, 5003, 5003])
    restored = {r.id: r.restored for r in got}
    assert sum(restored[i] == bad[i] for i in bad) >= 0.95 * len(bad)
    assert {r.chain for r in got if r.id == 5003} == {NAMES[-1]}


def test_empty(spark):
    df = spark.createDataFrame([], "id long, t string, s string")
    assert restore_encoding(df, row_id="id", text="t", source="s").collect() == []
