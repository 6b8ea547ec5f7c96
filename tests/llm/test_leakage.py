import random
import re

from dealweave.llm.leakage import Items, hashes, leaked_items, plain

WORDS = "the a of and to in that was for on with as by at from this have not are but had his they which one you were all her she there would their".split()


def item(rnd, k):
    name = lambda: f"{rnd.choice('BDKLMRT')}{''.join(rnd.choice('aeioubdgklmnrt') for _ in range(7))}"
    out = []
    for _ in range(4):
        out.append(f"Nothing in the {rnd.choice(WORDS)} of {name()} {name()} hinted that {name()} would leave {rnd.randint(10, 999)} of the {rnd.choice(WORDS)} pool before {rnd.randint(1990, 2020)}.")
    return (k, " ".join(out), "x")


def test_planted_passages_and_decoys(spark):
    rnd = random.Random(4)
    items = [item(rnd, k) for k in range(12)]
    docs, want = [], set()
    filler = lambda n: " ".join("q" + rnd.choice(WORDS) for _ in range(n))
    for i in range(200):
        k, text, _ = items[i % 12]
        words = text.split()
        kind = i % 5
        at = rnd.randrange(len(words) - 40)
        cut = words[at : at + 30]
        if kind == 0:  # verbatim, other case, broken lines and markup
            docs.append((i, f"{filler(20)} <b>{' '.join(cut).upper()}</b>\n\n> {filler(9)}", "z"))
            want.add((i, k))
        elif kind == 1:  # words of no weight changed, added or missing, one in eight at most
            for p in (9, 18):
                c = [j for j in range(p - 3, p + 3) if cut[j].isalpha() and cut[j].islower()]
                cut[c[0]] = rnd.choice(["", "very", cut[c[0]] + " indeed"])
            docs.append((i, f"{filler(20)} {' '.join(' '.join(cut).split())} {filler(9)}", "z"))
            want.add((i, k))
        elif kind == 2:  # the same sentences of other names and figures
            other = re.sub(r"\b[BDKLMRT][a-z]{7}\b", lambda m: m.group()[::-1].title(), text)
            docs.append((i, re.sub(r"\d+", lambda m: str(int(m.group()) + 1), other), "z"))
        elif kind == 3:  # too short
            docs.append((i, f"{filler(20)} {' '.join(words[at : at + 12])} {filler(20)}", "z"))
        else:
            docs.append((i, filler(200), "z"))
    docs += [(900, None, ""), (901, "", ""), (902, "short", ""), (903, filler(30_000) + " " + items[0][1] + filler(30_000), "")]
    want.add((903, 0))
    d = spark.createDataFrame(docs, "did long, t string, iid string")
    t = spark.createDataFrame([*items, (98, None, ""), (99, "", "")], "iid long, t string, did string")
    for kw in ({}, {"shard_chars": 3000, "items_bytes": 1000}):
        got = leaked_items(d, t, doc_id="did", doc_text="t", item_id="iid", item_text="t", **kw).collect()
        found = {(r.did, r.iid) for r in got}
        assert found == want and len(got) == len(found)


def test_repeated_rows_and_empty_tables(spark):
    rnd = random.Random(1)
    k, text, _ = item(rnd, 1)
    d = spark.createDataFrame([(1, text), (1, text)], "did long, t string")
    t = spark.createDataFrame([(k, text), (k, text)], "iid long, t string")
    run = lambda a, b: leaked_items(a, b, doc_id="did", doc_text="t", item_id="iid", item_text="t").collect()
    assert len(run(d, t)) == 4
    assert run(d.limit(0), t) == [] and run(d, t.limit(0)) == []


def test_words_agree_with_the_plain_reading():
    text = plain("The “fund’s” 1,234.5 pre-seed\ncafé İzmir x² <i>on</i> A&amp;B 3.14. end")
    h, of = hashes([text, "", "The end"])
    assert len(h) == len(re.findall(r"\w+", re.sub(r"(?<=\d)[.,](?=\d)|(?<=\w)'(?=\w)", "", text))) + 2
    assert h[0] == h[-2] and of[-1] == 2 and not len(hashes([])[0])
    Items([1], [text], 5)


def test_edits_next_to_each_other(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(40)]
    put = lambda at, *new: [*words[:at], *new, *words[at + len(new) :]]
    docs = [
        (1, put(12, "changed", "twice")[:24]), (2, [*words[:12], "one", "two", *words[12:24]]), (3, [*words[:12], *words[14:26]]), (4, [*words[:12], "new", *words[13:20], "other", "third", *words[22:26]]),
        (5, [*words[:14], "not", "enough", "words"]), (6, ["not", "enough", "words", *words[5:19]]), (7, put(6, "a", "b", "c")[:24]),
    ]
    d = spark.createDataFrame([(i, "start of text " + " ".join(w) + " end of it") for i, w in docs], "did long, t string")
    t = spark.createDataFrame([(1, " ".join(words))], "iid long, t string")
    found = {r.did for r in leaked_items(d, t, doc_id="did", doc_text="t", item_id="iid", item_text="t").collect()}
    assert found == {1, 2, 3, 4, 7}  # 7 by its last fifteen words and the one changed before them
