import random

from dealweave.llm.names import alike
from dealweave.llm.variants import spelling_pairs


def test_spellings_meet_though_another_name_of_the_token_is_more_frequent(spark):
    # 'Sequoia' is mostly somebody else's; the two spellings share no rarer token as it is written.
    rows = [("k", "Gromebrefu Sequoia Partners", "1")] * 9 + [("k", f"{x} Sequoia Partners", None) for x in ("Velmorrin", "Vlmrrn", "Velm")]
    # Both mistyped forms of 'Tandovimur Meadow' share token and context with a more frequent name of another id.
    rows += [("k", "Tandovimur Meadow Growth", "2")] * 9 + [("k", "Tandovimur Mill Growth", "3"), ("k", "Tnadovimru Mill Growth", "3")]
    got = {tuple(r)[1:] for r in spelling_pairs(spark.createDataFrame(rows, "kind string, name string, e string"), kind="kind", name="name", entity_id="e").collect()}
    assert ("Velmorrin Sequoia Partners", "Vlmrrn Sequoia Partners") in got and ("Velm Sequoia Partners", "Velmorrin Sequoia Partners") in got
    assert ("Tandovimur Mill Growth", "Tnadovimru Mill Growth") in got
    assert not any("Gromebrefu" in a + b for a, b in got)


def test_all_alike_words_meet(spark):
    from dealweave.llm.variants import alike_words

    rnd = random.Random(5)
    words = {"".join(rnd.choice("bdgkmnrt") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 9)))[: rnd.randint(1, 18)] for _ in range(60)} | {"robert", "bob", "company", "companies", "b", "r"}
    for w in sorted(words):
        for _ in range(4):
            x = list(w)
            for _ in range(2):
                i = rnd.randrange(len(x))
                x[i : i + 2] = rnd.choice([x[i : i + 2][::-1], x[i + 1 : i + 2], ["z", *x[i : i + 2]], ["q", *x[i + 1 : i + 2]]]) or ["z"]
            words |= {"".join(x), w[0] + "".join(c for c in w[1:] if c not in "aeiou"), w[: len(w) // 2 + 1]}
    words = sorted(words)
    got = {(r.x, r.y) for r in alike_words(spark.createDataFrame([(w,) for w in words], "w string")).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and alike(a, b) > 0}


def test_words_of_a_key_meet_in_one_pass_over_batches(spark):
    from dealweave.llm.variants import _sharing, deletion_hashes, left_by_deletions

    rnd = random.Random(7)
    rows = sorted({(rnd.randrange(300), rnd.choice([*range(40), 99, 99])) for _ in range(900)})
    want = sorted((i, j) for i, k in rows for j, h in rows if k == h and i < j)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        posted = spark.createDataFrame(rows, "i long, k long")
        for most in (1_000_000, 5):
            assert sorted(tuple(r) for r in _sharing(posted, most).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # Words of fewer than seven letters are alike within one edit, so one deletion is enough.
    assert len(left_by_deletions("abcdef")) == 7 and left_by_deletions("abcdef") & left_by_deletions("abdcef") and left_by_deletions("abcdef") & left_by_deletions("abxcdefy")
    words = ["".join(rnd.choice("abcdéß") for _ in range(rnd.randint(1, 10))) for _ in range(200)] + ["abcdefg", "abcdefgh"]
    hashes = [set() for _ in words]
    for i, h in zip(*(x.tolist() for x in deletion_hashes(words))):
        hashes[i].add(h)
    strings = [left_by_deletions(w) for w in words]
    assert all(bool(hashes[i] & hashes[j]) == bool(strings[i] & strings[j]) and len(hashes[i]) == len(strings[i]) for i in range(len(words)) for j in range(i))
