"""Spellings of one name linked to each other.

A set-similarity join with prefix filtering over the distinct names. A name's tokens, rarest first, are its weighted set; only its prefix
(its two rarest tokens, and all of them written as one) is indexed whole. Words that are alike meet once, as words, so that a mistyped rare token still
meets the right one. All names that share their rarest token meet; names that share a second one meet if the rarest token of one is alike to a token
of the other, for what differs in both rarest tokens is not similar. What meets is verified by soft weighted token similarity, in which rare
tokens count more. Verified links make components, and the spellings of a component are its pairs. Where ids are known, they have the last word on a pair: two names known only under different ids are
not linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealweave.operators.components import components
from dealweave.llm.names import SHORT_NAMES, alike, numerals, similarity, tokens
from dealweave.session import collected, written


def grams(word: str) -> list[str]:
    """The word's 3-grams with its ends marked, each with its number if it recurs."""
    padded, seen, out = f"^{word}$", {}, []
    for i in range(len(padded) - 2):
        g = padded[i : i + 3]
        seen[g] = seen.get(g, 0) + 1
        out.append(g if seen[g] == 1 else f"{g}{seen[g]}")
    return out


#: Words up to LONG letters meet by what two deletions leave of them, those from LONG - 2 letters on by pairs of their rarest grams.
LONG, VOWELS = 14, frozenset("aeiou")


def left_by_deletions(word: str, twice: int = 7) -> set[str]:
    """The word and what one deletion leaves of it, from twice letters on also two.

    Words within two edits of which one has twice letters or more, and other words within one edit, share one of these: a shorter word loses a letter at most to
    one that is longer by one, and none to one that is longer by two.
    """
    one = {word[:i] + word[i + 1 :] for i in range(len(word))}
    return {word} | one | ({w[:i] + w[i + 1 :] for w in one for i in range(len(w))} if len(word) >= twice else set())


def _keyed(words: DataFrame, keys) -> DataFrame:
    """(w, key) of words (w): keys(word) are its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i, w in enumerate(b.column("w").to_pylist()):
                own = sorted(keys(w))
                at += [i] * len(own)
                out += own
            yield pa.RecordBatch.from_arrays([b.column("w").take(pa.array(at, pa.int64())), pa.array(out, pa.string())], names=["w", "key"])

    return words.select("w").mapInArrow(run, "w string, key string")


_BASE = 0x9E3779B97F4A7C15
_BACK, _BACK_TWICE = (np.uint64(pow(_BASE, -e, 1 << 64)) for e in (1, 2))


def deletion_hashes(words: list[str], twice: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes): the hash of each string that left_by_deletions gives of each word, with the word's place, some of them more than once.

    The hash of a string is a polynomial in its letters, so what deletions leave has that of its parts, moved forward.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    at, out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for n in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == n)
        letters = np.frombuffer("".join(words[i] for i in own).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), n).astype(np.uint64)
        powers = np.array([pow(_BASE, e + 1, 1 << 64) for e in range(n)], np.uint64)
        sums = np.zeros((len(own), n + 1), np.uint64)
        np.cumsum(letters * powers, axis=1, out=sums[:, 1:])
        whole = sums[:, n:]
        made = [whole, sums[:, :n] + (whole - sums[:, 1:]) * _BACK]
        if n >= twice:
            i, j = np.triu_indices(n, 1)
            made.append(sums[:, i] + (sums[:, j] - sums[:, i + 1]) * _BACK + (whole - sums[:, j + 1]) * _BACK_TWICE)
        h = np.concatenate(made, axis=1)
        at.append(np.repeat(own, h.shape[1]))
        out.append(h.ravel())
    return np.concatenate(at), np.concatenate(out)


def _posted(words: DataFrame) -> DataFrame:
    """(i, k) of words (i, w): the hashes of what deletions leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, h = deletion_hashes(b.column("w").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("i").take(pa.array(at)), pa.array(h.view(np.int64))], names=["i", "k"])

    return words.select("i", "w").mapInArrow(run, "i long, k long")


def _sharing(posted: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(i, j): each two i < j of a table (i, k) that share a key, some of them more than once.

    Rows are sorted by keys once, and those of a key are its run; most keys have one row.
    """
    rows = posted.repartition("k").sortWithinPartitions("k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, i = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the last key's rows, which may go on in the next batch
        for b in batches:
            first = len(k)
            k, i = np.concatenate([k, b.column("k").to_numpy()]), np.concatenate([i, b.column("i").to_numpy()])
            if not len(k):
                continue
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            # Each row meets those before it in its run; of the carried ones this is done.
            before = np.arange(len(k)) - np.repeat(starts, np.diff(np.append(starts, len(k))))
            before[:first] = 0
            at, ends = 0, np.cumsum(before)
            while at < len(k):
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
                n = before[at:upto]
                y = np.repeat(np.arange(at, upto), n)
                x = y - 1 - (np.arange(len(y)) - np.repeat(np.cumsum(n) - n, n))
                x, y = np.minimum(i[x], i[y]), np.maximum(i[x], i[y])
                other = x != y
                yield pa.RecordBatch.from_arrays([pa.array(x[other]), pa.array(y[other])], names=["i", "j"])
                at = upto
            k, i = k[starts[-1] :], i[starts[-1] :]

    return rows.mapInArrow(run, "i long, j long")


def alike_words(words: DataFrame, lost_grams: int = 8) -> DataFrame:
    """(x, y, edited): each two different words of a table (w) that are alike, in both orders; edited where they meet as edits of each other.

    Two edits, swaps among them, leave no more than lost_grams grams of a word without a partner.
    """
    named = words.select(F.xxhash64("w").alias("i"), "w")
    short = _posted(named.filter(F.length("w").between(3, LONG)))
    long_ = _keyed(words.filter(F.length("w") >= LONG - 1), grams)
    df = long_.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    prefix = long_.join(df, "key").groupBy("w").agg(F.slice(F.sort_array(F.collect_list(F.struct("df", "key"))), 1, lost_grams + 2)["key"].alias("g"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i, g in enumerate(b.column("g").to_pylist()):
                own = [f"{x}\x1f{y}" for x, y in combinations(sorted(g), 2)]
                at += [i] * len(own)
                out += own
            yield pa.RecordBatch.from_arrays([b.column("w").take(pa.array(at, pa.int64())), pa.array(out, pa.string())], names=["w", "key"])

    long_pairs = prefix.mapInArrow(pairs, "w string, key string").select(F.xxhash64("w").alias("i"), F.xxhash64("key").alias("k"))
    # Words of one hash stand for each other here; which of them are alike is verified.
    met = _sharing(short.unionByName(long_pairs)).distinct().join(named.withColumnRenamed("w", "a"), "i").join(named.toDF("j", "b"), "j")
    edited = met.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).filter("abs(length(x) - length(y)) <= 2")
    # A swap is one edit of two letters; words of fewer than seven letters may differ by one edit.
    edited = edited.filter(F.levenshtein("x", "y", 4).between(0, F.when(F.greatest(F.length("x"), F.length("y")) < 7, 2).otherwise(4)))

    # Short forms, beginnings, plurals, initials and what is written without vowels.
    def whole(w: str) -> set[str]:
        return {f"n{SHORT_NAMES.get(w, w)}", f"b{w}"} | ({f"v{w[:2]}"} if len(w) > 1 and not set(w[1:]) & VOWELS else set()) | ({f"b{w[:-1]}ies"} if w[-1:] == "y" else set())

    def parts(w: str) -> set[str]:
        n = SHORT_NAMES.get(w, w)
        return {f"n{n}", f"b{n[:1]}", f"b{w}"} | {f"b{w[:i]}" for i in range(1, len(w))} | {f"v{w[0]}{c}" for c in w[1:]}

    formed = _keyed(words, whole).toDF("x", "k").join(_keyed(words, parts).toDF("y", "k"), "k").filter("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    met = edited.withColumn("edited", F.lit(True)).unionByName(formed.withColumn("edited", F.lit(False))).groupBy("x", "y").agg(F.max("edited").alias("edited"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([alike(*w) > 0 for w in zip(b.column("x").to_pylist(), b.column("y").to_pylist())], pa.bool_()))

    one = written(met.mapInArrow(verify, "x string, y string, edited boolean"), "alike")
    collected(words.sparkSession)
    return one.unionByName(one.select(F.col("y").alias("x"), F.col("x").alias("y"), "edited"))


def _features(weighted: DataFrame) -> DataFrame:
    """(id, kind, n, nums, t) of rows (id, kind, n, nums, df, w, wt): the tokens of each id, rarest first."""
    cols = ["id", "kind", "n", "nums"]
    rows = weighted.select(*cols, F.col("df").cast("long"), "w", "wt").repartition("id").sortWithinPartitions("id", "df", "w", "wt")

    def made(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        t = t.combine_chunks()
        one = lambda c: c.chunk(0) if c.num_chunks else pa.array([], c.type)
        items = pa.StructArray.from_arrays([one(t.column(c)) for c in ("df", "w", "wt")], names=["df", "w", "wt"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, t.num_rows), pa.int32()), items)
        at = pa.array(starts)
        return pa.RecordBatch.from_arrays([*(one(t.column(c)).take(at) for c in cols), lists], names=[*cols, "t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None  # the last id's rows, which may go on in the next batch
        for b in batches:
            t = pa.Table.from_batches([b])
            t = (t if carried is None else pa.concat_tables([carried, t])).combine_chunks()
            if not t.num_rows:
                continue
            i = t.column("id").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            if len(starts) > 1:
                yield made(t.slice(0, int(starts[-1])), starts[:-1])
            carried = t.slice(int(starts[-1]))
        if carried is not None:
            yield made(carried, np.zeros(1, np.int64))

    return rows.mapInArrow(run, "id long, kind string, n long, nums string, t array<struct<df:long,w:string,wt:double>>")


def spelling_links(names: DataFrame, *, least: float = 0.65) -> tuple[DataFrame, DataFrame]:
    """(names with features, links) of a table (kind, name, ids, n): see spelling_pairs."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [tokens(x) for x in b.column("name").to_pylist()]
            nums = [numerals(w) for w in words]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "kind", "name", "ids", "n")), pa.array(words, pa.list_(pa.string())), pa.array(nums, pa.string()), pa.array([" " + "".join(w) for w in words])], names=["id", "kind", "name", "ids", "n", "words", "nums", "joined"])

    schema = "id long, kind string, name string, ids array<string>, n long, words array<string>, nums string, joined string"
    n = written(names.select(F.xxhash64("kind", "name").alias("id"), "kind", "name", "ids", "n").mapInArrow(split, schema), "names")
    words = n.select("id", "kind", "n", "nums", F.explode("words").alias("w"))
    df = words.select("kind", "w", "id").distinct().groupBy("kind", "w").agg(F.count(F.lit(1)).alias("df"))
    size = n.groupBy("kind").agg(F.count(F.lit(1)).alias("all"))
    weighted = words.join(df, ["kind", "w"]).join(F.broadcast(size), "kind").withColumn("wt", F.log(1 + F.col("all") / F.col("df")))
    features = _features(weighted)
    features = written(features, "features")

    # The prefix: the two rarest tokens. All names of a token meet of which one has it as its rarest, and all that are the same written as one.
    own = ["id", "kind", "nums"]
    token = written(features.select(*own, F.col("t")["w"].alias("all"), F.posexplode(F.slice("t", 1, 2)).alias("place", "x")).filter("x.df > 1").select(*own, "all", "place", F.col("x.w").alias("w")), "prefixes")
    pair = lambda x, y, on: x.toDF("a", *x.columns[1:]).join(y.toDF("b", *y.columns[1:]), on).filter("a <> b").select("a", "b")
    whole = n.select(*own, "joined")
    shared = pair(token.filter("place = 0").select(*own, "w"), token.select(*own, "w"), ["kind", "nums", "w"]).unionByName(pair(whole, whole, ["kind", "nums", "joined"]))
    # Of more than eight tokens, so many may agree that two rarest ones are outweighed.
    long_ = token.filter("size(all) > 8").select(*own, "w")
    shared = shared.unionByName(pair(long_, long_, ["kind", "nums", "w"]))

    # A second token brings together what also has the rarest token of one, or a word that is alike to it.
    collected(features.sparkSession)  # the next shuffles are the largest
    near = alike_words(features.select(F.explode(F.col("t")["w"]).alias("w")).distinct())
    by_second = token.filter("place = 1").select(*own, F.col("all")[0].alias("x"), "w")
    by_second = by_second.join(near.select("x", "y"), "x").drop("x").unionByName(by_second.withColumnRenamed("x", "y").select(*own, "w", "y"))
    others = token.select(*own, "w", F.explode("all").alias("y")).filter("w <> y")
    shared = shared.unionByName(pair(by_second.select(*own, "w", "y"), others, ["kind", "nums", "w", "y"]))

    # The edits of the rarest token, under the first letters of the next two tokens.
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, c = [], []
            for i, after in enumerate(b.column("after").to_pylist()):
                first = {SHORT_NAMES.get(x, x)[:1] for x in after} or {""}
                at += [i] * len(first)
                c += sorted(first)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(x).take(at) for x in (*own, "w")), pa.array(c, pa.string())], names=[*own, "w", "c"])

    rare = features.select(*own, F.col("t")[0]["w"].alias("w"), F.slice(F.col("t")["w"], 2, 2).alias("after"))
    rare = written(rare.mapInArrow(contexts, "id long, kind string, nums string, w string, c string"), "rare")
    mistyped = rare.join(near.filter("edited and x < y").select(F.col("x").alias("w"), "y"), "w").select(*own, "c", "y")
    shared = shared.unionByName(pair(mistyped, rare.select(*own, "c", F.col("w").alias("y")), ["kind", "nums", "c", "y"]))

    candidates = shared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    f = features.select("id", F.col("t")["w"].alias("w"), F.col("t")["wt"].alias("wt"))
    with_both = candidates.join(f.toDF("a", "wa", "ta"), "a").join(f.toDF("b", "wb", "tb"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [similarity(*x) for x in zip(*(b.column(c).to_pylist() for c in ("wa", "wb", "ta", "tb")))]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(s, pa.float64())], names=["a", "b", "s"])

    links = with_both.mapInArrow(verify, "a long, b long, s double").filter(F.col("s") >= least)
    ids = n.select("id", "ids")
    known = links.join(ids.toDF("a", "ia"), "a").join(ids.toDF("b", "ib"), "b")
    links = known.filter("size(ia) = 0 or size(ib) = 0 or arrays_overlap(ia, ib)").select("a", "b", "s")
    return n, links


def spelling_pairs(mentions: DataFrame, *, kind: str, name: str, entity_id: str, least: float = 0.65) -> DataFrame:
    """(kind, name_a, name_b): each two different spellings of one entity of a kind, name_a before name_b in UTF-8 byte order.

    Spellings are taken exactly as stored. NULL kinds and names are left out; empty or blank names have no tokens and get no pair; a NULL id means that
    nothing is known. Repeated rows count once. All columns but the three named are ignored. Numbers in a name ("Fund II") must agree.
    Very long words and names are told by hashes of the whole (see tokens), so they are alike only if equal but for case and signs. An empty table gives no rows.
    """
    m = mentions.select(F.col(kind).alias("kind"), F.col(name).alias("name"), F.col(entity_id).cast("string").alias("e")).filter("kind is not null and name is not null")
    one = m.groupBy("kind", "name", "e").agg(F.count(F.lit(1)).alias("n"))
    names = one.groupBy("kind", "name").agg(F.collect_set("e").alias("ids"), F.sum("n").alias("n"))
    n, links = spelling_links(names, least=least)
    member = components(links, "a", "b").join(n.withColumnRenamed("id", "node"), "node").select("root", "kind", "name", "ids")
    met = member.alias("x").join(member.alias("y"), "root").filter("x.name < y.name and x.kind = y.kind")
    sure = met.filter("size(x.ids) = 0 or size(y.ids) = 0 or arrays_overlap(x.ids, y.ids)")
    return sure.select("x.kind", F.col("x.name").alias("name_a"), F.col("y.name").alias("name_b"))
