"""New deliveries checked against everything accepted before.

A delivery is one or two points of a metric space: the skeleton of its company's main word (as an id's name, an article's address or the row itself
gives it), that of its investor's, the round, the numbers in the investor's name and the time. The distance of two points is the largest of the edit
distances of the skeletons (in units of the radius), the time between them (in units of the window) and infinity where round or numbers differ
or only one names an investor. The history is a stored pivot-distance table: of each accepted point the distance to the pivots of each part. The
pivot of time is the epoch; those of skeletons are the empty string, each single letter (a letter is nearer by one to a word that has it, so these distances
are the word's length and a bitmap) and two fixed strings. New points meet the history in ranges of the time's pivot distance, and, where a
range holds very many points, in bands of the skeletons' pivot distances as well; the triangle inequality prunes what meets, the true distance is
verified, and words, initials and ids have the last say. Accepted points are appended; what the history holds isn't compared anew.

A point whose time can't be read has no pivot distance in time. Its company's skeleton meets those of the history in an index of what deletions leave of
each skeleton, which is appended to like the points.

Deliveries that agree in every key within one hour are one point from the start, so a group of copies, however large, is never compared with itself.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from dealweave.operators.components import components
from dealweave.llm.names import Key, key
from dealweave.llm.variants import left_by_deletions
from dealweave.session import collected, shared_dir, written

HOUR = 3_600_000_000
RANGE = 90 * 24 * HOUR
#: The long pivots are any strings; they must stay the same as long as a history is used.
PIVOTS = ("brgdrtm", "kfsnvlp")
#: The verbs of headlines, as addresses have them.
_VERB = re.compile(r"-(?:raises|gets|lands|closes|secures|receives|nets|bags|wins|announces|completes)-", re.I)
_IN_SLUG = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789%-")


@lru_cache(maxsize=200_000)
def _key(name: str | None) -> dict | None:
    k = key(name) if name and name.strip() else None
    return k and k._asdict() | {"bits": _letters(k.core)}


@lru_cache(maxsize=50_000)
def slug_name(url: str | None) -> str | None:
    """The company's name in an article's address, where the address has one."""
    if not url:
        return None
    url = re.sub("%2d", "-", url, flags=re.I)
    for m in _VERB.finditer(url):
        at = m.start()
        while at and url[at - 1] in _IN_SLUG:
            at -= 1
        if name := url[at : m.start()].strip("-").replace("-", " "):
            return name
    return None


def round_key(c: Column) -> Column:
    """series-a of 'Series  A ', 'A round', 'seriesa' and the like; NULL becomes ''."""
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[\\s_-]+", "-")
    t = F.regexp_replace(F.regexp_replace(t, "-?round$", ""), "^([a-h])$", "series-$1")
    return F.regexp_replace(t, "^series([a-h])$", "series-$1")


_KEY = "struct<core:string,initials:string,numbers:string,word:string,bits:int>"
_ARROW = pa.struct([*((f, pa.string()) for f in Key._fields), ("bits", pa.int32())])


def _keys(df: DataFrame, of: dict[str, str], kept: list[str]) -> DataFrame:
    """kept columns with the key of the name in each column of `of`, under its value as name; a column that starts with @ holds addresses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for c in of:
                names = b.column(c.lstrip("@")).to_pylist()
                made.append(pa.array([_key(slug_name(x) if c[0] == "@" else x) for x in names], _ARROW))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *made], names=[*kept, *of.values()])

    schema = ", ".join([f"{c} {df.schema[c].dataType.simpleString()}" for c in kept] + [f"{n} {_KEY}" for n in of.values()])
    return df.mapInArrow(run, schema)


def entity_keys(entities: DataFrame, *, entity_id: str, name: str) -> DataFrame:
    """(eid, ek): the key of what each entity is called; of several names of an id the smallest counts. Written, for use with each batch."""
    e = entities.filter(F.col(entity_id).isNotNull() & F.col(name).isNotNull()).groupBy(F.col(entity_id).alias("eid")).agg(F.min(name).alias("n"))
    return written(_keys(e, {"n": "ek"}, ["eid"]).filter("ek is not null"), "entities")


def _letters(word: str) -> int:
    """The distances to the single letters, as a bitmap: a bit is set where its letter (the last one: any other sign) is in the word."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) - 97 if "a" <= c <= "z" else 26)
    return bits


def points(rows: DataFrame, entities: DataFrame, *, row_id: str, company: str, company_id: str, investor: str, investor_id: str, round_type: str, url: str, time_us: str, arrived: str) -> tuple[DataFrame, DataFrame]:
    """(points, copies): the distinct points of rows with their pivot distances; of rows that are the same point as an earlier one, that point.

    A point's id is its smallest row_id. entities are entity_keys of all known ids, so that a point's key doesn't depend on the batch it came in.
    Rows without any company's name (of its own, in the address or by id) are no points: nothing tells what they repeat.
    """
    t = rows.select(
        F.col(row_id).cast("long").alias("id"), F.col(company).alias("cn"), F.col(company_id).alias("ci"), F.col(investor).alias("vn"),
        F.col(investor_id).alias("vi"), round_key(F.col(round_type)).alias("r"), F.col(url).alias("u"), F.col(time_us).alias("t"), F.unix_micros(arrived).alias("at"),
    )
    t = _keys(t, {"cn": "ck", "vn": "vk", "@u": "sk"}, ["id", "ci", "vi", "r", "t", "at"])
    # NULL ids get keys of their own, so that they don't meet in one task.
    for i, k in (("ci", "ce"), ("vi", "ve")):
        on = F.coalesce(F.col(i), F.concat(F.lit("\x00"), (F.col("id") % 997).cast("string")))
        t = t.withColumn("eid", on).join(entities.withColumnRenamed("ek", k), "eid", "left").drop("eid")
    plain = F.translate("vi", "\x1f", " ")  # which separates words where they are shuffled
    unnamed = F.when(F.col("vi").isNotNull(), F.struct(F.concat(F.lit("#"), plain).alias("core"), F.lit("").alias("initials"), F.lit("").alias("numbers"), plain.alias("word"), F.lit(1 << 26).alias("bits")))
    one, two = F.coalesce("ce", "sk", "ck"), F.when(F.col("ce").isNull() & F.col("sk").isNotNull() & (F.col("sk.core") != F.col("ck.core")), F.col("ck"))
    none = F.lit("")
    v = F.coalesce("ve", "vk", unnamed)
    t = t.select(
        "id", "ci", "vi", "t", "at", F.xxhash64("r", v.isNotNull(), F.coalesce(v["numbers"], none)).alias("k"), F.floor(F.col("t") / HOUR).alias("h"),
        one.alias("c1"), two.alias("c2"), F.struct(*[F.coalesce(v[f], none).alias(f) for f in ("core", "initials", "word")], F.coalesce(v["bits"], F.lit(0)).alias("bits")).alias("v"),
    ).filter("c1 is not null")
    same = ["k", "h", "ci", "vi", "c1", "c2", "v"]
    t = written(t.withColumns({"h1": F.xxhash64(*same), "h2": F.hash(*reversed(same))}), "cores", "zstd")
    first = t.groupBy("h1", "h2").agg(F.min("id").alias("point"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = written(t.select("h1", "h2", "id").join(first, ["h1", "h2"]).filter("id <> point").select(F.col("id").alias("row"), "point"), "copies")
    # Points of one range of time are made in as few tasks as will do, so that the history gets few files.
    at = {"range": _range(F.col("t")), "part": F.pmod("h1", F.lit(max(1, int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 32)))}
    p = t.withColumns(at).repartition(*at).groupBy(*at, "h1", "h2").agg(*[F.first(x).alias(x) for x in same if x != "h"], F.min("id").alias("id"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.min("at").alias("at"))
    far = lambda x, s: {f"{s}p{i}": F.levenshtein(x, F.lit(q)) for i, q in enumerate(PIVOTS)} | {f"{s}n": F.length(x)}
    side = lambda x, s: F.struct(*[f.alias(n) for n, f in ({f"{s}c": x["core"], f"{s}o": x["initials"], f"{s}w": x["word"], f"{s}b": x["bits"]} | far(x["core"], s)).items()])
    p = p.select("range", "id", "k", "ci", "vi", "t0", "t1", "at", side(F.col("v"), "v").alias("v"),
                 F.when(F.col("c2").isNull(), F.array(side(F.col("c1"), "c"))).otherwise(F.array(side(F.col("c1"), "c"), side(F.col("c2"), "c"))).alias("c"))
    return p, copies


def _range(t: Column) -> Column:
    """Ninety days; -1 where there is no time."""
    return F.coalesce(F.floor(t / RANGE), F.lit(-1)).cast("long")


_INDEX = "c string, late boolean, h long"


@dataclass
class History:
    """The accepted points and the index of their skeletons, as tables below a path; both are only ever appended to."""

    spark: SparkSession
    path: str
    days: int = 3
    batches: int = 0
    schema: StructType | None = None

    def append(self, new: DataFrame) -> DataFrame:
        """Appends the points of a batch; gives the keys of their skeletons, which the index gets."""
        self.schema = StructType([*new.schema.fields, StructField("batch", IntegerType())])
        new.write.option("compression", "zstd").partitionBy("range").parquet(f"{self.path}/points/batch={self.batches}")
        at = f"{self.path}/index/batch={self.batches}"
        self.batches += 1
        _deletions(self.points().filter("fresh").select(F.explode("c.cc").alias("c"), F.col("t0").isNull().alias("late")).distinct()).write.parquet(at)
        return self.spark.read.schema(_INDEX).parquet(at)

    def near(self, keys: DataFrame) -> DataFrame:
        """(m, cc): skeletons m of points without a time and all cc of any points within the radius, where one of both is the batch's that gave keys."""
        index = self.spark.read.schema(f"{_INDEX}, batch int").parquet(f"{self.path}/index")
        met = keys.filter("late").select(F.col("c").alias("m"), "h").join(index.select(F.col("c").alias("cc"), "h"), "h").select("m", "cc")
        if self.batches > 1:
            before = index.filter(f"late and batch < {self.batches - 1}").select(F.col("c").alias("m"), "h")
            met = met.unionByName(before.join(keys.select(F.col("c").alias("cc"), "h"), "h").select("m", "cc"))
        return written(met.distinct().filter(_within(F.col("m"), F.col("cc"))), "near")

    def points(self, within_reach: bool = False) -> DataFrame:
        """The accepted points, fresh where they are the last batch's: all, or those in the ranges within reach of that batch. The ranges are few: one for each ninety days of news."""
        p = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/points").parquet(f"{self.path}/points")
        p = p.withColumn("fresh", F.col("batch") == self.batches - 1).drop("batch")
        if within_reach:
            r = [x[0] for x in p.filter("fresh").select("range").distinct().collect()]
            near = -(-self.days // 90)
            p = p.filter(F.col("range").isin(sorted({y for x in r for y in range(x - near, x + near + 1)})))
        return p.drop("range")


def _deletions(cores: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i, c in enumerate(b.column("c").to_pylist()):
                n = len(c)
                own = (left_by_deletions(c, 7) if n <= 20 else set()) | ({f"\x04{k}" for k in (n - 2, n - 1, n, n + 1, n + 2)} if n >= 19 else set())
                at += [i] * len(own)
                out += sorted(own)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("c").take(at), b.column("late").take(at), pa.array(out, pa.string())], names=["c", "late", "key"])

    return cores.mapInArrow(run, "c string, late boolean, key string").select("c", "late", F.xxhash64("key").alias("h"))


def _within(a: Column, b: Column) -> Column:
    """Whether two skeletons are within the radius: one edit or swap, two where both have seven letters or more."""
    d = F.levenshtein(a, b, 2)
    swapped = (F.length(a) == F.length(b)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return d.between(0, 1) | ((d == 2) & ((F.least(F.length(a), F.length(b)) >= 7) | swapped))


SURE, BEST_EARLIER, BEST_LATER = 0, 1, 2
_WORDS = tuple(f"{s}{p}" for s in "vc" for p in "cow")
_FAR = tuple(f"{s}{p}" for s in "vc" for p in ("n", "p0", "p1"))
_NO_TIME = -(1 << 62)
#: A cell of time has so many windows.
CELL = 10
#: What a row is in its group: a guest there, being of the next cell of time or the next band of either skeleton; in another block than its own; of the last batch; one whom visitors meet; a visitor.
LATER, FARTHER_C, FARTHER_V, ASKS, FRESH, HOST, VISITOR = (1 << i for i in range(7))


def links(history: History, keys: DataFrame, *, split_rows: int = 20_000) -> DataFrame:
    """(a, b, kind, apart, gap): points b of the last batch and earlier points a, of the batch or the history, that may report the same announcement.

    The batch has been appended to the history, which gave keys. Links of kind SURE stand for themselves. A point without a time goes with one announcement only,
    the one most like it and closest to it in arrival: BEST_EARLIER are those that may come first, of which each b keeps one; BEST_LATER those
    that may come after it, of which each a keeps one once there is no earlier one (resolve does both). A point is in its own cell of time, and as a guest also in the cell before if
    that is within the window. Where a window holds more than split_rows points of one round, its cell is split by bands of pivot distances of both
    skeletons, again with guests from the next band, and these into blocks; results don't depend on it.
    """
    window = history.days * 24 * HOUR
    spark, t0 = history.spark, F.col("t0")
    timed = history.points(within_reach=True).filter("t0 is not null")
    rows = _flat(timed).withColumns({"s": t0, "role": F.lit(HOST | VISITOR), "own": F.floor(t0 / (CELL * window))})
    rows = _guests(rows, "cell", "own", F.floor((t0 - window) / (CELL * window)), LATER)
    counts = timed.groupBy("k", F.floor(t0 / window).alias("w")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > split_rows)
    met = written(_true(_met(_split(rows, counts.withColumn("cell", F.floor(F.col("w") / CELL)), ["k", "cell"], split_rows), window)), "timed")
    collected(spark)

    # Without a time: those of a round and a skeleton are met by all of the round whose skeletons are near.
    everything = _flat(history.points())
    late = everything.filter("t0 is null").withColumn("m", F.col("cc"))
    hosts = late.groupBy("k", "m").agg(F.max("fresh").alias("host_fresh"))
    near = history.near(keys).join(hosts, "m")
    visitors = everything.join(near, ["k", "cc"]).filter("fresh or host_fresh").drop("host_fresh").withColumn("role", F.lit(VISITOR))
    rows = written(late.withColumn("role", F.lit(HOST)).unionByName(visitors).withColumn("s", F.lit(0).cast("long")), "late")
    collected(spark)
    counts = rows.groupBy("k", "m").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > split_rows)
    return met.unionByName(written(_true(_met(_split(rows, counts, ["k", "m"], split_rows), window)), "untimed"))


def _flat(p: DataFrame) -> DataFrame:
    """Each point with one of its companies' skeletons: what is compared, in few and narrow columns."""
    p = p.select("id", "k", "ci", "vi", "t0", "t1", "at", "fresh", "v.*", F.inline("c"))
    far = [F.shiftleft(F.least(F.col(c), F.lit(127)).cast("long"), 7 * i) for i, c in enumerate(_FAR)]
    bits = F.shiftleft(F.col("vb").cast("long"), 32).bitwiseOR(F.col("cb").cast("long"))
    texts = F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in _WORDS])
    return p.select("id", "k", "ci", "vi", "t0", "t1", "at", "fresh", "cc", bits.alias("bits"), sum(far[1:], far[0]).alias("far"), texts.alias("texts"))


def _guests(rows: DataFrame, place: str, own: str, other: Column, role: int) -> DataFrame:
    """The rows at their own place, and as guests at the other one where that is another."""
    at = rows.withColumn(place, F.explode(F.array_distinct(F.array(F.col(own), other))))
    return at.withColumn("role", F.when(F.col(place) == F.col(own), F.col("role")).otherwise(F.col("role").bitwiseOR(role))).drop(own)


def _split(rows: DataFrame, counts: DataFrame, by: list[str], split_rows: int) -> DataFrame:
    """Rows with their group g, by the columns of by; crowded ones, which counts has with their n, by bands and blocks as well."""
    hot = written(counts.groupBy(*by).agg(F.ceil(F.max("n") / split_rows).cast("int").alias("blocks")), "hot")
    if hot.isEmpty():
        return rows.withColumn("g", F.xxhash64(*by))
    # There are at most so many of these as there are points by split_rows.
    rows = rows.join(F.broadcast(hot), by, "left")
    split = F.col("blocks").isNotNull()
    for s, role in (("c", FARTHER_C), ("v", FARTHER_V)):
        p0 = F.shiftright("far", 7 * _FAR.index(f"{s}p0")).bitwiseAND(F.lit(127))
        band = lambda d, p0=p0: F.when(split, F.floor((p0 - d) / 5)).otherwise(F.lit(-9))
        rows = _guests(rows.withColumn("own", band(0)), f"{s}x", "own", band(2), role)
    blocks = F.coalesce("blocks", F.lit(1))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumn("role", F.when(F.col("block") == F.pmod(F.xxhash64("id"), blocks), F.col("role")).otherwise(F.col("role").bitwiseOR(ASKS)))
    return rows.withColumn("g", F.xxhash64(*by, "cx", "vx", "block"))


def _met(rows: DataFrame, window: int) -> DataFrame:
    """Pairs x, y of rows of a group whose pivot distances allow them to be near, x before y."""
    time = lambda c: F.coalesce(c, F.lit(_NO_TIME)).alias(c)
    role = F.when(F.col("fresh"), F.col("role").bitwiseOR(FRESH)).otherwise(F.col("role"))
    rows = rows.select(
        "g", "s", "id", "k", time("t0"), time("t1"), "bits", "far", role.alias("role"), "texts", "ci", "vi", "at",
    ).repartition("g").sortWithinPartitions("g", "s")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema} | {c: "string" for c in _WORDS} | {"late": "boolean"}
    out = ["id", "at", "ci", "vi"]
    numbers = ("g", "s", "id", "k", "t0", "t1", "bits", "far", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None  # what is still within reach in the next batch
        for b in batches:
            t = pa.Table.from_batches([b])
            first = 0 if carried is None else carried.num_rows
            t = t if carried is None else pa.concat_tables([carried, t]).combine_chunks()
            n = {c: t.column(c).to_numpy() for c in numbers}
            for pair in _compare(n, first, window):
                cols = []
                for i in pair:
                    side = t.take(pa.array(i))
                    words = pc.split_pattern(side.column("texts").combine_chunks(), "\x1f")
                    words = (words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words).flatten()
                    cols += [_one(side.column(c)) for c in out] + [pa.array(n["t0"][i] == _NO_TIME)]
                    cols += [words.take(pa.array(np.arange(j, len(words), len(_WORDS)))) for j in range(len(_WORDS))]
                yield pa.RecordBatch.from_arrays(cols, names=[f"{s}_{c}" for s in "xy" for c in (*out, "late", *_WORDS)])
            if t.num_rows:
                kept = (n["g"] == n["g"][-1]) & (n["s"] >= n["s"][-1] - window)
                carried = t.filter(pa.array(kept))

    return rows.mapInArrow(run, ", ".join(f"{s}_{c} {kinds[c]}" for s in "xy" for c in (*out, "late", *_WORDS)))


def _one(c: pa.ChunkedArray) -> pa.Array:
    c = c.combine_chunks()
    return c.chunk(0) if isinstance(c, pa.ChunkedArray) else c


def _compare(n: dict[str, np.ndarray], first: int, window: int, most: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows that may be near, the smaller id before the other, of rows in the order of groups and times; those before first have met each other.

    An edit moves each pivot distance by one at most, and changes two letters at most.
    """
    g, s, role = n["g"], n["s"], n["role"]
    vb, cb = (n["bits"] >> 32).astype(np.int32), (n["bits"] & 0xFFFFFFFF).astype(np.int32)
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(g))
    some = (ends - starts > 1) & (ends > first)
    xs, ys, size = [], [], 0
    for lo, hi in zip(starts[some].tolist(), ends[some].tolist()):
        bits, other = (vb, cb) if vb[lo:hi].any() else (cb, vb)
        at = max(lo, first)
        while at < hi:
            back = lo + int(np.searchsorted(s[lo : at + 1], s[at] - window))
            upto = min(hi, at + max(1, min(256, most // (at + 1 - back))))
            y, x = np.nonzero(np.bitwise_count(bits[at:upto, None] ^ bits[None, back:upto]) <= 4)
            x, y = x + back, y + at
            at = upto
            keep = x < y
            x, y = x[keep], y[keep]
            keep = (np.bitwise_count(other[x] ^ other[y]) <= 4) & (n["k"][x] == n["k"][y])
            x, y = x[keep], y[keep]
            if not len(x):
                continue
            swap = n["id"][x] > n["id"][y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            keep = (n["id"][x] != n["id"][y]) & ((role[x] & role[y] & (LATER | FARTHER_C | FARTHER_V)) == 0) & (((role[x] | role[y]) & FRESH) != 0) & ((role[x] & ASKS) == 0)
            host_x = ((role[x] & HOST) != 0) & ((role[y] & VISITOR) != 0)
            no_x, no_y = n["t0"][x] == _NO_TIME, n["t0"][y] == _NO_TIME
            keep &= host_x | ((role[y] & HOST) != 0) & ((role[x] & VISITOR) != 0) & ~(no_x & no_y)
            keep &= no_x | no_y | (np.maximum(np.abs(n["t1"][y] - n["t0"][x]), np.abs(n["t1"][x] - n["t0"][y])) <= window)
            for i in range(len(_FAR)):
                keep &= np.abs(((n["far"][x] >> 7 * i) & 127) - ((n["far"][y] >> 7 * i) & 127)) <= 2
            if keep.any():
                xs.append(x[keep])
                ys.append(y[keep])
                size += len(xs[-1])
                if size > 100_000:
                    yield np.concatenate(xs), np.concatenate(ys)
                    xs, ys, size = [], [], 0
    if xs:
        yield np.concatenate(xs), np.concatenate(ys)


def _true(met: DataFrame) -> DataFrame:
    """Those pairs whose true distance is within the radius, and which words, initials and ids don't speak against."""
    col = lambda c: (F.col(f"x_{c}"), F.col(f"y_{c}"))
    true = _within(*col("vc")) & _within(*col("cc"))
    for s in "vc":
        # Words may differ by two edits, unless one has lost its vowels; no initial of one may speak against the other.
        (a, b), (i, j), (c, d) = col(f"{s}w"), col(f"{s}o"), col(f"{s}c")
        true &= (a == c) | (b == d) | (F.levenshtein(a, b, 2) >= 0)
        true &= (F.call_function("translate", i, j, F.lit("")) == "") | (F.call_function("translate", j, i, F.lit("")) == "")
    for c in ("ci", "vi"):
        p, q = col(c)
        true &= F.coalesce(p == q, F.lit(True))
    no_x, no_y = col("late")
    kind = F.when(no_x == no_y, SURE).when(no_x, BEST_LATER).otherwise(BEST_EARLIER)
    differ = sum((F.levenshtein(*col(f"{s}c")) for s in "vc"), F.lit(0))
    return met.filter(true).select(F.col("x_id").alias("a"), F.col("y_id").alias("b"), kind.cast("int").alias("kind"), differ.alias("apart"), F.abs(F.col("y_at") - F.col("x_at")).alias("gap"))


def resolve(found: DataFrame) -> DataFrame:
    """(node, root): of each linked point the first of its announcement, from the links of all batches so far."""
    sure = found.filter(F.col("kind") == SURE).select("a", "b")
    order = F.struct("apart", "gap", "id")
    forth = found.filter(F.col("kind") == BEST_EARLIER).withColumn("id", F.col("a")).groupBy("b").agg(F.min_by("a", order).alias("a")).select("a", "b")
    back = found.filter(F.col("kind") == BEST_LATER).withColumn("id", F.col("b")).groupBy("a").agg(F.min_by("b", order).alias("b"))
    back = back.join(forth.select(F.col("b").alias("a")), "a", "left_anti").select("a", "b")
    return components(sure.unionByName(forth).unionByName(back), "a", "b")


class Deliveries:
    """A running check: accept each batch in turn; repeats tells what repeats what so far."""

    def __init__(self, spark: SparkSession, path: str | None = None, *, days: int = 3, split_rows: int = 20_000):
        self.history = History(spark, path or f"{shared_dir(spark)}/repeats-{uuid.uuid4().hex}", days)
        self.split_rows, self.found, self.copies = split_rows, None, None

    def accept(self, new: DataFrame, copies: DataFrame) -> DataFrame:
        """Appends the points of a batch and gives its links to what was accepted before and to itself."""
        met = links(self.history, self.history.append(new), split_rows=self.split_rows)
        self.found = met if self.found is None else self.found.unionByName(met)
        self.copies = copies if self.copies is None else self.copies.unionByName(copies)
        return met

    def repeats(self) -> DataFrame:
        """(first, row): row reports an announcement that was first reported by the smaller id first."""
        roots = written(resolve(self.found), "roots")
        again = self.copies.join(roots.select(F.col("node").alias("point"), "root"), "point", "left").select(F.coalesce("root", "point").alias("first"), "row")
        return roots.filter("node <> root").select(F.col("root").alias("first"), F.col("node").alias("row")).unionByName(again)
