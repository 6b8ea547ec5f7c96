"""Several values packed in one field, split by dictionary-guided segmentation.

An Aho-Corasick automaton over all known values finds where whole values stand in a text, in their plain form and in the forms that CSV
and JSON quoting give them. A dynamic program then picks the cheapest cover: known values cost nothing, text that no
value explains costs by its length, and between two values a delimiter must stand ("and" or "&" only after a value that ended there). So
delimiters inside a known value never split it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealweave.session import written

DELIMITERS = frozenset("|;,/\t\r\n•·")
OPEN, CLOSE, BLANK = frozenset("[{("), frozenset("]})"), frozenset("    ﻿")
WORDS = (" and ", " & ")
_FILLER = DELIMITERS | OPEN | CLOSE | BLANK | {'"'}


def forms(value: str) -> set[str]:
    """A value as it may stand in a list: plain, with doubled quotation marks, JSON-escaped."""
    return {value, value.replace('"', '""'), json.dumps(value, ensure_ascii=False)[1:-1], json.dumps(value)[1:-1]}


def automaton(values: list[str]) -> ahocorasick.Automaton | None:
    a = ahocorasick.Automaton()
    for i, v in enumerate(values):
        for f in forms(v):
            a.add_word(f, (i, len(f)))
    if not len(a):
        return None
    a.make_automaton()
    return a


def spans(a: ahocorasick.Automaton | None, text: str) -> list[tuple[int, int, int]]:
    """(start, end, value's index) of each known value that stands between fillers."""
    if a is None:
        return []
    n, out = len(text), []
    for last, (i, length) in a.iter(text):
        s, e = last - length + 1, last + 1
        if (s == 0 or text[s - 1] in _FILLER) and (e == n or text[e] in _FILLER):
            out.append((s, e, i))
    return out


def segment(text: str, known: list[tuple[int, int, int]]) -> list[tuple[str | None, int]]:
    """The values of text in order: (text of an unknown value, -1) or (None, index of a known one)."""
    n = len(text)
    starts: dict[int, list[tuple[int, int]]] = {}
    for s, e, i in known:
        starts.setdefault(s, []).append((e, i))
    stop = [n] * (n + 1)  # the next delimiter at or after
    for p in range(n - 1, -1, -1):
        stop[p] = p if text[p] in DELIMITERS else stop[p + 1]
    # State (p, ready): text[:p] is explained; ready: a value may begin. Costs are whole numbers, so ties are real ties.
    best: list[list[tuple[int, tuple] | None]] = [[None, None] for _ in range(n + 1)]
    best[0][1] = (0, ())

    def reach(p: int, ready: int, cost: int, back: tuple) -> None:
        if best[p][ready] is None or cost < best[p][ready][0]:
            best[p][ready] = (cost, back)

    for p in range(n):
        c = text[p]
        for ready in (0, 1):
            if best[p][ready] is None:
                continue
            cost = best[p][ready][0]
            if c in DELIMITERS:
                reach(p + 1, 1, cost, (p, ready, None))
            elif c in _FILLER:
                reach(p + 1, ready, cost, (p, ready, None))
                if c == " " and not ready:
                    for word in WORDS:
                        if text.startswith(word, p):
                            reach(p + len(word), 1, cost + 1, (p, ready, None))
            if ready:
                for e, i in starts.get(p, ()):
                    reach(e, 0, cost + 1, (p, ready, (None, i)))
                if c == '"' and (e := _closing(text, p)):
                    inner = _unescape(text[p + 1 : e - 1])
                    if inner.strip():
                        reach(e, 0, cost + 6 + 2 * (e - p), (p, ready, (inner, -1)))
                if c not in _FILLER:
                    e = stop[p]
                    reach(e, 0, cost + 8 + 2 * (e - p), (p, ready, (text[p:e], -1)))
    ends = [x for x in best[n] if x is not None]
    if not ends:
        return [(x, -1) for x in text.split("|")]
    out, at = [], min(ends, key=lambda x: x[0])[1]
    while at:
        p, ready, value = at
        if value:
            out.append(value)
        at = best[p][ready][1]
    out.reverse()
    cleaned = ((v if v is None else _outer(v), i) for v, i in out)
    return [(v, i) for v, i in cleaned if i >= 0 or v]


def _closing(text: str, p: int) -> int:
    """The end of the quoted stretch that begins at p, if a delimiter, closing bracket or the end follows; else 0."""
    q = p + 1
    while q < len(text):
        if text[q] == "\\":
            q += 2
            continue
        if text[q] == '"':
            if text[q + 1 : q + 2] == '"':
                q += 2
                continue
            rest = q + 1
            while rest < len(text) and (text[rest] in BLANK or text[rest] in CLOSE):
                rest += 1
            return q + 1 if rest == len(text) or text[rest] in DELIMITERS else 0
        q += 1
    return 0


def _unescape(s: str) -> str:
    if "\\" in s:
        try:
            return json.loads(f'"{s}"')
        except ValueError:
            pass
    return s.replace('""', '"')


def _outer(s: str) -> str:
    s = s.strip("    ﻿\t\r\n")
    while s and (s[-1] in CLOSE and not any(o in s for o in OPEN) or s[-1] == '"' and s.count('"') % 2):
        s = s[:-1].rstrip()
    return s


def unpack_lists(rows: DataFrame, values: DataFrame, *, row_id: str, text: str, value: str, dictionary_bytes: int = 48_000_000) -> DataFrame:
    """(row_id, pos, val, known): one row per value packed in text; pos counts from 1 over values that aren't blank.

    known tells whether val is one of values. NULL and blank texts give no row; repeated rows are split again; NULL or blank
    dictionary values are left out and repeated ones count once; with an empty dictionary the delimiters, quotes and brackets
    alone decide. Between equal covers, the one with fewer values wins. Other columns are ignored.

    The dictionary goes to each worker only up to dictionary_bytes. Beyond that it is cut into shards of that size, which go to the workers one
    after the other and over all rows; the places found are brought together by row before the cover is picked.
    """
    spark = rows.sparkSession
    t = rows.select(F.col(row_id).alias("_id"), F.col(text).alias("_x")).filter("_x is not null and trim(_x) <> ''")
    d = values.select(F.col(value).alias("_v")).filter("_v is not null and trim(_v) <> ''").distinct()
    schema = f"_id {t.schema['_id'].dataType.simpleString()}, pos int, val string, known boolean"
    total = d.agg(F.sum(F.octet_length("_v"))).first()[0] or 0
    if total <= dictionary_bytes:
        words = spark.sparkContext.broadcast(sorted(r[0] for r in d.collect()))

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = words.value
            a = automaton(known)
            for b in batches:
                yield from _split(b.column("_id"), b.column("_x").to_pylist(), [None] * b.num_rows, lambda x, _: spans(a, x), lambda i: known[i])

        out = t.mapInArrow(split, schema)
    else:
        out = _sharded(t, d, -(-total // dictionary_bytes), schema)
    return out.select(F.col("_id").alias(row_id), "pos", "val", "known")


def _sharded(t: DataFrame, d: DataFrame, shards: int, schema: str) -> DataFrame:
    """One shard of the dictionary after the other goes to the workers and over all rows; only the places found are shuffled."""
    spark = t.sparkSession
    id_type = t.schema["_id"].dataType.simpleString()
    t, d = t.withColumn("_u", F.xxhash64("_id", "_x")), written(d, "dictionary")
    kinds = [("_u", pa.int64()), ("_s", pa.int32()), ("_e", pa.int32()), ("_w", pa.string())]
    found = None
    for k in range(shards):
        words = spark.sparkContext.broadcast(sorted(r[0] for r in d.filter(F.pmod(F.xxhash64("_v"), F.lit(shards)) == k).collect()))

        def find(batches: Iterator[pa.RecordBatch], words=words) -> Iterator[pa.RecordBatch]:
            known = words.value
            a = automaton(known)
            for b in batches:
                out = [(u, s, e, known[i]) for u, x in zip(b.column("_u").to_pylist(), b.column("_x").to_pylist()) for s, e, i in spans(a, x)]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])

        part = written(t.select("_u", "_x").mapInArrow(find, "_u long, _s int, _e int, _w string"), "places")
        words.destroy()
        found = part if found is None else found.unionByName(part)
    by_row = found.distinct().groupBy("_u").agg(F.collect_list(F.struct("_s", "_e", "_w")).alias("_m"))  # bounded by a row's length
    met = t.join(by_row, "_u", "left").select("_id", "_x", "_m")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = [[(m["_s"], m["_e"], m["_w"]) for m in ms or ()] for ms in b.column("_m").to_pylist()]
            numbered = [[(s, e, k) for k, (s, e, _) in enumerate(ms)] for ms in places]
            for i in range(b.num_rows):
                yield from _split(b.column("_id").slice(i, 1), b.column("_x").slice(i, 1).to_pylist(), [numbered[i]], lambda _, k: k, lambda k, i=i: places[i][k][2])

    return met.mapInArrow(split, f"_id {id_type}, " + schema.split(", ", 1)[1])


def _split(ids: pa.Array, texts: list[str], given: list, find, word) -> Iterator[pa.RecordBatch]:
    row, pos, val, known = [], [], [], []
    for r, (x, g) in enumerate(zip(texts, given)):
        for k, (v, i) in enumerate(segment(x, find(x, g)), 1):
            row.append(r)
            pos.append(k)
            val.append(v if i < 0 else word(i))
            known.append(i >= 0)
    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), pa.array(pos, pa.int32()), pa.array(val, pa.string()), pa.array(known, pa.bool_())], names=["_id", "pos", "val", "known"])
