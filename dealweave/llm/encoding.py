"""Text that was decoded with the wrong character encoding: found and restored.

A record's latent state is the chain of encodings it went through: written in one, read in another, maybe twice. The evidence is its
stretches of non-ASCII characters, each with its two neighbours. A stretch is judged by the ratio of what a character model says of it as it
stands and of what it becomes when a chain is undone. The model (pairs of neighbouring characters) and the chains' shares in each source
and field are estimated together by expectation-maximisation over the distinct stretches of all records: stretches that a chain explains
stop counting as language, so a manner of garbling that is common in one source doesn't come to look normal. In the end each record takes
the chain of the highest posterior over all its stretches.

All statistics cover all records. The model has a fixed size (character pairs and sources are hashed), so what goes to the driver and to the
workers doesn't grow with the data.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealweave.session import written

PAIRS, SINGLES, SOURCES = 1 << 18, 1 << 16, 1 << 12
#: Chains (written in, read in), undone from the last to the first.
_SINGLE = ("cp1252", "cp1250", "cp1251", "cp1254", "koi8_r", "cp866", "mac_roman", "cp437", "cp850", "iso8859_2", "iso8859_5")
_UTF8_READ = ("cp1252", "latin_1", "cp1250", "cp1251", "cp1254", "mac_roman", "cp437", "cp850", "koi8_r", "cp866", "iso8859_2", "cp932", "gbk", "euc_jp", "big5", "cp949")
_WIDE = ("cp932", "euc_jp", "gbk", "big5", "euc_kr")
CHAINS: tuple[tuple[tuple[str, str], ...], ...] = (
    *((("utf_8", r),) for r in _UTF8_READ),
    *((("utf_8", a), ("utf_8", b)) for a in ("cp1252", "latin_1") for b in ("cp1252", "latin_1")),
    *(((w, r),) for w in _WIDE for r in ("cp1252", "latin_1", "cp1251", "mac_roman", "cp437", *(_WIDE)) if w != r),
    *(((w, r),) for w in _SINGLE for r in _SINGLE if w != r),
)
LOST = len(CHAINS)  # what no chain can undo
NAMES = [" > ".join(f"{w} read as {r}" for w, r in c) for c in CHAINS] + ["lost bytes"]
STRETCH = re.compile("[^\x00-\x7f]+")
_WIDE_STRETCH = re.compile("[^\x00-\x7f](?:[@-~]?[^\x00-\x7f])*[@-~]?")
_SMOOTH, _FIRST_SHARE = 2.0, 0.02


_CODECS = sorted({e for c in CHAINS for step in c for e in step} - {"utf_8"})
_ONE_BYTE = tuple(e for e in _CODECS if e not in _WIDE and e != "cp949")


@lru_cache(maxsize=None)
def _byte_of(codec: str) -> dict[str, bytes]:
    """For a one-byte encoding, the byte of each character; bytes without one stand for themselves, as browsers and editors do."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = bytes([b])
        except UnicodeDecodeError:
            out[chr(b)] = bytes([b])
    return out


@lru_cache(maxsize=None)
def _readers(c: str) -> frozenset[str]:
    """The encodings that can give a character."""
    if c <= "\x7f" or c == "�":
        return frozenset(_CODECS)
    out = {e for e in _ONE_BYTE if c in _byte_of(e)}
    for e in set(_CODECS) - set(_ONE_BYTE):
        try:
            c.encode(e)
            out.add(e)
        except UnicodeError:
            pass
    return frozenset(out)


def _bytes(s: str, read: str, lost: bytes) -> bytes:
    if read in _ONE_BYTE:
        table = _byte_of(read)
        return b"".join(lost if c == "�" else table[c] if c > "\x7f" else c.encode() for c in s)
    return s.replace("�", "").encode(read)


def _undo_step(s: str, write: str, read: str) -> str | None:
    try:
        return _bytes(s.strip("�"), read, b"").decode(write)
    except UnicodeError:
        pass
    if write not in ("utf_8", *_WIDE) or "�" not in s:
        return None
    out = _bytes(s, read, b"\xff").decode(write, "replace")
    return out if out.count("�") * 3 <= len(out) else None


def undo(s: str, chain: int) -> str | None:
    """s with the chain undone; None if the bytes don't allow it or nothing changes."""
    out: str | None = s
    for write, read in reversed(CHAINS[chain]):
        if not all(read in _readers(c) for c in set(out)):
            return None
        out = _undo_step(out, write, read)
        if not out:
            return None
    if out == s or any("\x80" <= c <= "\x9f" for c in out):
        return None
    return out


@lru_cache(maxsize=200_000)
def candidates(s: str) -> tuple[tuple[tuple[int, ...], str], ...]:
    """(chains, restored) for every text that some chains make of s when undone."""
    can = frozenset.intersection(*map(_readers, set(s)))
    seen: dict[str, list[int]] = {}
    for k, c in enumerate(CHAINS):
        if c[-1][1] in can and (r := undo(s, k)) is not None:
            seen.setdefault(r, []).append(k)
    if not seen and any(c == "�" or "\x80" <= c <= "\x9f" for c in s):
        seen[s] = [LOST]  # neither a replacement character nor a control character is ever written
    return tuple((tuple(ks), r) for r, ks in seen.items())


def _usual(c: str) -> bool:
    n = ord(c)
    return n < 0x530 or 0x1E00 <= n < 0x2C00 or 0x3000 <= n < 0x3100 or 0x4E00 <= n < 0xA000 or 0xAC00 <= n < 0xD7B0 or 0xFF00 <= n < 0xFFF0 or 0x1F300 <= n < 0x1FB00


def _structural(s: str) -> bool:
    """Whether s itself tells of garbling: control characters, lost bytes, or one-byte characters that read as UTF-8."""
    if any("\x80" <= c <= "\x9f" or c == "�" for c in s):
        return True
    return any(CHAINS[k][-1][0] == "utf_8" and CHAINS[k][-1][1] in _ONE_BYTE and all(map(_usual, r)) for ks, r in candidates(s) for k in ks if k < LOST)


def pair(a: str, b: str) -> int:
    return ((ord(a) * 2654435761) ^ (ord(b) * 40503)) % PAIRS


def _chars(c: str) -> str:
    return "\x02" if c.isspace() and c != "\xa0" else "0" if c in "0123456789" else c


def bigrams(left: str, s: str, right: str) -> list[tuple[str, str]]:
    t = [_chars(left), *map(_chars, s), _chars(right)]
    return list(zip(t, t[1:]))


class Model:
    """Log probabilities of character pairs, and each source's log shares of the chains."""

    def __init__(self, pairs: array, firsts: array, singles: array, total: float, shares: dict[tuple[int, int], float]):
        self.pairs, self.firsts, self.singles, self.total, self.shares = pairs, firsts, singles, total, shares
        self.cache: dict = {}

    def of(self, left: str, s: str, right: str) -> float:
        out = 0.0
        for a, b in bigrams(left, s, right):
            single = (self.singles[ord(b) % SINGLES] + 0.02) / (self.total + 0.02 * SINGLES)
            out += math.log((self.pairs[pair(a, b)] + _SMOOTH * single) / (self.firsts[ord(a) % SINGLES] + _SMOOTH))
        return out

    def ratios(self, left: str, s: str, right: str) -> list[tuple[tuple[int, ...], str, float]]:
        """(chains, restored, log ratio of restored to s), where it is above -3."""
        key = (left, s, right)
        if key not in self.cache:
            if len(self.cache) > 300_000:
                self.cache.clear()
            own = self.of(left, s, right)
            scored = ((ks, r, 20.0 if ks[0] == LOST else self.of(left, r, right) - own) for ks, r in candidates(s))
            self.cache[key] = [x for x in scored if x[2] > -3]
        return self.cache[key]

    def share(self, source: int, chain: int) -> float:
        return self.shares.get((source, chain), self.shares.get((-1, chain), 1e-6))


def _source(name: object) -> int:
    return xxhash.xxh64_intdigest(str(name)) % SOURCES


def stretches(text: str) -> Iterator[tuple[str, str, str]]:
    for m in STRETCH.finditer(text):
        i, j = m.span()
        yield text[i - 1] if i else "\x02", m.group(), text[j] if j < len(text) else "\x02"


def _collect(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for source, text in zip(b.column("_source").to_pylist(), b.column("_x").to_pylist()):
                if not text.isascii():
                    seen.update((source, a, s, z) for a, s, z in stretches(text))
            if len(seen) > 200_000:
                yield from _counted(seen)
                seen.clear()
        yield from _counted(seen)

    counted = rows.select("_source", "_x").mapInArrow(run, "_source string, _a string, _s string, _z string, _n long")
    return counted.groupBy("_source", "_a", "_s", "_z").agg(F.sum("_n").alias("_n"))


def _counted(seen: Counter) -> Iterator[pa.RecordBatch]:
    if seen:
        cols = list(zip(*seen))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array(seen.values(), pa.int64())], names=["_source", "_a", "_s", "_z", "_n"])


def _posterior(model: Model, source: int, a: str, s: str, z: str) -> tuple[float, list[tuple[int, str, float]]]:
    """The probability that a stretch stands as written, and that of each chain."""
    found = [x for x in model.ratios(a, s, z) if x[2] > 0]
    if not found:
        return 1.0, []
    shares = [[model.share(source, k) for k in ks] for ks, _, _ in found]
    logs = [math.log(sum(x)) + r for x, (_, _, r) in zip(shares, found)]
    top = max(0.0, *logs)
    weights = [math.exp(x - top) for x in logs]
    whole = math.exp(-top) + sum(weights)
    out = []
    for (ks, r, _), w, x in zip(found, weights, shares):
        out += [(k, r, w / whole * y / sum(x)) for k, y in zip(ks, x)]
    return math.exp(-top) / whole, out


def _expect(units: DataFrame, model: Model | None) -> Model:
    """One step of expectation-maximisation; without a model, the first one: stretches that tell of garbling by themselves don't count."""
    sent = units.sparkSession.sparkContext.broadcast(None if model is None else (model.pairs, model.firsts, model.singles, model.total, model.shares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None if sent.value is None else Model(*sent.value)
        out: dict[tuple[int, int, int], float] = defaultdict(float)
        for b in batches:
            for source, a, s, z, n in zip(*(b.column(c).to_pylist() for c in ("_source", "_a", "_s", "_z", "_n"))):
                at = _source(source)
                if m is None:
                    clean, garbled = (0.0, []) if _structural(s) else (1.0, [])
                else:
                    clean, garbled = _posterior(m, at, a, s, z)
                for text, w in [(s, clean), *((r, w) for k, r, w in garbled if k < LOST and "�" not in r)]:
                    if w > 1e-6:
                        # A stretch counts by less than its number: a phrase repeated without end must not drown the rest.
                        w *= n**0.75
                        for x, y in bigrams(a, text, z):
                            out[0, pair(x, y), 0] += w
                            out[1, ord(x) % SINGLES, 0] += w
                            out[2, ord(y) % SINGLES, 0] += w
                out[3, at, -1] += n
                for k, _, w in garbled:
                    out[3, at, k] += w * n
        if out:
            kind, key, chain = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.int32()), pa.array(chain, pa.int32()), pa.array(out.values(), pa.float64())], names=["kind", "key", "chain", "w"])

    sums = units.mapInArrow(run, "kind int, key int, chain int, w double").groupBy("kind", "key", "chain").agg(F.sum("w").alias("w"))
    pairs, firsts, singles = (array("f", bytes(4 * n)) for n in (PAIRS, SINGLES, SINGLES))
    seen: dict[int, float] = defaultdict(float)
    by: dict[tuple[int, int], float] = defaultdict(float)
    for kind, key, chain, w in sums.toPandas().itertuples(index=False):
        if kind < 3:
            (pairs, firsts, singles)[kind][key] = w
        elif chain < 0:
            seen[key] += w
            seen[-1] += w
        else:
            by[key, chain] += w
            by[-1, chain] += w
    if model is None:
        shares = {(-1, k): _FIRST_SHARE / len(NAMES) for k in range(len(NAMES))}
    else:
        # Each source's shares lean on those of all sources, by the weight of 200 stretches.
        whole = {k: (by.get((-1, k), 0.0) + 1e-3) / (seen[-1] + 1.0) for k in range(len(NAMES))}
        shares = {(-1, k): max(v, 1e-7) for k, v in whole.items()}
        shares |= {(at, k): max((by[at, k] + 200 * whole[k]) / (seen[at] + 200), 1e-7) for at, k in by if at >= 0}
    return Model(pairs, firsts, singles, sum(singles), shares)


def judge(model: Model, source: int, text: str, least: float = 0.5) -> tuple[int, float, str] | None:
    """(chain, posterior, restored text) of a record, or None where it most likely stands as written."""
    scores: dict[int, float] = defaultdict(float)
    for a, s, z in stretches(text):
        for ks, _, r in model.ratios(a, s, z):
            for k in ks if r > 0 else ():
                scores[k] += max(0.0, r - math.log(2))  # a stretch of a garbled record may itself be untouched
    if not scores:
        return None
    logs = {k: v + math.log(model.share(source, k)) for k, v in scores.items()}
    top = max(0.0, *logs.values())
    clean = math.exp(-top)
    whole = clean + sum(math.exp(v - top) for v in logs.values())
    best = max(logs, key=lambda k: (logs[k], -k))
    if 1 - clean / whole < least:
        return None

    if best < LOST and CHAINS[best][0][0] in _WIDE:  # second bytes may be ASCII
        joined = _WIDE_STRETCH.sub(lambda m: undo(m.group(), best) or m.group(), text)
        if joined.count("�") <= text.count("�"):
            return best, 1 - clean / whole, joined

    def mend(m: re.Match) -> str:
        i, j = m.span()
        found = model.ratios(text[i - 1] if i else "\x02", m.group(), text[j] if j < len(text) else "\x02")
        own = [r for ks, r, _ in found if best in ks]
        other = max(found, key=lambda x: x[2], default=None)
        return own[0] if own else other[1] if other and other[0][0] < LOST and other[2] > 6 else m.group()

    return best, 1 - clean / whole, STRETCH.sub(mend, text) if best < LOST else text


def restore_encoding(rows: DataFrame, *, row_id: str, text: str, source: str, steps: int = 4, least: float = 0.3) -> DataFrame:
    """(row_id, chain, posterior, restored): one row for each record that has a garbled stretch with a probability of at least `least`.

    restored is the text with its garbled stretches mended as far as the chain can be undone; chain names it, "lost bytes" meaning that
    nothing can be. NULL, empty and ASCII texts give no row. A NULL source is a source of its own. Repeated records are judged alike
    and counted as often as they occur. Other columns are ignored. An empty table gives no rows.
    """
    t = rows.select(F.col(row_id).alias("_id"), F.col(source).cast("string").alias("_source"), F.col(text).alias("_x")).filter("_x is not null and _x <> ''")
    units = written(_collect(t), "stretches")
    model = None
    for _ in range(steps):
        model = _expect(units, model)
    sent = rows.sparkSession.sparkContext.broadcast((model.pairs, model.firsts, model.singles, model.total, model.shares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        for b in batches:
            hits = []
            for i, (source, x) in enumerate(zip(b.column("_source").to_pylist(), b.column("_x").to_pylist())):
                if not x.isascii() and (j := judge(m, _source(source), x, least)):
                    hits.append((i, NAMES[j[0]], j[1], j[2]))
            row, chain, p, restored = zip(*hits) if hits else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column("_id").take(pa.array(row, pa.int64())), pa.array(chain, pa.string()), pa.array(p, pa.float64()), pa.array(restored, pa.string())], names=["_id", "chain", "posterior", "restored"])

    kind = t.schema["_id"].dataType.simpleString()
    return t.mapInArrow(run, f"_id {kind}, chain string, posterior double, restored string").withColumnRenamed("_id", row_id)
