"""Evaluation passages inside a training corpus, verbatim or slightly altered.

Documents are read in shards. Of each shard a suffix array over its words is built (suffixes in the order of their first SEED words, words
being ordered by their hash), and every suffix of every test item is looked up in it by binary search. That gives all places where a test
item and the corpus agree for SEED words or more; each is extended to the longest verbatim match, and from there, by a banded edit distance, across
changed, added or missing words, as long as these are neither names nor figures. A document leaks an item if a stretch of the item of at least
min_words words is covered with at most one such edit in edit_share words.

Why no case is lost: a covered stretch can be cut into pieces of min_words to 2 * min_words - 1 words, one of which holds no more than
its share of edits (2 in 16, 3 in 24); its words then include a run of at least 5 verbatim words, which is SEED.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 5
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|&(?:[a-zA-Z]{2,8}|#\d{1,6});")
_QUOTES, _SPACES = "’‘ʼ`´", "“”„«»‹›–—‑…•·→←★☆│├└─┌┐§¿¡€£¥©®™±    　、。，（）「」"
_JOINERS = "­​﻿"
_WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")
_POWERS = np.cumprod(np.full(512, 1099511628211, np.uint64), dtype=np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[48:58] = True


def plain(text: str) -> str:
    """text without markup and with plain punctuation."""
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        for c in _QUOTES:
            text = text.replace(c, "'")
        for c in _SPACES:
            text = text.replace(c, " ")
        for c in _JOINERS:
            text = text.replace(c, "")
    return text


def hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of each word, the index of its text), in order. Case, punctuation and what stands inside figures don't count."""
    joined = "\n\x01".join(texts).lower()  # the mark gives the index
    raw = np.frombuffer(joined.encode(), np.uint8)
    digit, word = _IS_DIGIT[raw], _IS_WORD[raw]
    # Points and commas between digits and quotes between letters vanish.
    inner = np.zeros(len(raw), bool)
    if len(raw) > 2:
        mid = raw[1:-1]
        inner[1:-1] = (((mid == 44) | (mid == 46)) & digit[:-2] & digit[2:]) | ((mid == 39) & word[:-2] & word[2:])
    raw, word = raw[~inner], word[~inner]
    text_of = np.cumsum(raw == 1)
    at = np.flatnonzero(word)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.ones(len(at), bool)
    first[1:] = np.diff(at) > 1
    start = np.flatnonzero(first)
    place = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
    values = (raw[at].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 511]
    h = np.add.reduceat(values, start)
    h ^= h >> np.uint64(29)
    h *= _MIX[0]
    h ^= h >> np.uint64(32)
    return h, text_of[at[start]]


def seeds(h: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of the suffixes that have SEED words in their text."""
    n = len(h) - SEED + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(text_of[:n] == text_of[SEED - 1 :])
    key = np.zeros(len(at), np.uint64)
    for j in range(SEED):
        key += (h[at + j] ^ (h[at + j] >> np.uint64(17))) * _MIX[j]
    return at, key


class Items:
    """The test items: their words' hashes, which words are names or figures, and their suffixes by key."""

    def __init__(self, ids: list, texts: list[str], common_from: int):
        self.ids = ids
        texts = [plain(t) for t in texts]
        self.h, self.text_of = hashes(texts)
        self.fixed = self._fixed(texts, common_from)
        self.end = np.searchsorted(self.text_of, self.text_of, "right")
        self.begin = np.searchsorted(self.text_of, self.text_of, "left")
        at, key = seeds(self.h, self.text_of)
        order = np.argsort(key, kind="stable")
        self.keys, first, self.count = np.unique(key[order], return_index=True, return_counts=True)
        self.at, self.first = at[order], first

    def _fixed(self, texts: list[str], common_from: int) -> np.ndarray:
        """Words with a digit; capitalised words, but for those that open a sentence and are written small elsewhere or open many."""
        words, opens = [], []
        for t in texts:
            t = re.sub(r"(?<=\d)[.,](?=\d)|(?<=[0-9A-Za-z\u0080-\U0010ffff])'(?=[0-9A-Za-z\u0080-\U0010ffff])", "", t)
            end = 0
            for m in _WORD.finditer(t):
                gap = t[end : m.start()]
                words.append(m.group())
                opens.append(end == 0 or bool(re.search(r"[.!?:\n]", gap)))
                end = m.end()
        small = {w for w in words if w[0].islower()}
        opening = Counter(w.lower() for w, o in zip(words, opens) if o)
        out = []
        for w, o in zip(words, opens):
            common = o and (w.lower() in small or opening[w.lower()] >= common_from)
            out.append(any(c.isdigit() for c in w) or (w[0].isupper() and not common))
        assert len(out) == len(self.h)
        return np.array(out, bool)


def _runs(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray, p_end: np.ndarray, q_end: np.ndarray, step: int) -> np.ndarray:
    """How many words from (p, q) on agree, forwards (step 1, ends exclusive) or backwards (-1, ends inclusive)."""
    n = np.zeros(len(p), np.int64)
    live = np.arange(len(p))
    while len(live):
        a, b = p[live] + step * n[live], q[live] + step * n[live]
        ok = (a < p_end[live]) & (b < q_end[live]) if step > 0 else (a >= p_end[live]) & (b >= q_end[live])
        live, a, b = live[ok], a[ok], b[ok]
        live = live[x[a] == y[b]]
        n[live] += 1
    return n


def _reach(items: Items, x: np.ndarray, names: np.ndarray, p: np.ndarray, q: np.ndarray, p_end: np.ndarray, q_end: np.ndarray, step: int, edits: int) -> np.ndarray:
    """Item words covered from (p, q) on with 0, 1, ... edits, as columns.

    A banded edit distance: for each number of edits and each diagonal (added less missing words) the farthest place is kept, so edits may
    stand next to each other and no choice between them is final. A word that is a name or a figure on either side isn't passed by an edit.
    """
    out = np.zeros((len(p), edits + 1), np.int64)
    n = _runs(x, items.h, p, q, p_end, q_end, step)
    out[:, 0] = n
    inside = lambda a, end: a < end if step > 0 else a >= end
    # far[d]: item words covered on diagonal d; -1 where it isn't reached. The document's place is p + step * (far + d).
    far = {0: n}
    for e in range(1, edits + 1):
        new: dict[int, np.ndarray] = {}
        for d, f in far.items():
            at_p, at_q = p + step * (f + d), q + step * f
            ok_p, ok_q = (f >= 0) & inside(at_p, p_end), (f >= 0) & inside(at_q, q_end)
            ok_p[ok_p] = ~names[at_p[ok_p]]
            ok_q[ok_q] = ~items.fixed[at_q[ok_q]]
            # A word added in the document, one missing, one changed.
            for to, may, dq in ((d + 1, ok_p, 0), (d - 1, ok_q, 1), (d, ok_p & ok_q, 1)):
                new[to] = np.maximum(new.get(to, np.full(len(p), -1)), np.where(may, f + dq, -1))
        for d, f in new.items():
            i = np.flatnonzero(f >= 0)
            run = _runs(x, items.h, p[i] + step * (f[i] + d), q[i] + step * f[i], p_end[i], q_end[i], step)
            f[i] += run
            closed = i[run > 0]  # what is covered ends with a word that agrees
            out[closed, e] = np.maximum(out[closed, e], f[closed])
            far[d] = np.maximum(f, far[d]) if d in far else f
        out[:, e] = np.maximum(out[:, e], out[:, e - 1])
    return out


def leaks_in(items: Items, texts: list[str], min_words: int, edit_share: int) -> list[tuple[int, int, int, int, int]]:
    """(text, item, longest verbatim match, its place in the text, its place in the item) of each text that leaks an item."""
    h, text_of = hashes(texts)
    at, key = seeds(h, text_of)
    if not len(at) or not len(items.keys):
        return []
    suffixes = np.argsort(key)
    ordered = key[suffixes]
    lo = np.searchsorted(ordered, items.keys, "left")
    hi = np.searchsorted(ordered, items.keys, "right")
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return []
    # Every place of a hit suffix with every item suffix of that key.
    width = (hi - lo)[hit]
    which = np.repeat(hit, width)
    place = at[suffixes[np.repeat(lo[hit] - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())]]
    many = items.count[which]
    p = np.repeat(place, many)
    q = items.at[np.repeat(items.first[which] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())]
    doc_lo = np.searchsorted(text_of, text_of[p], "left")
    doc_hi = np.searchsorted(text_of, text_of[p], "right")
    # One place of each verbatim run is enough: that at its start.
    opens = (p == doc_lo) | (q == items.begin[q])
    opens[~opens] = h[p[~opens] - 1] != items.h[q[~opens] - 1]
    p, q, doc_lo, doc_hi = p[opens], q[opens], doc_lo[opens], doc_hi[opens]
    edits = (2 * min_words - 1) // edit_share
    names = np.isin(h, np.unique(items.h[items.fixed]))
    ahead = _reach(items, h, names, p, q, doc_hi, items.end[q], 1, edits)
    keep = ahead[:, 0] >= SEED
    p, q, doc_lo, ahead = p[keep], q[keep], doc_lo[keep], ahead[keep]
    back = _reach(items, h, names, p - 1, q - 1, doc_lo, items.begin[q], -1, edits)
    found = np.zeros(len(p), bool)
    for a in range(edits + 1):
        for b in range(edits + 1 - a):
            n = back[:, a] + ahead[:, b]
            found |= (n >= min_words) & ((a + b) * edit_share <= n)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for k in np.flatnonzero(found):
        key_, run = (int(text_of[p[k]]), int(items.text_of[q[k]])), int(ahead[k, 0])
        if key_ not in best or run > best[key_][0]:
            best[key_] = (run, int(p[k] - doc_lo[k]), int(q[k] - items.begin[q[k]]))
    return [(*key_, *v) for key_, v in best.items()]


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    *,
    doc_id: str,
    doc_text: str,
    item_id: str,
    item_text: str,
    min_words: int = 16,
    edit_share: int = 8,
    common_from: int = 5,
    shard_chars: int = 2_000_000,
    items_bytes: int = 16_000_000,
) -> DataFrame:
    """(doc_id, item_id, verbatim_words, doc_word, item_word): each document that carries a passage of an item, once per item.

    verbatim_words is the longest verbatim match among the seeds found leaking, doc_word and item_word are where it begins, counted in
    words from 0. NULL and empty texts, and items of fewer than min_words words, give no row. Repeated documents come out once per row, repeated
    items once per row. A capitalised word that opens at least common_from sentences of the items isn't taken for a name. Test items go to the
    workers in blocks of up to items_bytes, one pass over the corpus for each block. Other columns are ignored.
    """
    d = documents.select(F.col(doc_id).alias("_d"), F.col(doc_text).alias("_x")).filter("_x is not null and _x <> ''")
    t = items.select(F.col(item_id).alias("_i"), F.col(item_text).alias("_y")).filter("_y is not null and _y <> ''")
    kinds = [x.schema[c].dataType.simpleString() for x, c in ((d, "_d"), (t, "_i"))]
    schema = f"_d {kinds[0]}, _i {kinds[1]}, verbatim_words int, doc_word int, item_word int"
    total = t.agg(F.sum(F.octet_length("_y"))).first()[0] or 0
    blocks = max(1, -(-total // items_bytes))
    out = None
    for k in range(blocks):
        block = t if blocks == 1 else t.filter(F.pmod(F.xxhash64("_i"), F.lit(blocks)) == k)
        rows = block.orderBy("_i", "_y").collect()
        sent = documents.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))
        found = d.mapInArrow(_scan(sent, min_words, edit_share, common_from, shard_chars, pa.from_numpy_dtype(np.int32)), schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumnsRenamed({"_d": doc_id, "_i": item_id})


def _scan(sent, min_words: int, edit_share: int, common_from: int, shard_chars: int, small: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*sent.value, common_from)
        for b in batches:
            texts = [plain(x) for x in b.column("_x").to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= shard_chars):
                    size += len(texts[end])
                    end += 1
                hits = leaks_in(items, texts[at:end], min_words, edit_share)
                if hits:
                    doc, item, *rest = zip(*hits)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("_d").take(pa.array([at + i for i in doc])), pa.array([items.ids[i] for i in item]), *(pa.array(x, small) for x in rest)],
                        names=["_d", "_i", "verbatim_words", "doc_word", "item_word"],
                    )
                at = end

    return run
