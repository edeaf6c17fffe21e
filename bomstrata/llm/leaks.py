"""Evaluation passages in training text, by greedy string tiling on words.

The held-out items are split into blocks of bounded size; each block is broadcast and met by every document in a
narrow map, so documents are never shuffled and a hot author, source or copy costs nothing extra. In a task,
batches of documents become word numbers with vectorised Arrow and NumPy functions; a running Karp-Rabin hash over
``SEED`` words joins documents and items on shared seeds. Each pair that shares ``least_seeds`` is tiled: the longest
common runs of words are marked first, never overlapping, down to runs of ``TILE`` words. Neighbouring tiles in
the same order, with a few words replaced between them, form a passage, which goes on over single replaced words at
both ends; a passage of ``min_words`` item words or
more, of which tiles cover ``coverage``, is a leak. Tiles do not have to follow the item's order as a whole, so
items whose sentences were rearranged are found by each passage.
"""

from __future__ import annotations

import functools
import hashlib
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED, TILE, GAP = 4, 3, 3
#: Items of one broadcast.
ITEMS_PER_BLOCK = 20_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Marks without meaning for the words: tags, comments, character references, invisible characters.
_ATTRIBUTE = r"""\s+[A-Za-z_:@][A-Za-z0-9_:.\-]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>=]+))?"""
_MARKUP = rf"(?s)<!--.*?-->|</?[A-Za-z][A-Za-z0-9:\-]*(?:{_ATTRIBUTE})*\s*/?>|&#?[A-Za-z0-9]+;"
_INVISIBLE = "[­​-‍⁠﻿]"


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which characters of the basic plane are letters or digits."""
    return np.array([unicodedata.category(chr(i))[0] in "LN" for i in range(1 << 16)])


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = (np.cumprod(np.r_[np.uint64(1), np.full(n, x, np.uint64)], dtype=np.uint64) for x in (_BASE, _INVERSE))
    return up, down


@dataclass
class Words:
    """Words of a batch of texts, lower-case, without markup, punctuation and layout: hashes, and where each text starts."""

    codes: np.ndarray
    first: np.ndarray
    last: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        t = pc.replace_substring_regex(texts, _MARKUP, " ")
        t = pc.utf8_lower(pc.replace_substring_regex(t, _INVISIBLE, ""))
        lists = t.to_pylist()
        codes = np.frombuffer("\n".join([*lists, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        ok = _letters()[np.minimum(codes, 65535)]
        for i in np.flatnonzero(codes > 65535).tolist():
            ok[i] = unicodedata.category(chr(codes[i]))[0] in "LN"
        edge = np.flatnonzero(np.diff(np.r_[False, ok, False].astype(np.int8)))
        ends = np.cumsum(np.array([len(x) + 1 for x in lists], np.int64)) if lists else np.zeros(0, np.int64)
        return cls(codes, edge[::2], edge[1::2], np.r_[0, np.searchsorted(edge[::2], ends)])

    def hashes(self) -> np.ndarray:
        """One hash per word, from prefix sums over the batch."""
        up, down = _powers(1 << max(10, int(len(self.codes)).bit_length()))
        with np.errstate(over="ignore"):
            sums = np.r_[np.uint64(0), np.cumsum((self.codes.astype(np.uint64) + np.uint64(1)) * up[: len(self.codes)], dtype=np.uint64)]
            z = (sums[self.last] - sums[self.first]) * down[self.first]
            z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return z ^ (z >> np.uint64(29))

    def texts(self) -> list[str]:
        whole = self.codes.tobytes().decode("utf-32-le", "surrogatepass")
        return [whole[x:y] for x, y in zip(self.first.tolist(), self.last.tolist())]


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``k`` word numbers."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * _BASE + ids[j : j + n].astype(np.uint64)
    return h


def tiles(item: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item position, document position, length), longest first; words 0 match nothing."""
    a, b = rolling(item, TILE), rolling(doc, TILE)
    order = np.argsort(a, kind="stable")
    lo, hi = np.searchsorted(a[order], b), np.searchsorted(a[order], b, "right")
    n = hi - lo
    j = np.repeat(np.arange(len(b)), n)
    i = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    same = np.ones(len(i), bool)
    for k in range(TILE):
        same &= (item[i + k] == doc[j + k]) & (item[i + k] > 0)
    i, j = i[same], j[same]
    if not len(i):
        return []
    by = np.lexsort((i, i - j))
    i, j = i[by], j[by]
    new = np.r_[True, (np.diff(i - j) != 0) | (np.diff(i) != 1)]
    first = np.flatnonzero(new)
    runs = [(int(m) + TILE - 1, int(i[f]), int(j[f])) for f, m in zip(first, np.diff(np.r_[first, len(i)]))]
    free_i, free_j = np.ones(len(item), bool), np.ones(len(doc), bool)
    out = []
    runs.sort(key=lambda r: (-r[0], r[1], r[2]))
    import heapq

    heap = [(-m, x, y) for m, x, y in runs]
    heapq.heapify(heap)
    while heap:
        m, x, y = heapq.heappop(heap)
        m = -m
        open_ = free_i[x : x + m] & free_j[y : y + m]
        if open_.all():
            free_i[x : x + m] = False
            free_j[y : y + m] = False
            out.append((x, y, m))
            continue
        edge = np.flatnonzero(np.diff(np.r_[False, open_, False].astype(np.int8)))  # what a longer tile left over
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if e - s >= TILE:
                heapq.heappush(heap, (s - e, x + s, y + s))
    return out


def _beyond(item: np.ndarray, doc: np.ndarray, x: int, y: int, step: int, most: int) -> list[tuple[int, int]]:
    """(words, equal words) that a passage may gain from positions x and y on, over single replaced words."""
    out, words_, equal, replaced = [(0, 0)], 0, 0, False
    while words_ < most and 0 <= x < len(item) and 0 <= y < len(doc):
        same = item[x] == doc[y]
        if not same and replaced:
            break
        replaced = not same
        words_, equal = words_ + 1, equal + int(same)
        if same:
            out.append((words_, equal))
        x, y = x + step, y + step
    return out


def has_passage(item: np.ndarray, doc: np.ndarray, min_words: int, coverage: float) -> bool:
    """Whether neighbouring tiles, with runs shorter than a tile at both ends, cover a passage of ``min_words`` words of the item."""
    marked = sorted(tiles(item, doc), key=lambda t: t[1])
    for s in range(len(marked)):
        x, y, m = marked[s]
        start, end_i, end_j, covered = x, x + m, y + m, m
        if m >= min_words:
            return True
        before = _beyond(item, doc, x - 1, y - 1, -1, min_words)

        def fits() -> bool:
            after = _beyond(item, doc, end_i, end_j, 1, min_words)
            return any((n := end_i - start + u + w) >= min_words and covered + v + e >= coverage * n for u, v in before for w, e in after)

        if fits():
            return True
        for x, y, m in marked[s + 1 :]:
            if y - end_j > GAP:
                break
            if not 0 <= x - end_i <= GAP:
                continue
            end_i, end_j, covered = x + m, y + m, covered + m
            if fits():
                return True
    return False


class Items:
    """Seed index of a block of items."""

    def __init__(self, rows: list[tuple[int, str]], min_words: int):
        w = Words.of(pa.array([t for _, t in rows], pa.string()))
        h = w.hashes()
        self.vocabulary = np.unique(h)
        ids = number(h, self.vocabulary)
        self.items: list[tuple[int, np.ndarray]] = []
        seeds, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, (key, _) in enumerate(rows):
            own = ids[w.starts[i] : w.starts[i + 1]]
            if len(own) < min_words:
                continue
            r = np.unique(rolling(own, SEED))
            seeds.append(r)
            owner.append(np.full(len(r), len(self.items)))
            self.items.append((key, own))
        all_seeds, all_owner = np.concatenate(seeds), np.concatenate(owner)
        by = np.argsort(all_seeds, kind="stable")
        self.seeds, self.owner = all_seeds[by], all_owner[by]


def number(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Word numbers from 1; 0 for words that no item has."""
    if not len(vocabulary):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at + 1, 0)


def least_seeds(min_words: int, coverage: float) -> int:
    """Seeds that a document and an item with a passage in common share at least.

    Of ``n`` words ``r`` are replaced and leave ``r + 1`` runs, each of which has ``SEED - 1`` seeds fewer than words. Half
    of the smallest number leaves room for words that are put in, which break runs too.
    """
    replaced = lambda n: int(n * (1 - coverage))
    return max(1, (min(n - replaced(n) - (replaced(n) + 1) * (SEED - 1) for n in range(min_words, 4 * min_words)) + 1) // 2)


_INDEXES: dict = {}


def find_leaks(docs: DataFrame, items: DataFrame, min_words: int = 20, coverage: float = 0.875) -> DataFrame:
    """``doc_id, item_id`` of each document whose text holds a passage of an item.

    Letter case, punctuation, layout, markup and a few replaced words (one in eight at most) do not count. Items of
    fewer than ``min_words`` words cannot leak; null and empty texts give no rows; repeated rows give a pair each
    once per row id; whole texts are read, however long. Only ``doc_id, text, item_id, item_text`` are read.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("text").isNotNull())
    it = items.select(F.col("item_id").cast("long"), "item_text").where(F.col("item_text").isNotNull()).distinct()
    n = it.count()
    out = None
    blocks = max(1, -(-n // ITEMS_PER_BLOCK))
    for b in range(blocks):
        rows = sorted((r[0], r[1]) for r in it.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == b).collect())
        part = _against(d, spark.sparkContext.broadcast(rows), min_words, coverage)
        out = part if out is None else out.unionByName(part)
    return out.distinct() if blocks > 1 else out


def _against(docs: DataFrame, shared, min_words: int, coverage: float) -> DataFrame:
    enough = least_seeds(min_words, coverage)
    digest = hashlib.sha256(repr(shared.value).encode()).hexdigest()  # of the items themselves: a worker outlives a query

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (digest, min_words)
        if key not in _INDEXES:
            _INDEXES.clear()
            _INDEXES[key] = Items(shared.value, min_words)
        ix = _INDEXES[key]
        for whole in batches:
            for a in range(0, whole.num_rows, 2000):
                batch = whole.slice(a, 2000)
                w = Words.of(batch.column(1))
                ids, starts = number(w.hashes(), ix.vocabulary), w.starts
                h = rolling(ids, SEED)
                at = np.searchsorted(ix.seeds, h)
                hit = np.flatnonzero((at < len(ix.seeds)) & (ix.seeds[np.minimum(at, len(ix.seeds) - 1)] == h)) if len(ix.seeds) else np.zeros(0, np.int64)
                if not len(hit):
                    continue
                doc = np.searchsorted(starts, hit, "right") - 1
                lo, hi = at[hit], np.searchsorted(ix.seeds, h[hit], "right")
                m = hi - lo
                d = np.repeat(doc, m)
                o = ix.owner[np.repeat(lo, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
                pairs, shared_seeds = np.unique(d * len(ix.items) + o, return_counts=True)
                found = []
                for p in pairs[shared_seeds >= enough].tolist():
                    i, j = divmod(p, len(ix.items))
                    if has_passage(ix.items[j][1], ids[starts[i] : starts[i + 1]], min_words, coverage):
                        found.append((i, ix.items[j][0]))
                if found:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([f[0] for f in found])), pa.array([f[1] for f in found], pa.int64())], names=["doc_id", "item_id"])

    return docs.mapInArrow(run, "doc_id long, item_id long").distinct()
