"""Text decoded with the wrong character encoding: found and restored.

A wrong decoding is a substitution cipher: every letter stands, after the swap of code pages, as another letter (one
byte read in the wrong page) or as a group of letters (the bytes of UTF-8 read one by one). Which ciphers a source
suffers from, and the mapping from bytes to letters of each, is learned by expectation-maximisation against the
bigrams of the language; the public code pages only seed the mappings:

* language: bigrams of characters with at least one letter outside ASCII, counted over all documents into a table
  of fixed size (hashed pairs), so the model has the same size for any corpus;
* E step: each line is deciphered under every cipher; its posterior odds are the bigram likelihood of the result
  against the line as it stands, times the source's weight of that cipher. In lines that a cipher explains, every
  symbol gathers, for each letter of the written page, how well the letter fits between its neighbours;
* M step: bigrams are counted again over the lines as deciphered; the weights of the ciphers are counted per source; and
  a symbol of a source's cipher moves from the letter of its seed to another one if its neighbours speak for that
  letter by more than ``SEED_BONUS`` nats and no other symbol in use stands for it (``Learned``).

The last model deciphers every line, by translation tables from symbols to letters, again as long as a line gains by
it, for text that went wrong repeatedly. Text with replacement characters has lost letters for good and is reported
without a restoration.

Bigrams only count where a letter outside ASCII takes part, so scoring looks at such letters and their neighbours and
at nothing else of a text. Every pass is a narrow map with a bounded aggregate; no document is shuffled until the found
ones are written.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomstrata.session import cut

#: Pages in which the bytes of UTF-8 may have been read. "west" is Latin-1 and Windows-1252 together.
UTF8_READ_AS = ("west", "mac_roman", "cp437", "cp1251", "cp850", "cp1250", "koi8_r", "cp866")
#: (written in, read as) for one-byte pages.
SWAPS = (
    ("cp1251", "west"), ("koi8_r", "west"), ("cp866", "west"), ("iso8859_5", "west"), ("cp1250", "west"), ("iso8859_2", "west"), ("mac_roman", "west"), ("cp850", "west"),
    ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("iso8859_5", "cp1251"), ("west", "cp1251"), ("west", "mac_roman"), ("west", "cp437"), ("west", "cp850"),
    ("west", "cp1250"), ("cp1250", "iso8859_2"), ("west", "koi8_r"),
)
#: Most passes of learning; it ends when no symbol moves any more, after two passes where the seeds hold.
PASSES = 12
#: Sizes of the tables of pairs and of sources.
PAIRS, SOURCES = 1 << 19, 1 << 12
#: Evidence in nats that takes a symbol from the letter of its seed to another.
SEED_BONUS = 12.0
_KINDS = len(UTF8_READ_AS) + len(SWAPS)
_ALPHA, _PRIOR = 0.5, 1e-3
_ENTITIES = re.compile(r"(?:&#(?:12[89]|1[3-9]\d|2[0-4]\d|25[0-5]);)+")


def _decode_byte(b: int, page: str) -> str:
    try:
        return bytes([b]).decode("cp1252" if page == "west" else page)
    except UnicodeDecodeError:
        return chr(b)  # undefined bytes stay control characters


@functools.lru_cache(maxsize=None)
def to_byte(page: str) -> np.ndarray:
    """Letter -> byte of a page for bytes from 128; 0 elsewhere."""
    t = np.zeros(1 << 16, np.uint8)
    if page == "west":
        for b in range(128, 256):
            t[b] = b
    for b in range(128, 256):
        c = ord(_decode_byte(b, page))
        if c > 127:
            t[c] = b
    return t


@functools.lru_cache(maxsize=None)
def page_letters(page: str) -> np.ndarray:
    """Letters of the bytes from 128 of a page."""
    return np.array([ord(_decode_byte(x, page)) for x in range(128, 256)])


@functools.lru_cache(maxsize=None)
def swap_table(written: str, read: str) -> np.ndarray:
    """Letter as read -> letter as written: the seed of a cipher."""
    t = np.arange(1 << 16, dtype=np.int64)
    b = to_byte(read)
    t[b > 0] = page_letters(written)[b[b > 0].astype(np.int64) - 128]
    return t


class Learned:
    """Symbols that stand for other letters than their seeds say: {(source, cipher): {symbol: letter}}."""

    def __init__(self, moved: dict[tuple[int, int], dict[int, int]] | None = None):
        self.moved = moved or {}
        self.of_cipher: dict[int, list[tuple[int, np.ndarray]]] = {}
        for (source, k), own in self.moved.items():
            t = swap_table(*SWAPS[k]).copy()
            t[list(own)] = list(own.values())
            self.of_cipher.setdefault(k, []).append((source, t))

    def apply(self, k: int, low: np.ndarray, source: np.ndarray) -> np.ndarray:
        """Letters of symbols under cipher ``k``, each by its source's table."""
        d = swap_table(*SWAPS[k])[low]
        for s, t in self.of_cipher.get(k, ()):
            d = np.where(source == s, t[low], d)
        return d

    def translation(self, k: int, source: int) -> dict[int, int]:
        """The table of a cipher and source for ``str.translate``."""
        key = (k, source if (source, k) in self.moved else -1)
        if key not in self._tables:
            t = swap_table(*SWAPS[k])
            at = np.flatnonzero(t != np.arange(1 << 16))
            self._tables[key] = dict(zip(at.tolist(), t[at].tolist())) | self.moved.get((source, k), {})
        return self._tables[key]

    @functools.cached_property
    def _tables(self) -> dict:
        return {}


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def text_of(c: np.ndarray) -> str:
    return c.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (a.astype(np.uint64) << np.uint64(21) | b.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(45)).astype(np.int64)  # 64 - 19 bits


class Language:
    """Bigram model with hashed pairs."""

    def __init__(self, pairs: np.ndarray, single: np.ndarray):
        self.pairs, self.single, self.total = pairs, single, max(1, int(single.sum()))
        self.rate = ((single + 0.01) / self.total).astype(np.float64)

    def score(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """log P(b | a) of pairs of letters."""
        x, y = np.minimum(a, 65535), np.minimum(b, 65535)
        n = np.minimum(self.pairs[_pair(a, b)], np.minimum(self.single[x], self.single[y]))  # pairs share hashed places
        return np.log((n + _ALPHA * self.rate[y]) / (self.single[x] + _ALPHA))


def lines_score(lang: Language, c: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    """Sum of the scores of pairs with a letter outside ASCII, per line."""
    p = np.flatnonzero((c[:-1] > 127) | (c[1:] > 127))
    return np.bincount(line[p + 1], lang.score(c[p], c[p + 1]), minlength=n) if len(p) else np.zeros(n)


def join_utf8(c: np.ndarray, page: str, lang: Language) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(new letters, kept positions, leading positions): groups that are UTF-8 when read as bytes of a page."""
    b = to_byte(page)[np.minimum(c, 65535)].astype(np.int64)
    b[c > 65535] = 0
    pad = np.r_[b, 0, 0, 0]
    c1, c2, c3 = pad[1:-2], pad[2:-1], pad[3:]
    k1, k2, k3 = ((x & 0xC0) == 0x80 for x in (c1, c2, c3))
    two = (b >= 0xC2) & (b <= 0xDF) & k1
    v3 = ((b & 15) << 12) | ((c1 & 63) << 6) | (c2 & 63)
    three = (b >= 0xE0) & (b <= 0xEF) & k1 & k2 & (v3 >= 0x800) & ((v3 < 0xD800) | (v3 > 0xDFFF))
    v4 = ((b & 7) << 18) | ((c1 & 63) << 12) | ((c2 & 63) << 6) | (c3 & 63)
    four = (b >= 0xF0) & (b <= 0xF4) & k1 & k2 & k3 & (v4 >= 0x10000) & (v4 <= 0x10FFFF)
    value = np.where(two, ((b & 31) << 6) | (c1 & 63), np.where(three, v3, v4))
    lead = np.flatnonzero(two | three | four)
    if len(lead):  # a usual pair of letters that would become an unknown letter is no group
        nxt = c[np.minimum(lead + 1, len(c) - 1)]
        seen = (lang.single[np.minimum(c[lead], 65535)] >= 1e-5 * lang.total) & (lang.single[np.minimum(nxt, 65535)] >= 1e-5 * lang.total) & (nxt > 0x9F)
        usual = seen & (lang.pairs[_pair(c[lead], nxt)] >= 1e-5 * lang.total) & (lang.single[np.minimum(value[lead], 65535)] == 0)
        lead = lead[~usual]
    width = np.where(two, 2, np.where(three, 3, 4))[lead]
    keep = np.ones(len(c), bool)
    for k in (1, 2, 3):
        keep[lead[width > k] + k] = False
    out = c.copy()
    out[lead] = value[lead]
    return out[keep], keep, lead


def reduced(texts: list[str]) -> np.ndarray:
    """Line feeds, letters outside ASCII and their neighbours, of lines put between line feeds."""
    c = codes("\n" + "\n".join(texts) + "\n")
    far = c > 127
    keep = far | (c == 10)
    keep[1:] |= far[:-1]
    keep[:-1] |= far[1:]
    return c[keep]


class Decipherer:
    """Applies a language, weights of ciphers per source and learned mappings to batches of texts."""

    def __init__(self, lang: Language, weights: np.ndarray, learned: Learned, evidence: dict | None = None):
        self.lang, self.log, self.learned, self.evidence = lang, np.log(weights), learned, evidence

    def lines(self, texts: list[str], source: np.ndarray, doc: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Deciphered lines and the first cipher of each (-1: as it stands)."""
        texts, n = list(texts), len(texts)
        kinds = np.full(n, -1)
        busy = np.arange(n)
        while len(busy):  # a line that changes gains likelihood, so this ends
            busy = self._round(texts, source, doc, busy, kinds)
        return texts, kinds

    def _gains(self, c: np.ndarray, line: np.ndarray, m: int, source: np.ndarray) -> list:
        """Per cipher None or [gain per line, how often it is applied per line]."""
        base = lines_score(self.lang, c, line, m)
        gains: list = []
        for page in UTF8_READ_AS:
            top, d, own, times = None, c, line, 0
            while True:  # the same mistake may have been made again and again; each turn shortens the text
                d, keep, lead = join_utf8(d, page, self.lang)
                if not len(lead):
                    break
                times += 1
                touched = np.zeros(m, bool)
                touched[own[lead]] = True
                own = own[keep]
                gain = np.where(touched, lines_score(self.lang, d, own, m) - base, -np.inf)
                if top is None:
                    top = [gain, np.ones(m, np.int64)]
                else:
                    top[1][gain > top[0]] = times
                    top[0] = np.maximum(top[0], gain)
            gains.append(top)
        p = np.flatnonzero((c[:-1] > 127) | (c[1:] > 127))
        far = np.flatnonzero((c > 127) & (c < 1 << 16))
        for k in range(len(SWAPS)):
            d = c.copy()
            d[far] = self.learned.apply(k, c[far], source[line[far]])
            moved = np.zeros(m, bool)
            moved[line[far[d[far] != c[far]]]] = True
            s = np.bincount(line[p + 1], self.lang.score(d[p], d[p + 1]), minlength=m) if len(p) else np.zeros(m)
            gains.append([np.where(moved, s - base, -np.inf), None])
        return gains

    def _round(self, texts: list[str], source: np.ndarray, doc: np.ndarray, busy: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        m = len(busy)
        c = reduced([texts[i] for i in busy.tolist()])
        line = np.minimum(np.cumsum(c == 10) - 1, m - 1)
        gains = self._gains(c, line, m, source[busy])
        best, kind = np.full(m, 0.0), np.full(m, -1)
        by_doc = doc[busy]
        for sweep in (0, 1):
            known = np.unique(by_doc[kind >= 0] * _KINDS + kind[kind >= 0])
            for k, g in enumerate(gains):
                if g is None:
                    continue
                odds = g[0] + self.log[source[busy], k]
                if sweep:  # a line of a document that has this cipher elsewhere
                    odds = np.where(np.isin(by_doc * _KINDS + k, known), np.maximum(odds, g[0]), odds)
                better = odds > best
                best[better], kind[better] = odds[better], k
        done = np.flatnonzero(kind >= 0)
        if self.evidence is not None:
            self._gather(c, line, kind, source[busy])
        for i in done.tolist():
            k, at = int(kind[i]), busy[i]
            if k >= len(UTF8_READ_AS):
                texts[at] = texts[at].translate(self.learned.translation(k - len(UTF8_READ_AS), int(source[at])))
                continue
            d = codes(texts[at] + "\n")
            for _ in range(int(gains[k][1][i])):
                d = join_utf8(d, UTF8_READ_AS[k], self.lang)[0]
            texts[at] = text_of(d[:-1])
        first = kinds[busy[done]] < 0
        kinds[busy[done[first]]] = kind[done[first]]
        return busy[done]

    def _gather(self, c: np.ndarray, line: np.ndarray, kind: np.ndarray, source: np.ndarray) -> None:
        """How well each letter of the written page fits where a symbol stands, in lines that a swap explains."""
        for k, (written, read) in enumerate(SWAPS):
            mine = kind[line] == k + len(UTF8_READ_AS)
            if not mine.any():
                continue
            letters, byte = page_letters(written), to_byte(read)
            p = np.flatnonzero(mine & (c > 127) & (c < 1 << 16))
            p = p[(byte[c[p]] >= 128) & (p > 0) & (p < len(c) - 1)]
            d = c.copy()
            far = np.flatnonzero(mine & (c > 127) & (c < 1 << 16))
            d[far] = self.learned.apply(k, c[far], source[line[far]])
            for a in range(0, len(p), 4096):
                q = p[a : a + 4096]
                fit = self.lang.score(d[q - 1][:, None], letters[None, :]) + self.lang.score(letters[None, :], d[q + 1][:, None])
                where = (source[line[q]] * len(SWAPS) + k) * 128 + byte[c[q]].astype(np.int64) - 128
                keys, inverse = np.unique(where, return_inverse=True)
                sums, n = np.zeros((len(keys), 128)), np.bincount(inverse)
                np.add.at(sums, inverse, fit)
                for i, key in enumerate(keys.tolist()):
                    old = self.evidence.get(key)
                    self.evidence[key] = (sums[i], int(n[i])) if old is None else (old[0] + sums[i], old[1] + int(n[i]))

    def restore(self, texts: list[str], sources: list[str | None]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """(restored text or None where nothing is wrong, source bucket per line kind count, lines per source)."""
        code = np.array([source_bucket(s) for s in sources])
        plain = [_entities(t) for t in texts]
        parts: list[str] = []
        where: list[tuple[int, int]] = []
        split = []
        for i, t in enumerate(plain):
            if t.isascii():
                split.append(None)
                continue
            s = t.split("\n")
            split.append(s)
            for j, x in enumerate(s):
                if not x.isascii():
                    parts.append(x)
                    where.append((i, j))
        counts = np.zeros((SOURCES, _KINDS + 1), np.int64)
        if parts:
            doc = np.array([w[0] for w in where])
            out, kinds = self.lines(parts, code[doc], doc)
            np.add.at(counts, (code[doc], np.where(kinds < 0, _KINDS, kinds)), 1)
            for (i, j), x in zip(where, out):
                split[i][j] = x
        whole = [t if s is None else "\n".join(s) for t, s in zip(plain, split)]
        return whole, counts


def source_bucket(source: str | None) -> int:
    return int.from_bytes(hashlib.blake2b((source or "").encode(), digest_size=4).digest(), "little") % SOURCES


def _entities(text: str) -> str:
    """Bytes of UTF-8 that were written as numeric character references."""
    if "&#" not in text:
        return text

    def one(m: re.Match) -> str:
        try:
            return bytes(int(x) for x in re.findall(r"\d+", m.group())).decode()
        except UnicodeDecodeError:
            return m.group()

    return _ENTITIES.sub(one, text)


_BATCH = 2000


def _count(model):
    """Map that counts pairs, letters and ciphers over (deciphered) texts, and sums up the evidence for letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence: dict[int, tuple[np.ndarray, int]] = {}
        m = Decipherer(*model.value, evidence) if model is not None else None
        pairs, single, kinds = np.zeros(PAIRS, np.int64), np.zeros(1 << 16, np.int64), np.zeros((SOURCES, _KINDS + 1), np.int64)
        for whole in batches:
            for a in range(0, whole.num_rows, _BATCH):
                b = whole.slice(a, _BATCH)
                texts = [t for t in b.column(1).to_pylist()]
                if m is not None:
                    texts, k = m.restore(texts, b.column(2).to_pylist())
                    kinds += k
                c = codes("\n" + "\n".join(t for t in texts) + "\n")
                single += np.bincount(np.minimum(c, 65535), minlength=1 << 16)
                p = np.flatnonzero((c[:-1] > 127) | (c[1:] > 127))
                pairs += np.bincount(_pair(c[p], c[p + 1]), minlength=PAIRS)
        rows = lambda what, at, n: pa.RecordBatch.from_arrays([pa.array(np.full(len(at), what, np.int32)), pa.array(np.asarray(at, np.int64)), pa.array(np.asarray(n, np.float64))], names=["what", "slot", "n"])
        for what, table in ((0, pairs), (1, single), (2, kinds.ravel())):
            at = np.flatnonzero(table)
            yield rows(what, at, table[at])
        for key, (sums, n) in evidence.items():
            yield rows(3, key * 128 + np.arange(128), sums)
            yield rows(4, [key], [n])

    return run


def better_letters(sums: DataFrame) -> list[tuple[int, int, float]]:
    """(symbol of a cipher and source, letter, advantage over the seed's letter) where the advantage is large.

    The comparison runs on the cluster, on at most 128 letters a symbol; what it leaves is collected.
    """
    e = sums.where("what = 3").groupBy(F.floor(F.col("slot") / 128).alias("key")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("slot") % 128).cast("int"), "n"))).alias("fit"))
    e = e.select("key", F.explode(F.expr("transform(map_entries(fit), x -> struct(x.key AS letter, x.value - fit[CAST(key % 128 AS INT)] AS gain))")).alias("x")).where(F.col("x.gain") > SEED_BONUS)
    return [(r["key"], r["letter"], r["gain"]) for r in e.select("key", "x.letter", "x.gain").collect()]


def moved_symbols(better: list[tuple[int, int, float]], used: set[int]) -> dict[tuple[int, int], dict[int, int]]:
    """One symbol to one letter: the largest advantages first, never to a letter that another symbol in use stands for."""
    taken = set(used)  # a symbol in use holds the letter of its seed, which has the symbol's own byte
    out: dict[tuple[int, int], dict[int, int]] = {}
    done = set()
    for key, letter, _ in sorted(better, key=lambda x: (-x[2], x[0], x[1])):
        base = key - key % 128
        if key in done or base + letter in taken:
            continue
        done.add(key)
        taken.add(base + letter)
        source, k = divmod(key // 128, len(SWAPS))
        symbol = ord(_decode_byte(128 + key % 128, SWAPS[k][1]))
        out.setdefault((source, k), {})[symbol] = int(page_letters(SWAPS[k][0])[letter])
    return out


def learn(docs: DataFrame) -> tuple[Language, np.ndarray, Learned]:
    """The language, the weights of the ciphers and their mappings per source, by expectation-maximisation over all documents."""
    spark = docs.sparkSession
    weights, learned, model = np.full((SOURCES, _KINDS), _PRIOR), Learned(), None
    for _ in range(PASSES):
        before = learned.moved
        sums = docs.mapInArrow(_count(model), "what int, slot long, n double").groupBy("what", "slot").agg(F.sum("n").alias("n"))
        if model is not None:
            sums = cut(sums)
        t = sums.where("what <> 3").toArrow()  # at most PAIRS + 65536 + SOURCES * (kinds + symbols of its ciphers) rows
        what, slot, n = (t[x].to_numpy() for x in ("what", "slot", "n"))
        pairs, single, kinds = np.zeros(PAIRS, np.float64), np.zeros(1 << 16, np.float64), np.zeros(SOURCES * (_KINDS + 1))
        for i, table in enumerate((pairs, single, kinds)):
            table[slot[what == i]] = n[what == i]
        if model is not None:
            kinds = kinds.reshape(SOURCES, _KINDS + 1)
            weights = (kinds[:, :_KINDS] + _PRIOR * 100) / (kinds.sum(1, keepdims=True) + 100)
            learned = Learned(moved_symbols(better_letters(sums), set(slot[what == 4].tolist())))
        lang = Language(pairs.astype(np.float32), single.astype(np.float32))
        again = model is None or learned.moved != before
        model = spark.sparkContext.broadcast((lang, weights, learned))
        if not again:
            break
    return lang, weights, learned


def restore_text(docs: DataFrame) -> DataFrame:
    """``doc_id, restored, lost`` of each document with garbled characters.

    ``restored`` is the whole text as first written; null, with ``lost`` true, where replacement characters show
    that letters are gone. Null and empty texts, and plain ASCII, are never cases; a null source is a source of its
    own; repeated rows come out each; very long texts are read whole, line by line. Only ``doc_id, text, source``
    are read.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long"), "text", "source").where(F.col("text").isNotNull())
    model = spark.sparkContext.broadcast(learn(d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Decipherer(*model.value)
        for whole in batches:
            for a in range(0, whole.num_rows, _BATCH):
                b = whole.slice(a, _BATCH)
                texts = b.column(1).to_pylist()
                new, _ = m.restore(texts, b.column(2).to_pylist())
                at = [i for i, (x, y) in enumerate(zip(texts, new)) if x != y or "�" in x]
                lost = ["�" in texts[i] or "�" in new[i] for i in at]
                if at:
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(at)), pa.array([None if x else new[i] for i, x in zip(at, lost)], pa.string()), pa.array(lost)], names=["doc_id", "restored", "lost"]
                    )

    return d.mapInArrow(run, "doc_id long, restored string, lost boolean")
