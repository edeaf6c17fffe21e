"""Free-entered names mapped to the entries of a canonical list.

Two operators share the index and the distance: ``map_values`` for any list of names (cities, brands, job titles), and
``map_to_list`` for lists whose entries have families, versions and suffixes, like licences; which words mean what
there is a ``Grammar``, a parameter.

Words of the list (names, descriptive words, suffixes) form a symmetric-delete dictionary: every deletion of up
to two letters points to its words, so a typed word finds all words within the bound by looking up its own
deletions. Candidates are ranked by a weighted Damerau-Levenshtein distance, ties by how often the list's
entries occur as they stand. A text means an entry if every word of it is explained by that entry; a version,
a suffix or a likeness that the list does not have leaves it unmatched.

The list is broadcast: its size is checked against ``MAX_ENTRIES`` first; ``map_values`` joins larger lists on their
deletions instead. The rows are not shuffled: each batch
is dictionary-encoded and each distinct text resolved once, so a text that fills a third of the rows is free.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More entries than this are no list for one broadcast.
MAX_ENTRIES = 50_000
MAX_DISTANCE = 2
#: Texts that stand for no value.
NULL_TOKENS = frozenset(("", "noassertion", "none", "n/a", "unknown"))
#: Letters of a word from which deletions are made. Two words within the bound share a deletion of their beginnings too.
PREFIX = 16


@dataclass(frozen=True)
class Grammar:
    """Words of a list whose entries have versions and suffixes."""

    #: Words around an entry that say nothing about which it is.
    noise: frozenset = frozenset()
    #: Words of the suffixes "or later" and "only".
    later: frozenset = frozenset()
    only: frozenset = frozenset()
    #: Numbers written as words.
    numbers: tuple = ()
    #: Letters after a number and the word they stand for.
    short: tuple = ()
    #: Words that are often misspelt beyond the bound, and the edits allowed for them.
    loose: tuple = ()
    loose_edits: int = 3


#: The words of licence texts.
LICENSES = Grammar(
    noise=frozenset("license licence licensed lic under the of v ver version spdx a an this is terms see ref".split()), later=frozenset(("later", "newer", "above")), only=frozenset(("only",)),
    numbers=tuple((w, str(i)) for i, w in enumerate("one two three four five six seven eight nine ten".split(), 1)), short=(("c", "clause"),), loose=("license", "licence"),
)
#: Rows of the keyboard; neighbours are cheaper to confuse.
KEYBOARD = ("qwertyuiop", "asdfghjkl", "zxcvbnm")

_NEAR = {(a, b) for r in KEYBOARD for a, b in zip(r, r[1:])}
_NEAR |= {(b, a) for a, b in _NEAR}
_HYPHENS = dict.fromkeys(map(ord, "‐‑‒–—―−_"), "-")
_TOKEN = re.compile(r"\d+(?:\.\d+)*|[^\W\d_]+|\+")


def weighted_distance(a: str, b: str) -> float:
    """Damerau-Levenshtein distance (adjacent transpositions) with cheaper typical slips.

    A neighbour on the keyboard costs 0.7, a transposition 0.8, a doubled or dropped double letter 0.6, any other
    edit 1.
    """
    m, n = len(a), len(b)
    d = [[0.0] * (n + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        d[i][0] = d[i - 1][0] + 1
    for j in range(1, n + 1):
        d[0][j] = d[0][j - 1] + 1
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            x, y = a[i - 1], b[j - 1]
            cut = 0.6 if i > 1 and x == a[i - 2] else 1.0
            add = 0.6 if j > 1 and y == b[j - 2] else 1.0
            best = min(d[i - 1][j] + cut, d[i][j - 1] + add, d[i - 1][j - 1] + (0.0 if x == y else 0.7 if (x, y) in _NEAR else 1.0))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2] and x != y:
                best = min(best, d[i - 2][j - 2] + 0.8)
            d[i][j] = best
    return d[m][n]


def edits(a: str, b: str) -> int:
    """Plain number of edits, transpositions counted once."""
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        two, one = one, row
    return one[-1]


def deletions(word: str, most: int) -> set[str]:
    out, level = {word}, {word}
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out |= level
    return out


def bound(word: str) -> int:
    """Edits allowed for a typed word: none up to three letters, one up to five, else two."""
    return 0 if len(word) <= 3 else 1 if len(word) <= 5 else MAX_DISTANCE


class Dictionary:
    """Symmetric-delete index of words with a weight (frequency) each."""

    def __init__(self, words: dict[str, int]):
        self.words = words
        self.index: dict[str, list[str]] = {}
        for w in words:
            for x in deletions(w[:PREFIX], min(MAX_DISTANCE, bound(w) + 1)):
                self.index.setdefault(x, []).append(w)

    def lookup(self, typed: str) -> list[tuple[float, str]]:
        """Words within the bound, best first: (weighted distance, word)."""
        if typed in self.words:
            return [(0.0, typed)]
        found = {w for x in deletions(typed[:PREFIX], MAX_DISTANCE if len(typed) > 4 else 1) for w in self.index.get(x, ())}
        near = (w for w in found if abs(len(w) - len(typed)) <= MAX_DISTANCE)
        out = [(weighted_distance(typed, w), -self.words[w], w) for w in near if edits(typed, w) <= max(bound(w), bound(typed))]
        return [(d, w) for d, _, w in sorted(out)]


@dataclass(frozen=True)
class Entry:
    id: str
    family: str
    words: frozenset
    version: str
    suffix: str


def normal_version(v: str) -> str:
    """A whole number means ``.0``."""
    return v if "." in v else v + ".0"


class Matcher:
    """Resolves texts against a list of (id, full name, family, frequency)."""

    def __init__(self, entries: list[tuple[str, str, str, int]], grammar: Grammar = LICENSES):
        g = self.grammar = grammar
        self.numbers, self.short = dict(g.numbers), dict(g.short)
        self.families: dict[str, list[Entry]] = {}
        self.acronyms: dict[str, set[str]] = {}
        words: dict[str, int] = dict.fromkeys(g.noise | g.later | g.only | {"or", "any", "no"}, 0)
        names: dict[str, int] = {}
        for id_, full, family, freq in entries:
            tokens = _TOKEN.findall(f"{full} {id_}".translate(_HYPHENS).lower())
            fam = family.lower()
            numbers = {normal_version(t) for t in tokens if t[0].isdigit()}
            suffix = "later" if g.later & set(tokens) else "only" if g.only & set(tokens) else ""
            own = frozenset(t for t in tokens if t[0].isalpha())
            self.families.setdefault(fam, []).append(Entry(id_, fam, own, next(iter(numbers), ""), suffix))
            initials = [t[0] for t in _TOKEN.findall(full.translate(_HYPHENS).lower()) if t[0].isalpha() and t not in ("v", "only", "or", "later")]
            if len(initials) > 2:
                self.acronyms.setdefault("".join(initials), set()).add(fam)
            names[fam] = names.get(fam, 0) + freq
            for w in own:
                words[w] = words.get(w, 0) + freq
        for f in names:
            words.pop(f, None)
        self.names, self.words = Dictionary(names), Dictionary(words)
        self.ids = {e[0] for e in entries}
        self.resolve = functools.lru_cache(maxsize=200_000)(self._resolve)
        self._word = functools.lru_cache(maxsize=200_000)(self._explain)

    def _explain(self, typed: str) -> tuple[str, str]:
        """(kind, word) of a typed word: family, acronym, word or unknown."""
        if typed in self.acronyms and typed not in self.words.words:
            return "acronym", typed
        family, word = self.names.lookup(typed), self.words.lookup(typed)
        if family and (not word or family[0][0] < word[0][0]):
            return "family", family[0][1]
        return ("word", word[0][1]) if word else ("unknown", typed)

    def _tokens(self, text: str) -> list[str]:
        text = text.translate(_HYPHENS).strip()
        if re.match(r"(?i)[a-z]+://\S+$", text):
            text = re.sub(r"(?i)\.(?:txt|html?|md|php)$", "", text.rstrip("/").rsplit("/", 1)[-1])
        return _TOKEN.findall(text.lower())

    def _compound(self, tokens: list[str]) -> bool:
        """Whether two parts are joined by and, or, with, at least one of which names a licence."""
        joined = False
        for i, t in enumerate(tokens):
            if t in ("and", "with"):
                joined |= 0 < i < len(tokens) - 1
            elif t == "or" and 0 < i < len(tokens) - 1:
                after = tokens[i + 1]
                if not (after == "any" or (self._word(after)[0] == "word" and self._word(after)[1] in self.grammar.later)):
                    joined = True
        return joined and any(self._word(t)[0] in ("family", "acronym") for t in tokens if t.isalpha())

    def _resolve(self, text: str) -> str | None:
        """Entry id, '' if none is meant, None if the text is no case."""
        if text.strip().lower() in NULL_TOKENS or text in self.ids:
            return None
        tokens = self._tokens(text)
        if self._compound(tokens):
            return None
        families, words, versions, later, only, rest = set(), set(), set(), False, False, []
        for i, t in enumerate(tokens):
            if t[0].isdigit() or t in self.numbers:
                versions.add(normal_version(self.numbers.get(t, t)))
                continue
            if t == "+":
                later = True
                continue
            kind, w = self._word(t)
            if kind == "family":
                families.add(w)
            elif kind == "acronym":
                words.add(w)
                if len(self.acronyms[w]) == 1:
                    families |= self.acronyms[w]
            elif kind == "word" and w in self.grammar.later:
                later = True
            elif kind == "word" and w in self.grammar.only:
                only = True
            elif kind == "word":
                words.add(w)
            elif t in self.short and i and tokens[i - 1][0].isdigit():
                words.add(self.short[t])
            elif edits(t, "or") <= 1 and i + 1 < len(tokens) and self._word(tokens[i + 1])[1] in self.grammar.later:
                continue
            elif any(abs(len(t) - len(w)) <= self.grammar.loose_edits and len(t) >= 5 and edits(t, w) <= self.grammar.loose_edits for w in self.grammar.loose):
                continue
            else:
                rest.append(t)
        if len(families) != 1 or len(versions) > 1:
            return ""
        for t in rest:  # a badly typed suffix, of a family that has suffixes
            near = min((edits(t, w), w) for w in ("later", "only")) if len(t) <= 7 else (9, "")
            if near[0] > 2 or not any(e.suffix for f in families for e in self.families[f]):
                return ""
            later, only = later or near[1] == "later", only or near[1] == "only"
        suffix = "only" if only else "later" if later else ""
        fits = []
        for e in self.families[families.pop()]:
            acronym = {a for a, f in self.acronyms.items() if e.family in f}
            if words - e.words - self.grammar.noise - acronym - {"or", "any", "no"}:
                continue
            if versions and versions != {e.version}:
                continue
            if suffix and suffix != e.suffix:
                continue
            fits.append(e)
        return fits[0].id if len(fits) == 1 else ""


_MATCHERS: dict = {}


def cached(make, entries: list[tuple], *more):
    """One index per list and process."""
    key = (make, hash(tuple(entries)), *more)
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = make(entries, *more)
    return _MATCHERS[key]


def map_to_list(df: DataFrame, reference: DataFrame, key: str, text: str, grammar: Grammar = LICENSES) -> DataFrame:
    """``row_id, text, license_id`` of each text that is no null token, no list entry and no joined text.

    ``license_id`` is the entry meant, or '' where the list has none. ``reference``: license_id, full_name,
    family. Null texts give no row, very long texts are read whole, repeated rows are judged each; an empty list
    leaves everything unmatched. Only the named columns are read. A list above ``MAX_ENTRIES`` is refused.
    """
    spark = df.sparkSession
    size = reference.count()
    if size > MAX_ENTRIES:
        raise ValueError(f"the list has {size} entries; {MAX_ENTRIES} is the most for a broadcast")
    value = F.col(f"`{text}`")
    ref = reference.select("license_id", "full_name", "family").where(F.col("license_id").isNotNull())
    counts = df.select(value.alias("license_id")).join(F.broadcast(ref.select("license_id")), "license_id").groupBy("license_id").count()
    freq = {r["license_id"]: r["count"] for r in counts.collect()}
    entries = sorted((r["license_id"], r["full_name"] or r["license_id"], r["family"] or r["license_id"], freq.get(r["license_id"], 0)) for r in ref.collect())
    shared = spark.sparkContext.broadcast(entries)
    return _resolved(df, key, text, lambda: cached(Matcher, shared.value, grammar).resolve, "license_id")


def _resolved(df: DataFrame, key: str, text: str, resolver, name: str) -> DataFrame:
    """Rows with what a resolver, made in the worker, says of each distinct text of a batch; None leaves the row out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resolve = resolver()
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            found = pa.array([resolve(t) for t in coded.dictionary.to_pylist()], pa.string())
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found.take(coded.indices)], names=["row_id", "text", name])
            yield out.filter(out.column(2).is_valid())

    value = F.col(f"`{text}`")
    return df.select(F.col(f"`{key}`").cast("long").alias("row_id"), value.alias("text")).where(value.isNotNull()).mapInArrow(run, f"row_id long, text string, {name} string")


def folded(text: str) -> str:
    """Lower case, no diacritics, one kind of hyphen, single blanks."""
    t = unicodedata.normalize("NFKD", text.translate(_HYPHENS).lower())
    return " ".join("".join(c for c in t if not unicodedata.combining(c)).split())


class Values:
    """Closest entries of a plain list of (id, name, frequency)."""

    def __init__(self, entries: list[tuple[str, str, int]]):
        self.ids: dict[str, str] = {}
        words: dict[str, int] = {}
        for id_, name, freq in sorted(entries, key=lambda e: (-e[2], e[0])):
            self.ids.setdefault(folded(name), id_)
            words[folded(name)] = words.get(folded(name), 0) + freq
        self.names = {name for _, name, _ in entries}
        self.words = Dictionary(words)
        self.resolve = functools.lru_cache(maxsize=200_000)(self._resolve)

    def _resolve(self, text: str) -> str | None:
        if text in self.names or text.strip().lower() in NULL_TOKENS:
            return None
        found = self.words.lookup(folded(text))
        return self.ids[found[0][1]] if found else ""


def map_values(df: DataFrame, reference: DataFrame, key: str, text: str) -> DataFrame:
    """``row_id, text, entry_id`` of each text that is no null token and no name of the list as it stands.

    ``reference``: entry_id, name. ``entry_id`` is the entry whose name is closest, of equally close ones the one that
    more rows hold as it stands, then the smallest name; '' if none is within the bound (``bound``: edits by length),
    case, diacritics and blanks aside. Null texts give no row, an empty list leaves everything unmatched, repeated rows
    come out each. Lists of up to ``MAX_ENTRIES`` are broadcast; longer ones are joined on their deletions.
    """
    spark = df.sparkSession
    value = F.col(f"`{text}`")
    ref = reference.select(F.col("entry_id").cast("string"), "name").where(F.col("name").isNotNull() & F.col("entry_id").isNotNull())
    counts = df.select(value.alias("name")).where(value.isNotNull()).groupBy("name").agg(F.count(F.lit(1)).alias("freq"))
    entries = ref.join(counts, "name", "left").select("entry_id", "name", F.coalesce("freq", F.lit(0)).alias("freq"))
    if ref.count() <= MAX_ENTRIES:
        shared = spark.sparkContext.broadcast(sorted(map(tuple, entries.collect())))
        return _resolved(df, key, text, lambda: cached(Values, shared.value).resolve, "entry_id")
    texts = df.select(value.alias("text")).where(value.isNotNull() & ~F.lower(F.trim(value)).isin(*NULL_TOKENS)).distinct().join(ref.select(F.col("name").alias("text")), "text", "left_anti")
    typed, listed = _with_deletions(texts, "text"), _with_deletions(entries, "name")
    pairs = typed.join(listed, "deletion").select("text", "name").distinct()
    best = pairs.mapInArrow(_judge, "text string, name string, distance double").join(entries, "name").groupBy("text").agg(F.min(F.struct("distance", -F.col("freq"), "name", "entry_id")).alias("x"))
    best = texts.join(best, "text", "left").select("text", F.coalesce("x.entry_id", F.lit("")).alias("entry_id"))
    return df.select(F.col(f"`{key}`").cast("long").alias("row_id"), value.alias("text")).join(best, "text").select("row_id", "text", "entry_id")


def _with_deletions(df: DataFrame, name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            found = [sorted(deletions(folded(t)[:PREFIX], MAX_DISTANCE)) for t in texts]
            n = [len(x) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, k in zip(texts, n) for _ in range(k)], pa.string()), pa.array([x for f in found for x in f], pa.string())], names=[name, "deletion"])

    return df.select(name).distinct().mapInArrow(run, f"{name} string, deletion string")


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within the bound, with their weighted distance."""
    for b in batches:
        rows = []
        for t, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = folded(t), folded(w)
            if abs(len(x) - len(y)) <= MAX_DISTANCE and edits(x, y) <= max(bound(x), bound(y)):
                rows.append((t, w, weighted_distance(x, y)))
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], names=["text", "name", "distance"])


def misses(mapped: DataFrame) -> DataFrame:
    """Unmatched texts with the number of rows that hold them."""
    return mapped.where(F.col("license_id") == "").groupBy("text").agg(F.count(F.lit(1)).alias("n_rows"))
