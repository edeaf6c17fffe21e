"""Deeply nested JSON records to flat linked tables, by vectorised structural indexing.

Many payloads are indexed together as one byte array: bitmaps of backslashes, quotes and structural
characters, string spans by the parity of unescaped quotes, nesting depth by prefix sums, parents by binary
search in the opening brackets of the level above, and the JSON grammar by position among siblings. No
payload is parsed into objects; only the spans that a row needs are decoded.

The operator is a narrow map (no shuffle). A task holds ``_CHUNK`` bytes of payloads at a time (or one
payload, if that is longer).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CHUNK = 4 << 20
_ITEMS = "raw_id long, node_path string, item_kind string, item_pos int, item_key string, item_value string"
_OWNERS = "raw_id long, node_path string, parent_path string, node_pos int, node_kind string, node_ref string, node_name string, node_version string"

#: Member names that are looked up.
_KEYS = (
    "metadata", "component", "components", "packages", "files", "hashes", "checksums", "externalReferences", "externalRefs", "licenses", "license",
    "alg", "content", "algorithm", "checksumValue", "type", "url", "referenceType", "referenceLocator", "expression", "id", "name", "bom-ref", "SPDXID", "version", "versionInfo", "fileName",
)
_CODE = {k: i for i, k in enumerate(_KEYS)}
_NUMBER = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\Z")
_OPEN, _CLOSE, _COMMA, _COLON, _STRING, _LITERAL = 1, 2, 3, 4, 5, 6
_CLASS = np.zeros(256, np.int8)
for _c, _k in ((b"{", 1), (b"[", 1), (b"}", 2), (b"]", 2), (b",", 3), (b":", 4)):
    _CLASS[_c[0]] = _k
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r")] = True
_ESCAPE = np.zeros(256, bool)
_ESCAPE[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True


class Index:
    """Structural index of several payloads. ``valid`` tells per payload whether it is JSON."""

    def __init__(self, payloads: list[bytes]):
        n = len(payloads)
        raw = self.raw = b"\n".join(payloads) + b"\n" * 8
        B = self.bytes = np.frombuffer(raw, np.uint8)
        lengths = np.fromiter(map(len, payloads), np.int64, n)
        begin = np.cumsum(lengths + 1) - lengths - 1
        bad = np.zeros(n + 1, bool)
        of = lambda pos: np.minimum(np.searchsorted(begin, pos, "right") - 1, n)
        # backslashes: one that ends an odd run escapes the next byte
        back = np.flatnonzero(B == 92)
        escaped = np.zeros(len(B), bool)
        if len(back):
            first = np.r_[True, np.diff(back) != 1]
            place = np.arange(len(back)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            lead = back[place % 2 == 0]
            escaped[lead + 1] = True
            wrong = ~_ESCAPE[B[lead + 1]]
            u = B[lead + 1] == 117
            for k in range(2, 6):
                wrong |= u & ~_HEX[B[np.minimum(lead + k, len(B) - 1)]]
            bad[of(lead[wrong])] = True
        quote = (B == 34) & ~escaped
        q = np.cumsum(quote, dtype=np.int64)
        base = np.r_[0, q][begin] if n else np.zeros(0, np.int64)
        ends = q[begin + lengths - 1] if n else base
        ends = np.where(lengths > 0, ends, base)
        odd = (ends - base) % 2 == 1
        bad[:n] |= odd
        # parity counts from each payload's start
        inside = ((q - np.repeat(np.r_[base, q[-1:]], np.r_[lengths + 1, len(B) - (lengths + 1).sum()])) & 1).astype(bool)
        bad[of(np.flatnonzero(inside & (B < 32)))] = True
        bad[of(back[~inside[back]])] = True
        out = ~inside & ~quote
        kind = np.where(out, _CLASS[B], 0).astype(np.int8)
        word = out & (kind == 0) & ~_SPACE[B]
        lit = word & ~np.r_[False, word[:-1]]
        kind[lit] = _LITERAL
        kind[quote & inside] = _STRING
        pos = np.flatnonzero(kind)
        kind = kind[pos]
        doc = of(pos)
        # ends of strings and literals
        end = pos + 1
        closing = np.flatnonzero(quote & ~inside)
        s = kind == _STRING
        if s.any():
            at = np.searchsorted(closing, pos[s])
            end[s] = closing[np.minimum(at, len(closing) - 1)] if len(closing) else pos[s]
        lits = np.flatnonzero(kind == _LITERAL)
        if len(lits):
            stop = np.flatnonzero(word & ~np.r_[word[1:], False]) + 1
            end[lits] = stop[np.searchsorted(stop, pos[lits], "right")]
            known: dict[bytes, bool] = {b"true": True, b"false": True, b"null": True}
            for i in lits.tolist():
                t = raw[pos[i] : end[i]]
                ok = known.get(t)
                if ok is None:
                    ok = known[t] = bool(_NUMBER.match(t))
                if not ok:
                    bad[doc[i]] = True
        # depth by prefix sums; an opening and its closing bracket have the level of their container
        step = (kind == _OPEN).astype(np.int64) - (kind == _CLOSE)
        total = np.cumsum(step)
        first = np.searchsorted(doc, np.arange(n))
        last = np.searchsorted(doc, np.arange(n), "right")
        offset = np.r_[0, total][first]
        level = total - offset[doc] - (kind == _OPEN) if len(pos) else total
        bad[doc[level < 0]] = True
        bad[:n] |= (np.r_[0, total][last] - offset) != 0
        bad[:n] |= first == last
        keep = ~bad[doc]
        pos, end, kind, doc, level = (a[keep] for a in (pos, end, kind, doc, level))
        # parents: the last opening bracket of the level above
        N, L = len(pos) + 1, int(level.max(initial=0)) + 2
        seq = np.arange(len(pos), dtype=np.int64)
        opens = np.flatnonzero(kind == _OPEN)
        key = (doc[opens] * L + level[opens]) * N + seq[opens]
        by = np.argsort(key, kind="stable")
        okey, oidx = key[by], opens[by]
        want = (doc * L + level - 1) * N + seq
        parent = np.full(len(pos), -1, np.int64)
        deep = level > 0
        if deep.any():
            parent[deep] = oidx[np.searchsorted(okey, want[deep]) - 1]
        # closing brackets fit the opening one of the same level
        closes = np.flatnonzero(kind == _CLOSE)
        if len(closes):
            mate = oidx[np.searchsorted(okey, (doc[closes] * L + level[closes]) * N + seq[closes]) - 1]
            bad[doc[closes[B[pos[mate]] + 2 != B[pos[closes]]]]] = True
        # grammar: place among siblings (closing brackets left out)
        item = np.flatnonzero(kind != _CLOSE)
        group = np.where(parent[item] >= 0, parent[item], -1 - doc[item])
        by = np.lexsort((item, group))
        item, group = item[by], group[by]
        starts = np.flatnonzero(np.r_[True, np.diff(group) != 0]) if len(item) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(item)])
        place = np.arange(len(item)) - np.repeat(starts, sizes)
        size = np.repeat(sizes, sizes)
        k = kind[item]
        value = (k == _OPEN) | (k == _STRING) | (k == _LITERAL)
        p = parent[item]
        obj = (p >= 0) & (B[pos[np.maximum(p, 0)]] == 123)
        arr = (p >= 0) & ~obj
        good = np.where(obj, np.choose(place % 4, [k == _STRING, k == _COLON, value, k == _COMMA]) & (size % 4 == 3), np.where(arr, np.where(place % 2 == 0, value, k == _COMMA) & (size % 2 == 1), value & (size == 1)))
        bad[doc[item[~good]]] = True
        self.valid = ~bad[:n]
        # values with their place: index in a list, name in an object
        v = np.flatnonzero(value & ~bad[doc[item]] & (~obj | (place % 4 == 2)))
        self.pos, self.end, self.kind, self.doc = pos, end, kind, doc
        self.token = item[v]
        self.parent = p[v]
        self.index = np.where(obj[v], -1, place[v] // 2)
        self.code = np.full(len(v), -1, np.int64)
        named = np.flatnonzero(obj[v])
        names = item[v[named] - 2] if len(named) else np.zeros(0, np.int64)
        self.code[named] = self._codes(names)
        self.root = np.full(n, -1, np.int64)
        top = self.parent < 0
        self.root[doc[self.token[top]]] = self.token[top]
        by = np.lexsort((self.token, self.code, self.parent))
        self.token, self.parent, self.index, self.code = (a[by] for a in (self.token, self.parent, self.index, self.code))
        self._member = self.parent * (len(_KEYS) + 1) + self.code + 1

    def _codes(self, names: np.ndarray) -> np.ndarray:
        out = np.full(len(names), -1, np.int64)
        if not len(names):
            return out
        B, a = self.bytes, self.pos[names] + 1
        width = self.end[names] - a
        for word, code in _CODE.items():
            w = np.frombuffer(word.encode(), np.uint8)
            c = np.flatnonzero(width == len(w))
            for j in range(len(w)):
                c = c[B[a[c] + j] == w[j]]
            out[c] = code
        slashes = np.r_[0, np.cumsum(B == 92)]
        for i in np.flatnonzero(slashes[a + width] != slashes[a]).tolist():
            out[i] = _CODE.get(self.text(names[i]), -1)
        return out

    def text(self, token: int) -> str | None:
        """The decoded string of a token, or None if it is no string."""
        if token < 0 or self.kind[token] != _STRING:
            return None
        t = self.raw[self.pos[token] + 1 : self.end[token]]
        if b"\\" in t:
            s = json.loads(b'"' + t + b'"')
            return re.sub("[\ud800-\udfff]", "�", s)  # half of a pair can't be written as UTF-8
        return t.decode()

    def is_object(self, token: np.ndarray) -> np.ndarray:
        return (token >= 0) & (self.bytes[self.pos[np.maximum(token, 0)]] == 123) & (self.kind[np.maximum(token, 0)] == _OPEN) if len(self.pos) else np.zeros(len(token), bool)

    def member(self, objects: np.ndarray, name: str) -> np.ndarray:
        """Token of the member ``name`` (the last of that name) of each object, -1 where absent."""
        want = objects * (len(_KEYS) + 1) + _CODE[name] + 1
        at = np.searchsorted(self._member, want, "right") - 1
        ok = (at >= 0) & self.is_object(objects)
        ok[ok] &= self._member[at[ok]] == want[ok]
        return np.where(ok, self.token[np.maximum(at, 0)] if len(self.token) else -1, -1)

    def elements(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into ``lists``, position, token) of the elements; a lone object stands for a list of one."""
        lone = np.flatnonzero(self.is_object(lists))
        arrays = np.flatnonzero((lists >= 0) & ~self.is_object(lists) & (self.kind[np.maximum(lists, 0)] == _OPEN)) if len(self.pos) else lone[:0]
        base = lists[arrays] * (len(_KEYS) + 1)
        a, b = np.searchsorted(self._member, base), np.searchsorted(self._member, base, "right")
        m = b - a
        src = np.repeat(arrays, m)
        at = np.repeat(a, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        return np.r_[lone, src], np.r_[np.zeros(len(lone), np.int64), self.index[at]], np.r_[lists[lone], self.token[at]]


def _owners(ix: Index) -> list[tuple[np.ndarray, np.ndarray, list[str], list[str], np.ndarray, str]]:
    """Levels of owners: (payload, token, path, parent path, position, kind)."""
    docs = np.flatnonzero(ix.is_object(ix.root))
    root = ix.root[docs]
    out = []

    def listed(doc, holder, paths, name, kind):
        i, at, tok = ix.elements(ix.member(holder, name))
        ok = ix.is_object(tok)
        i, at, tok = i[ok], at[ok], tok[ok]
        parents = [paths[j] for j in i.tolist()]
        return doc[i], tok, [(f"{p}." if p else "") + f"{name}[{k}]" for p, k in zip(parents, at.tolist())], parents, at, kind

    none = [""] * len(docs)
    main = ix.member(ix.member(root, "metadata"), "component")
    ok = ix.is_object(main)
    out.append((docs[ok], main[ok], ["metadata.component"] * int(ok.sum()), [""] * int(ok.sum()), np.zeros(int(ok.sum()), np.int64), "component"))
    level = listed(docs, root, none, "components", "component")
    out.append(level)
    frontier = [out[0], level]
    while frontier:
        d, t = np.concatenate([x[0] for x in frontier]), np.concatenate([x[1] for x in frontier])
        level = listed(d, t, [p for x in frontier for p in x[2]], "components", "component")
        frontier = [level] if len(level[0]) else []
        out += frontier
    out.append(listed(docs, root, none, "packages", "package"))
    out.append(listed(docs, root, none, "files", "file"))
    return out


def _items(ix: Index, ids: list) -> list[tuple]:
    rows = []
    cdx = (("hash", "hashes", "alg", "content"), ("external_ref", "externalReferences", "type", "url"))
    spdx = (("hash", "checksums", "algorithm", "checksumValue"), ("external_ref", "externalRefs", "referenceType", "referenceLocator"))
    text = ix.text
    for doc, tok, paths, _, _, kind in _owners(ix):
        for item, holder, key, value in cdx if kind == "component" else spdx:
            i, at, el = ix.elements(ix.member(tok, holder))
            k, v = ix.member(el, key), ix.member(el, value)
            for j, a, kt, vt in zip(i.tolist(), at.tolist(), k.tolist(), v.tolist()):
                if kt >= 0 and vt >= 0 and (x := text(kt)) and (y := text(vt)) and x.strip() and y.strip():
                    rows.append((ids[doc[j]], paths[j], item, a, x, y))
        if kind == "component":
            i, at, el = ix.elements(ix.member(tok, "licenses"))
            inner = ix.member(el, "license")
            for j, a, *found in zip(i.tolist(), at.tolist(), ix.member(el, "expression").tolist(), ix.member(inner, "id").tolist(), ix.member(inner, "name").tolist()):
                for key, t in zip(("expression", "id", "name"), found):
                    if t >= 0 and (y := text(t)) and y.strip():
                        rows.append((ids[doc[j]], paths[j], "license", a, key, y))
                        break
    return rows


def _nodes(ix: Index, ids: list) -> list[tuple]:
    rows = []
    names = {"component": ("bom-ref", "name", "version"), "package": ("SPDXID", "name", "versionInfo"), "file": ("SPDXID", "fileName", "version")}
    for doc, tok, paths, parents, at, kind in _owners(ix):
        cols = [ix.member(tok, k).tolist() for k in names[kind]]
        for j, (d, p, up, a, *t) in enumerate(zip(doc.tolist(), paths, parents, at.tolist(), *cols)):
            rows.append((ids[d], p, up, a, kind, *map(ix.text, t)))
    return rows


def _mapper(make, fields):
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(n, types[t]) for n, t in (f.split() for f in fields.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            a = 0
            while a < len(ids):
                b, size, chunk = a, 0, []
                while b < len(ids) and (size < _CHUNK or b == a):
                    chunk.append(texts[b].as_py().encode())
                    size += len(chunk[-1])
                    b += 1
                rows = make(Index(chunk), ids[a:b])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                a = b

    return run


def flatten_items(df: DataFrame, key: str = "raw_id", payload: str = "payload") -> DataFrame:
    """Flat rows of hashes, licences and external references, each with the path of its owner.

    Result: ``raw_id, node_path, item_kind, item_pos, item_key, item_value``. Owners are CycloneDX
    ``metadata.component`` and ``components[i]`` with all nested ``.components[i]``, SPDX ``packages[i]`` and
    ``files[i]``. A lone object stands for a list of one; elements that are no objects, and items whose key or
    value is no text or blank, give nothing but keep their position.

    Null and empty payloads, and those that are no JSON object, give no rows. Of members with the same name the
    last counts. Repeated rows give their items each. Half of a surrogate pair becomes U+FFFD. Only the two named
    columns are read, so other columns of any name do no harm; an empty table gives an empty table.
    """
    return df.select(F.col(f"`{key}`").cast("long"), F.col(f"`{payload}`")).where(F.col(f"`{payload}`").isNotNull()).mapInArrow(_mapper(_items, _ITEMS), _ITEMS)


def flatten_owners(df: DataFrame, key: str = "raw_id", payload: str = "payload") -> DataFrame:
    """The owners themselves, linked to their parents: the table that the items refer to by (raw_id, node_path).

    Cases as in ``flatten_items``; a member that is no text is null.
    """
    return df.select(F.col(f"`{key}`").cast("long"), F.col(f"`{payload}`")).where(F.col(f"`{payload}`").isNotNull()).mapInArrow(_mapper(_nodes, _OWNERS), _OWNERS)
