"""Dictionary pages of a Parquet column chunk, read without its data pages (public Parquet format)."""

from __future__ import annotations

import pyarrow as pa

#: Fixed values of the format: page types and encodings.
_DATA, _DICTIONARY, _DATA_V2 = 0, 2, 3
_PLAIN_DICTIONARY, _RLE_DICTIONARY = 2, 8
_HEADER = 1 << 13


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[i]
        i += 1
        out |= (x & 127) << shift
        if x < 128:
            return out, i
        shift += 7


def _value(b: bytes, i: int, kind: int):
    if kind in (1, 2):
        return kind == 1, i
    if kind == 3:
        return b[i], i + 1
    if kind in (4, 5, 6):
        n, i = _varint(b, i)
        return (n >> 1) ^ -(n & 1), i
    if kind == 7:
        return None, i + 8
    if kind == 8:
        n, i = _varint(b, i)
        return b[i : i + n], i + n
    if kind in (9, 10):
        size, item = b[i] >> 4, b[i] & 15
        i += 1
        if size == 15:
            size, i = _varint(b, i)
        out = []
        for _ in range(size):
            x, i = _value(b, i, item)
            out.append(x)
        return out, i
    if kind == 12:
        return _struct(b, i)
    raise ValueError(f"unexpected field kind {kind}")


def _struct(b: bytes, i: int) -> tuple[dict, int]:
    """A struct of the compact protocol as {field id: value}."""
    out, field = {}, 0
    while b[i]:
        step, kind = b[i] >> 4, b[i] & 15
        i += 1
        if step:
            field += step
        else:
            n, i = _varint(b, i)
            field = (n >> 1) ^ -(n & 1)
        out[field], i = _value(b, i, kind)
    return out, i + 1


def dictionary_values(f, chunk) -> list[str] | None:
    """The dictionary of a text chunk, or None if any data page does without it.

    ``f`` is an open random-access file, ``chunk`` the column chunk's metadata. Only page headers and the
    dictionary page are read.
    """
    if not chunk.has_dictionary_page or chunk.dictionary_page_offset is None:
        return None
    at, end = chunk.dictionary_page_offset, chunk.dictionary_page_offset + chunk.total_compressed_size
    values: list[str] = []
    left = chunk.num_values
    while at < end and left > 0:
        head = f.read_at(min(_HEADER, end - at), at)
        page, n = _struct(head, 0)
        body = at + n
        if page[1] == _DICTIONARY:
            raw = f.read_at(page[3], body)
            if chunk.compression != "UNCOMPRESSED":
                raw = pa.Codec(chunk.compression.lower()).decompress(raw, page[2], asbytes=True)
            i = 0
            for _ in range(page[7][1]):
                n = int.from_bytes(raw[i : i + 4], "little")
                values.append(raw[i + 4 : i + 4 + n].decode("utf-8", "replace"))
                i += 4 + n
        elif page[1] in (_DATA, _DATA_V2):
            h = page[5 if page[1] == _DATA else 8]
            if h[2 if page[1] == _DATA else 4] not in (_PLAIN_DICTIONARY, _RLE_DICTIONARY):
                return None
            left -= h[1]
        at = body + page[3]
    return values
