"""Binary codecs for stored values, for exchange with other readers of the format; tables hold typed structs instead.

All integers are little-endian. A location is a 16-bit length, the file key, and two 32-bit numbers; a location set a
32-bit count and locations; path entries a 16-bit count of (16-bit length, id, kind byte); an adjacency list two 16-bit
counts and edges (16-bit length, id, kind byte, and for custom kinds a 16-bit length and a name). What doesn't fit its
width raises an error.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable
from typing import Any

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftstone.errors import InvalidFormat, InvalidUtf8, TooShort, ValueDecodeError
from siftstone.schemas import ADJACENCY, CUSTOM_REL_KIND, ENTITY_KINDS, LOCATION, OTHER, OTHER_ENTITY_KIND, PATH_ENTRY, REL_KINDS

_REL_NAMES = {v: k for k, v in REL_KINDS.items()}
_ENTITY_NAMES = {v: k for k, v in ENTITY_KINDS.items()}


def _number(value: int, width: int) -> bytes:
    try:
        return int(value).to_bytes(width, "little")
    except OverflowError as e:
        raise ValueDecodeError(f"{value} doesn't fit {8 * width} bits") from e


def _string(text: str) -> bytes:
    data = text.encode()
    return _number(len(data), 2) + data


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise TooShort(f"{n} bytes wanted at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, width: int) -> int:
        return int.from_bytes(self.take(width), "little")

    def string(self) -> str:
        try:
            return self.take(self.number(2)).decode()
        except UnicodeDecodeError as e:
            raise InvalidUtf8(str(e)) from e


def encode_location(x: dict) -> bytes:
    return _string(x["file_key"]) + _number(x["row_group"], 4) + _number(x["row_offset"], 4)


def _read_location(r: _Reader) -> dict:
    return {"file_key": r.string(), "row_group": r.number(4), "row_offset": r.number(4)}


def decode_location(data: bytes) -> dict:
    return _read_location(_Reader(data))


def encode_locations(xs: Iterable[dict]) -> bytes:
    xs = list(xs)
    return struct.pack("<I", len(xs)) + b"".join(map(encode_location, xs))


def decode_locations(data: bytes) -> list[dict]:
    r = _Reader(data)
    return [_read_location(r) for _ in range(r.number(4))]


def _encode_edge(e: dict) -> bytes:
    code = REL_KINDS.get(e["rel_kind"], CUSTOM_REL_KIND)
    return _string(e["entity_id"]) + bytes([code]) + (_string(e["rel_kind"]) if code == CUSTOM_REL_KIND else b"")


def _read_edge(r: _Reader) -> dict:
    entity, code = r.string(), r.number(1)
    if code == CUSTOM_REL_KIND:
        return {"entity_id": entity, "rel_kind": r.string()}
    if code not in _REL_NAMES:
        raise InvalidFormat(f"unknown relation kind {code}")
    return {"entity_id": entity, "rel_kind": _REL_NAMES[code]}


def encode_adjacency(x: dict) -> bytes:
    out, into = x["outgoing"] or [], x["incoming"] or []
    return _number(len(out), 2) + _number(len(into), 2) + b"".join(map(_encode_edge, [*out, *into]))


def decode_adjacency(data: bytes) -> dict:
    r = _Reader(data)
    n, m = r.number(2), r.number(2)
    return {"outgoing": [_read_edge(r) for _ in range(n)], "incoming": [_read_edge(r) for _ in range(m)]}


def encode_path_entries(xs: Iterable[dict]) -> bytes:
    xs = list(xs)
    return _number(len(xs), 2) + b"".join(_string(x["entity_id"]) + bytes([ENTITY_KINDS.get(x["kind"], OTHER_ENTITY_KIND)]) for x in xs)


def decode_path_entries(data: bytes) -> list[dict]:
    r = _Reader(data)
    return [{"entity_id": r.string(), "kind": _ENTITY_NAMES.get(r.number(1), OTHER)} for _ in range(r.number(2))]


def _column_function(f: Callable[[Any], Any], returns: T.DataType, arrow: pa.DataType):
    """An Arrow UDF that maps ``f`` over a batch; null stays null."""

    @F.arrow_udf(returns)
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f(v) for v in values.to_pylist()], arrow)

    return run


_LOCATION = pa.struct([("file_key", pa.string()), ("row_group", pa.int64()), ("row_offset", pa.int64())])
_EDGE = pa.struct([("entity_id", pa.string()), ("rel_kind", pa.string())])
location_to_binary = _column_function(encode_location, T.BinaryType(), pa.binary())
binary_to_location = _column_function(decode_location, LOCATION, _LOCATION)
locations_to_binary = _column_function(encode_locations, T.BinaryType(), pa.binary())
binary_to_locations = _column_function(decode_locations, T.ArrayType(LOCATION), pa.list_(_LOCATION))
adjacency_to_binary = _column_function(encode_adjacency, T.BinaryType(), pa.binary())
binary_to_adjacency = _column_function(decode_adjacency, ADJACENCY, pa.struct([("outgoing", pa.list_(_EDGE)), ("incoming", pa.list_(_EDGE))]))
path_entries_to_binary = _column_function(encode_path_entries, T.BinaryType(), pa.binary())
binary_to_path_entries = _column_function(decode_path_entries, T.ArrayType(PATH_ENTRY), pa.list_(pa.struct([("entity_id", pa.string()), ("kind", pa.string())])))
