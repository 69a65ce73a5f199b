"""Byte-sortable row keys: comparing the bytes compares the rows.

Each column is ascending or descending, its nulls first or last whatever the direction.
Floats order by their bits (-NaN < -inf < ... < -0 < +0 < ... < +NaN).
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError

# The layout of the keys.
#: Data bytes in a block of a variable-width body.
BLOCK = 32
#: By direction, what stands before a variable-width value that has bytes, and before one that has none.
MARKS = {False: (0x02, 0x01), True: (0xFD, 0xFE)}


@dataclass(frozen=True)
class KeyColumn:
    name: str
    descending: bool = False
    nulls_first: bool = True


def _width(kind: T.DataType) -> int:
    """Bytes of a fixed-width value; 0 for variable width."""
    fixed = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8}
    if isinstance(kind, T.DecimalType):
        return next(w for digits, w in ((2, 1), (4, 2), (9, 4), (18, 8), (38, 16)) if kind.precision <= digits)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return 0
    if type(kind) in fixed:
        return fixed[type(kind)]
    raise SchemaError(f"{kind.simpleString()} has no row key")


def _fixed(value, kind: T.DataType, width: int) -> bytes:
    """Big-endian bytes whose order is the value's."""
    if isinstance(kind, T.BooleanType):
        return b"\x02" if value else b"\x01"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        bits = int.from_bytes(struct.pack(">f" if width == 4 else ">d", value), "big")
        top = 1 << (8 * width - 1)
        return (bits ^ (top if not bits & top else (1 << 8 * width) - 1)).to_bytes(width, "big")
    if isinstance(kind, T.DecimalType):
        value = int(value.scaleb(kind.scale))
    return (int(value) + (1 << (8 * width - 1))).to_bytes(width, "big")


def _flip(body: bytes) -> bytes:
    return bytes(255 - b for b in body)


def _blocks(data: bytes, descending: bool) -> bytes:
    out = b""
    while len(data) > BLOCK:
        out += data[:BLOCK] + b"\xff"
        data = data[BLOCK:]
    out += data.ljust(BLOCK, b"\x00") + bytes([len(data)])
    return _flip(out) if descending else out


def encode(value, kind: T.DataType, column: KeyColumn) -> bytes:
    """The bytes of one value."""
    width = _width(kind)
    if width:
        if value is None:
            return (b"\x00" if column.nulls_first else b"\x02") + bytes(width)
        body = _fixed(value, kind, width)
        return b"\x01" + (_flip(body) if column.descending else body)
    if value is None:
        return b"\x00" if column.nulls_first else b"\xff"
    data = value.encode() if isinstance(value, str) else bytes(value)
    if not data:
        return b"\xfe" if column.descending else b"\x01"
    return (b"\xfd" if column.descending else b"\x02") + _blocks(data, column.descending)


def encoded(values, kind: T.DataType, column: KeyColumn) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow array of values one after another, and where each starts and the last ends; as encode gives them."""
    import pyarrow as pa
    import pyarrow.compute as pc

    null = np.asarray(values.is_null())
    width, n = _width(kind), len(values)
    if width:
        if isinstance(kind, T.DecimalType):
            body = np.frombuffer(b"".join(_fixed(v, kind, width) if v is not None else bytes(width) for v in values.to_pylist()), np.uint8).reshape(n, width)
        else:
            if isinstance(kind, T.BooleanType):
                bits = np.asarray(values.fill_null(False)).astype(np.uint8) + np.uint8(1)
            elif isinstance(kind, (T.FloatType, T.DoubleType)):
                raw = np.asarray(values.fill_null(0.0), dtype=f"f{width}").view(f"u{width}")
                top = raw.dtype.type(1 << (8 * width - 1))
                bits = np.where(raw & top, ~raw, raw | top)
            else:
                bits = np.asarray(values.fill_null(0)).astype(f"i{width}").view(f"u{width}") ^ np.dtype(f"u{width}").type(1 << (8 * width - 1))
            body = bits.astype(bits.dtype.newbyteorder(">")).reshape(n, 1).view(np.uint8).reshape(n, width)
        out = np.empty((n, width + 1), np.uint8)
        out[:, 0], out[:, 1:] = 1, ~body if column.descending else body
        out[null, 0], out[null, 1:] = 0 if column.nulls_first else 2, 0
        return out.reshape(-1), np.arange(n + 1) * (width + 1)
    size = np.asarray(pc.fill_null(pc.binary_length(values), 0)).astype(np.int64)
    blocks = -(-size // BLOCK)
    offsets = np.append(0, np.cumsum(1 + blocks * (BLOCK + 1)))
    out = np.zeros(int(offsets[-1]), np.uint8)
    data = np.frombuffer(b"".join(v for v in values.cast(pa.binary()).fill_null(b"").to_pylist()), np.uint8)
    place = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)  # within its value
    out[np.repeat(offsets[:-1] + 1, size) + place + place // BLOCK] = data
    ordinal = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    last = ordinal == np.repeat(blocks, blocks) - 1
    out[np.repeat(offsets[:-1] + 1, blocks) + ordinal * (BLOCK + 1) + BLOCK] = np.where(last, np.repeat(size, blocks) - BLOCK * ordinal, 0xFF)
    if column.descending:
        out = ~out
    head = np.where(size > 0, MARKS[column.descending][0], MARKS[column.descending][1])
    out[offsets[:-1]] = np.where(null, 0 if column.nulls_first else 0xFF, head)
    return out, offsets


def _sent(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), column)
    return F.unix_date(column) if isinstance(kind, T.DateType) else column


def row_key(df: DataFrame, columns: list[KeyColumn]) -> Column:
    """A binary column whose byte order is the order of the columns."""
    kinds = [df.schema[c.name].dataType for c in columns]
    for kind in kinds:
        _width(kind)
    # instants travel as microseconds and dates as days, so no library rounds or zones them
    moved = [_sent(F.col(f"`{c.name}`"), k) for k, c in zip(kinds, columns, strict=True)]
    as_sent = [T.LongType() if isinstance(k, (T.TimestampType, T.TimestampNTZType)) else T.IntegerType() if isinstance(k, T.DateType) else k for k in kinds]

    @F.arrow_udf("binary")
    def key(*values):
        import pyarrow as pa

        parts = [encoded(v, k, c) for v, k, c in zip(values, as_sent, columns, strict=True)]
        ends = np.cumsum(sum(np.diff(offsets) for _, offsets in parts))
        starts = np.append(0, ends[:-1]) if len(ends) else ends
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        for data, offsets in parts:
            size = np.diff(offsets)
            out[np.repeat(starts - offsets[:-1], size) + np.arange(len(data))] = data
            starts = starts + size
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(out)])

    return key(*moved)
