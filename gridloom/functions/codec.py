"""Ascending places as bytes: gaps between neighbours, less one, in base 128 with a continuation bit (LEB128)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, LongType


#: Least gaps that need 2, 3, ... digits.
STEPS = np.array([1 << 7 * k for k in range(1, 9)], np.uint64)


def encode_all(places: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends) of lists of places that lie one after another, `sizes` long; each is sorted first.

    Places of a list must be distinct and not negative.
    """
    places, of = np.asarray(places, np.int64), np.repeat(np.arange(len(sizes)), sizes)
    first = np.r_[True, of[1:] != of[:-1]][: len(of)]
    if not (first[1:] | (places[1:] > places[:-1])).all():
        places = places[np.lexsort((places, of))]
    gaps = np.diff(places, prepend=-1) - 1
    gaps[first] = places[first]
    if (gaps < 0).any():
        raise ValueError("places must be distinct and not negative")
    gaps = gaps.astype(np.uint64)
    width = 1 + np.searchsorted(STEPS, gaps, side="right")
    ends = np.cumsum(width)
    total = int(ends[-1]) if len(ends) else 0
    step = np.arange(total) - np.repeat(ends - width, width)
    digits = (np.repeat(gaps, width) >> (7 * step).astype(np.uint64)).astype(np.uint8) & 127
    digits[np.delete(np.arange(total), ends - 1)] |= 128
    return digits, np.r_[0, ends][np.cumsum(sizes)] if len(sizes) else np.zeros(0, int)


def decode_all(digits: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, ends) of what was encoded to byte strings that lie one after another, `sizes` long."""
    last = digits < 128
    byte_ends = np.cumsum(sizes)
    if not last[byte_ends[sizes > 0] - 1].all():
        raise ValueError("the last number is cut off")
    number_ends = np.flatnonzero(last) + 1
    begin = np.r_[0, number_ends[:-1]][: len(number_ends)]
    step = np.arange(len(digits)) - np.repeat(begin, number_ends - begin)
    parts = (digits & 127).astype(np.int64) << (7 * step)
    gaps = np.add.reduceat(parts, begin) if len(begin) else np.zeros(0, np.int64)
    ends = np.r_[0, np.cumsum(last)][byte_ends]
    reached = np.cumsum(gaps + 1)
    counts = np.diff(ends, prepend=0)
    return reached - 1 - np.repeat(np.r_[0, reached][ends - counts], counts), ends


def encode(places: np.ndarray) -> bytes:
    return encode_all(places, np.array([len(places)]))[0].tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_all(np.frombuffer(data, np.uint8), np.array([len(data)]))[0]


@arrow_udf(BinaryType())
def pack(places: pa.Array) -> pa.Array:
    return packed(places.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(places).fill_null(0).to_numpy(zero_copy_only=False))


@arrow_udf(ArrayType(LongType()))
def unpack(data: pa.Array) -> pa.Array:
    places, ends = unpacked(data)
    return listed(places, ends)


def unpack_some(asked: Sequence[int]):
    """unpack of those places only that are asked for."""
    wanted = np.unique(np.asarray(asked, np.int64))

    @arrow_udf(ArrayType(LongType()))
    def run(data: pa.Array) -> pa.Array:
        places, ends = unpacked(data)
        near = np.searchsorted(wanted, places)
        found = wanted[np.minimum(near, len(wanted) - 1)] == places if len(wanted) else np.zeros(len(places), bool)
        return listed(places[found], np.r_[0, np.cumsum(found)][ends])

    # Else Spark filters by the size of what explode gets, and opens the bytes once more for that.
    return run.asNondeterministic()


def packed(places: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Lists that lie one after another, as an array of byte strings."""
    digits, ends = encode_all(places, np.asarray(sizes, np.int64))
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(digits)])


def unpacked(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, 4 * data.offset) if len(data) else np.zeros(1, np.int32)
    held = data.buffers()[2]
    digits = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held else np.zeros(0, np.uint8)
    return decode_all(digits, np.diff(offsets).astype(np.int64))


def listed(places: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.r_[0, ends].astype(np.int32), pa.array(places, pa.int64()))
