"""Vectors as bytes: plain, half and brain floats, blocks of 3 to 8 bits and ternary groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

# Kind numbers, and (elements, bytes) of a block of each.
F32, F16, Q8_0, Q3_K, Q4_K, Q5_K, Q6_K, BF16, TQ1_0, PTQ1 = 0, 1, 8, 11, 12, 13, 14, 30, 34, 143
BLOCKS = {F32: (1, 4), F16: (1, 2), Q8_0: (32, 34), Q3_K: (256, 110), Q4_K: (256, 144), Q5_K: (256, 176), Q6_K: (256, 210), BF16: (1, 2), TQ1_0: (256, 54), PTQ1: (128, 28)}


def _places(unit: int) -> np.ndarray:
    """By byte of a ternary group and digit: the element; -1 where the last bytes have no fifth digit.

    The bytes come in runs of 8, 4 and 1 units; a unit is 2 bytes of 128 elements, 4 of 256.
    """
    at = np.full((13 * unit, 5), -1)
    n = np.arange(5)
    at[: 8 * unit] = np.arange(8 * unit)[:, None] + 8 * unit * n
    at[8 * unit : 12 * unit] = 40 * unit + np.arange(4 * unit)[:, None] + 4 * unit * n
    at[12 * unit :, :4] = 60 * unit + np.arange(unit)[:, None] + unit * n[:4]
    return at


_AT = _places(2)


def _halves(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view("<f2").astype(np.float32)


def _ternary(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Base-3 digits less 1, times the half float at the end of each row."""
    out = np.zeros((len(rows), at.max() + 1), np.float32)
    rest = rows[:, : len(at)].astype(np.uint16)
    for digit in range(5):
        rest = rest * 3
        used = at[:, digit] >= 0
        out[:, at[used, digit]] = (rest >> 8)[:, used].astype(np.float32) - 1
        rest &= 255
    return out * _halves(rows[:, len(at) :])


def _bit_planes(rows: np.ndarray) -> np.ndarray:
    """(row, bit from the lowest, byte)."""
    return np.unpackbits(rows[:, :, None], axis=2, bitorder="little").transpose(0, 2, 1)


def _two_bits(rows: np.ndarray) -> np.ndarray:
    """(row, run of 32 bytes, pair of bits from the lowest, byte)."""
    return rows.reshape(len(rows), -1, 1, 32) >> (2 * np.arange(4, dtype=np.uint8))[:, None] & 3


def _nibbles(rows: np.ndarray, run: int) -> np.ndarray:
    """(row, run of bytes, low or high half, byte)."""
    runs = rows.reshape(len(rows), -1, run)
    return np.stack([runs & 15, runs >> 4], axis=2)


def _three_bits(rows: np.ndarray) -> np.ndarray:
    """Third bits, 16 runs of 16 values by their low two bits, 12 bytes of 6-bit scales and a half float."""
    packed = rows[:, 96:108]
    low = _nibbles(packed[:, :8], 8).reshape(-1, 16)
    high = (packed[:, None, 8:] >> (2 * np.arange(4, dtype=np.uint8))[:, None] & 3).reshape(-1, 16)
    scale = _halves(rows[:, 108:]) * ((low | high << 4).astype(np.float32) - 32)
    value = _two_bits(rows[:, 32:96]).reshape(-1, 8, 32) + 4.0 * _bit_planes(rows[:, :32]) - 4
    return value.reshape(-1, 16, 16).astype(np.float32) * scale[:, :, None]


def _four_bits(rows: np.ndarray, fifth: bool) -> np.ndarray:
    """Two half floats, 12 bytes of 6-bit scales and offsets of 8 runs of 32, fifth bits if any, nibbles."""
    whole = _halves(rows[:, :4])
    a, b, c = rows[:, 4:8], rows[:, 8:12], rows[:, 12:16]
    scale = np.concatenate([a & 63, c & 15 | a >> 6 << 4], axis=1) * whole[:, :1]
    offset = np.concatenate([b & 63, c >> 4 | b >> 6 << 4], axis=1) * whole[:, 1:]
    value = _nibbles(rows[:, -128:], 32).reshape(-1, 8, 32)
    if fifth:
        value = value | _bit_planes(rows[:, 16:48]) << 4
    return value * scale[:, :, None] - offset[:, :, None]


def _six_bits(rows: np.ndarray) -> np.ndarray:
    """Low nibbles, high pairs of bits, 16 signed scales and a half float."""
    low = _nibbles(rows[:, :128], 64).reshape(-1, 2, 4, 32)
    value = (low | _two_bits(rows[:, 128:192]) << 4).reshape(-1, 16, 16).astype(np.float32) - 32
    scale = np.ascontiguousarray(rows[:, 192:208]).view(np.int8) * _halves(rows[:, 208:])
    return value * scale[:, :, None]


def decode_bytes(kind: int, data: bytes) -> np.ndarray | None:
    """The numbers; null for unknown kinds, an error if the bytes aren't whole blocks."""
    if kind not in BLOCKS:
        return None
    size = BLOCKS[kind][1]
    if len(data) % size:
        raise ValueError(f"{len(data)} bytes are not whole blocks of {size}")
    if kind in (F32, F16):
        return np.frombuffer(data, "<f4" if kind == F32 else "<f2").astype(np.float32)
    if kind == BF16:
        return (np.frombuffer(data, "<u2").astype(np.uint32) << 16).view(np.float32)
    if not data:
        return np.empty(0, np.float32)
    rows = np.frombuffer(data, np.uint8).reshape(-1, size)
    if kind == Q8_0:
        out = rows[:, 2:].view(np.int8) * _halves(rows[:, :2])
    elif kind in (TQ1_0, PTQ1):
        out = _ternary(rows, _places(4) if kind == TQ1_0 else _AT)
    elif kind == Q3_K:
        out = _three_bits(rows)
    elif kind == Q6_K:
        out = _six_bits(rows)
    else:
        out = _four_bits(rows, kind == Q5_K)
    return out.astype(np.float32).ravel()


def encode_groups(x: np.ndarray) -> bytes:
    """Values -1, 0, 1, a multiple of 128 of them, to 28 bytes a group."""
    groups = np.rint(np.asarray(x, float)).astype(np.int64).reshape(-1, 128) + 1
    digits = np.where(_AT >= 0, groups[:, _AT], 0)
    value = digits @ (3 ** np.arange(4, -1, -1))
    out = np.zeros((len(groups), 28), np.uint8)
    out[:, :26] = -(-value * 256 // 243)
    out[:, 26:] = np.array([1.0], "<f2").view(np.uint8)
    return out.tobytes()


@F.pandas_udf(ArrayType(FloatType()))
def decode_vectors(kind: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([None if k is None or b is None else decode_bytes(int(k), bytes(b)) for k, b in zip(kind, data, strict=True)])


@F.pandas_udf(BinaryType())
def encode_ternary(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else encode_groups(v))


@F.pandas_udf(BinaryType())
def float_bytes(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())
