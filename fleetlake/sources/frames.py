"""Activation frames: a 26-byte little-endian header and floats; announcements have a hash in their place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlake.functions.encodings import F32, decode_vectors, float_bytes
from fleetlake.sources.shards import le_bytes, le_number, turned
from fleetlake.storage import bounded_batches

# Fixed values of the format.
MAGIC, VERSION, PLAIN, ANNOUNCED, HEADER = 0x4F55524F, 1, 0, 1, 26


FIELDS = ("sequence", "token_pos", "layer_start", "layer_end")


def _head(kind: int, elements):
    numbers = [le_bytes(F.col(c), 4) for c in FIELDS]
    return F.concat(le_bytes(F.lit(MAGIC), 4), le_bytes(F.lit(VERSION), 1), le_bytes(F.lit(kind), 1), *numbers, le_bytes(elements, 4))


def encode_frames(df: DataFrame) -> DataFrame:
    """Adds ``frame``, hexadecimal, from sequence, token_pos, layer_start, layer_end and ``x``."""
    bounded_batches(df.sparkSession)
    return df.withColumn("frame", F.hex(F.concat(_head(PLAIN, F.size("x")), float_bytes("x"))))


def encode_announcements(df: DataFrame) -> DataFrame:
    """Adds ``frame``, hexadecimal, from the same fields and ``hash``, 16 hexadecimal digits of a 64-bit number."""
    return df.withColumn("frame", F.hex(F.concat(_head(ANNOUNCED, F.lit(0)), turned(F.unhex("hash"), 8))))


def _judged(df: DataFrame, col: str, kind: int):
    """(rows with ``b``, the bytes, and ``reason``; the columns to keep; the header's fields)."""
    raw = df.withColumn("b", F.unhex(col))
    b, n = F.col("b"), F.octet_length("b")
    elements = le_number(b, 22, 4)
    reason = (
        F.when(n.isNull() | (n < HEADER), "short").when(le_number(b, 0, 4) != MAGIC, "magic").when(le_number(b, 4, 1) != VERSION, "version")
        .when(le_number(b, 5, 1) != kind, "type").when((elements != 0) if kind == ANNOUNCED else F.lit(False), "elements")
        .when(n < HEADER + (8 if kind == ANNOUNCED else 4 * elements), "truncated")
    )
    fields = [le_number(b, 6 + 4 * i, 4).alias(c) for i, c in enumerate(FIELDS)]
    return raw.withColumn("reason", reason), [c for c in df.columns if c != col], fields


def decode_frames(df: DataFrame, col: str = "frame") -> tuple[DataFrame, DataFrame]:
    """(frames with their fields and ``x``, errors with a reason)."""
    bounded_batches(df.sparkSession)
    judged, keep, fields = _judged(df, col, PLAIN)
    payload = F.substring("b", HEADER + 1, (4 * le_number(F.col("b"), 22, 4)).cast("int"))
    good = judged.where("reason is null").select(*keep, *fields, decode_vectors(F.lit(F32), payload).alias("x"))
    return good, judged.where("reason is not null").select(*keep, "reason")


def decode_announcements(df: DataFrame, col: str = "frame") -> tuple[DataFrame, DataFrame]:
    """(announcements with their fields and ``hash``, errors with a reason)."""
    judged, keep, fields = _judged(df, col, ANNOUNCED)
    good = judged.where("reason is null").select(*keep, *fields, F.lower(F.hex(turned(F.substring("b", HEADER + 1, 8), 8))).alias("hash"))
    return good, judged.where("reason is not null").select(*keep, "reason")
