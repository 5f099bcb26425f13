"""Quality rules: how often a line stands in different documents of one host.

Lines are normalised (A-Z to a-z, digits to 0, white space to one space) and
hashed. A line that stands in more than ``max_docs`` documents of its host is
boilerplate and is removed; a document left with too few of its words is rejected,
and so are all copies of a text that a host holds more than ``max_docs`` times.
Plain measures of each text stand beside this.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlake.llm.common import materialize, pieces, shingle_hashes, texts_of, word_hashes

SYMBOLS = b"#*$%&|<>"
NORMAL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")


@dataclass(frozen=True)
class LineParams:
    max_docs: int = 30  # documents of a host that may share a line
    min_left_percent: int = 30  # of its words that a kept document must have left
    min_words: int = 50
    max_repeat_percent: int = 50


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more."""
    t = shingle_hashes(word_hashes(words), 3)
    if len(t) < 2 or len(np.unique(t)) == len(t):
        return 0
    _, inverse, counts = np.unique(t, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(len(words), bool)
    for j in range(3):
        covered[j : j + len(t)] |= twice
    return int(covered.sum())


def line_hash(line: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(b" ".join(line.translate(NORMAL).split())) - 2**63


_SCHEMA = "doc_id long, host string, thash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<h:long,w:long>>"


def _measure(batches):
    import pyarrow as pa

    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6, pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int64())]))]
    for b in pieces(batches):
        out: list[list] = [[] for _ in range(6)]
        for t in texts_of(b.column(1)):
            words = t.split()
            lines = [x for x in t.split(b"\n") if not (x.isspace() or not x)]
            row = (
                len(words), len(b"".join(words).decode("utf-8", "replace")), len(t) - len(t.translate(None, SYMBOLS)),
                len(lines) - len(set(lines)), repeated_words(words), [{"h": line_hash(x), "w": len(x.split())} for x in lines],
            )
            for column, value in zip(out, row, strict=True):
                column.append(value)
        yield pa.record_batch([pa.array(x, k) for x, k in zip([b.column(0), b.column(2), b.column(3), *out], kinds, strict=True)], names=["doc_id", "host", "thash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])


def _analyse(docs: DataFrame, p: LineParams, id_col: str, text_col: str, host_col: str):
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(host_col), F.lit("")).alias("host"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("thash"))
    rows = materialize(base.mapInArrow(_measure, _SCHEMA), "measures")
    lines = rows.select("doc_id", "host", "thash", F.explode("lines").alias("l")).select("doc_id", "host", "thash", "l.h", "l.w")
    shared = lines.groupBy("host", "h").agg(F.countDistinct(F.struct("doc_id")).alias("docs")).where(F.col("docs") > p.max_docs).select("host", "h")
    shared = materialize(shared, "shared_lines")
    # A row that repeats has its lines counted once.
    once = rows.dropDuplicates(["doc_id", "host", "thash"])
    cut = once.select("doc_id", "host", "thash", F.explode("lines").alias("l")).select("doc_id", "host", "thash", "l.h", "l.w").join(shared, ["host", "h"])
    removed = cut.groupBy("doc_id", "host", "thash").agg(F.sum("w").alias("cut_words"), F.collect_set("h").alias("cut_lines"))
    return base, rows, removed


def line_quality(docs: DataFrame, params: LineParams = LineParams(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of ``docs`` with its measures, ``base_failed``, ``cut_words`` and ``kept``.

    Null text is empty: no words, ``base_failed``, not kept. A null host is a host
    of its own. Rows that repeat an id are one document for line frequency (those
    without one are one, too) and each get the result of their text. An empty table gives an empty result. Other columns aren't
    read, whatever their names.
    """
    p = params
    _, rows, removed = _analyse(docs, p, id_col, text_col, host_col)
    removed = removed.select(F.col("doc_id").alias("rid"), F.col("host").alias("rhost"), F.col("thash").alias("rhash"), "cut_words")
    same = F.col("doc_id").eqNullSafe(F.col("rid")) & (F.col("host") == F.col("rhost")) & (F.col("thash") == F.col("rhash"))
    out = rows.join(removed, same, "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.coalesce("cut_words", F.lit(0)).alias("cut_words"))
    failed = (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat_percent * F.col("n_words"))
    depleted = 100 * (F.col("n_words") - F.col("cut_words")) < p.min_left_percent * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def _drop_lines(batches):
    import pyarrow as pa

    for b in pieces(batches):
        texts = []
        for t, null, cut in zip(texts_of(b.column(1)), b.column(1).is_null().to_pylist(), b.column(2).to_pylist(), strict=True):
            gone = set(cut or [])
            texts.append(None if null else (t if not gone else b"\n".join(x for x in t.split(b"\n") if not x.split() or line_hash(x) not in gone)).decode())
        yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def without_shared_lines(docs: DataFrame, params: LineParams = LineParams(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, text) of every row, the text without its host's boilerplate lines; null text stays null."""
    base, _, removed = _analyse(docs, params, id_col, text_col, host_col)
    removed = materialize(removed.select(F.col("doc_id").alias("rid"), F.col("host").alias("rhost"), F.col("thash").alias("rhash"), "cut_lines"), "cut_lines")
    same = F.col("doc_id").eqNullSafe(F.col("rid")) & (F.col("host") == F.col("rhost")) & (F.col("thash") == F.col("rhash"))
    return base.join(removed, same, "left").select("doc_id", "text", "cut_lines").mapInArrow(_drop_lines, "doc_id long, text string")
