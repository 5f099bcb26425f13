"""Importance resampling towards a target: hashed features, array-scored weights, a bracketed cutoff.

Features (runs of words) fall into a fixed number of buckets. A bucket's gain is the
log ratio of its share in the target to its share in the documents; a document's
weight is its features' mean gain, read from one array. With a seeded Gumbel term
added, the highest scores are a draw without replacement in proportion to exp(weight).

The cutoff is found without a sort of all scores: a mergeable quantile sketch gives a
bracket around it, exact counts above and inside validate the bracket or widen it, and
only the bracket is ranked to place the cutoff. Those above it are in whatever their order;
they are ranked because the result numbers them.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlake.llm.common import CACHE_ENTRIES, alnum_runs, int_lists, materialize, pieces, texts_of
from fleetlake.operators.scans import running


@dataclass(frozen=True)
class ResampleParams:
    runs: int = 1  # features are all runs of 1 to so many words
    buckets: int = 10_000
    min_words: int = 20
    percent: int = 10
    seed: int = 2024
    accuracy: int = 10_000  # of the sketch: ranks are off by a share of 1/accuracy at most


class _Buckets(dict):
    """Word to bucket; remembers up to ``CACHE_ENTRIES`` words."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        value = zlib.crc32(word) % self.buckets
        if len(self) < CACHE_ENTRIES:
            self[word] = value
        return value


def features(text: bytes, runs: int, known: _Buckets) -> tuple[int, np.ndarray, np.ndarray]:
    """(words, buckets, counts) of a whole text; the arrays are no longer than there are buckets, however long the text."""
    words, total, before = 0, np.zeros(0, np.int64), []
    for part in alnum_runs(text):
        found = list(map(known.__getitem__, part))
        for k in range(2, runs + 1):
            joined = before[max(0, len(before) - k + 1) :] + part
            found += [zlib.crc32(b" ".join(joined[i : i + k])) % known.buckets for i in range(len(joined) - k + 1)]
        words += len(part)
        before = (before + part)[-(runs - 1) :] if runs > 1 else []
        if found:
            counts = np.bincount(found, minlength=len(total))
            counts[: len(total)] += total
            total = counts
    at = np.flatnonzero(total)
    return words, at, total[at]


def _feature_batches(batches, p: ResampleParams):
    import pyarrow as pa

    known = _Buckets(p.buckets)
    for b in pieces(batches):
        words, at, n = zip(*(features(t, p.runs, known) for t in texts_of(b.column(1))), strict=True) if b.num_rows else ((), (), ())
        yield pa.record_batch([b.column(0), pa.array(words, pa.int64()), int_lists(list(at)), int_lists(list(n), np.int64)], names=["doc_id", "n_words", "b", "c"])


def _flat(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _total_batches(batches, buckets: int):
    import pyarrow as pa

    total = np.zeros(buckets, np.int64)
    for b in batches:
        np.add.at(total, _flat(b.column(0)), _flat(b.column(1)))
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])


def feature_table(texts: DataFrame, params: ResampleParams, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_words, b, c): how often each bucket occurs in each whole text; null is empty."""
    rows = texts.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _feature_batches(it, params), "doc_id long, n_words long, b array<int>, c array<long>")


def bucket_totals(table: DataFrame, buckets: int) -> np.ndarray:
    """The sum of each bucket: each task adds up its own rows, the driver gets a row a bucket."""
    sums = table.select("b", "c").mapInArrow(lambda it: _total_batches(it, buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[sums["bucket"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) for each bucket."""
    b, s_all, t_all = len(source), float(source.sum()) + len(source), float(target.sum()) + len(source)
    return np.fromiter((math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)), np.int64, b)


def gumbel(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score_batches(batches, gains, seed: int) -> Iterator:
    import pyarrow as pa

    for b in batches:
        lengths = np.diff(b.column(2).offsets.to_numpy())
        counts = _flat(b.column(3))
        ends = np.cumsum(lengths)
        running_gain = np.concatenate([[0], np.cumsum(gains.value[_flat(b.column(2))] * counts)])
        running_n = np.concatenate([[0], np.cumsum(counts)])
        n = running_n[ends] - running_n[ends - lengths]
        weight = np.where(n > 0, (running_gain[ends] - running_gain[ends - lengths]) // np.maximum(n, 1), 0).astype(np.int64)
        noise = np.fromiter((gumbel(d, seed) for d in b.column(0).to_pylist()), np.int64, b.num_rows)
        yield pa.record_batch([b.column(0), b.column(1), pa.array(n.astype(np.int64)), pa.array(weight), pa.array(weight + noise)], names=["doc_id", "n_words", "n_features", "weight", "score"])


def bracket(scores: DataFrame, k: int, n: int, accuracy: int) -> tuple[int, int, int]:
    """(low, high, above): the k-th highest of the n scores lies in [low, high] and ``above`` scores are higher than ``high``.

    The sketch's quantiles beside the wanted rank give the first bracket. Exact counts
    tell whether it holds; if not, it is made four times as wide, up to all scores.
    """
    at, width = 1 - k / n, 2 / accuracy
    while True:
        sides = [max(0.0, at - width), min(1.0, at + width)]
        low, high = scores.agg(F.percentile_approx("score", sides, accuracy)).first()[0]
        if width >= 1:
            low, high = scores.agg(F.min("score"), F.max("score")).first()
        above, inside = scores.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < k <= above + inside:
            return low, high, above
        width *= 4


def resample(docs: DataFrame, target: DataFrame, params: ResampleParams = ResampleParams(), id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank): every row's score; rank 1, 2, 3... for those drawn, else null.

    Of the rows with ``min_words`` words, ``percent`` (rounded down) are drawn: the
    highest scores, ties to the smaller doc_id, rows without an id last of a tie, rows
    that repeat id and score by number of features. Each row is a document of its own, also if it
    repeats an id. Null, empty and wordless texts have no features and weight 0; very
    long texts are read in runs and leave a count a bucket. Empty documents give an
    empty result, an empty target one with all of its shares equal. Other columns are
    not read.
    """
    p = params
    table = materialize(feature_table(docs, p, id_col, text_col), "features")
    wanted = feature_table(target.select(F.lit(0).alias("i"), F.col(target_text_col).alias("t")), p, "i", "t")
    gains = docs.sparkSession.sparkContext.broadcast(bucket_gains(bucket_totals(table, p.buckets), bucket_totals(wanted, p.buckets)))  # a number a bucket
    scored = materialize(table.mapInArrow(lambda it: _score_batches(it, gains, p.seed), "doc_id long, n_words long, n_features long, weight long, score long"), "scores")
    result = ["doc_id", "n_features", "weight", "score"]
    apt = F.col("n_words") >= p.min_words
    n = scored.where(apt).count()
    k = p.percent * n // 100
    if not k:
        return scored.select(*result, F.lit(None).cast("long").alias("rank"))
    low, high, above = bracket(scored.where(apt), k, n, p.accuracy)
    keyed = scored.where(apt).select(*result, (-F.col("score")).alias("__down"), F.col("doc_id").isNull().alias("__none"))
    order = ["__down", "__none", "doc_id", "n_features"]
    first = running(keyed.where(F.col("score") > high), [], order, rank="rank").select(*result, "rank")
    inside = running(keyed.where(F.col("score").between(low, high)), [], order, rank="rank")
    inside = inside.select(*result, F.when(F.col("rank") <= k - above, F.col("rank") + above).alias("rank"))
    rest = scored.where(~apt | (F.col("score") < low)).select(*result, F.lit(None).cast("long").alias("rank"))
    return first.unionByName(inside).unionByName(rest)


def drawn(docs: DataFrame, ranks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id was drawn, all their columns as they came."""
    ids = ranks.where("rank is not null").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(ids, docs[id_col].cast("long") == F.col("__drawn"), "left_semi")
