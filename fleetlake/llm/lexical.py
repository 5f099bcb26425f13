"""Ranked lexical search of many queries: short lists summed up front, long lists skipped through.

Documents are cut into shards, in the order they are read and sorted by id inside. A
shard is one row: its documents, their lengths and, for each term that some query has,
the list of documents with the term and its frequency there. No shuffle is needed to
build it or to search it.

In a shard a query's shortest lists are summed term at a time into accumulators, as far
as a fixed number of postings goes. These then stand as one more list, with its own
largest sum, beside the long lists, and all are read document at a time: in blocks of
neighbouring documents, in order. A block whose lists' largest contributions don't add
up to the score of the last ranked document is skipped; in others only documents of
those lists are looked at without which the rest can't add up to it, and the rest is
looked up for these documents only. A task keeps its ranking from shard to shard, so
the bar rises with all that it reads.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlake.llm.common import alnum_runs, int_lists, materialize, pieces, texts_of

SHARD = "ids array<long>, lengths array<long>, terms array<int>, ends array<int>, docs array<int>, freqs array<int>"


@dataclass(frozen=True)
class SearchParams:
    k: int = 10
    length_percent: int = 90  # of a document's length in its norm
    saturation: int = 8  # tenths
    accumulate: int = 4_096  # postings of short lists that are summed up front, a query and shard
    block: int = 256  # neighbouring documents
    shard_postings: int = 1_000_000
    shard_docs: int = 65_536
    block_terms: int = 200_000  # terms of queries that are searched together, about; one query at least


def _term_batches(batches):
    import pyarrow as pa

    for b in pieces(batches):
        ids, terms = [], []
        for i, t in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
            own = {w for part in alnum_runs(t) for w in part}
            ids += [i] * len(own)
            terms += own
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(terms, pa.binary())], names=["item_id", "term"])


def query_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term): the different terms of each item, as bytes."""
    rows = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null and text is not null")
    return rows.mapInArrow(_term_batches, "item_id long, term binary").distinct()


def _frequencies(text: bytes, known: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """(terms of a whole text, ids of those that are known, their frequencies)."""
    n, found = 0, []
    for part in alnum_runs(text):
        n += len(part)
        hit = [x for x in map(known.get, part) if x is not None]
        found.append(np.unique(np.array(hit, np.int32), return_counts=True))
    if len(found) == 1:
        return n, *found[0]
    ids, back = np.unique(np.concatenate([np.zeros(0, np.int32), *(f[0] for f in found)]), return_inverse=True)
    return n, ids, np.bincount(back, np.concatenate([np.zeros(0, np.int64), *(f[1] for f in found)]), len(ids)).astype(np.int64)


def _shard_batches(batches, vocabulary, p: SearchParams):
    import pyarrow as pa

    known: dict[bytes, int] = {w: i for i, w in enumerate(vocabulary.value)}
    ids, lengths, terms, freqs, postings = [], [], [], [], 0

    def shard():
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        sizes = np.array([len(terms[i]) for i in order], np.int64)
        t = np.concatenate([np.zeros(0, np.int32), *(terms[i] for i in order)])
        f = np.concatenate([np.zeros(0, np.int64), *(freqs[i] for i in order)])
        by_term = np.argsort(t, kind="stable")  # documents stay in order
        own, counts = np.unique(t, return_counts=True)
        row = [pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), int_lists([np.array([lengths[i] for i in order])], np.int64)]
        row += [int_lists([x]) for x in (own, np.cumsum(counts), np.repeat(np.arange(len(order)), sizes)[by_term], f[by_term])]
        return pa.record_batch(row, names=["ids", "lengths", "terms", "ends", "docs", "freqs"])

    for b in pieces(batches):
        for d, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
            n, t, f = _frequencies(text, known)
            ids.append(d)
            lengths.append(n)
            terms.append(t)
            freqs.append(f)
            postings += len(t)
            if postings >= p.shard_postings or len(ids) >= p.shard_docs:
                yield shard()
                ids, lengths, terms, freqs, postings = [], [], [], [], 0
    if ids:
        yield shard()


def index_documents(docs: DataFrame, vocabulary: list[bytes], params: SearchParams = SearchParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of all documents with the lists of the vocabulary's terms; terms are named by their places in it."""
    words = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _shard_batches(it, words, params), SHARD)


def _df_batches(batches, size: int):
    import pyarrow as pa

    total = np.zeros(size, np.int64)
    for b in batches:
        for terms, ends in zip(b.column(0), b.column(1), strict=True):
            total[terms.values.to_numpy()] += np.diff(ends.values.to_numpy(), prepend=0)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["term", "df"])


def term_weights(index: DataFrame, n: int, size: int) -> np.ndarray:
    """floor(1000 ln((2N+2) / (2df+1))) for each term: each task adds up its shards, the driver gets a row a term."""
    sums = index.select("terms", "ends").mapInArrow(lambda it: _df_batches(it, size), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(size, np.int64)
    df[sums["term"].to_numpy(np.int64)] = sums["df"].to_numpy(np.int64)
    return np.fromiter((math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()), np.int64, size)


class Shard:
    """The lists of a shard with each posting's contribution to a score."""

    def __init__(self, row: dict, weights: np.ndarray, n: int, total: int, p: SearchParams):
        self.p = p
        self.ids, lengths = row["ids"], row["lengths"]
        self.terms = {t: i for i, t in enumerate(row["terms"].tolist())}
        self.ends = np.concatenate([[0], row["ends"]])
        self.docs = row["docs"]
        norm = 100 - p.length_percent + (p.length_percent * lengths * n) // max(total, 1)
        tf = row["freqs"].astype(np.int64)
        w = np.repeat(weights[row["terms"]], np.diff(self.ends))
        self.scores = w * ((1_000_000_000 * tf) // (1000 * tf + p.saturation * norm[self.docs]))
        self.blocks = -(-len(self.ids) // p.block)
        self.bounds = functools.cache(self._bounds)

    def find(self, terms: np.ndarray) -> list[int]:
        return [i for t in terms.tolist() if (i := self.terms.get(t)) is not None]

    def part(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.ends[i], self.ends[i + 1])
        return self.docs[at], self.scores[at]

    def _bounds(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return block_bounds(*self.part(i), self.blocks, self.p.block)


def block_bounds(docs: np.ndarray, scores: np.ndarray, blocks: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, largest): where each block of documents begins in a list, and its largest score there."""
    starts = np.searchsorted(docs, np.arange(blocks + 1) * block)
    largest = np.zeros(blocks, np.int64)
    some = np.flatnonzero(np.diff(starts))
    if len(some):
        largest[some] = np.maximum.reduceat(scores, starts[some])
    return starts, largest


class Ranking:
    """The k best (score, id) so far: higher scores first, then smaller ids, none last."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.bar = 1  # scores below it can't enter

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        s, i, n = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.none, none])
        best = np.lexsort((i, n, -s))[: self.k]
        self.scores, self.ids, self.none = s[best], i[best], n[best]
        if len(best) == self.k:
            self.bar = max(1, int(self.scores[-1]))


def search_shard(shard: Shard, terms: np.ndarray, ids: np.ndarray, none: np.ndarray, ranking: Ranking) -> int:
    """Adds a shard's documents to the ranking of a query; returns the number of blocks that were read."""
    p = shard.p
    lists = sorted(shard.find(terms), key=lambda i: shard.ends[i + 1] - shard.ends[i])
    short = int(np.searchsorted(np.cumsum([shard.ends[i + 1] - shard.ends[i] for i in lists]), p.accumulate, "right")) if lists else 0
    streams = [(*shard.part(i), *shard.bounds(i)) for i in lists[short:]]
    if short:
        docs, scores = (np.concatenate(x) for x in zip(*(shard.part(i) for i in lists[:short]), strict=True))
        order = np.argsort(docs, kind="stable")
        docs, first = np.unique(docs[order], return_index=True)
        summed = np.add.reduceat(scores[order], first)
        streams.append((docs, summed, *block_bounds(docs, summed, shard.blocks, p.block)))
    if not streams:
        return 0
    most = np.sum([largest for *_, largest in streams], axis=0)
    read = 0
    for block in np.flatnonzero(most >= ranking.bar).tolist():
        if most[block] < ranking.bar:  # it has risen since
            continue
        read += 1
        base = block * p.block
        here = sorted(((int(largest[block]), docs[starts[block] : starts[block + 1]] - base, scores[starts[block] : starts[block + 1]]) for docs, scores, starts, largest in streams if largest[block]), key=lambda x: x[0])
        rest = 0  # what lists that aren't needed to reach the bar can add
        optional = 0
        while optional < len(here) and rest + here[optional][0] < ranking.bar:
            rest += here[optional][0]
            optional += 1
        sums = np.zeros(p.block, np.int64)
        for _, docs, scores in here[optional:]:
            sums[docs] += scores
        found = np.flatnonzero((sums > 0) & (sums + rest >= ranking.bar))
        for largest, docs, scores in reversed(here[:optional]):
            at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            hit = docs[at] == found
            sums[found[hit]] += scores[at[hit]]
            rest -= largest
            found = found[sums[found] + rest >= ranking.bar]
            if not len(found):
                break
        if len(found):
            ranking.add(sums[found], ids[base + found], none[base + found])
    return read


def _result_batches(batches, shared, p: SearchParams):
    import pyarrow as pa

    queries, weights, n, total = shared.value
    rankings = {item: Ranking(p.k) for item, _ in queries}
    for b in batches:
        for at in range(b.num_rows):
            row = {name: b.column(i)[at].values for i, name in enumerate(b.schema.names)}
            none = row["ids"].is_null().to_numpy(zero_copy_only=False)
            ids = row["ids"].fill_null(0).to_numpy()
            shard = Shard({k: ids if k == "ids" else v.to_numpy() for k, v in row.items()}, weights, n, total, p)
            for item, terms in queries:
                search_shard(shard, terms, ids, none, rankings[item])
    items = [item for item, r in rankings.items() for _ in r.ids]
    ids = [None if gone else i for r in rankings.values() for i, gone in zip(r.ids.tolist(), r.none.tolist(), strict=True)]
    scores = [s for r in rankings.values() for s in r.scores.tolist()]
    yield pa.record_batch([pa.array(items, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["item_id", "doc_id", "score"])


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item: first in 64 parts of each item, then of what these leave."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    parts = found.withColumn("part", F.spark_partition_id() % 64)
    some = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, params: SearchParams = SearchParams(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents with the highest scores above 0 for each item.

    A term's weight is floor(1000 ln((2N+2) / (2df+1))), its contribution the weight
    times (10^9 tf) div (1000 tf + 8 m), m the document's norm of length. N, lengths and df
    are counted over all documents, also those without an id; the latter rank last among equal
    scores. Each row is a document of its own, also if it repeats an id. Rows that
    repeat an item_id are one item with all their terms, rows without one are not
    searched; null, empty and wordless items find nothing, such documents aren't found.
    Very long texts are read in runs. Empty tables give an empty result. Other columns
    are not read.

    Queries are searched in blocks of about ``block_terms`` terms, whose vocabulary and
    rankings are what is broadcast and kept; each block reads the documents once.
    """
    p, spark = params, docs.sparkSession
    pairs = materialize(query_terms(items, item_col, item_text_col), "query-terms")
    blocks = -(-pairs.count() // p.block_terms)
    out = None
    for block in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toPandas()
        vocabulary = sorted(map(bytes, set(own["term"])))
        place = {w: i for i, w in enumerate(vocabulary)}
        terms = own["term"].map(lambda w: place[bytes(w)])
        queries = [(int(item), np.sort(t.to_numpy(np.int32))) for item, t in terms.groupby(own["item_id"])]
        index = materialize(index_documents(docs, vocabulary, p, id_col, text_col), "index")
        n, total = index.select(F.explode("lengths").alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        shared = spark.sparkContext.broadcast((queries, term_weights(index, n, len(vocabulary)), n, total))
        found = _best(materialize(index.mapInArrow(lambda it, s=shared: _result_batches(it, s, p), "item_id long, doc_id long, score long"), "found"), p.k)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
