"""Benchmark decontamination by size-partitioned MinHash containment search.

Items (short test texts) and documents are sets of word shingles. Items are
partitioned by size in powers of two. The sketch of an item is the bottom of its
MinHash order, shingles of few items first, and is as long as its size partition
needs: if a document contains ``percent`` of an item's shingles, the missing ones
can't be all of the sketch. Documents are searched by sketch values only: one that
shares none is out, however long it is. Of the others, those shingles that stand in
any item are kept, and exact counts against the items they were led to decide.

An item of fewer than five words is one shingle of all its words. Items with equal
sets are searched as one.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlake.llm.common import materialize, mix, pieces, shingle_hashes, texts_of, word_hashes

#: A-Z to a-z and ASCII punctuation to spaces.
PLAIN = bytes.maketrans((string.ascii_uppercase + string.punctuation).encode(), (string.ascii_lowercase + " " * len(string.punctuation)).encode())


@dataclass(frozen=True)
class ContainmentParams:
    shingle: int = 5
    percent: int = 80
    common_above: int = 8  # items with a shingle beyond which it comes last in sketches
    broadcast_rows: int = 1_000_000  # item shingles (8 MB) that are searched at once; more are searched in blocks of items


def plain_words(text: bytes) -> np.ndarray:
    """Hashes of the words, case and ASCII punctuation aside."""
    return word_hashes(text.translate(PLAIN).split())


def plain_shingles(text: bytes, k: int) -> np.ndarray:
    """Hashes of the k-word shingles in order, case and ASCII punctuation aside."""
    return shingle_hashes(plain_words(text), k).view(np.int64)


def short_shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of shingles of fewer words than usual, which equal none of the usual ones."""
    return mix(shingle_hashes(h, size) + np.uint64(size)).view(np.int64)


class Members:
    """Membership in a sorted array of hashes; a bitmap of their first bits sifts first."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.sieve = np.zeros(1 << 18, bool)
        self.sieve[self.values.view(np.uint64) >> np.uint64(46)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of the hashes that are members."""
        near = np.flatnonzero(self.sieve[hashes.view(np.uint64) >> np.uint64(46)])
        at = np.searchsorted(self.values, hashes[near])
        return near[self.values[np.minimum(at, len(self.values) - 1)] == hashes[near]] if len(self.values) else near[:0]


def _item_batches(batches, k: int):
    import pyarrow as pa

    for b in pieces(batches):
        hashes = [plain_words(t) for t in texts_of(b.column(1))]
        sets = [np.unique(shingle_hashes(h, k).view(np.int64) if len(h) >= k else short_shingles(h, len(h)) if len(h) else np.empty(0, np.int64)) for h in hashes]
        yield pa.record_batch([b.column(0), pa.array([x.tolist() for x in sets], pa.list_(pa.int64())), pa.array([min(len(h), k) for h in hashes], pa.int32())], names=["item_id", "s", "words"])


def _doc_shingles(text: bytes, k: int, short: list[int]) -> np.ndarray:
    h = plain_words(text)
    return np.concatenate([shingle_hashes(h, k).view(np.int64), *(short_shingles(h, n) for n in short if len(h) >= n)])


def _hit_batches(batches, k: int, short: list[int], tables):
    """(doc_id, thash, sk, s) of texts with sketch values: those, and all their shingles that stand in items.

    ``tables``: members of sketches and of all items.
    """
    import pyarrow as pa
    import xxhash

    sketch, known = tables.value
    for b in pieces(batches):
        ids, hashes, led, found = [], [], [], []
        for d, t in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
            s = _doc_shingles(t, k, short)
            hit = s[sketch.find(s)]
            if len(hit):
                ids.append(d)
                hashes.append(xxhash.xxh3_64_intdigest(t) - 2**63)
                led.append(np.unique(hit))
                found.append(np.unique(s[known.find(s)]))
        lists = []
        for x in (led, found):
            flat = np.concatenate(x) if x else np.empty(0, np.int64)
            lists.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]).astype(np.int32)), pa.array(flat)))
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), *lists], names=["doc_id", "thash", "sk", "s"])


def contained_items(docs: DataFrame, items: DataFrame, params: ContainmentParams = ContainmentParams(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared): items found in documents.

    ``n_shingles`` is the item's number of different shingles, ``n_shared`` those
    in the document. Items without words are never found, nor is anything in null,
    empty or blank texts. Rows that repeat an id are one document: the text that
    shares most counts. Rows that repeat an item id are one item for each different
    text. Empty tables give an empty result; very long texts are searched whole; other columns are not read.
    """
    p, k = params, params.shingle
    spark = docs.sparkSession
    rows = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null and text is not null").distinct()
    owned = rows.mapInArrow(lambda it: _item_batches(it, k), "item_id long, s array<long>, words int").withColumn("n", F.size("s")).where("n > 0").withColumn("v", F.xxhash64("s"))
    owned = materialize(owned, "item_sets")
    sets = owned.groupBy("v").agg(F.first("s").alias("s"), F.first("n").alias("n"))
    tokens = sets.select("v", "n", F.explode("s").alias("t"))
    common = tokens.groupBy("t").agg(F.count("*").alias("df"))
    upper = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1  # of the size partition
    keep = upper - F.ceil(p.percent * upper / 100) + 1
    order = Window.partitionBy("v").orderBy((F.col("df") > p.common_above).cast("int"), "t")
    ranked = tokens.join(common, "t").withColumn("i", F.row_number().over(order))
    index = materialize(ranked.select("t", "v", (F.col("i") <= keep).alias("sketch")), "item_index")
    short = sorted(r[0] for r in owned.where(F.col("words") < k).select("words").distinct().collect())  # k - 1 numbers at most
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    # Blocks of items, by hash, of about as many shingles as are broadcast; each block reads the documents once.
    size = index.count()
    blocks = 1 if size <= p.broadcast_rows else min(sets.count(), -(-size // max(1, p.broadcast_rows)))
    counts = None
    for block in range(blocks):
        mine = index.where(F.pmod("v", F.lit(blocks)) == block) if blocks > 1 else index
        local = mine.select("t", "sketch").toPandas()
        tables = Members(local["t"][local["sketch"].astype(bool)].to_numpy(np.int64)), Members(local["t"].to_numpy(np.int64))
        shared = spark.sparkContext.broadcast(tables)
        hits = texts.mapInArrow(lambda it, shared=shared: _hit_batches(it, k, short, shared), "doc_id long, thash long, sk array<long>, s array<long>")
        hits = materialize(hits.dropDuplicates(["doc_id", "thash"]), "sketch_hits")
        pairs = hits.select("doc_id", "thash", F.explode("sk").alias("t")).join(mine.where("sketch").select("t", "v"), "t").select("doc_id", "thash", "v").distinct()
        both = pairs.join(hits.select(F.col("doc_id").alias("d"), F.col("thash").alias("h"), F.col("s").alias("ds")), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("thash") == F.col("h"))).join(sets, "v")
        found = both.select("doc_id", "v", "n", F.size(F.array_intersect("ds", "s")).alias("n_shared"))
        counts = found if counts is None else counts.unionByName(found)
    good = counts.where(100 * F.col("n_shared") >= p.percent * F.col("n")).join(owned.select("item_id", "v"), "v")
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_shared") / F.col("n"), "n", "n_shared")).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.n").cast("long").alias("n_shingles"), F.col("m.n_shared").cast("long").alias("n_shared"))
