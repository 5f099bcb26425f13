"""Best-fit packing of documents into fixed-length bins under conflicts.

A bin holds at most one document of a source and one of a cluster of copies. Bins
stand in the order of what is left in them and carry bitmaps of their sources and
clusters. A document, longest first, goes to the tightest bin that holds it and
has neither bit: the search takes the successor of its length among the residuals
and goes on to the next one while bins conflict. A new bin opens if none fits.

Documents are dealt by a hash of their key into shards of bounded size that are
packed independently, so a hot source or cluster spreads over all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlake.llm.common import materialize, pieces, texts_of


@dataclass(frozen=True)
class PackParams:
    capacity: int = 2048  # tokens of a bin; a token is a word, and one ends each document
    shard_rows: int = 8192  # pieces that one task packs


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each piece; ``sizes`` must not grow. A source or cluster of -1 never conflicts."""
    residual: list[int] = []
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    levels: list[dict[int, None]] = [{} for _ in range(capacity + 1)]
    open_at = np.zeros(capacity + 1, np.int32)
    taken: dict[tuple[str, int], np.ndarray] = {}  # by source or cluster: bins with its bit, at each residual
    members: list[list[tuple[str, int]]] = []
    count: dict[tuple[str, int], int] = {}
    for s, c in zip(sources, clusters, strict=True):
        for key in (("s", s), ("c", c)):
            count[key] = count.get(key, 0) + 1
    bins, offsets = [], []
    for size, s, c in zip(sizes, sources, clusters, strict=True):
        keys = [k for k in (("s", s), ("c", c)) if k[1] >= 0 and count[k] > 1]
        sbit, cbit = (1 << s if s >= 0 else 0), (1 << c if c >= 0 else 0)
        free = open_at[size:]
        for k in keys:
            if k in taken:
                free = np.minimum(free, open_at[size:] - taken[k][size:])
        chosen = -1
        for level in np.flatnonzero(free > 0):
            chosen = next((b for b in levels[size + level] if not source_bits[b] & sbit and not cluster_bits[b] & cbit), -1)
            if chosen >= 0:
                break
        if chosen < 0:
            chosen = len(residual)
            residual.append(capacity)
            source_bits.append(0)
            cluster_bits.append(0)
            members.append([])
        else:
            left = residual[chosen]
            del levels[left][chosen]
            open_at[left] -= 1
            for k in members[chosen]:
                taken[k][left] -= 1
        bins.append(chosen)
        offsets.append(capacity - residual[chosen])
        residual[chosen] -= size
        source_bits[chosen] |= sbit
        cluster_bits[chosen] |= cbit
        members[chosen] += keys
        left = residual[chosen]
        if left > 0:  # a full bin takes nothing more
            levels[left][chosen] = None
            open_at[left] += 1
            for k in members[chosen]:
                taken.setdefault(k, np.zeros(capacity + 1, np.int32))[left] += 1
    return bins, offsets


def _measure(batches, given: bool):
    import pyarrow as pa
    import xxhash

    for b in pieces(batches):
        n, cluster = [], []
        for t in texts_of(b.column(1)):
            words = t.lower().split()
            n.append(len(words) + 1)
            cluster.append(None if given else xxhash.xxh3_64_intdigest(b" ".join(words)) - 2**63)
        yield pa.record_batch([b.column(0), b.column(2), pa.array(n, pa.int64()), b.column(3) if given else pa.array(cluster, pa.int64())], names=["doc_id", "source", "n", "cluster"])


def _codes(column) -> list[int]:
    """Small numbers for values; -1 for null."""
    seen: dict = {}
    return [-1 if v is None else seen.setdefault(v, len(seen)) for v in column.to_pylist()]


def pack(docs: DataFrame, params: PackParams = PackParams(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None) -> DataFrame:
    """(doc_id, piece, n_tokens, bin_id, bin_start): every row of ``docs`` in bins.

    A document longer than a bin is cut into whole bins and a rest. Clusters are
    rows with the same ``cluster_col`` (a long, as ``component_id`` of the n-gram
    join; null: a cluster of its own), or without it texts with the same words, A-Z
    lower-cased. Null text is empty and takes its
    end token; a null source conflicts with none. Equally long pieces go by id and
    piece. Repeated rows are copies and go to different bins. An empty table gives
    an empty result; other columns aren't read.
    """
    import pyarrow as pa

    p = params
    given = F.col(cluster_col).cast("long") if cluster_col else F.lit(None).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"), given.alias("given"))
    lengths = rows.mapInArrow(lambda it: _measure(it, cluster_col is not None), "doc_id long, source string, n long, cluster long")
    # Equal rows are counted and numbered, so that they are dealt to all shards as others are.
    counted = lengths.groupBy("doc_id", "source", "n", "cluster").agg(F.count("*").alias("rows"))
    each = counted.select("doc_id", "source", "n", "cluster", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("copy"))
    whole = F.floor((F.col("n") - 1) / p.capacity)
    cut = each.select("doc_id", "source", "cluster", "copy", "n", F.explode(F.sequence(F.lit(0).cast("long"), whole)).alias("piece"))
    parts = materialize(cut.withColumn("n_tokens", F.least(F.col("n") - F.col("piece") * p.capacity, F.lit(p.capacity))).drop("n"), "pieces")
    shards = max(1, -(-parts.count() // p.shard_rows))
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster", "copy"), F.lit(shards)))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("cluster", "ascending"), ("copy", "ascending")])
        bins, starts = best_fit(table["n_tokens"].to_pylist(), _codes(table["source"]), _codes(table["cluster"]), p.capacity)
        shard = table["shard"][0].as_py()
        return pa.table({"doc_id": table["doc_id"], "piece": table["piece"], "n_tokens": table["n_tokens"], "bin_id": pa.array([shard << 32 | b for b in bins], pa.int64()), "bin_start": pa.array(starts, pa.int64())})

    return dealt.groupBy("shard").applyInArrow(fill, "doc_id long, piece long, n_tokens long, bin_id long, bin_start long")
