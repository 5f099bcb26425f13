"""Language-model scores from a weighted backoff automaton.

Words and word sequences up to ``order`` that occur ``least_count`` times in
training documents become states, each with arcs to the words seen after it
(discounted) and a failure arc to its longest suffix whose weight hands the
discounted mass down; at the root stand add-0.1 unigrams of the whole vocabulary.
At each word of a text the state fails until it has an arc, and log-probabilities
add up.

The automaton grows with the corpus and is nowhere whole. Documents are gathered
into blocks with a dictionary of their own. A block deals the distinct words and
sequences it holds to buckets, which are ranges of their hashes, sorted and
written as differences; the bucket adds up the counts and tells each block the
totals of its own, and one of the blocks that hold an arc to answer for it. The
blocks then walk their texts: they sum the arcs they answer for by context and note
where a state failed. Buckets add up these sums to the weights of the failure arcs
and send each block those that it met, which completes its scores.

A block sends a bucket one row if it has anything for it, so there are never more
rows than distinct sequences of blocks. No task sees more than a block or a bucket,
whose number follows the size of the input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlake.llm.common import drop_old_shuffles, materialize, mix, pieces, release, texts_of, word_hashes
from fleetlake.storage import bounded_batches

END = b"\0end"  # not a word: words hold what isn't white space, and none has this hash by design
START = np.uint64(0x5E0F7C3A91D24B86)  # stands before each text in the hashes of sequences


@dataclass(frozen=True)
class LmParams:
    order: int = 3
    least_count: int = 2  # occurrences that make a word a state and a sequence an arc
    discount: float = 0.75
    block_tokens: int = 1_500_000
    bucket_keys: int = 4_000_000  # words and sequences that blocks deal to one bucket, about


def _end_hash() -> int:
    return int(word_hashes([END])[0] ^ np.uint64(0x5BF03635))


def _pack(a: np.ndarray) -> bytes:
    """Compressed, the first bytes of all numbers together, then the second ones and so on."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).data if len(a) else b"")


def _open(data: bytes, kind) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences: their low bytes are random and stay as they are, the others are compressed."""
    import zstandard

    if not len(keys):
        return b""
    planes = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    low = max(0, int(keys[-1] - keys[0]) // len(keys)).bit_length() // 8
    return bytes([low]) + len(keys).to_bytes(8, "little") + np.ascontiguousarray(planes[:low]).tobytes() + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[low:]).tobytes())


def _open_keys(data: bytes) -> np.ndarray:
    import zstandard

    if not data:
        return np.empty(0, np.uint64)
    low, n = data[0], int.from_bytes(data[1:9], "little")
    cut = 9 + low * n
    planes = np.concatenate([np.frombuffer(data[9:cut], np.uint8), np.frombuffer(zstandard.ZstdDecompressor().decompress(data[cut:]), np.uint8)])
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)


def _blocks(batches, p: LmParams):
    """Rows of (block, doc_ids, train, lengths, train_tokens, train_docs, words, tokens); ``words`` is a dictionary of hashes."""
    import pyarrow as pa
    from pyspark import TaskContext

    part, serial, size = TaskContext.get().partitionId(), 0, 0
    docs: list = []
    end = np.array([_end_hash()], np.uint64)

    def block():
        lengths = np.array([len(h) for *_, h in docs])
        train = np.array([t for _, t, _ in docs], bool)
        words, local = np.unique(np.concatenate([h for *_, h in docs]), return_inverse=True)
        # Frequent words first: this takes a third of the bytes.
        often = np.argsort(-np.bincount(local, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.int32)
        rank[often] = np.arange(len(words), dtype=np.int32)
        cells = [part << 20 | serial, [d for d, *_ in docs], train.tolist(), lengths.tolist(), int(lengths[train].sum()), int(train.sum()), words[often].tobytes(), _pack(rank[local])]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.record_batch([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=["block", "doc_ids", "train", "lengths", "train_tokens", "train_docs", "words", "tokens"])

    for b in pieces(batches):
        for d, text, train in zip(b.column(0).to_pylist(), texts_of(b.column(1)), b.column(2).to_pylist(), strict=True):
            h = np.concatenate([word_hashes(text.lower().split()), end])
            if docs and size + len(h) > p.block_tokens:
                yield block()
                docs, size, serial = [], 0, serial + 1
            docs.append((d, train, h))
            size += len(h)
    if docs:
        yield block()


BLOCKS = "block long, doc_ids array<long>, train array<boolean>, lengths array<long>, train_tokens long, train_docs long, words binary, tokens binary"


def _one_by_one(batches):
    """The rows of the batches as dicts, of which one is held at a time."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


@dataclass
class Level:
    """The distinct sequences of one length in a block: hashes, and the one that ends at each place (or -1)."""

    hashes: np.ndarray
    place: np.ndarray
    context: np.ndarray | None = None  # of each sequence: the sequence without its last word
    suffix: np.ndarray | None = None  # and without its first


class Block:
    """A block's texts, each behind its start, and the sequences they hold."""

    def __init__(self, row: dict, order: int):
        words, local = np.frombuffer(row["words"], np.uint64), _open(row["tokens"], np.int32)
        self.lengths, train = np.array(row["lengths"], np.int64), np.array(row["train"], bool)
        ends = np.cumsum(self.lengths)
        self.first = ends - self.lengths + np.arange(len(ends))  # places of the starts
        self.w = np.insert(local + 1, ends - self.lengths, 0)
        self.train = np.repeat(train, self.lengths + 1)
        hashes = np.concatenate([[START], words])
        self.levels = [Level(mix(hashes), self.w)]
        for _ in range(order - 1):
            low = self.levels[-1]
            before = np.concatenate([np.array([-1], np.int32), low.place[:-1]])
            at = np.flatnonzero((before >= 0) & (self.w > 0))
            codes = before[at].astype(np.int64) * len(hashes) + self.w[at]
            by_code = np.argsort(codes).astype(np.int32)
            codes, at = codes[by_code], at.astype(np.int32)[by_code]
            del before, by_code
            new = np.append(True, codes[1:] != codes[:-1])[: len(codes)]
            codes, suffix = codes[new], low.place[at[new]]
            place = np.full(len(self.w), -1, np.int32)
            place[at] = np.cumsum(new, dtype=np.int32) - 1
            del at, new
            context, word = (codes // len(hashes)).astype(np.int32), (codes % len(hashes)).astype(np.int32)
            del codes
            self.levels.append(Level(mix(low.hashes[context] * np.uint64(0x9E3779B97F4A7C15) + hashes[word]), place, context, suffix))

    def counts(self, n: int) -> np.ndarray:
        """Of the sequences of level ``n``: occurrences in the block's training texts."""
        level = self.levels[n]
        at = (level.place >= 0) & self.train
        return np.bincount(level.place[at], minlength=len(level.hashes)).astype(np.uint32)


def _keys(levels: list[Level]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all sequences of the levels in rising order, and that order. Without sequences both are empty."""
    keys = np.concatenate([x.hashes for x in levels]) if levels else np.empty(0, np.uint64)
    order = np.argsort(keys).astype(np.int32)
    return keys[order], order


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each of the rising keys; it never falls."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _runs(parts: list[np.ndarray], buckets: int):
    """(bucket, slices): where each bucket's keys stand in the sorted ``parts``; only buckets that get any."""
    owners = [_cuts(k, buckets) for k in parts]
    full = np.unique(np.concatenate(owners))
    low, high = ([np.searchsorted(o, full, side=s) for o in owners] for s in ("left", "right"))
    for i, bucket in enumerate(full.tolist()):
        yield bucket, [slice(int(a[i]), int(z[i])) for a, z in zip(low, high, strict=True)]


def _counted(row: dict, order: int):
    """Of a block's words and of its sequences: rising keys and their counts. The block itself isn't kept."""
    block = Block(row, order)
    ones = block.counts(0)
    ones[0] = 0  # a start isn't a word
    counts = np.concatenate([np.empty(0, np.uint32), *(block.counts(n) for n in range(1, order))])
    for level in block.levels:
        level.place = level.context = level.suffix = None
    (wk, wo), (sk, so) = _keys(block.levels[:1]), _keys(block.levels[1:])
    return wk, ones[wo], sk, counts[so]


def _deal_counts(batches, order: int, buckets: int, most_bytes: int = 1 << 20):
    """Rows of (bucket, block, words, word_counts, keys, counts), in batches of about ``most_bytes``."""
    import pyarrow as pa

    def batch(rows):
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 2 + [pa.binary()] * 4, strict=True)], names=["bucket", "block", "words", "word_counts", "keys", "counts"])

    for row in _one_by_one(batches):
        name, rows, size = row["block"], [], 0
        wk, wv, sk, sv = _counted(row, order)
        del row
        for i, (w, s) in _runs([wk, sk], buckets):
            rows.append((i, name, _pack_keys(wk[w]), _pack(wv[w]), _pack_keys(sk[s]), _pack(sv[s])))
            size += sum(map(len, rows[-1][2:]))
            if size >= most_bytes:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)
        del wk, wv, sk, sv, rows


COUNTS = "bucket long, block long, words binary, word_counts binary, keys binary, counts binary"
TOTALS = "bucket long, block long, n_seen long, word_totals binary, totals binary"


def _same(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different key, and the number of its key at each place."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.append(True, s[1:] != s[:-1])[: len(s)]
    inverse = np.empty(len(s), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def _split(a: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    return np.split(a, np.cumsum(lengths)[:-1])


def _add_counts(table, least: int):
    """Adds up a bucket and tells each block the totals of its words, and of its sequences 0 or twice the total, and 1 more in one block."""
    import pyarrow as pa

    table = table.sort_by("block")

    def summed(keys: str, counts: str):
        keys = [_open_keys(x) for x in table[keys].to_pylist()]
        values = np.concatenate([_open(x, np.uint32) for x in table[counts].to_pylist()])
        first, inverse = _same(np.concatenate(keys))
        return np.bincount(inverse, weights=values, minlength=len(first)).astype(np.int64), first, inverse, [len(k) for k in keys]

    total, _, inverse, sizes = summed("words", "word_counts")
    seen, words = int((total > 0).sum()), _split(total[inverse], sizes)
    total, first, inverse, sizes = summed("keys", "counts")
    told = np.where(total >= least, total * 2, 0)[inverse]
    told[first] += told[first] > 0
    n = table.num_rows
    return pa.table({"bucket": table["bucket"], "block": table["block"], "n_seen": pa.array([seen] + [0] * (n - 1), pa.int64()), "word_totals": pa.array([_pack(x) for x in words], pa.binary()), "totals": pa.array([_pack(x) for x in _split(told, sizes)], pa.binary())})


def _answers(levels: list[Level], told, column: str) -> np.ndarray:
    """What the buckets told of each sequence of the levels."""
    order = _keys(levels)[1]
    out = np.empty(len(order), np.int64)
    out[order] = _joined(told, column, np.int64)
    return out


def _joined(table, column: str, kind) -> np.ndarray:
    """What the buckets told a block, in the order of its keys. ``table`` is sorted by bucket."""
    return np.concatenate([np.empty(0, kind), *(_open(x, kind) for x in table[column].to_pylist())])


WALKED = "bucket long, block long, words binary, word_sums binary, keys binary, sums binary, n_seen long, doc_ids array<long>, n_tokens array<long>, n_known array<long>, base array<double>, score array<double>, n_root array<long>, failures array<struct<n:array<long>,at:binary>>"
#: Sums of a context: its count, its arcs, their counts, their lower probabilities (of words: counts), and whether its weight is asked for.
SUMS = np.dtype([("count", "<u4"), ("arcs", "<u4"), ("mass", "<u8"), ("below", "<f8"), ("asked", "u1")])


def _walk(row: dict, told, p: LmParams, starts: int, buckets: int):
    """One block's rows for the buckets of its contexts, and one row with its scores as far as they are known."""
    import pyarrow as pa

    told = told.sort_by("bucket")
    block, order = Block(row, p.order), p.order
    n_seen = int(sum(told["n_seen"].to_pylist()))
    total = _answers(block.levels[:1], told, "word_totals")
    total[0] = starts
    answers = _answers(block.levels[1:], told, "totals")
    del told
    if order > 1:
        block.levels[-1].hashes = None  # no contexts of anything
    counts, mine = [total], [np.zeros(len(total), bool)]
    for part in _split(answers, [len(x.context) for x in block.levels[1:]]) if order > 1 else []:
        counts.append(part >> 1)
        mine.append(part & 1 > 0)
    part = answers = None

    words = block.w > 0
    cost = np.zeros(len(block.w))
    open_ = words.copy()
    sums, asked = [], []
    for n in range(order - 1, 0, -1):
        level, low = block.levels[n], counts[n - 1]
        kept = (level.place >= 0) & (counts[n] > 0)[level.place] if len(level.context) else np.zeros(len(words), bool)
        hit = np.flatnonzero(open_ & kept)
        at = level.place[hit]
        cost[hit] = np.log10((counts[n][at] - p.discount) / low[level.context[at]]) if len(hit) else 0
        open_[hit] = False
        before = np.concatenate([np.array([-1], np.int32), block.levels[n - 1].place[:-1]])
        least = p.least_count if n == 1 else 1  # totals of sequences below the least count aren't told
        failed = np.flatnonzero(open_ & (before >= 0))
        failed = failed[(low[before[failed]] >= least) | ((before[failed] == 0) & (n == 1))].astype(np.int32)
        asked.append((failed, before[failed]))
        del kept, hit, at
        # Arcs that this block answers for, by context.
        arcs = np.flatnonzero(mine[n])
        context, suffix = level.context[arcs], level.suffix[arcs]
        s = np.zeros(len(low), SUMS)
        s["arcs"] = np.bincount(context, minlength=len(low))
        s["mass"] = np.bincount(context, weights=counts[n][arcs], minlength=len(low))
        s["count"] = np.where(s["arcs"] > 0, low, 0)
        lower = total[suffix] if n == 1 else (counts[n - 1][suffix] - p.discount) / counts[n - 2][block.levels[n - 1].context[suffix]]
        s["below"] = np.bincount(context, weights=lower, minlength=len(low))
        s["asked"][before[failed]] = 1
        sums.append(s)
        level.place = level.context = level.suffix = counts[n] = mine[n] = None  # shorter ones don't need it
        del arcs, context, suffix, lower, before
    sums.reverse()
    asked.reverse()
    base = np.log10(total + 0.1)[block.w]
    cost[open_] = base[open_]
    base[block.first] = 0

    def dealt(levels, parts):
        keys, at = _keys(levels)
        s = np.concatenate(parts)[at] if parts else np.empty(0, SUMS)
        used = (s["arcs"] > 0) | (s["asked"] > 0)
        rank = np.full(len(keys), -1, np.int64)
        wanted = s["asked"] > 0
        rank[at[wanted]] = np.arange(int(wanted.sum()))
        return keys[used], s[used], rank

    (wk, ws, wrank), (sk, ss, srank) = dealt(block.levels[: order > 1], sums[:1]), dealt(block.levels[1 : order - 1], sums[1:])
    del sums
    rows = [(i, row["block"], _pack_keys(wk[w]), _pack(ws[w]), _pack_keys(sk[s]), _pack(ss[s])) for i, (w, s) in _runs([wk, sk], buckets)] if len(wk) + len(sk) else []
    doc = np.repeat(np.arange(len(block.lengths)), block.lengths + 1)

    def failures(at, ranks):
        """Of each document the number of failures, and the weights they take, as numbers in the order of all asked for."""
        return {"n": np.bincount(doc[at], minlength=len(block.lengths)).tolist(), "at": _pack(ranks.astype(np.uint32))}

    more, shift = [], 0
    if order > 1:
        more.append(failures(asked[0][0], wrank[asked[0][1]]))
    for n in range(2, order):
        more.append(failures(asked[n - 1][0], srank[shift + asked[n - 1][1]]))
        shift += len(block.levels[n - 1].hashes)
    add = lambda x: np.add.reduceat(x, block.first)
    done = (None, row["block"], None, None, None, None, n_seen, row["doc_ids"], block.lengths.tolist(), add(((total[block.w] > 0) & words).astype(np.int64)).tolist(), add(base).tolist(), add(cost).tolist(), add(open_.astype(np.int64)).tolist(), more)
    rows = [(*r, *[None] * 8) for r in rows] + [done]
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.int64(), *[pa.list_(pa.int64())] * 3, *[pa.list_(pa.float64())] * 2, pa.list_(pa.int64()), pa.list_(pa.struct([("n", pa.list_(pa.int64())), ("at", pa.binary())]))]
    names = ["bucket", "block", "words", "word_sums", "keys", "sums", "n_seen", "doc_ids", "n_tokens", "n_known", "base", "score", "n_root", "failures"]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


WEIGHTS = "bucket long, block long, word_weights binary, weights binary"


def _weigh(table, discount: float, whole: float):
    """Adds up the sums of a bucket's contexts and sends each block the weights of those it asked for."""
    import pyarrow as pa

    def weights(keys: str, sums: str, of_words: bool) -> list[bytes]:
        keys = [_open_keys(x) for x in table[keys].to_pylist()]
        s = np.concatenate([_open(x, SUMS) for x in table[sums].to_pylist()])
        first, inverse = _same(np.concatenate(keys))
        add = lambda c: np.bincount(inverse, weights=s[c], minlength=len(first))
        arcs, count = add("arcs"), np.zeros(len(first))
        np.maximum.at(count, inverse, s["count"])
        left = 1 - (add("mass") - discount * arcs) / np.maximum(count, 1)
        below = add("below")
        below = (below + 0.1 * arcs) / whole if of_words else below
        log = np.log10(np.clip(left, 1e-9, 1) / np.clip(1 - below, 1e-9, None))[inverse].astype(np.float32)
        sizes = [len(k) for k in keys]
        return [_pack(x[a > 0]) for x, a in zip(_split(log, sizes), _split(s["asked"], sizes), strict=True)]

    return pa.table({"bucket": table["bucket"], "block": table["block"], "word_weights": pa.array(weights("words", "word_sums", True), pa.binary()), "weights": pa.array(weights("keys", "sums", False), pa.binary())})


def _finish(row: dict, weights, whole: float):
    import pyarrow as pa

    weights = weights.sort_by("bucket")
    tables = [_joined(weights, c, np.float32).astype(float) for c in ("word_weights", "weights")]
    tokens, root = (np.array(row[c], np.int64) for c in ("n_tokens", "n_root"))
    score = np.array(row["score"]) - root * np.log10(whole)
    for i, f in enumerate(row["failures"]):
        doc = np.repeat(np.arange(len(tokens)), np.array(f["n"], np.int64))
        score += np.bincount(doc, weights=tables[min(i, 1)][_open(f["at"], np.uint32)], minlength=len(tokens))
    return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "n_tokens": pa.array(tokens), "n_known": pa.array(row["n_known"], pa.int64()), "base_score": pa.array(np.array(row["base"]) - tokens * np.log10(whole)), "score": pa.array(score)})


def score_texts(docs: DataFrame, params: LmParams = LmParams(), id_col: str = "doc_id", text_col: str = "text", train_col: str = "train") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.

    ``train_col`` says which rows the model learns from (null: not). Tokens are the
    words, A-Z lower-cased, and one end; null text is empty and has its end only.
    Without training rows all words are unknown. Repeated rows each count and each
    get their score. An empty table gives an empty result; other columns aren't
    read.
    """
    p = params
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(train_col), F.lit(False)).alias("train"))
    blocks = materialize(rows.mapInArrow(lambda it: _blocks(it, p), BLOCKS), "blocks")
    size = blocks.agg(F.coalesce(F.sum("train_tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("train_docs"), F.lit(0)).alias("d"), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("all")).first()
    tokens, starts = int(size["n"]), int(size["d"])
    pairs = p.order * int(size["all"])
    buckets = max(1, -(-pairs // p.bucket_keys), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-4 * pairs // p.bucket_keys)))

    heavy = blocks.select("block", "doc_ids", "train", "lengths", "words", "tokens")
    dealt = heavy.mapInArrow(lambda it: _deal_counts(it, p.order, buckets), COUNTS)
    told = materialize(dealt.groupBy("bucket").applyInArrow(lambda t: _add_counts(t, p.least_count), TOTALS), "totals")
    drop_old_shuffles(spark)

    def walk(block, replies):
        return _walk(block.to_pylist()[0], replies, p, starts, buckets)

    walked = materialize(heavy.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(walk, WALKED), "walked")
    release(blocks, told)
    drop_old_shuffles(spark)
    vocabulary = int(walked.agg(F.coalesce(F.sum("n_seen"), F.lit(0))).first()[0])
    whole = tokens + 0.1 * (vocabulary + 1)

    sums = walked.where("bucket is not null").select("bucket", "block", "words", "word_sums", "keys", "sums")
    weights = sums.groupBy("bucket").applyInArrow(lambda t: _weigh(t, p.discount, whole), WEIGHTS)
    done = walked.where("bucket is null").select("block", "doc_ids", "n_tokens", "n_known", "base", "score", "n_root", "failures")
    out = done.groupBy("block").cogroup(weights.groupBy("block")).applyInArrow(lambda block, w: _finish(block.to_pylist()[0], w, whole), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
