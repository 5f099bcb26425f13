"""Byte-pair encoding under a given vocabulary."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlake.functions.tokens import PIECES
from fleetlake.storage import bounded_batches

# Bytes that stand for themselves in token strings (all others follow from 256 on), and types of tokens that have no text.
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
CONTROL, UNUSED = 3, 5

_OTHERS = sorted(set(range(256)) - set(PLAIN))
SYMBOLS = {**{b: chr(b) for b in PLAIN}, **{b: chr(256 + i) for i, b in enumerate(_OTHERS)}}
BYTES = {c: b for b, c in SYMBOLS.items()}

#: Pieces whose ids a worker remembers; others are encoded anew. Longer pieces aren't remembered.
CACHE_PIECES, CACHE_CHARS = 200_000, 64
#: Pieces, or ids, of a batch that are looked up at a time.
PIECES_AT_ONCE = 1 << 18
#: Symbols up to which pairs are found by scans.
FEW = 48


@dataclass(frozen=True)
class Vocabulary:
    """Token strings by id, their types by id (1: normal), and pairs in order of rank. Its size is the tokenizer's, whatever the data."""

    tokens: dict[int, str]
    types: dict[int, int]
    merges: list[tuple[str, str]]


def read_vocabulary(path: str) -> Vocabulary:
    """From a JSON file of the kind that keeps ``vocab`` and ``merges`` under ``model``."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in whole["model"]["merges"]]
    special = {t["id"]: t["content"] for t in whole.get("added_tokens", []) if t.get("special")}
    tokens = {i: t for t, i in whole["model"]["vocab"].items()} | special
    return Vocabulary(tokens, dict.fromkeys(special, CONTROL), merges)


def _merge_few(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """``merge_pairs`` by scans over the ranks of all pairs, which is faster for few symbols."""
    parts, none = list(symbols), 1 << 62
    at = [ranks.get(p, none) for p in zip(parts, parts[1:])]
    while at and (best := min(at)) < none:
        i = at.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del at[i]
        if i:
            at[i - 1] = ranks.get((parts[i - 1], parts[i]), none)
        if i < len(at):
            at[i] = ranks.get((parts[i], parts[i + 1]), none)
    return parts


def merge_pairs(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merges the adjacent pair of lowest rank, the leftmost of equals, until no pair has a rank.

    Few symbols are scanned, many wait in a heap, so that a long piece doesn't take quadratic time.
    """
    if len(symbols) <= FEW:
        return _merge_few(symbols, ranks)
    parts: list[str | None] = list(symbols)
    end = len(parts)
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))
    heap = [(r, i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get(p)) is not None]
    heapify(heap)
    while heap:
        _, i, pair = heappop(heap)
        j = after[i]
        if j == end or (parts[i], parts[j]) != pair:
            continue  # one side has been merged since
        parts[i], parts[j], after[i] = pair[0] + pair[1], None, after[j]
        if after[i] < end:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < end and (r := ranks.get(new := (parts[k], parts[after[k]]))) is not None:
                heappush(heap, (r, k, new))
    return [p for p in parts if p is not None]


class _Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.ranks = {p: r for r, p in reversed(list(enumerate(vocabulary.merges)))}
        self.ids = {t: i for i, t in vocabulary.tokens.items()}
        self.seen: dict[str, list[int] | None] = {}

    def piece(self, piece: str) -> list[int] | None:
        found = self.seen.get(piece, False)
        if found is False:
            symbols = [SYMBOLS[b] for b in piece.encode()]
            found = [self.ids.get(p) for p in merge_pairs(symbols, self.ranks)]
            found = None if None in found else found
            if len(self.seen) < CACHE_PIECES and len(piece) <= CACHE_CHARS:
                self.seen[piece] = found
        return found

    def batch(self, texts: pa.Array) -> pa.Array:
        """Ids of a batch of lists of pieces: each different piece is encoded once, the ids of a text are gathered from them."""
        coded = texts.flatten().dictionary_encode()
        known = [self.piece(p) for p in coded.dictionary.to_pylist()]
        sizes = np.array([0 if ids is None else len(ids) for ids in known], dtype=np.int64)
        whole = np.fromiter((i for ids in known if ids is not None for i in ids), dtype=np.int32, count=int(sizes.sum()))
        used = coded.indices.to_numpy(zero_copy_only=False)
        took = sizes[used]
        after = np.concatenate([[0], np.cumsum(took)])
        # Place k of the output lies behind the start of its piece's ids by as much as it lies behind the start of the piece's output.
        shift = (np.cumsum(sizes) - sizes)[used] - after[:-1]
        ids = whole[np.repeat(shift, took) + np.arange(after[-1])]
        lengths = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        strange = np.concatenate([[0], np.cumsum(np.array([ids is None for ids in known], dtype=np.int64)[used])])
        null = texts.is_null().to_numpy(zero_copy_only=False) | (strange[ends[1:]] > strange[ends[:-1]])
        # A text that has null ids may have some all the same; they are left out with it.
        keep = np.repeat(~null, after[ends[1:]] - after[ends[:-1]])
        n = np.where(null, 0, after[ends[1:]] - after[ends[:-1]])
        offsets = np.concatenate([[0], np.cumsum(n)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids[keep], pa.int32()), mask=pa.array(null))


def _slices(lists: pa.Array, at_once: int) -> list[pa.Array]:
    """A batch of lists, cut into runs of about ``at_once`` values."""
    before = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    cuts = [0, *(np.flatnonzero(np.diff(before // at_once)) + 1).tolist(), len(lists)]
    return [lists.slice(i, j - i) for i, j in zip(cuts, cuts[1:])]


def encode_slices(encoder: _Encoder, texts: pa.Array, at_once: int = PIECES_AT_ONCE) -> pa.Array:
    """Ids of a batch, whose texts are taken together up to about ``at_once`` pieces."""
    return pa.concat_arrays([encoder.batch(t) for t in _slices(texts, at_once)])


class _Decoder:
    """The bytes of all tokens in one array; ids without text have none."""

    def __init__(self, v: Vocabulary):
        spelled = {i: bytes(BYTES[c] for c in t) for i, t in v.tokens.items() if v.types.get(i) not in (CONTROL, UNUSED)}
        self.sizes = np.zeros(max(spelled, default=-1) + 2, np.int64)  # the last one stands for unknown ids
        for i, b in spelled.items():
            self.sizes[i] = len(b)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.spelled = np.frombuffer(b"".join(spelled[i] for i in sorted(spelled)), np.uint8)

    def batch(self, lists: pa.Array) -> pa.Array:
        ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
        ids = np.where((ids >= 0) & (ids < len(self.sizes)), ids, len(self.sizes) - 1)
        took = self.sizes[ids]
        after = np.concatenate([[0], np.cumsum(took)])
        data = self.spelled[np.repeat(self.starts[ids] - after[:-1], took) + np.arange(after[-1])].tobytes()
        ends = after[np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])].tolist()
        null = lists.is_null().to_pylist()
        return pa.array([None if gone else data[a:z].decode("utf-8", "replace") for gone, a, z in zip(null, ends, ends[1:])], pa.string())


def bpe_encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """Adds ``ids`` in place of ``text``.

    Words repeat, so a batch encodes each of its different pieces once and each task
    remembers the ids of its pieces; nothing is shuffled. Null text has null ids, empty text none. A text with a piece outside
    the vocabulary has null ids and ``unknown`` is true.
    """
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _Encoder(shared.value)
        for b in batches:
            yield encode_slices(encoder, b)

    rest = [c for c in df.columns if c != text]
    out = df.select(*rest, F.col(text).isNull().alias("_empty"), encode(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))).alias("ids"))
    return out.select(*rest, "ids", (~F.col("_empty") & F.col("ids").isNull()).alias("unknown"))


def bpe_decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """``text`` in place of ``ids``; control, unused and unknown tokens are empty, broken UTF-8 is replaced, null stays null."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = _Decoder(shared.value)
        for b in batches:
            yield pa.concat_arrays([decoder.batch(x) for x in _slices(b, PIECES_AT_ONCE)])

    return df.select(*[c for c in df.columns if c != ids], decode(F.col(ids)).alias("text"))
