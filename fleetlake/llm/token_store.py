"""Token ids in wavelet matrices, one compressed file a shard.

Documents are encoded in the order of their ids, in shards of bounded size. A
shard's ids become a wavelet matrix: one bit-plane a binary digit, each ordered by
the digits before it, with rank counts beside the bits. The compressed bytes of a
matrix give single tokens, counts of an id up to a position and the places where
it occurs, without the ids being unpacked. Shards are rows of Parquet files that
Spark writes and commits, one row a file part, so lost tasks are simply rerun.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlake.llm.common import materialize, texts_of

MAGIC = b"FLWM"
BLOCK = 512  # bits between rank counts
#: Encoded words that a worker remembers, under 200 bytes each; others are encoded again for each run of texts.
CACHE_WORDS = 1_000_000


@dataclass(frozen=True)
class StoreParams:
    end_id: int = 2
    shard_tokens: int = 4_000_000
    tokenizer: str | None = None  # path of any tokenizers file; None: word_bpe_49k.json of the public tokenizers


class WaveletMatrix:
    """A sequence of small non-negative integers as bit-planes with rank and select."""

    def __init__(self, n: int, planes: list[np.ndarray]):
        self.n, self.planes = n, planes  # planes: packed bits, the highest digit first
        self.ranks, self.zeros = [], []
        for bits in planes:
            ones = np.bitwise_count(bits).astype(np.int64)
            ones = np.add.reduceat(ones, np.arange(0, len(ones), BLOCK // 8)) if len(ones) else ones
            self.ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype(np.int64))
            self.zeros.append(n - int(self.ranks[-1][-1]))

    @staticmethod
    def build(values: np.ndarray) -> WaveletMatrix:
        values = values.astype(np.uint32) if len(values) and values.max() > 65535 else values.astype(np.uint16)
        planes = []
        for digit in reversed(range(int(values.max()).bit_length() if len(values) else 0)):
            bits = (values >> digit & 1).astype(bool)
            planes.append(np.packbits(bits, bitorder="little"))
            values = np.concatenate([values[~bits], values[bits]])
        return WaveletMatrix(len(values), planes)

    def to_bytes(self) -> bytes:
        import zstandard

        body = b"".join(p.tobytes() for p in self.planes)
        return MAGIC + struct.pack("<QI", self.n, len(self.planes)) + zstandard.ZstdCompressor(level=1).compress(body)

    @staticmethod
    def from_bytes(data: bytes) -> WaveletMatrix:
        import zstandard

        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        n, digits = struct.unpack_from("<QI", data, 4)
        size = (n + 7) // 8
        body = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[16:], max_output_size=max(1, size * digits)), np.uint8)
        return WaveletMatrix(n, [body[i * size : (i + 1) * size] for i in range(digits)])

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, bits = i // BLOCK, self.planes[level]
        start = block * (BLOCK // 8)
        whole, rest = bits[start : i // 8], i % 8
        last = int(bits[i // 8]) & ((1 << rest) - 1) if rest else 0
        return int(self.ranks[level][block]) + int(np.bitwise_count(whole).sum()) + last.bit_count()

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, bits in enumerate(self.planes):
            bit = int(bits[i // 8]) >> (i % 8) & 1
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where, after the last plane, stand the occurrences of ``value`` among the first i."""
        if value < 0 or value >> len(self.planes):
            return 0, 0
        start, end = 0, i
        for level in range(len(self.planes)):
            a, b = self._rank1(level, start), self._rank1(level, end)
            start, end = (self.zeros[level] + a, self.zeros[level] + b) if value >> (len(self.planes) - 1 - level) & 1 else (start - a, end - b)
        return start, end

    def rank(self, value: int, i: int) -> int:
        """Occurrences of ``value`` among the first i."""
        start, end = self._range(value, min(i, self.n))
        return end - start

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) ``bit`` of a plane."""
        r = self.ranks[level]
        before = r if bit else np.minimum(np.arange(len(r)) * BLOCK, self.n) - r
        block = int(np.searchsorted(before, k, side="right")) - 1
        piece = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(piece == bit)[k - int(before[block])])

    def select(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of ``value``."""
        start, end = self._range(value, self.n)
        if not 0 <= k < end - start:
            raise IndexError(k)
        i = start + k
        for level in reversed(range(len(self.planes))):
            bit = value >> (len(self.planes) - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def locate(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.rank(value, self.n))]

    def values(self) -> np.ndarray:
        """All values, by undoing the planes' orders from the last to the first."""
        out = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        one = out.dtype.type(1)
        for level in reversed(range(len(self.planes))):
            bits = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            digit = one << out.dtype.type(len(self.planes) - 1 - level)
            up = np.empty_like(out)
            up[~bits] = out[: self.zeros[level]]
            up[bits] = out[self.zeros[level] :] | digit
            out = up
        return out


_ENCODERS: dict = {}


# What a tokenizer file must say for its words to be encoded on their own.
WORDWISE_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORDWISE_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
#: Lower-case letters that are one byte-level piece as they stand: no normalisation changes them.
_LETTERS = re.compile("[a-zß-öø-ÿ]+")


def is_wordwise(spec: dict) -> bool:
    """Whether no normalisation, piece or token of this tokenizer reaches over a space, and letter case doesn't count."""
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    parts = cut.get("pretokenizers") or [None, {}]
    return (
        (spec.get("normalizer") or {}).get("normalizers") == WORDWISE_NORMALIZER
        and len(parts) == 2 and parts[0] == WORDWISE_SPLIT and parts[1].get("type") == "ByteLevel"
        and not parts[1].get("add_prefix_space") and not parts[1].get("use_regex", True)
        and model["type"] == "BPE" and not model.get("dropout") and not spec.get("truncation")
    )


def _byte_letters() -> dict[int, str]:
    """The character that byte-level pieces show for each byte: itself if it prints, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Ids of texts as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    If the tokenizer's file says that nothing reaches over a space or line end
    (``is_wordwise``), words between them are encoded once and remembered; words of
    plain letters go straight to the tokenizer's model. Texts that spell an added
    token (as ``<|endoftext|>``), and all texts of other tokenizers, are encoded whole.
    """

    def __init__(self, path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.plain = Tokenizer.from_file(str(path))
        self.wordwise = is_wordwise(json.loads(self.plain.to_str()))
        self.words = Tokenizer.from_file(str(path))  # only sees texts in which no added token is spelled
        self.words.encode_special_tokens = True
        self.model = self.words.model
        contents = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        # Whether letter case counts is the library's to say; here any case sends a text to it.
        self.added = re.compile("|".join(map(re.escape, contents)).encode(), re.IGNORECASE) if contents else None
        self.kind = np.uint16 if self.plain.get_vocab_size() <= 65536 else np.uint32
        self.known: dict[bytes, bytes] = {b"": b""}
        self.letters = _byte_letters()

    def _encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Codes of new words: letters by the model, the others as one text, whose offsets tell which word a token is of."""
        codes, rest = {}, []
        for w in words:
            text = w.decode()
            if _LETTERS.fullmatch(text):
                piece = text if len(text) == len(w) else w.decode("latin-1").translate(self.letters)
                codes[w] = np.array([t.id for t in self.model.tokenize(piece)], self.kind).tobytes()
            else:
                rest.append((w, text))
        if rest:
            starts = np.cumsum([0, *(len(t) + 1 for _, t in rest)])
            e = self.words.encode(" ".join(t for _, t in rest), add_special_tokens=False)
            ids, at = np.array(e.ids, self.kind), np.array([a for a, _ in e.offsets], np.int64)
            cuts = np.searchsorted(at, starts).tolist()
            codes |= {w: ids[cuts[i] : cuts[i + 1]].tobytes() for i, (w, _) in enumerate(rest)}
        return codes

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        whole = [i for i, t in enumerate(texts) if not self.wordwise or (self.added and self.added.search(t))]
        if not whole:
            return self._encode(texts)
        found = dict(zip(whole, self.plain.encode_batch_fast([texts[i].decode() for i in whole], add_special_tokens=False), strict=True))
        rest = iter(self._encode([t for i, t in enumerate(texts) if i not in found]))
        return [np.array(found[i].ids, self.kind) if i in found else next(rest) for i in range(len(texts))]

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        words = [t.lower().replace(b"\n", b" ").split(b" ") for t in texts]
        new = set().union(*words).difference(self.known)
        # A letter or digit and the mark that ends a word are tokens of their own.
        ended = {w for w in new if len(w) > 1 and w[-1] in b".," and w[-2:-1].isalnum()}
        cores = ((new - ended) | {w[:-1] for w in ended} | {b".", b","}).difference(self.known)
        codes = self._encode_words(sorted(cores)) if cores else {}
        for w in ended:
            codes[w] = (codes.get(w[:-1]) or self.known[w[:-1]]) + (codes.get(w[-1:]) or self.known[w[-1:]])
        if len(self.known) + len(codes) <= CACHE_WORDS:
            self.known.update(codes)
            get = self.known.__getitem__
        else:
            get = {**{w: self.known[w] for ws in words for w in ws if w in self.known}, **codes}.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), self.kind) for ws in words]


def _encoder(path: str | None) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _write_shards(batches, p: StoreParams):
    import pyarrow as pa
    from pyspark import TaskContext

    part, encoder = TaskContext.get().partitionId(), _encoder(p.tokenizer)
    end = np.array([p.end_id], encoder.kind)
    ids: list = []
    runs: list[np.ndarray] = []
    size = serial = 0

    def shard():
        lengths = np.array([len(r) for r in runs], np.int64)
        blob = WaveletMatrix.build(np.concatenate(runs)).to_bytes()
        return pa.record_batch([pa.array([part << 20 | serial]), pa.array([int(lengths.sum())]), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths.tolist()], pa.list_(pa.int64())), pa.array([blob], pa.binary())], names=["shard", "n_tokens", "doc_ids", "lengths", "matrix"])

    for b in batches:
        texts, keys = texts_of(b.column(1)), b.column(0).to_pylist()
        for i in range(0, len(texts), 1024):
            for d, e in zip(keys[i : i + 1024], encoder.encode(texts[i : i + 1024]), strict=True):
                run = np.concatenate([e, end])
                if runs and size + len(run) > p.shard_tokens:
                    yield shard()
                    ids, runs, size, serial = [], [], 0, serial + 1
                ids.append(d)
                runs.append(run)
                size += len(run)
    if runs:
        yield shard()


def write_store(docs: DataFrame, params: StoreParams = StoreParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all rows in the order of their ids and write the shards; returns the table of shards.

    (shard, n_tokens, doc_ids, lengths, matrix), ``shard`` rising with the ids. A
    document longer than ``shard_tokens`` is a shard of its own.
    """
    p = params
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(lambda it: _write_shards(it, p), "shard long, n_tokens long, doc_ids array<long>, lengths array<long>, matrix binary"), "token_store")


def _read_shards(batches):
    import pyarrow as pa

    for b in batches:
        for base, ids, lengths, matrix in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            values = WaveletMatrix.from_bytes(matrix).values()
            ends = np.cumsum(lengths)
            starts = ends - lengths
            crc = [zlib.crc32(values[a:z].astype("<u4").tobytes()) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(starts + base), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(store: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of the store.

    Null and empty texts hold the end id alone; rows that repeat an id follow each
    other by text; null ids stand first. An empty store gives an empty result.
    """
    sizes = store.select("shard", "n_tokens")  # one short row a shard
    base = sizes.select("shard", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return store.join(F.broadcast(base) if sizes.count() <= 1_000_000 else base, "shard").select("base", "doc_ids", "lengths", "matrix").mapInArrow(_read_shards, "doc_id long, start long, n_tokens long, ids_crc32 long")
