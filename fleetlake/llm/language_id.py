"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of up to ``order`` bytes of its own. In a context
seen in training, a byte seen there costs its share and any other byte the escape
probability (escapes count as often as the context has different bytes), spread
over the next shorter context without the bytes already excluded; at the end
stands a uniform distribution. The statistics are frozen after training, so a tree
becomes an automaton: a table of all its contexts by byte with the next context and
the exact code length. A text's language is the one that codes it shortest.

The trees are fitted on all labelled documents. Tasks count their runs of bytes, the
counts are added up by Spark, and each tree is fitted from them in a task of its
own; every document is scored whole. The model grows with the different contexts of a
language and not with its documents: some megabytes a language, in the driver and in
each worker.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlake.llm.common import pieces

#: Texts are scored in pieces of so many bytes.
PIECE = 1 << 21


@dataclass(frozen=True)
class PpmParams:
    order: int = 3
    bits_quantile: float = 0.95  # of a language's labelled texts, for ``bits_bounds``
    bits_slack: float = 1.25
    short_bits: float = 120.0  # that a text may take beyond its bound, for words that the labelled texts lack


#: Different runs of bytes that a task adds up before it hands them on.
GRAMS_AT_ONCE = 1 << 21


def _added(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of sorted values, with their counts added up."""
    if not len(values):
        return values, counts
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[at], np.add.reduceat(counts, at)


def _windows(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different runs of ``size`` bytes, packed into a number, one from each byte on; byte 0 stands behind a text."""
    u = np.frombuffer(b"\0".join([*texts, bytes(size)]), np.uint8)
    code = np.zeros(len(u) - size + 1, np.uint32 if size <= 4 else np.uint64)
    for j in range(size):
        code <<= code.dtype.type(8)
        code |= u[j : j + len(code)]
    values, counts = np.unique(code, return_counts=True)
    return values.astype(np.int64), counts


def _count_grams(batches, order: int):
    """(lang, k, code, n): how often k bytes, packed into a long, follow each other. Byte 0 ends a text.

    Only the longest runs are counted; those of k bytes are their beginnings.
    """
    import pyarrow as pa

    known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def told():
        for lang, (values, counts) in known.items():
            for k in range(1, order + 2):
                code, clean = values >> 8 * (order + 1 - k), np.ones(len(values), bool)
                for j in range(k):
                    clean &= code >> 8 * j & 255 > 0
                code, n = _added(code[clean], counts[clean])
                yield pa.record_batch([pa.repeat(pa.scalar(lang), len(code)), pa.array(np.full(len(code), k, np.int64)), pa.array(code), pa.array(n)], names=["lang", "k", "code", "n"])

    for b in pieces(batches):
        texts: dict[str, list[bytes]] = {}
        for g, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
            texts.setdefault(g, []).append(t)
        for g, own in texts.items():
            new = _windows(own, order + 1)
            values, counts = (np.concatenate(x) for x in zip(known[g], new, strict=True)) if g in known else new
            by = np.argsort(values, kind="stable")
            known[g] = _added(values[by], counts[by])
        if sum(len(v) for v, _ in known.values()) > GRAMS_AT_ONCE:
            yield from told()
            known.clear()
    yield from told()


class PpmTree:
    """A language's automaton: ``step[source[context], symbol]`` and ``cost[context, symbol]`` in bits; context 0 is the empty one.

    The longest contexts lead where those without their first byte lead, so they
    share the rows of ``step``.
    """

    def __init__(self, symbol: np.ndarray, source: np.ndarray, step: np.ndarray, cost: np.ndarray):
        self.symbol, self.source, self.step, self.cost = symbol, source, step, cost

    @property
    def width(self) -> int:
        return self.step.shape[1]

    @staticmethod
    def fit(k: np.ndarray, code: np.ndarray, n: np.ndarray, order: int) -> PpmTree:
        """From all counts ``n`` of ``k`` bytes in a row (packed into ``code``) of one language."""
        grams = [(code[k == size], n[k == size]) for size in range(1, order + 2)]
        seen = np.unique(grams[0][0])
        symbol = np.zeros(256, np.int32)  # 0: ends a text; 1: never seen
        symbol[1:] = 1
        symbol[seen] = np.arange(2, 2 + len(seen))
        width = 2 + len(seen)
        # Contexts of each length: all that something follows.
        contexts = [np.unique(c >> 8) for c, _ in grams]
        offset = np.cumsum([0, *map(len, contexts)])
        at = lambda size, c: offset[size] + np.searchsorted(contexts[size], c)
        step = np.zeros((offset[max(order, 1)], width), np.int32)
        source = np.arange(offset[-1], dtype=np.int32)
        cost = np.zeros((offset[-1], width), np.float32)
        for size, (c, count) in enumerate(grams):
            own = slice(offset[size], offset[size + 1])
            mass = np.zeros((len(contexts[size]), width))
            mass[at(size, c >> 8) - offset[size], symbol[c & 255]] = count
            if size:
                shorter = at(size - 1, contexts[size] & (1 << 8 * (size - 1)) - 1)
                lower = 2.0 ** -cost[shorter].astype(float)
                if size < order:
                    step[own] = step[shorter]
                else:
                    source[own] = shorter
            else:
                lower = np.full((len(mass), width), 1 / 256)
            if size < order:
                longer = contexts[size + 1]
                step[at(size, longer >> 8), symbol[longer & 255]] = at(size + 1, longer)
            kinds, whole = (mass > 0).sum(1, keepdims=True), mass.sum(1, keepdims=True)
            free = np.where(mass > 0, 0, lower)
            free[:, 0] = 0
            free[:, 1] *= 256 - len(seen)  # one entry stands for all bytes never seen
            rest = np.maximum(free.sum(1, keepdims=True), 1e-12) if size else np.maximum((256 - kinds) / 256, 1 / 256)
            p = np.where(mass > 0, mass / (whole + kinds), lower * kinds / (whole + kinds) / rest)
            cost[own] = -np.log2(np.maximum(p, 1e-12))
            cost[own, 0] = 0
        return PpmTree(symbol, source, step, cost)

    def code_lengths(self, buffer: np.ndarray, starts: np.ndarray, order: int, piece: int = PIECE) -> np.ndarray:
        """Bits of each text. ``buffer``: texts ending in byte 0; ``starts``: where they begin."""
        out = np.zeros(len(starts))
        source, flat, cost = self.source * np.int32(self.width), self.step.ravel(), self.cost.ravel()
        for a in range(0, len(buffer), piece):
            lead = min(a, order)
            u = self.symbol[buffer[a - lead : a + piece]]
            state = np.zeros(len(u), np.int32)  # the context before each byte
            for _ in range(order):
                state[1:] = flat[source[state[:-1]] + u[:-1]]
            bits = cost[state.astype(np.int64) * self.width + u][lead:]
            first = int(np.searchsorted(starts, a, side="right")) - 1
            last = int(np.searchsorted(starts, a + len(bits), side="left"))
            cuts = np.maximum(starts[first:last] - a, 0)
            out[first:last] += np.add.reduceat(bits, cuts, dtype=np.float64)
        return out


class PpmModel:
    """The trees of all languages, in the order of their names."""

    def __init__(self, trees: dict[str, PpmTree]):
        self.languages = sorted(trees)
        self.trees = [trees[g] for g in self.languages]

    def code_lengths(self, buffer: np.ndarray, starts: np.ndarray, order: int, piece: int = PIECE) -> np.ndarray:
        """Bits of each text (rows) in each language (columns)."""
        return np.stack([t.code_lengths(buffer, starts, order, piece) for t in self.trees], 1)


def _usable(labelled: DataFrame) -> DataFrame:
    return labelled.where("text is not null and text <> '' and lang is not null")


def fit_ppm(labelled: DataFrame, params: PpmParams = PpmParams()) -> PpmModel:
    """``labelled``: key (long), text, lang. Fitted on all texts that have a language."""
    import pyarrow as pa

    p = params
    grams = _usable(labelled).select("lang", "text").mapInArrow(lambda it: _count_grams(it, p.order), "lang string, k long, code long, n long")

    def fit(table: pa.Table) -> pa.Table:
        import zstandard

        tree = PpmTree.fit(*(table[c].to_numpy() for c in ("k", "code", "n")), p.order)
        parts = [zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for x in (tree.symbol, tree.source, tree.step, tree.cost)]
        return pa.table({"lang": table["lang"].slice(0, 1), "width": pa.array([tree.width], pa.int64()), **{c: pa.array([x], pa.binary()) for c, x in zip(("symbol", "source", "step", "cost"), parts, strict=True)}})

    counts = grams.groupBy("lang", "k", "code").agg(F.sum("n").alias("n"))
    trees = counts.groupBy("lang").applyInArrow(fit, "lang string, width long, symbol binary, source binary, step binary, cost binary").toArrow()

    def opened(data: bytes, kind):
        import zstandard

        return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)

    return PpmModel({r["lang"]: PpmTree(opened(r["symbol"], np.int32), opened(r["source"], np.int32), opened(r["step"], np.int32).reshape(-1, r["width"]), opened(r["cost"], np.float32).reshape(-1, r["width"])) for r in trees.to_pylist()})


def _score(batches, model, order: int, field: str | None):
    """``field``: where the text stands in the column that is handed on, if there is one."""
    import pyarrow as pa
    import pyarrow.compute as pc

    m = model.value
    for b in pieces(batches):
        column = b.column(1) if field is None else pc.struct_field(b.column(2), field)
        texts = pc.fill_null(column.cast(pa.large_binary()), b"")
        joined = pc.binary_join_element_wise(texts, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\0", pa.large_binary()))
        if isinstance(joined, pa.ChunkedArray):
            joined = joined.combine_chunks()
        offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
        data = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(joined) else np.empty(0, np.uint8)
        bits = m.code_lengths(data, offsets[:-1] - offsets[0], order)
        best = bits.argmin(1)
        gap = 2.0 ** np.maximum(bits.min(1, keepdims=True) - bits, -1000)
        size = np.maximum(np.diff(offsets) - 1, 1)
        letters, more = (b.column(2), []) if field is None else (b.column(1), [b.column(2)])
        yield pa.record_batch([b.column(0), letters, pa.array([m.languages[i] for i in best], pa.string()), pa.array(1 / gap.sum(1)), pa.array(bits.min(1) / size), *more], names=["doc_id", "letters", "lang_pred", "score", "bits_per_byte", *b.schema.names[2:][: len(more)]])


def bits_bounds(labelled: DataFrame, model: PpmModel, params: PpmParams = PpmParams()) -> dict[str, float]:
    """Bits a byte of each language's own labelled texts: the quantile ``bits_quantile`` times ``bits_slack``.

    Bits a byte are taken to a thousandth, so that a language has some ten thousand different ones however many texts it has.
    """
    p = params
    rows = _usable(labelled).select(F.col("key").alias("doc_id"), F.struct("text", "lang", F.octet_length("text").alias("size")).alias("row"))
    own = identify(rows, model, p, passed="row").where("lang_pred = row.lang and row.size >= 100")
    found = own.groupBy("lang_pred").agg(F.percentile(F.round("bits_per_byte", 3), F.lit(p.bits_quantile)).alias("q")).collect()
    return {r.lang_pred: r.q * p.bits_slack for r in found}


def well_coded(bounds: dict[str, float], size, params: PpmParams = PpmParams()):
    """Whether ``bits_per_byte`` is within the bound of ``lang_pred``; texts of ``size`` bytes have ``short_bits`` more in all.

    A language without a bound (no labelled text long enough) rejects nothing.
    """
    bound = F.lit(None).cast("double")
    for lang, b in sorted(bounds.items()):
        bound = F.when(F.col("lang_pred") == lang, b).otherwise(bound)
    return F.coalesce(F.col("bits_per_byte") <= bound + F.lit(params.short_bits) / F.greatest(size, F.lit(1)), F.lit(True))


def identify(docs: DataFrame, model: PpmModel | None, params: PpmParams = PpmParams(), id_col: str = "doc_id", text_col: str = "text", passed: str | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte), one row per row of ``docs``.

    The struct column ``passed`` of ``docs`` is handed on beside them, if named; the
    text is then its field ``text_col`` and isn't sent twice.

    ``score`` is the share of the best language among all by code length. Texts
    that are null or have no letter are ``und`` with score 0; so is everything if
    no language was learned. Of equally short codes the first language by name
    wins. Repeated rows each get their result; other columns aren't read.
    """
    text, more = F.col(passed)[text_col] if passed else F.col(text_col), [passed] if passed else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *([] if passed else [text.alias("text")]), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"), *more)
    if model is None or not model.languages:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte"), *more)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some megabytes a language
    schema = "doc_id long, letters boolean, lang_pred string, score double, bits_per_byte double" + "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in more)
    scored = rows.mapInArrow(lambda it: _score(it, shared, params.order, text_col if passed else None), schema)
    return scored.select("doc_id", F.when(F.col("letters"), F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"), "bits_per_byte", *more)
