"""Personal data by bootstrapped contextual extraction.

Fixed patterns with checks (address form, octets, Luhn, number of digits) find
seed entities. The one and two words to their left and the two to their right are
lexical patterns of that kind. All other words with a digit or an @, and groups of
digits with spaces between, are instances that may be found. Patterns and instances
form a graph that Spark scores in turns: a pattern is as good as the share of all
its occurrences in the corpus that stand beside an instance, weighted by how good
the instances are; an instance is as good as its patterns make it. Those beyond
``accept`` give patterns in the next turn, until a turn accepts nothing new. Scores
never fall, as accepted instances only become more. Accepted instances are reported
wherever they stand, with the kind that scores best, beside the seeds, which always
stay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlake.llm.common import materialize, mix, packed, pieces, quoted, shingle_hashes, texts_of, unpacked, word_hashes
from fleetlake.llm.decontaminate import PLAIN, Members

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number that doesn't match from its first digit matches from no later one, so starts inside numbers are skipped.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_GROUPS = re.compile(r"(?<![\w.@+-])\(?[0-9]++(?:(?:\) ?| \(?|[.-]{1,2})[0-9]++)++(?!\w)")
MOST_DIGITS = 34  # of an identifier: an account number's
_SPACE = frozenset(" \t\n\r\x0b\x0c=:;,<>\"'")
_IP_FORM, _CARD_FORM, _PHONE_FORM, _EMAIL_FORM = re.compile(r"[0-9]+(?:\.[0-9]+){3}"), re.compile(r"[0-9-]{16,22}"), re.compile(r"[0-9().-]{7,20}"), re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+")


@dataclass(frozen=True)
class PiiParams:
    least_seeds: int = 5  # different seeds or accepted instances beside a pattern that make it count
    accept: float = 0.8
    broadcast_rows: int = 1_000_000  # patterns (8 MB); more are joined by a shuffle


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def seed_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((0, start, end))
        at = text.find("@", max(end, at + 1))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def candidate_spans(text: str, seeds: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Words with a digit or an @ that touch no seed, with the kind they look like, or -1.

    No identifier has more than MOST_DIGITS digits, so longer numbers are none.
    """
    taken = sorted((a, b) for _, a, b in seeds)
    out, pos, i, n = [], 0, 0, len(text)
    while m := _MARK.search(text, pos):
        start = end = m.start()
        while start > pos and text[start - 1] not in _SPACE:
            start -= 1
        while end < n and text[end] not in _SPACE:
            end += 1
        pos = end
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if i < len(taken) and taken[i][0] < end:
            continue
        word = text[start:end].rstrip(".!?)]}").lstrip("([{")
        start = text.index(word, start)
        digits = len(_NOT_DIGIT.sub("", word))
        kind = 0 if _EMAIL_FORM.fullmatch(word) else 1 if _IP_FORM.fullmatch(word) else 2 if 16 <= digits <= 19 and _CARD_FORM.fullmatch(word) else 3 if 7 <= digits <= 15 and _PHONE_FORM.fullmatch(word) else -1
        if digits <= MOST_DIGITS and word != "@":
            out.append((kind, start, start + len(word)))
    # Groups of digits with spaces between, unless a seed or a word of them is one already.
    groups: list[tuple[int, int, int]] = []
    formed, i = sorted(taken + [(a, b) for k, a, b in out if k >= 0]), 0
    for m in _GROUPS.finditer(text):
        a, b = m.span()
        while i < len(formed) and formed[i][1] <= a:
            i += 1
        digits = len(_NOT_DIGIT.sub("", m[0]))
        kind = 2 if 16 <= digits <= 19 else 3 if 7 <= digits <= 15 else -1
        if kind >= 0 and " " in m[0] and not (i < len(formed) and formed[i][0] < b):
            groups.append((kind, a, b))
    # A group takes the place of the words it is made of.
    out, i = sorted(out, key=lambda x: x[1:]), 0
    rest = []
    for k, a, b in out:
        while i < len(groups) and groups[i][2] <= a:
            i += 1
        if not (i < len(groups) and groups[i][1] < b):
            rest.append((k, a, b))
    return sorted(rest + groups, key=lambda x: x[1:])


def pattern_hashes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of patterns: of each word to the left, and of each two in a row to the left and to the right."""
    two = shingle_hashes(h, 2)
    return mix(h + np.uint64(1)), mix(two + np.uint64(2)), mix(two + np.uint64(3))


def words_beside(text: str, s: int, e: int) -> tuple[list[bytes], list[bytes]]:
    """The two words before ``s`` and the two after ``e`` (fewer at the text's ends), however long."""
    out = []
    for left in (True, False):
        width = 40
        while True:
            part = text[max(0, s - width) : s] if left else text[e : e + width]
            words = part.encode("utf-8", "replace").translate(PLAIN).split()
            if len(words) > 2 or (width >= s if left else e + width >= len(text)):
                break
            width *= 4
        out.append(words[-2:] if left else words[:2])
    return out[0], out[1]


_SPAN = "struct<k:int,s:int,e:int>"
_FOUND = f"doc_id long, th long, base array<{_SPAN}>, seen array<struct<k:int,s:int,e:int,i:long,seed:boolean,p:array<long>>>"


def _extract(batches):
    import pyarrow as pa
    import xxhash

    span = pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])
    seen_kind = pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("i", pa.int64()), ("seed", pa.bool_()), ("p", pa.list_(pa.int64()))])
    for b in pieces(batches):
        bases, seens = [], []
        for t in texts_of(b.column(1)):
            text = t.decode("utf-8", "replace")
            seeds = seed_spans(text)
            seen = []
            for is_seed, spans in ((True, seeds), (False, candidate_spans(text, seeds))):
                for k, s, e in spans:
                    before, after = words_beside(text, s, e)
                    one, two, _ = pattern_hashes(word_hashes(before))
                    *_, right = pattern_hashes(word_hashes(after))
                    seen.append({"k": k, "s": s, "e": e, "i": xxhash.xxh3_64_intdigest(text[s:e].lower().encode()) - 2**63, "seed": is_seed, "p": [x for v in (one[-1:], two, right) for x in v.view(np.int64).tolist()]})
            bases.append([{"k": k, "s": s, "e": e} for k, s, e in seeds])
            seens.append(seen)
        yield pa.record_batch([b.column(0), b.column(2), pa.array(bases, pa.list_(span)), pa.array(seens, pa.list_(seen_kind))], names=["doc_id", "th", "base", "seen"])


def _count_patterns(batches, known):
    """(p, n): occurrences of patterns in whole texts, of ``known`` ones or of all."""
    import pyarrow as pa

    members = None if known is None else known.value
    for b in pieces(batches):
        found = []
        for t in texts_of(b.column(0)):
            for x in pattern_hashes(word_hashes(t.translate(PLAIN).split())):
                x = x.view(np.int64)
                found.append(x if members is None else x[members.find(x)])
        values, counts = np.unique(np.concatenate(found) if found else np.empty(0, np.int64), return_counts=True)
        yield pa.record_batch([pa.array(values, pa.int64()), pa.array(counts, pa.int64())], names=["p", "n"])


def _discover(docs: DataFrame, p: PiiParams, id_col: str, text_col: str):
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("th"))
    found = materialize(rows.mapInArrow(lambda it: _extract(it), _FOUND), "entities")
    seen = found.select("doc_id", "th", F.explode("seen").alias("x")).select("doc_id", "th", "x.*")
    # ``k`` of an instance that looks like no kind is -1: patterns of any kind may take it.
    edges = materialize(seen.select("k", "i", "seed", F.explode("p").alias("p")).groupBy("p", "k", "i", "seed").agg(F.count("*").alias("n")), "pattern_graph")
    scores = edges.where("seed").select("k", "i", F.lit(1.0).alias("score")).distinct()
    open_ = edges.where("not seed").select("p", F.col("k").alias("form")).distinct()
    fits = lambda form, kind: (F.col(form) < 0) | (F.col(form) == F.col(kind))
    totals, accepted_before = None, scores.count()
    while True:
        # Patterns beside instances accepted so far; only new ones are counted in the texts.
        beside = edges.withColumnRenamed("k", "form").join(scores, "i").where(fits("form", "k"))
        strong = beside.groupBy("p", "k").agg(F.count_distinct("i").alias("found"), F.sum(F.col("n") * F.col("score")).alias("hits")).where(F.col("found") >= p.least_seeds)
        live = materialize(strong.join(open_, "p").where(fits("form", "k")).select("p", "k", "hits").distinct(), "patterns")
        fresh = live.select("p").distinct()
        fresh = materialize(fresh if totals is None else fresh.join(totals, "p", "left_anti"), "new_patterns")
        n = fresh.count()
        if n:
            known = spark.sparkContext.broadcast(Members(fresh.toPandas()["p"].to_numpy(np.int64))) if n <= p.broadcast_rows else None
            counts = rows.where("text is not null").select("text").mapInArrow(lambda it, known=known: _count_patterns(it, known), "p long, n long")
            counted = materialize(counts.join(fresh, "p", "left_semi").groupBy("p").agg(F.sum("n").alias("total")), "pattern_totals")
            totals = counted if totals is None else totals.unionByName(counted)
        if totals is None:  # no pattern stands beside anything that could be found
            break
        weight = live.join(totals, "p").select("p", "k", F.least(F.col("hits") / F.col("total"), F.lit(0.999999)).alias("w"))
        found_now = edges.where("not seed").select("p", F.col("k").alias("form"), "i").distinct().join(weight, "p").where(fits("form", "k"))
        better = found_now.groupBy("k", "i").agg((1 - F.exp(F.sum(F.log(1 - F.col("w"))))).alias("score")).where(F.col("score") >= p.accept)
        better = better.unionByName(edges.where("seed").select("k", "i", F.lit(1.0).alias("score")))
        scores = materialize(better.groupBy("k", "i").agg(F.max("score").alias("score")), "instance_scores")
        accepted = scores.count()
        if accepted == accepted_before:
            break
        accepted_before = accepted
    best = scores.groupBy("i").agg(F.max(F.struct("score", (-F.col("k")).alias("minus"))).alias("b"), F.collect_set("k").alias("kinds")).select("i", (-F.col("b.minus")).alias("kind"), "kinds")
    # What looks like a kind is of that kind or of none.
    named = seen.where("not seed").join(best, "i").where((F.col("k") < 0) | F.array_contains("kinds", F.col("k"))).withColumn("k", F.when(F.col("k") < 0, F.col("kind")).otherwise(F.col("k")))
    added = named.groupBy("doc_id", "th").agg(F.collect_set(F.struct("k", "s", "e")).alias("added"))
    added = materialize(added.select(F.col("doc_id").alias("aid"), F.col("th").alias("ath"), "added"), "discovered")
    return rows, found, added


def find_pii(docs: DataFrame, params: PiiParams = PiiParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of (k, s, e), one row per row of ``docs``.

    ``k`` numbers KINDS; start and end are code points, the end exclusive. ``base``
    has the seeds, ``spans`` also what patterns discovered, by kind and start. Null
    text is empty and has none. Repeated rows each get their spans; patterns count
    them all. Empty tables give an empty result; other columns aren't read.
    """
    _, found, added = _discover(docs, params, id_col, text_col)
    both = found.join(added, F.col("doc_id").eqNullSafe(F.col("aid")) & (F.col("th") == F.col("ath")), "left")
    return both.select("doc_id", "base", F.array_sort(F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added"))).alias("spans"))


def _mask(batches):
    import pyarrow as pa

    for b in pieces(batches):
        texts = []
        for t, null, added in zip(texts_of(b.column(0)), b.column(0).is_null().to_pylist(), b.column(1).to_pylist(), strict=True):
            text = t.decode("utf-8", "replace")
            spans = sorted((s, e, k) for k, s, e in [*seed_spans(text), *((x["k"], x["s"], x["e"]) for x in added or ())])
            out, at = [], 0
            for s, e, k in spans:
                if s >= at:
                    out += [text[at:s], f"[{KINDS[k].upper()}]"]
                at = max(at, e)
            texts.append(None if null else "".join([*out, text[at:]]))
        yield pa.record_batch([pa.array(texts, pa.string()), *b.columns[2:]], names=["text", *b.schema.names[2:]])


def mask_pii(docs: DataFrame, params: PiiParams = PiiParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``find_pii`` in the text replaced by its kind in brackets; overlapping ones by the first.

    Null texts stay null. Repeated rows are masked each, rows without an id by their text.
    All other columns come as they are, whatever their names. An empty table gives an
    empty result; texts of any length are masked whole.
    """
    _, _, added = _discover(docs, params, id_col, text_col)
    text = quoted(text_col)
    rows = docs.select(text.alias("text"), quoted(id_col).cast("long").alias("did"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("dth"), packed([c for c in docs.columns if c != text_col]).alias("rest"))
    joined = rows.join(added, F.col("did").eqNullSafe(F.col("aid")) & (F.col("dth") == F.col("ath")), "left").select("text", "added", "rest")
    masked = joined.mapInArrow(_mask, f"text string, rest {joined.schema['rest'].dataType.simpleString()}")
    others = unpacked([c for c in docs.columns if c != text_col], "rest")
    others.insert(docs.columns.index(text_col), F.col("text").alias(text_col))
    return masked.select(*others)
