"""Token sequences: pre-tokens, continuations and drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the pieces a text is cut into, contractions, letters with their marks, digits, signs and space.
PIECES = r"(?:'[sS]|'[tT]|'[rR][eE]|'[vV][eE]|'[mM]|'[lL][lL]|'[dD])|[^\r\n\p{L}\p{N}]?[\p{L}\p{M}]+|\p{N}| ?[^\s\p{L}\p{M}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"


def pretokenize(df: DataFrame, text: str = "text") -> DataFrame:
    """(…, i, piece): the pieces, which cover the text."""
    return df.select(*[c for c in df.columns if c != text], F.posexplode(F.regexp_extract_all(text, F.lit(f"(?U){PIECES}"), F.lit(0))).alias("i", "piece"))


def ngram_continuations(words: DataFrame) -> DataFrame:
    """(a, b, c, next): what followed each trigram, in order of first sight. Needs seq and an order column ``pos``."""
    w = Window.partitionBy("seq").orderBy("pos")
    t = words.select("seq", "pos", F.col("token").alias("a"), *[F.lead("token", i).over(w).alias(n) for i, n in ((1, "b"), (2, "c"), (3, "d"))]).where("d is not null")
    first = t.groupBy("a", "b", "c", "d").agg(F.min(F.struct("seq", "pos")).alias("at"))
    ordered = first.groupBy("a", "b", "c").agg(F.array_sort(F.collect_list(F.struct("at", "d"))).alias("l"))
    return ordered.select("a", "b", "c", F.transform("l", lambda x: x["d"]).alias("next"))


def draft(history: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """(id, tokens): up to ``k`` first-seen continuations of the last three tokens of each history."""
    first = table.select(F.array("a", "b", "c").alias("key"), F.get("next", F.lit(0)).alias("n"))
    state = history.select("id", F.when(F.size("tokens") >= 3, F.slice("tokens", -3, 3)).alias("key"), F.array().cast("array<string>").alias("out"))
    for _ in range(k):
        joined = state.join(first, "key", "left")
        state = joined.select("id", F.when(F.col("n").isNotNull(), F.concat(F.slice("key", 2, 2), F.array("n"))).alias("key"), F.when(F.col("n").isNotNull(), F.concat("out", F.array("n"))).otherwise(F.col("out")).alias("out"))
    return state.select("id", F.col("out").alias("tokens"))


def acceptance(drafts: DataFrame) -> DataFrame:
    """(id, accepted, missed) of drafted against actual tokens: the longest common beginning counts."""
    differs = F.zip_with("drafted", F.slice("actual", F.lit(1), F.size("drafted")), lambda a, b: ~a.eqNullSafe(b))
    at = F.array_position(differs, True)
    accepted = F.when(at == 0, F.size("drafted").cast("long")).otherwise(at - 1)
    return drafts.select("id", accepted.alias("accepted"), (F.size("drafted") - accepted).alias("missed"))


def acceptance_totals(drafts: DataFrame, single: bool = False) -> DataFrame:
    """(hits, misses, no_draft) over all drafts; with ``single`` only the first drafted token counts."""
    d = drafts.withColumn("drafted", F.slice("drafted", 1, 1)) if single else drafts
    empty = F.coalesce(F.size("drafted"), F.lit(0)) <= 0
    told = acceptance(d.where(~empty)).agg(F.sum("accepted").alias("hits"), F.sum("missed").alias("misses"))
    return told.join(d.agg(F.count_if(empty).alias("no_draft"))).select(F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("misses", F.lit(0)).alias("misses"), "no_draft")  # a row each
