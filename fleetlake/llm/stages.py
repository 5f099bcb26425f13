"""The stages of the corpus pipeline.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; ``run`` writes
each result to the shared folder and reads it back as the next stage's input. All
but the last return the columns of ``docs`` as they came, extra ones included and
whatever their names; none reads other columns than doc_id, text, lang and source. An
empty table gives an empty result in every stage; texts are handled whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlake.llm import decontaminate, language_id, ngram_join, packing, pii
from fleetlake.llm.common import id_or_text, materialize, packed, quoted, release, unpacked

#: Near copies: five words, links from 0.8 on.
NEAR = ngram_join.JoinParams(shingle=5, percent=80)


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): the whole row in a struct; rows without an id are known by their text (``id_or_text``)."""
    return docs.select(id_or_text("doc_id", "text").alias("doc_id"), quoted("text").alias("text"), packed(docs.columns).alias("row"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that is known; ``lang`` becomes the one found.

    A text must be coded in no more bits a byte than its language's own labelled
    texts take (``language_id.bits_bounds``): one that no language codes well is in
    none of them. Null texts and texts without a letter go. Repeated rows, and rows
    without a doc_id, are judged by their texts alike; of equally short codes the
    first language by name wins. If no row has a ``lang``, nothing is known and all go.
    """
    labelled = docs.select(id_or_text("doc_id", "text").alias("key"), "text", "lang")
    model = language_id.fit_ppm(labelled)
    text = f"c{docs.columns.index('text')}"
    found = language_id.identify(_rows(docs).select("doc_id", "row"), model, text_col=text, passed="row")
    good = found.where("lang_pred <> 'und'").where(language_id.well_coded(language_id.bits_bounds(labelled, model), F.octet_length(F.col("row")[text])))
    return good.select(*unpacked(docs.columns, "row", lang=F.col("lang_pred")))


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, near: ngram_join.JoinParams = NEAR) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies.

    Copies share ``near.percent`` of their ``near.shingle``-word shingles. Null, empty
    and blank texts are copies of nothing and stay. Rows that repeat id and text
    become one; rows that share an id with different texts are one document, which
    stays or goes with all of them. Rows without an id are a document for each
    text; a group keeps one of these only if it has no other.
    """
    rows = _rows(docs)
    groups = ngram_join.jaccard_components(rows.select("doc_id", "text"), near)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = rows.join(first, "doc_id", "left_semi").select("doc_id", F.xxhash64("text").alias("th"), "row")
    return kept.dropDuplicates(["doc_id", "th"]).select(*unpacked(docs.columns, "row"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that contain no benchmark item.

    Null, empty and blank texts contain none. Rows that share an id go together;
    repeated rows stay as they are, rows without an id stay or go by their text.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _rows(docs)
    leaks = decontaminate.contained_items(rows.select("doc_id", "text"), items).select("doc_id").distinct()
    return rows.select("doc_id", "row").join(materialize(leaks, "leaks"), "doc_id", "left_anti").select(*unpacked(docs.columns, "row"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in every row; ``n_chars`` follows the text if there is one. Null texts stay null."""
    masked = pii.mask_pii(docs)
    follow = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return masked.select(*[follow.get(c, quoted(c)).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every row into bins: (doc_id, piece, n_tokens, bin_id, bin_start). Edge rows as in ``packing.pack``."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard", copies_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: The first and the last stage aren't SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``; a table is deleted when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
