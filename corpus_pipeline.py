"""Corpus pipeline: quality classifier, line dedup, near-duplicate join, decontamination, packing.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor kept, and returns a DataFrame; run() writes each one's
rows as Parquet to the shared folder and rereads them for the next. All but the last return the columns of documents. No stage
drops, caps or samples rows other than by its decision. Nulls, empty texts, repeated rows and empty tables are treated as the
operators' docstrings say; n_chars follows a text that a stage has changed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.llm.common import materialize, table
from threadloom.llm.decontaminate import find_leaks
from threadloom.llm.line_dedup import drop_lines
from threadloom.llm.ngram_join import near_duplicates
from threadloom.llm.packing import pack
from threadloom.llm.quality import fit_quality, score_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark, docs, sf_dir):
    """Documents that the classifier, fitted on this stage's own input and the labels, doesn't reject."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, keep=COLUMNS).where("predicted = 1").select(*COLUMNS)


def lines(spark, docs, sf_dir):
    """Documents without the lines that many documents hold; one that loses all its lines stays, with an empty text."""
    return drop_lines(docs).select("doc_id", "text", "lang", "source", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_copies(spark, docs, sf_dir):
    """One document of each group of near copies (Jaccard similarity of five-word shingles of 0.8 or more), that with the least id; of rows that repeat an id, all stay if one does."""
    classes = near_duplicates(docs, k=5, percent=80)
    first = classes.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(first, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select(*COLUMNS)


def decontamination(spark, docs, sf_dir):
    """Documents in which no benchmark item is found."""
    leaks = find_leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti").select(*COLUMNS)


def packing(spark, docs, sf_dir):
    """The kept documents' pieces, dealt to sequences."""
    return pack(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", decontamination), ("packing", packing)]
#: SQL can express neither the classifier nor the latent search nor the tokenizer.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The pieces of all stages' survivors among documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
