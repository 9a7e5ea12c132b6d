"""From documents to packed training sequences, in five stages.

quality: documents that the additive model scores under GOOD go. toxicity: those whose restored text scores
TOXIC or more go. lines: lines of windows that stood before go. near_duplicates: of each group of near copies,
by a Jaccard similarity of 0.8 or more of their five-word shingles, the document with the smallest doc_id stays. packing: what is left, as pieces of sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platen.llm import lines, packing, quality, simhash, toxicity
from platen.llm.common import fresh, remainder, scratch, stored, table

GOOD, TOXIC = 0.5, 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score GOOD or more by the additive model, learnt from labels of the documents that are there.

    Null and empty texts score as an empty text. Repeated rows and rows without a key are judged as any other; without
    labels every score is 0.5 and all stay. An empty table gives an empty one. Columns stay as they are, extra ones too.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2))
    return quality.keep_good(docs, model, GOOD)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores less than TOXIC. Nulls, repeated rows, empty tables and columns are as in
    keep_quality(); without labels every score is 0.5, which says nothing, and all stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(remainder("doc_id", 3) != 1))
    return toxicity.keep_clean(docs, model, TOXIC) if model.weights.any() else docs


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of three-line windows that stood before; n_chars, if it is there, follows the text.

    Null texts, texts of fewer than three lines and rows without a key stay as they are. Repeated rows come out alike. An
    empty table gives an empty one. Extra columns stay, whatever their names.
    """
    removed = fresh(docs.columns, "removed")
    made = lines.dedup_lines(docs, removed=removed)
    if "n_chars" in docs.columns:
        changed = F.when(F.size(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        made = made.withColumn("n_chars", changed)
    return made.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at a Jaccard similarity of 0.8 of their five-word shingles, that with the smallest
    doc_id, once. Texts without words (null, empty, blank) are one group. Rows without a key stay. Extra columns stay."""
    return simhash.keep_one(docs, similar=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a sequence; see packing.pack(). Null and empty texts are the end token alone, repeated rows and
    rows without a key are packed as any other, other columns are not read. An empty table gives an empty one."""
    return packing.digests(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=2))


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: Trained models and word shingles are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that stay. What each stage but the last returns is written to the shared folder, and what it
    wrote itself is deleted then."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), name, outer=True)
    return STAGES[-1][1](spark, docs, sf_dir)
