"""The corpus pipeline: documents through five of the training-data operators, each stage written and read again.

Stages take (spark, docs, sf_dir); all but the last return the columns of documents for the documents that stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import jaccard, langid, packing, pii, quality
from tidewright.llm.common import materialize, release, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents; a document takes the language found, those that are rejected go.

    Rejected are a null text, one without a letter and one whose languages are too close; a null lang is not learned from,
    and where nothing is learned all go. Repeated rows are judged alike and all stay or go. An empty table stays empty.
    """
    found = langid.identify_languages(docs, langid.fit_languages(docs), whole_row=True)
    return found.where("NOT rejected").select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far from their language go.

    A null text has no words and goes; a null lang has no reference, so the base rules alone judge; repeated rows all stay
    or go, and each counts in the references. An empty table stays empty.
    """
    return quality.quality_rules(docs, whole_row=True).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of least doc_id; documents without a doc_id stay.

    Of rows that repeat a doc_id the one that the join compared stays: that of the least jaccard.text_hash(), and of those the
    first as JSON. Null and empty texts are groups of their own. An empty table stays empty.
    """
    kept = jaccard.join_similar(docs).where("is_representative").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)).hint("merge")
    often = materialize(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated")
    single = docs.join(often, "doc_id", "left_anti").join(kept, "doc_id", "left_semi").select(*docs.columns)
    row = F.struct(*docs.columns)
    judged = F.min_by(row, F.struct(jaccard.text_hash(F.col("text")), F.to_json(row)))
    repeated = docs.join(often, "doc_id", "left_semi").join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(judged.alias("row")).select("row.*")
    return single.unionByName(repeated).unionByName(docs.where("doc_id IS NULL"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data and the terms that reveal it; n_chars counts the new text.

    A null text stays null, with n_chars null; repeated rows stay, with the same new text. An empty table stays empty.
    """
    new = {"text": F.col("sanitised"), "n_chars": F.length("sanitised").cast("long")}
    return pii.find_pii(docs, whole_row=True).select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, a row for each piece.

    A null or empty text is its end token alone; repeated rows are packed each. An empty table gives no rows.
    """
    import public_tokenizers

    return packing.pack_words(docs, public_tokenizers.path("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("pii", personal_data),
    ("packing", pack),
]

#: SQL can express neither the compression classifier nor the packing; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        release(before)
    return docs
