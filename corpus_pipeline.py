"""Corpus pipeline: language ID, quality, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.

In every stage null texts count as empty, ids may be null or repeat, columns beside those of documents are
dropped whatever their names, very long texts are worked on whole, and an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.llm import langid, packing, quality, simhash, suffix
from lotline.llm.common import drop_materialised, materialise
from lotline.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A language is believed from this probability on.
LANGUAGE_SCORE = 0.5
#: Documents below this probability of being of quality are rejected.
QUALITY_SCORE = 0.3
#: Bytes of a repeated passage: some 50 short words.
PASSAGE_BYTES = 240


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score of LANGUAGE_SCORE or more; those without a letter, null and empty ones go.

    Repeated rows fare alike; of languages that tie the first by name counts. Without labelled rows no language is known and all go.
    """
    model = langid.train(docs, "text", "lang")
    return langid.predict(docs, model, COLUMNS).where((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SCORE)).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of QUALITY_SCORE or more.

    Empty texts have the model's base rate as score; repeated rows and equal texts fare alike; a score that ties with the
    threshold stays. Without labels every score is 0.5.
    """
    model = quality.train(spark.read.parquet(f"{sf_dir}/labels.parquet"), docs)
    return quality.score(docs, model, COLUMNS).where(F.col("score") >= QUALITY_SCORE).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id: shingles of five words, similarity of 0.8 or more.

    A null id stays only where a group has no other; rows with the same id and text are one document, and rows with
    the same id and other texts are told apart by their text. Empty texts are one group.
    """
    return simhash.keep_one_per_component(docs, find=simhash.similar_components, words_per_shingle=5).select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their later copies of repeated passages removed; a document with nothing left of some text goes.

    First is what has the smallest id, null before all, then the smallest hash of the text, then the first place; texts
    shorter than a passage, empty ones among them, stay. Of equal longer texts one stays and the others go.
    """
    found = suffix.find_repeats(docs, ["doc_id", "lang", "source"], "doc_id", length=PASSAGE_BYTES, keep_first=True, want_text=True, whole_characters=True)
    return found.where("n_removed = 0 OR octet_length(kept) > 0").select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("bigint").alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed into sequences of 1024 tokens; empty texts are an end token, repeated rows are packed each."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the trained models nor the packing plan.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again; what a stage has read goes when its own table is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_materialised(before)
        before = docs
    return docs
