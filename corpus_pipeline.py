"""The corpus pipeline: language, toxicity, near duplicates, repeated passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of documents,
whatever other columns there are and whatever their names. Null texts are empty texts, and texts of any length are read
whole. Ids may be null or repeat: rows are told apart by id and text. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import language, packing, simhash, substrings, toxicity
from pagewright.llm.common import Scratch, prepare, read

#: Part of the tokenizer's file name; the folder comes from the installed package of public tokenizers.
VOCABULARY = "word_bpe_49k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned and can be told; those that the model isn't sure of go.

    Null and empty texts, and texts without a letter, go. Repeated rows stay as they are.
    """
    return language.known(docs, train=F.lit(True), least=language.LEAST)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier scores below 0.5; a score of 0.5 goes. Empty texts stay, repeated rows too."""
    return toxicity.harmless(docs, toxicity.fit(docs, read(spark, sf_dir, "labels"), train=F.lit(True)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group whose five-word shingles are 0.8 alike or more.

    Similarity is exact, so every document that goes has a partner that is alike; a similarity of 0.8 itself links. Of
    repeated rows one stays; null ids stay only where their group has no other.
    """
    return simhash.keep_one(docs, width=5, least=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; of texts with passages that repeat across the corpus only the other words stay, joined by one space.

    Texts without such passages stay letter by letter, null ones too; of repeated rows every copy's passages go.
    """
    # The row travels in a struct, so that no column of documents clashes with one of the operator's.
    found = substrings.remove_repeated(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return found.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 tokens; an empty text is its separator alone, repeated rows are packed each."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language ID", language_id),
    ("toxicity", without_toxic),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("best-fit packing", best_fit_packing),
]

#: Language models, label models and tokenizers can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again by the next."""
    scratch = Scratch(prepare(spark))
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.put(str(k), docs)
    return docs
