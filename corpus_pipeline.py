"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, BPE; each stage written and read again.

Defined cases, for all stages: null and empty texts have no letter and go in the first stage; rows with a null doc_id take
part and are never the first of their kind; repeated rows are copies, of which one stays; very long texts are read whole;
an empty table gives an empty result; columns beside doc_id, text and lang pass through whatever their names, but for
n_chars, which follows a changed text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstream.llm import bpe, decontam, langid, line_dedup, simhash
from veilstream.llm.common import crc_remainder, discard, materialize, table

#: A document goes if its language's score is less than this many times an even share, or if less of its n-grams is known.
LEAST_LANGUAGE_SHARE, LEAST_KNOWN = 1.2, 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, in no learned language by their n-grams, or for which no language speaks, go.

    Texts of several learned languages stay.
    """
    model = langid.train(docs.where(crc_remainder(F.col("doc_id"), 3) != 1).select("doc_id", "text", "lang"))
    return langid.accept(docs, model, LEAST_LANGUAGE_SHARE, LEAST_KNOWN)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from all but their first document; documents of which no letter is left thereby go too."""
    return line_dedup.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, Jaccard similarity 0.8) stays, the one with the smallest id."""
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents (two or more items) go; a passage of a single item is cut out of its document."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and a digest of what they decode to."""
    out = bpe.encode_documents(docs, bpe.default_tokenizer())
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("bpe", encode),
]

#: Trained models, components and token ids are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
        before = docs
    return docs
