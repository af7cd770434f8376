"""Corpus pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and returns a
DataFrame; ``run`` writes each result to the shared folder and reads it back as the next one's input. All but
the last return the columns of ``documents``. Nulls, repeated rows and empty tables follow the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import langid, pieces, secret_scan
from basketry.llm.common import fold, fresh, read_table, stored
from basketry.llm.mixing import mix
from basketry.llm.simhash import keep_one

#: A document whose language is less certain than this goes. For any number of languages a certain one has 1, and
#: a guess both between families and between the languages of one has at most 0.25.
LEAST_LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or with an uncertain language go; a missing ``lang`` is filled in.

    Where no language can be learned (no labelled text), nothing can be rejected for it and all rows stay."""
    model = langid.fit(docs.filter(fold("doc_id", 5) != 0), "text", "lang", F.xxhash64("doc_id", F.lit(3)))
    if model is None:
        return docs
    (p,) = fresh(docs, "language")
    marked = langid.with_language(docs, "text", model, p)
    kept = marked.filter((F.col(f"{p}.lang") != langid.UND) & (F.col(f"{p}.score") >= LEAST_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", F.col(f"{p}.lang"))).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each near-duplicate group: that with the smallest id."""
    return keep_one(docs, "doc_id", "text", k=4, max_bits=4)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; every secret in their texts is replaced, and ``n_chars`` follows the text."""
    out = secret_scan.redact(docs, "doc_id", "text")
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to the sources' target weights: documents are left out or repeated."""
    return mix(docs, "doc_id", "text", "source")


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, two sampled segmentations, and whether the ids decode to the text."""
    e = pieces.with_pieces(docs, "doc_id", "text", k=2, keep=["doc_id", "lang", "source", "n_chars"])
    return e.drop("log_prob", "log_inclusion")


STAGES = [("language_id", language_id), ("simhash_dedup", simhash_dedup), ("secret_redaction", secret_redaction),
          ("source_mix", source_mix), ("piece_encoding", piece_encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs


#: Fingerprints and trained models have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None
