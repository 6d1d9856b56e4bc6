"""The corpus pipeline: language ID, near-dedup, substring dedup, benchmark decontamination, packing.

Every stage takes and gives the columns of ``documents``, but for the last, which gives packed pieces.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from clinfeat.llm import decontam, langid, near, packing, substring
from clinfeat.llm.catalogue import TOKENIZER
from clinfeat.llm.shared import table

#: A document whose likeliest language has a smaller share of its words is no text in a learned language.
LEAST_SHARE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without a language for LEAST_SHARE of their words, go; a missing ``lang`` is filled in.

    The field learns from the rows with ``lang``; where there are none, only documents without letters go.
    """
    field = langid.fit(docs)
    if not field.labels:
        return docs.where(F.col("text").rlike("\\p{L}"))
    found = langid.predict(docs, field).where((F.col("_lang") != "und") & (F.col("_score") >= LEAST_SHARE))
    return found.withColumn("lang", F.coalesce("lang", "_lang")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; rows without an id stay."""
    kept = near.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    stay = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return stay.select(*docs.columns).union(docs.where("doc_id IS NULL"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 20-word windows that also start earlier go; a document that loses all its words stays with an empty text."""
    found = substring.without_repeats(docs, window=20)
    return found.withColumns({"text": F.col("_kept_text"), "n_chars": F.length("_kept_text").cast("long")}).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.pack(docs, TOKENIZER, context=1024).withColumn("ids_crc32", F.crc32("ids").cast("long"))


STAGES = [
    ("crf_language_id", language_id),
    ("minmax_near_dedup", near_dedup),
    ("fm_substring_dedup", substring_dedup),
    ("containment_decontamination", decontamination),
    ("tiered_packing", packed),
]

#: Language ID, substring dedup's digests and packing are not expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
