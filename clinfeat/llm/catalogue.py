"""The queries opN_<name> over the test tables, with production parameters."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from clinfeat.llm import align, chat, decontam, html, langid, licenses, near, packing, pii, spelling, substring, urls, vectors
from clinfeat.llm.shared import table

QUERIES = {}

# The tokenizer's file lies beside the installed package, on the driver and on every executor.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_minmax_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of documents whose four-word shingle sets have a Jaccard similarity of 0.8 or more."""
    return near.near_duplicates(table(spark, folder, "documents"), n=4, percent=80)


@query
def op2_fm_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of each document without the 20-word windows that also start earlier."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return substring.without_repeats(docs, window=20).select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"),
        F.col("_kept_sha256").alias("kept_sha256"),
    )


@query
def op3_tiered_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    pieces = packing.pack(table(spark, folder, "documents"), TOKENIZER, context=1024)
    return pieces.withColumn("ids_crc32", F.crc32("ids").cast("long")).drop("ids")


@query
def op4_containment_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold at least 0.8 of the five-word shingles of a benchmark item."""
    return decontam.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"), n=5, share=0.8)


@query
def op7_crf_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from the documents that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    field = langid.fit(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", "text"), field).select(
        "doc_id", held_out.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score")
    )


@query
def op5_boosted_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's URL judged by the rules, else by the trees."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    return urls.judge(pages).select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict")
    )


@query
def op9_grammar_chat(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one with control strings, formatted and read back."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"),
    )
    return chat.conversation_digests(chat.formatted_turns(rows.union(extra)))


@query
def op10_scored_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", F.col("_main_text").alias("text"), F.col("_n_chars").alias("n_chars"))


@query
def op1_graph_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors linked by a cosine of 0.9 or more."""
    return vectors.linked(table(spark, folder, "embeddings"), threshold=0.9)


@query
def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence statements in the paragraphs of all documents."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return licenses.scan(docs, licenses.fit(docs))


@query
def op11_semi_markov_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document: the plain forms, and what the field adds."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pii.spans(docs, pii.fit(docs))
    base = F.filter("_spans", lambda x: x["base"])
    kinds = F.transform(base, lambda x: x["kind"])
    counts = [(F.size(base) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("_spans")).alias("spans"))


@query
def op13_hashed_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's tokens under two tokenizers, aligned, and the corpus-wide counts of the pairs they link."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    digest = F.when(F.col("_groups") == "", "").otherwise(F.sha2("_groups", 256))
    return align.aligned(docs, TOKENIZER, PIECES).select(
        F.col("doc_id").cast("long").alias("doc_id"), *[F.col(f"_{x}").alias(x) for x in names], digest.alias("groups_sha256")
    )


@query
def op12_kd_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents, one in 31 of a document's words worn by a letter, with their near words and forms."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return spelling.variants(spelling.counted_words(docs, least=7, occurrences=2, one_in=31), ratio=10)
