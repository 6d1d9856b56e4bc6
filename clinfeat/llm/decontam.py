"""Benchmark decontamination: short test items inside long documents, by containment.

Items are partitioned by size: shingle counts from 2**c to 2**(c+1)-1 share a partition, and each partition has its own length of
sketch. An item's sketch is the bottom-k MinHash of its shingle set: the k shingles with the smallest hashes. With
k above the share of shingles that may be missing (for the partition's largest item), a document that contains enough of
the item holds at least one shingle of the sketch, so the search has no misses; a MinHash of the document itself
would have, since a short item is a vanishing part of a long document's set. Candidates are verified by exact containment, on the
shingles' words. Everything is DataFrame functions; no Python runs on the executors.
"""

from pyspark.sql import Column, DataFrame, functions as F

from clinfeat.llm.shared import cut


def word_array(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _places(words: str, n: int) -> Column:
    return F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))


def shingle_texts(words: str, n: int) -> Column:
    """Distinct shingles as text."""
    return F.array_distinct(F.transform(_places(words, n), lambda i: F.array_join(F.slice(words, i + 1, n), " ")))


def _with_hashes(df: DataFrame, n: int) -> DataFrame:
    """``hashes``: one for each place of ``words``, from the hashes of its words."""
    hashed = df.withColumn("word_hashes", F.transform("words", lambda w: F.xxhash64(w)))
    return hashed.withColumn(
        "hashes", F.transform(_places("word_hashes", n), lambda i: F.xxhash64(*[F.get("word_hashes", i + j) for j in range(n)]))
    )


def sketches(items: DataFrame, share: float) -> DataFrame:
    """(item_id, size_class, h): the sketch of each item of (item_id, hashes), whose shingle hashes are distinct."""
    sized = items.withColumn("size", F.size("hashes")).where("size > 0")
    size_class = F.floor(F.log2("size")).cast("int")
    most = F.expr("shiftleft(1, size_class + 1) - 1")
    length = F.floor(most - F.ceil(most * F.lit(share) - F.lit(1e-9))).cast("int") + 1
    return sized.withColumn("size_class", size_class).select(
        "item_id", "size_class", F.explode(F.slice(F.array_sort("hashes"), F.lit(1), length)).alias("h")
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 5, share: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): items of which a document holds ``share`` or more of the n-word shingles.

    Words are lower-cased runs of letters and digits. Null, empty and shorter texts have no shingles: such items match nothing and such
    documents hold nothing. Rows with a null id are not searched. Rows that repeat an id give one row, with the largest
    count; an item id with several texts counts by the text that fits best. Empty tables give no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(
        "doc_id IS NOT NULL AND text IS NOT NULL"
    )
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_array(F.col("text").cast("string")).alias("words")).where(
        "item_id IS NOT NULL"
    )
    # Written once: a filter on an array that is still an expression would be computed again for every element below it.
    items = cut(_with_hashes(items, n).select("item_id", F.array_distinct("hashes").alias("hashes"), shingle_texts("words", n).alias("item_shingles")))
    parts = texts.select("doc_id", word_array(F.col("text")).alias("words"))
    # The outer form, since Spark would put the whole array expression into a filter below the plain one.
    hashed = _with_hashes(parts, n).select("doc_id", F.explode_outer("hashes").alias("h"))
    # Spark broadcasts the sketches if their size allows it, and else joins by shuffles.
    found = hashed.join(sketches(items, share), "h").select("doc_id", "item_id").distinct()
    sets = items.select("item_id", "item_shingles").where(F.size("item_shingles") > 0)
    held = parts.join(cut(found), "doc_id").withColumn("doc_shingles", shingle_texts("words", n)).drop("words").join(sets, "item_id")
    shared = held.select(
        "doc_id", "item_id", F.size("item_shingles").cast("long").alias("n_item"),
        F.size(F.array_intersect("item_shingles", "doc_shingles")).cast("long").alias("n_shared"),
    ).withColumn("containment", F.col("n_shared") / F.col("n_item"))
    best = shared.where(F.col("containment") >= share).groupBy("doc_id", "item_id").agg(
        F.max(F.struct("containment", "n_shared", "n_item")).alias("b")
    )
    return best.select("doc_id", "item_id", "b.n_item", "b.n_shared", "b.containment")
