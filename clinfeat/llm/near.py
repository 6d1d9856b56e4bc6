"""MinHash near-duplicates by min-max hashing.

Each permutation of the hash space gives two values of a document's shingle set, its minimum and its maximum, so 128
signature values cost 64 hash evaluations a shingle. Minimum and maximum each agree with probability J, and they
are negatively correlated, so the share of equal values is unbiased with less variance than that of independent minima.
A band joins minimum and maximum of two permutations; documents that share a band are candidates, and every link
is confirmed on the full shingle sets. At J = 0.8 a pair shares none of the 32 bands with a probability below 1e-6.

Rows with equal sets are one class from the start. In a bucket of a band, all members are first compared with the
smallest candidate partner they have; what is then still in different components is compared completely, in
blocks, so that no bucket is capped and no pair that could join two components is left out.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clinfeat.llm import words
from clinfeat.llm.graph import components
from clinfeat.llm.shared import cut, map_batches

BANDS = 32
PERMUTATIONS = 2 * BANDS
_KEYS = words.mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64))
BLOCK_ROWS = 512


def signature(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(minima, maxima), a row for each permutation and a column for each set; sets lie back to back from ``at``."""
    low = np.empty((PERMUTATIONS, len(at)), np.uint64)
    high = np.empty_like(low)
    for k in range(PERMUTATIONS):
        value = (sets ^ _KEYS[2 * k]) * (_KEYS[2 * k + 1] | np.uint64(1))
        np.minimum.reduceat(value, at, out=low[k])
        np.maximum.reduceat(value, at, out=high[k])
    return low, high


def band_hashes(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A row for each set: one hash for each band, the band's number in it."""
    out = np.empty((low.shape[1], BANDS), np.uint64)
    for band in range(BANDS):
        h = np.full(low.shape[1], band + 1, np.uint64)
        for part in (low[2 * band], high[2 * band], low[2 * band + 1], high[2 * band + 1]):
            h = words.mix(h * np.uint64(words._RUN) + part)
        out[:, band] = h
    return out


def _signed(batch, n: int):
    for block in words.blocks(batch.column("text")):
        sets, bounds = words.shingles(block, n)
        size = np.diff(bounds)
        full = np.flatnonzero(size)
        keys, bands = np.zeros((2, block.rows), np.uint64), np.zeros((block.rows, BANDS), np.uint64)
        if len(full):
            at = bounds[:-1][full]
            bands[full] = band_hashes(*signature(sets, at))
            keys[0, full] = np.add.reduceat(words.mix(sets ^ np.uint64(words._BASE)), at)
            keys[1, full] = np.add.reduceat(words.mix(sets + np.uint64(words._RUN)), at)
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(block.rows + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1).view(np.int64))
        )
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").slice(block.first_row, block.rows).cast(pa.int64()), pa.array(size.astype(np.int64)),
             pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), lists],
            ["doc_id", "n_shingles", "k1", "k2", "bands"],
        )


def _confirmed(batch, n: int, percent: int):
    """The pairs of a batch whose sets are similar enough; equal texts in a row are cut into shingles once."""
    a, b = batch.column("a"), batch.column("b")
    keep = []
    texts = [batch.column("text_a").dictionary_encode(), batch.column("text_b").dictionary_encode()]
    sets = []
    for column in texts:
        made = []
        for block in words.blocks(column.dictionary):
            found, bounds = words.shingles(block, n)
            made += [found[bounds[i]:bounds[i + 1]] for i in range(block.rows)]
        sets.append(made)
    for i, j in zip(texts[0].indices.to_pylist(), texts[1].indices.to_pylist()):
        x, y = sets[0][i], sets[1][j]
        both = len(np.intersect1d(x, y, assume_unique=True))
        keep.append(len(x) > 0 and 100 * both >= percent * (len(x) + len(y) - both))
    mask = pa.array(keep, pa.bool_())
    return pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])


def _joining(group, n: int, percent: int):
    """Links between different labels of a group, one for each pair of labels that are still apart."""
    ids, labels = group.column("doc_id").to_numpy(), group.column("label").to_numpy()
    found, sizes = [], []
    for block in words.blocks(group.column("text").combine_chunks()):
        sets, bounds = words.shingles(block, n)
        found.append(sets), sizes.append(np.diff(bounds))
    sizes = np.concatenate(sizes)
    values, column = np.unique(np.concatenate(found), return_inverse=True)
    row = np.repeat(np.arange(len(ids)), sizes)
    shared = np.bincount(column, minlength=len(values)) > 1
    number = np.cumsum(shared) - 1
    row, column = row[shared[column]], number[column[shared[column]]]
    names, counts = np.unique(labels, return_counts=True)
    outside = np.flatnonzero(labels != names[counts.argmax()])  # a pair of two labels has one outside the largest
    both = np.zeros((len(outside), len(ids)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(shared.sum()), 4096):
        part = slice(*np.searchsorted(column, [at, at + 4096]))
        has = np.zeros((len(ids), 4096), np.float32)
        has[row[part], column[part] - at] = 1
        both += has[outside] @ has.T
    union = sizes[outside][:, None] + sizes[None, :] - both
    x, y = np.nonzero((100 * both >= percent * union) & (labels[outside][:, None] != labels[None, :]))
    parent, links = {}, []

    def root(k):
        while parent.get(k, k) != k:
            k = parent[k]
        return k

    for i, j in zip(outside[x], y):
        p, q = root(labels[i]), root(labels[j])
        if p != q:
            parent[max(p, q)] = min(p, q)
            links.append((ids[i], ids[j]))
    return pa.table({
        "a": pa.array([min(k) for k in links], pa.int64()), "b": pa.array([max(k) for k in links], pa.int64())
    })


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those with 100 * |intersection| >= percent * |union| on the full sets."""
    joined = (
        pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )
    return map_batches(joined, lambda batch: _confirmed(batch, n, percent), "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text; other columns are ignored).

    Texts count with A-Z lower-cased. A null or blank text has an empty set and links with nothing; with fewer than n
    words the whole sequence is the only shingle. Rows that repeat a doc_id stay rows of their own with the same
    component. Rows with a null doc_id come back with component_id null and kept true. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(map_batches(
        docs, lambda batch: _signed(batch, n), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"
    ))
    known = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    member = cut(
        signed.select("doc_id", "n_shingles", "k1", "k2")
        .join(classes, ["k1", "k2", "n_shingles"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"))
    )
    banded = (
        known.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
        .dropDuplicates(["doc_id", "k1"]).select("doc_id", F.explode("bands").alias("h"))
    )
    buckets = banded.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")).where("size > 1")
    rows = cut(banded.join(buckets, "h"))
    wanted = rows.select("doc_id").distinct()
    texts = cut(docs.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]))

    first = rows.groupBy("doc_id").agg(F.min("first").alias("a")).where("a < doc_id").select("a", F.col("doc_id").alias("b"))
    links = cut(confirmed(first, texts, n, percent))
    labels = components(links)

    # What one comparison did not join: members of one bucket in different components, compared completely, block
    # against block. A group holds two blocks at most and gives the links that join components, not all it finds.
    labelled = rows.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "h", "size", "doc_id", F.coalesce("component", "doc_id").alias("label")
    )
    members = [F.bit_xor(F.xxhash64("doc_id", F.lit(k))).alias(f"m{k}") for k in (1, 2)]
    open_ = (  # buckets of several bands with the same members count once
        labelled.groupBy("h", "size").agg(F.min("label").alias("x"), F.max("label").alias("y"), *members)
        .where("x < y").groupBy("size", "m1", "m2").agg(F.min("h").alias("h")).select("h")
    )
    spread = labelled.join(open_, "h").withColumn("blocks", F.ceil(F.col("size") / BLOCK_ROWS)).withColumn(
        "block", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    )
    ways = spread.select(
        "h", "doc_id", "label", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    ).select("h", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "doc_id", "label")
    more = cut(
        ways.join(texts, "doc_id").groupBy("h", "p", "q")
        .applyInArrow(lambda group: _joining(group, n, percent), "a long, b long").distinct()
    )
    groups = components(links.union(more))
    return (
        member.join(groups, member.rep == groups.id, "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
    )
