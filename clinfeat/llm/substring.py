"""Substring dedup: later copies of word windows, found with a compressed FM-index for each shard.

A shard is made by content, not by document. In every window of ``window`` words the five-word gram with the smallest
hash is its minimizer; consecutive windows with the same minimizer form a run. Equal windows have equal minimizers,
so all copies of a window meet in the shard of their minimizer, and a document is streamed only to shards that can
match it. Runs whose minimizer occurs once in the corpus match nothing and go nowhere.

Runs with the same words are one class before they are indexed; all but the earliest run of a class go entirely.
A shard concatenates the words of its classes, builds the suffix order and the Burrows-Wheeler transform, and keeps
the latter as a wavelet matrix of packed bits with a count for every 64. Each class is then streamed through by
backward search: the matching statistics say which windows (matches of ``window`` words or more) occur elsewhere, and
the suffix interval gives the earliest place. A shard is closed after ``SHARD_WORDS`` words, at a minimizer's end; runs of a
minimizer with more than ``FINE`` runs are cut into single windows, each its own minimizer, so no shard outgrows a task.
"""

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clinfeat.llm import words
from clinfeat.llm.shared import cut, map_batches

GRAM = 5
SHARD_WORDS = 1 << 18
FINE = 100_000
HELD = 30_000


class Runs:
    """Runs of the texts of a block: row, first word in its text, number of windows, minimizer hash."""

    def __init__(self, block: words.Block, window: int):
        hashes = block.word_hashes()
        grams = words.run_hashes(hashes, GRAM)
        row, n = block.row_of_word(), max(0, len(hashes) - window + 1)
        value, place = grams, np.arange(len(grams))
        span, width = 1, window - GRAM + 1
        while span < width:  # the smallest gram of ever wider spans, the leftmost of equals
            step = min(span, width - span)
            left, right = value[:len(value) - step], value[step:]
            lower = right < left
            place = np.where(lower, place[step:], place[:len(place) - step])
            value = np.where(lower, right, left)
            span += step
        value, place = value[:n], place[:n]
        at = np.flatnonzero(row[:n] == row[window - 1:]) if n else np.zeros(0, np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (row[at[1:]] != row[at[:-1]]) | (place[at[1:]] != place[at[:-1]])
        first = np.flatnonzero(new)
        self.word = at[first]
        self.windows = np.diff(np.append(first, len(at)))
        self.row = row[self.word]
        self.at = self.word - block.bounds[self.row]
        self.minimizer = value[self.word]
        self.hashes = hashes


def _minimizers(batch, window: int):
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    for block in words.blocks(batch.column("text")):
        runs = Runs(block, window)
        yield pa.RecordBatch.from_arrays(
            [pa.array(runs.minimizer.view(np.int64)), pa.array(ids[block.first_row + runs.row]), pa.array(runs.at.astype(np.int32))],
            ["m", "doc_id", "at"],
        )


RUN_SCHEMA = "m long, k1 long, k2 long, doc_id long, at int, n int, run binary"
_RUN_TYPES = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
_RUN_NAMES = ["m", "k1", "k2", "doc_id", "at", "n", "run"]


def _keys(text: bytes) -> tuple[int, int]:
    digest = hashlib.blake2b(text, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _run_texts(batches, window: int):
    """The words of wanted runs; those of very frequent minimizers window by window.

    Of equal runs a task passes on the earliest, and the others as removed (without ``run``), so a hot passage reaches
    its shard once a task. What is held is given out after ``HELD`` runs.
    """
    held: dict = {}
    gone: list = []

    def out():
        rows = [(m, k1, k2, doc, at, n, run) for (m, k1, k2), (doc, at, n, run) in held.items()] + gone
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _RUN_TYPES)], _RUN_NAMES) if rows else None
        held.clear(), gone.clear()
        return made

    for batch in batches:
        ids, wanted = batch.column("doc_id").to_pylist(), batch.column("_wanted")
        asked, asked_row = wanted.flatten().to_numpy(), np.repeat(np.arange(len(ids)), wanted.value_lengths().to_numpy())
        fine_places = (asked_row.astype(np.int64) << 32 | asked >> 1)[asked & 1 == 1]
        places = asked_row.astype(np.int64) << 32 | asked >> 1
        for block in words.blocks(batch.column("text")):
            runs, raw = Runs(block, window), block.data.tobytes()
            key = (block.first_row + runs.row) << 32 | runs.at
            picked = np.flatnonzero(np.isin(key, places))
            fine = np.isin(key[picked], fine_places)
            begin, last = block.starts[runs.word[picked]], runs.word[picked] + runs.windows[picked] + window - 2
            end = block.ends[last]
            for k, split, x, y in zip(picked.tolist(), fine.tolist(), begin.tolist(), end.tolist()):
                doc, at, count = ids[block.first_row + runs.row[k]], int(runs.at[k]), int(runs.windows[k])
                found = raw[x:y].split()
                for part in range(count) if split else (None,):
                    text = b" ".join(found if part is None else found[part:part + window])
                    k1, k2 = _keys(text)
                    name = (k1 if split else int(runs.minimizer[k].view(np.int64)), k1, k2)
                    row = (doc, at + (part or 0), 1 if split else count, text)
                    other = held.get(name)
                    if other is not None:
                        row, later = (row, other) if row[:2] < other[:2] else (other, row)
                        if later[:2] != row[:2]:
                            gone.append((doc, k1, k2, *later[:3], None))
                    held[name] = row
            if len(held) >= HELD or len(gone) >= HELD:
                yield out()
    if held or gone:
        yield out()


class FmIndex:
    """Backward search over a sequence of numbers; 0 separates its parts.

    The transform is held as a wavelet matrix: for each bit of the numbers, from the highest, a packed bit vector.
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.size = n = len(text)
        rank, length = text.astype(np.int64), 1
        while length < depth:  # order of the suffixes by their first ``depth`` numbers, doubling
            key = rank * (n + max(1, int(rank.max(initial=0))) + 2)
            key[:n - length] += rank[length:] + 1
            rank = np.unique(key, return_inverse=True)[1]
            length *= 2
        self.suffix = np.argsort(rank, kind="stable")
        transform = text[self.suffix - 1]
        self.levels, self.zeros = [], []
        self.bits = max(1, int(text.max(initial=0)).bit_length())
        symbols = np.arange(int(text.max(initial=0)) + 2)
        self.first = np.searchsorted(np.sort(text), symbols)
        base = np.zeros(len(symbols), np.int64)
        for level in range(self.bits - 1, -1, -1):
            bit = (transform >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.pad(packed, (0, 8 - len(packed) % 8 + 8)).view(np.uint64)
            before = np.zeros(len(packed), np.int32)
            np.cumsum(np.bitwise_count(packed[:-1]), out=before[1:])
            self.levels.append((packed, before))
            self.zeros.append(n - int(bit.sum()))
            transform = np.concatenate([transform[bit == 0], transform[bit == 1]])
            base = self._down(len(self.levels) - 1, level, symbols, base)
        self.base = base

    def _down(self, number: int, level: int, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        packed, before = self.levels[number]
        at = place >> 6
        below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        ones = before[at] + np.bitwise_count(packed[at] & below)
        return np.where((symbol >> level) & 1, self.zeros[number] + ones, place - ones)

    def step(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where the suffixes before ``place`` stand once ``symbol`` is put in front of them."""
        out = place
        for number in range(self.bits):
            out = self._down(number, self.bits - 1 - number, symbol, out)
        return self.first[symbol] + out - self.base[symbol]

    def search(self, text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the patterns text[end - length:end], those with two or more matches: (their number, low, high)."""
        alive = np.arange(len(ends))
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        for j in range(1, length + 1):
            symbol = text[ends[alive] - j]
            both = self.step(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
            low, high = both[:len(alive)], both[len(alive):]
            more = high - low > 1  # a single match is the pattern itself
            alive, low, high = alive[more], low[more], high[more]
        return alive, low, high


def _earlier(runs: list, window: int):
    """(doc_id, at, mask) of the classes of a shard; bit i of mask: window i also starts earlier."""
    numbers: dict = {}
    parts, sizes = [], []
    for *_, run in runs:
        found = [numbers.setdefault(w, len(numbers) + 1) for w in run.split(b" ")]
        parts += found
        parts.append(0)
        sizes.append(len(found))
    text, sizes = np.array(parts, np.int64), np.array(sizes)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    doc, at = np.array([r[0] for r in runs], np.int64), np.array([r[1] for r in runs], np.int64)
    windows = sizes - window + 1
    owner = np.repeat(np.arange(len(runs)), windows)
    place = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    index = FmIndex(text, window)
    number, low, high = index.search(text, begin[owner] + place + window, window)
    masks = np.zeros(len(runs), np.int64)
    if len(number):
        run_of = np.repeat(np.arange(len(runs)), sizes + 1)
        where = at[run_of] + np.arange(len(text)) - begin[run_of]
        order = np.lexsort((where, doc[run_of]))
        rank = np.empty(len(text), np.int64)
        rank[order] = np.arange(len(text))
        same = np.zeros(len(text), bool)  # equal places of two runs share a rank
        same[1:] = (doc[run_of][order][1:] == doc[run_of][order][:-1]) & (where[order][1:] == where[order][:-1])
        rank[order] = np.maximum.accumulate(np.where(same, 0, np.arange(len(text))))
        in_order = np.append(rank[index.suffix], np.iinfo(np.int64).max)
        lows, back = np.unique(low, return_inverse=True)
        highs = np.zeros(len(lows), np.int64)
        highs[back] = high
        least = np.minimum.reduceat(in_order, np.column_stack([lows, highs]).reshape(-1))[::2][back]
        mine = rank[begin[owner[number]] + place[number]]
        late = least < mine
        np.bitwise_or.at(masks, owner[number][late], np.int64(1) << place[number][late])
    hit = np.flatnonzero(masks)
    return doc[hit], at[hit], masks[hit]


def _shards(batches, window: int):
    """Streams runs in the order (minimizer, words, place) and closes a shard at the end of a minimizer.

    The first run of equal ones is their class; the others are removed as they pass.
    """
    pending, count, last, own, place = [], 0, None, None, None
    gone: list = []

    def rows(doc, at, mask):
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(at, pa.int32()), pa.array(mask, pa.int64())], ["doc_id", "at", "mask"])

    for batch in batches:
        for m, k1, k2, doc, at, n, run in zip(*(batch.column(c).to_pylist() for c in _RUN_NAMES)):
            if run is None or (m, k1, k2) == own:
                if run is None or (doc, at) != place:
                    gone.append((doc, at, (1 << n) - 1))
                continue
            if count >= SHARD_WORDS and m != last:
                yield rows(*_earlier(pending, window))
                pending, count = [], 0
            pending.append((doc, at, run))
            count += n + window
            last, own, place = m, (m, k1, k2), (doc, at)
        if gone:
            yield rows(*zip(*gone))
            gone.clear()
    if pending:
        yield rows(*_earlier(pending, window))


def _kept(batch, window: int):
    """Words that no removed window covers; a text that loses nothing stays as it is."""
    removed, copies = batch.column("_removed").to_pylist(), batch.column("_copy").to_pylist()
    texts = batch.column("text")
    totals, gone, kept, digests = [], [], [], []
    for block in words.blocks(texts):
        raw = block.data.tobytes()
        for i in range(block.rows):
            row = block.first_row + i
            all_ = raw[block.offsets[i]:block.offsets[i + 1]].split()
            n, left = len(all_), all_
            if copies[row]:
                left = [] if n >= window else all_
            elif removed[row]:
                cover = np.zeros(n + 1, np.int32)
                for x in removed[row]:
                    for k in range(x["mask"].bit_length()):
                        if x["mask"] >> k & 1:
                            cover[x["at"] + k] += 1
                            cover[x["at"] + k + window] -= 1
                left = list(compress(all_, np.cumsum(cover[:n]) == 0))
            joined = b" ".join(left)
            totals.append(n)
            gone.append(n - len(left))
            digests.append(hashlib.sha256(joined).hexdigest())
            kept.append(joined.decode() if len(left) < n else texts[row].as_py())
    names = [f.name for f in batch.schema if not f.name.startswith("_")]
    made = [pa.array(kept, pa.string()), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
    return pa.RecordBatch.from_arrays(
        [batch.column(c) for c in names] + made, names + ["_kept_text", "_n_words", "_n_removed", "_kept_sha256"]
    )


def without_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """``docs`` (doc_id, text, any others) with ``_kept_text``, ``_n_words``, ``_n_removed``, ``_kept_sha256`` added.

    Words are runs of characters other than space and 0x09-0x0D. A word goes if a window of ``window`` consecutive
    words covers it whose words also start earlier: at a smaller doc_id, or earlier in the same document; windows are judged on
    the input. Between kept words stands one space; a text that loses nothing stays as it is (the digest is always
    of the joined words). Null text has no words and stays null; texts shorter than a window lose nothing. Rows that repeat a
    doc_id with the same text are one place and lose nothing to each other; rows with a null doc_id are not compared.
    Columns whose names begin with an underscore are left out. An empty table gives an empty table.
    """
    if not GRAM < window <= GRAM + 58:
        raise ValueError(f"window: {GRAM + 1} to {GRAM + 58} words")
    others = [c for c in docs.columns if not c.startswith("_")]
    # A cast only where it is needed: an alias in one of the two joins would keep Spark from using its shuffle for both.
    kinds = {"doc_id": "bigint", "text": "string"}
    docs = docs.select(*others).withColumns({c: F.col(c).cast(t) for c, t in kinds.items() if dict(docs.dtypes)[c] != t})
    known = docs.where("doc_id IS NOT NULL")
    texts = known.select("doc_id", "text")

    # Equal texts: all windows of a later one also start in the first.
    keyed = texts.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("x"), F.sha2("text", 256).alias("s"))
    first = keyed.groupBy("x", "s").agg(F.min("doc_id").alias("first"))
    copies = cut(
        keyed.join(first, ["x", "s"]).groupBy("doc_id").agg(F.min(F.col("doc_id") > F.col("first")).alias("_copy")).where("_copy")
    )

    found = map_batches(texts, lambda b: _minimizers(b, window), "m long, doc_id long, at int")
    often = found.groupBy("m").agg(F.count("*").alias("c")).where("c > 1")
    wanted = (
        found.join(often, "m").groupBy("doc_id")
        .agg(F.collect_set(F.col("at") * 2 + (F.col("c") > FINE).cast("int")).alias("_wanted"))
        .join(copies, "doc_id", "left_anti")
    )
    # Both joins read all columns of the same rows by doc_id, so that one shuffle of the texts serves both.
    runs = known.join(wanted, "doc_id").mapInArrow(lambda batches: _run_texts(batches, window), RUN_SCHEMA)
    sharded = runs.repartition("m").sortWithinPartitions("m", "k1", "k2", "doc_id", "at")
    later = sharded.mapInArrow(lambda batches: _shards(batches, window), "doc_id long, at int, mask long")
    removed = later.groupBy("doc_id").agg(F.collect_list(F.struct("at", "mask")).alias("_removed"))
    marks = removed.join(copies, "doc_id", "full_outer")
    marked = known.join(marks, "doc_id", "left").select(*others, "_removed", F.coalesce("_copy", F.lit(False)).alias("_copy"))
    unknown = docs.where("doc_id IS NULL").select(*others, F.lit(None).cast("array<struct<at:int,mask:bigint>>").alias("_removed"), F.lit(False).alias("_copy"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    return map_batches(
        marked.union(unknown), lambda b: _kept(b, window), schema + "_kept_text string, _n_words long, _n_removed long, _kept_sha256 string"
    )
