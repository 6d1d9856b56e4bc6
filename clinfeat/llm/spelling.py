"""Groups of spelling variants: every word's near words (one edit away) by k-d trees over letter counts.

One inserted, deleted or replaced code point moves a word's vector of letter counts by at most one up and one down, so by an L1
distance of at most two; an insertion only goes up. Words of one length are searched among those of the same length (one
up, one down) and of the next (one up). What a search finds is verified letter by letter.

Counts are held as steps, a bit for "at least t of this letter": a split of a tree is a bit, the box of a node is the bits that all its
points have and those that any has, and the way from a vector to a box is two counts of bits. Counts beyond ``STEPS``
and accented letters that share a place only bring vectors closer, never apart.

The upper levels of each length's tree are chosen on a bounded sample of ``SAMPLE`` words a length and cut all words into cells of
about ``CELL``. A word lies in one cell and asks in every cell that its one up and one down can reach. In a task the cell's
tree goes on to small leaves, its boxes drawn around the points it has. Cells with very many points or questions (words of
the same letters, say) are dealt into blocks, every block of points against every block of questions.
"""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from clinfeat.llm.shared import cut

SAMPLE = 20_000  # words of each length that the upper levels are chosen on
CELL, LEAF = 4096, 32
MOST_POINTS, MOST_QUESTIONS = 16_384, 262_144  # of a task's group
LONG = 40  # words of this length and above share a tree
TASK_WORDS = 500_000  # distinct words that a task adds up before it passes them on
PLACES, STEPS = 32, 4

# One byte a code point: letters A-Z become small, U+00C0 to U+00FF stay, all others end a word.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))
_PLACE = np.array([b - 97 if 97 <= b <= 122 else 26 + b % 6 for b in range(256)])


def _counted(batches, least: int, one_in: int):
    total: Counter = Counter()

    def out():
        words = [w.decode("latin-1") for w in total]
        made = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        total.clear()
        return made

    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            text = text.as_py()
            if not text:
                continue
            runs = Counter(w for w in text.encode("latin-1", "replace").translate(_LETTERS).split() if len(w) >= least)
            start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for word, n in runs.items():
                if one_in:
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                    if h % one_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least:
                            continue
                total[word] += n
            if len(total) >= TASK_WORDS:
                yield out()
    if total:
        yield out()


def counted_words(docs: DataFrame, least: int = 7, occurrences: int = 2, one_in: int = 0) -> DataFrame:
    """(word, n) of ``docs`` (doc_id, text): runs of A-Z, a-z and U+00C0 to U+00FF in whole texts, A-Z in lower case.

    Words of at least ``least`` code points that occur at least ``occurrences`` times. With ``one_in``, runs are worn first: where
    that number divides h, the unsigned crc32 of ``<doc_id>:<run>``, the run loses its code point h % length. Null texts hold
    none; a null doc_id reads as empty; rows that repeat others count again.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(lambda batches: _counted(batches, least, one_in), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


class Words:
    """Words as bytes of one array, a byte for each code point, and the step bits of their counts (two 64-bit numbers a word)."""

    def __init__(self, words: pa.Array):
        words = words.cast(pa.large_binary())
        _, offsets, data = words.buffers()
        self.offsets = np.frombuffer(offsets, np.int64)[words.offset:words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data, self.offsets = data[self.offsets[0]:self.offsets[-1]], self.offsets - self.offsets[0]
        self.sizes = np.diff(self.offsets)
        row = np.repeat(np.arange(len(words)), self.sizes)
        counts = np.bincount(row * PLACES + _PLACE[self.data], minlength=len(words) * PLACES).reshape(-1, PLACES)
        bits = counts[:, :, None] > np.arange(STEPS)
        self.bits = np.packbits(bits.reshape(len(words), -1), axis=1, bitorder="little").view(np.uint64)

    def matrix(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Letters of the words, filled up with zeros."""
        at = self.offsets[rows][:, None] + np.arange(width)
        return np.where(np.arange(width) < self.sizes[rows][:, None], self.data[np.minimum(at, len(self.data) - 1)], 0)


def has(bits: np.ndarray, bit) -> np.ndarray:
    return (bits[:, bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1) > 0


def beyond(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bits x has that y has not."""
    return np.bitwise_count(x & ~y).sum(-1, dtype=np.int64)


def split_bit(bits: np.ndarray) -> int:
    """The bit that parts the points best, or -1 if all are alike."""
    share = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").mean(0)
    bit = int(np.abs(share - 0.5).argmin())
    return bit if 0 < share[bit] < 1 else -1


def upper_tree(sample: np.ndarray, depth: int) -> np.ndarray:
    """The split bits of a full binary tree, children of node i at 2 i + 1 (bit not set) and 2 i + 2; -1 splits nothing off."""
    tree, parts = np.full((1 << depth) - 1, -1), {0: sample}
    for node in range(len(tree)):
        own = parts.pop(node)
        if len(own) > 1:
            tree[node] = split_bit(own)
        side = has(own, tree[node]) if tree[node] >= 0 else np.zeros(len(own), bool)
        parts[2 * node + 1], parts[2 * node + 2] = own[~side], own[side]
    return tree


def cells_of(bits: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """The cell of each point."""
    node = np.zeros(len(bits), np.int64)
    for _ in range((len(tree) + 1).bit_length() - 1):
        bit = tree[node]
        word = np.take_along_axis(bits, (np.maximum(bit, 0) >> 6)[:, None], 1)[:, 0]
        side = (bit >= 0) & ((word >> (np.maximum(bit, 0) & 63).astype(np.uint64)) & np.uint64(1) > 0)
        node = 2 * node + 1 + side
    return node - len(tree)


def reached(bits: np.ndarray, tree: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of every cell that ``up`` counts more and ``down`` fewer can reach (at most one each)."""
    row, node, bits = np.arange(len(bits)), np.zeros(len(bits), np.int64), bits.copy()
    left = np.stack([np.full(len(bits), up), np.full(len(bits), down)])
    for _ in range((len(tree) + 1).bit_length() - 1):
        bit = np.maximum(tree[node], 0)
        word, mask = bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64)
        value = bits[np.arange(len(bits)), word]
        side = (tree[node] >= 0) & (value & mask > 0)
        # One step of one letter: the step below must be there (up), the step above must not (down).
        low, high = bit % STEPS == 0, bit % STEPS == STEPS - 1
        below, above = (value & (mask >> np.uint64(1)) > 0) | low, (value & (mask << np.uint64(1)) > 0) & ~high
        cross = (tree[node] >= 0) & np.where(side, (left[1] > 0) & ~(above & ~high), (left[0] > 0) & below)
        # At the last step a count may be larger than its bits tell, so it may also stay there after a loss: that is the other way.
        other = np.flatnonzero(cross)
        more, moved = left[:, other].copy(), bits[other].copy()
        more[np.where(side[other], 1, 0), np.arange(len(other))] -= 1
        moved[np.arange(len(other)), word[other]] ^= mask[other]
        row, bits, left = np.concatenate([row, row[other]]), np.concatenate([bits, moved]), np.concatenate([left, more], 1)
        node = np.concatenate([2 * node + 1 + side, 2 * node[other] + 1 + ~side[other]])
    return row, node - len(tree)


def search(points: np.ndarray, questions: np.ndarray, up: int, down: int):
    """Yields (question, point) pairs at most ``up`` above and ``down`` below, by a tree over the points."""
    todo = [(np.arange(len(points)), np.arange(len(questions)))]
    while todo:
        own, ask = todo.pop()
        held = points[own]
        asked = questions[ask]
        close = (beyond(np.bitwise_and.reduce(held), asked) <= up) & (beyond(asked, np.bitwise_or.reduce(held)) <= down)
        ask, asked = ask[close], asked[close]
        if not len(ask):
            continue
        bit = split_bit(held) if len(own) > LEAF else -1
        if bit >= 0:
            side = has(held, bit)
            todo += [(own[~side], ask), (own[side], ask)]
            continue
        step = max(1, (1 << 21) // len(own))
        for at in range(0, len(ask), step):
            x, y = asked[at:at + step, None, :], held[None, :, :]
            q, p = np.nonzero((beyond(y, x) <= up) & (beyond(x, y) <= down))
            yield ask[at + q], own[p]


def one_edit(words: Words, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether words x and y differ by exactly one inserted, deleted or replaced letter."""
    out = np.zeros(len(x), bool)
    swap = words.sizes[x] > words.sizes[y]
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    more = words.sizes[y] - words.sizes[x]
    wide = words.sizes[y] > 4 * LONG
    for i in np.flatnonzero((more <= 1) & wide):
        a, b = (words.data[words.offsets[k]:words.offsets[k + 1]] for k in (x[i], y[i]))
        other = np.flatnonzero(a != b[:len(a)])
        if more[i]:
            k = other[0] if len(other) else len(a)
            out[i] = (a[k:] == b[k + 1:]).all()
        else:
            out[i] = len(other) == 1
    for n in (0, 1):
        for width in np.unique(words.sizes[y[(more == n) & ~wide]]):
            at = np.flatnonzero((more == n) & (words.sizes[y] == width))
            b = words.matrix(y[at], width)
            a = words.matrix(x[at], width - n)
            differ = a != b[:, :width - n]
            if n:
                k = np.where(differ.any(1), differ.argmax(1), width - 1)
                out[at] = ((a == b[:, 1:]) | (np.arange(width - 1) < k[:, None])).all(1)
            else:
                out[at] = differ.sum(1) == 1
    return out


POINT, SAME, LONGER = 0, 1, 2  # a cell's words: its points, questions of the tree's own words, questions of words one shorter


def _routed(batch: pa.RecordBatch, trees: dict[int, np.ndarray]):
    """(tree, cell, kind, row) of a batch of words, one kind and tree at a time."""
    words = Words(batch.column("word"))
    group = np.minimum(words.sizes, LONG)
    for size in np.unique(group):
        rows = np.flatnonzero(group == size)
        bits = words.bits[rows]
        yield int(size), cells_of(bits, trees[int(size)]), POINT, rows
        at, cell = reached(bits, trees[int(size)], 1, 1)
        yield int(size), cell, SAME, rows[at]
        if int(size) + 1 in trees and size < LONG:
            at, cell = reached(bits, trees[int(size) + 1], 1, 0)
            yield int(size) + 1, cell, LONGER, rows[at]


def _sizes(batches, trees):
    """(tree, cell, points, questions) of a task's words."""
    total: Counter = Counter()
    for batch in batches:
        for tree, cell, kind, _ in _routed(batch, trees):
            number, n = np.unique(cell, return_counts=True)
            for c, k in zip(number.tolist(), n.tolist()):
                total[tree, c, kind > POINT] += k
    keys = sorted({k[:2] for k in total})
    yield pa.RecordBatch.from_arrays([
        pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()),
        pa.array([total[*k, False] for k in keys], pa.int64()), pa.array([total[*k, True] for k in keys], pa.int64()),
    ], ["tree", "cell", "points", "questions"])


def _dealt(batches, trees):
    for batch in batches:
        for tree, cell, kind, rows in _routed(batch, trees):
            for at in range(0, len(rows), 50_000):
                own, part = rows[at:at + 50_000], cell[at:at + 50_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(own), tree, np.int32)), pa.array(part), pa.array(np.full(len(own), kind, np.int32)),
                    batch.column("word").take(pa.array(own)), batch.column("n").take(pa.array(own)),
                ], ["tree", "cell", "kind", "word", "n"])


def _found(group: pa.Table) -> pa.Table:
    """(word, n_near, best_n, best_word) of the words that have near ones in the group, each pair told to both its ends once."""
    kind, n = group.column("kind").to_numpy(), group.column("n").to_numpy()
    raw = group.column("word").combine_chunks()
    words = Words(raw)
    points = np.flatnonzero(kind == POINT)
    order = np.lexsort((pc.rank(raw, tiebreaker="dense").to_numpy(), -n))  # larger n first, then code-point order
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    near, best = np.zeros(len(kind), np.int64), np.full(len(kind), len(kind), np.int64)

    def tell(x, y):
        near[:] += np.bincount(x, minlength=len(near))
        np.minimum.at(best, x, rank[y])

    for asked, up, down in ((SAME, 1, 1), (LONGER, 1, 0)):
        ask = np.flatnonzero(kind == asked)
        if not len(points) or not len(ask):
            continue
        for q, p in _gathered(search(words.bits[points], words.bits[ask], up, down)):
            q, p = ask[q], points[p]
            hit = one_edit(words, q, p)
            tell(q[hit], p[hit])
            if asked == LONGER:
                tell(p[hit], q[hit])
    with_near = np.flatnonzero(near)
    other = order[best[with_near]]
    return pa.table({
        "word": raw.take(pa.array(with_near)), "n_near": near[with_near], "best_n": n[other], "best_word": raw.take(pa.array(other)),
    })


def _gathered(pairs, size: int = 200_000):
    q, p, held = [], [], 0
    for x, y in pairs:
        q.append(x)
        p.append(y)
        held += len(x)
        if held >= size:
            yield np.concatenate(q), np.concatenate(p)
            q, p, held = [], [], 0
    if held:
        yield np.concatenate(q), np.concatenate(p)


def _bits(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([
            pa.array([x.tobytes() for x in Words(batch.column("word")).bits], pa.binary()), batch.column("size"),
        ], ["bits", "size"])


def _trees(words: DataFrame) -> dict[int, np.ndarray]:
    """The upper tree of each length; at most ``SAMPLE`` vectors of 16 bytes a length come to the driver."""
    size = F.least(F.length("word"), F.lit(LONG)).alias("size")
    counts = {r["size"]: r["n"] for r in words.groupBy(size).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, SAMPLE / n))])
    chance = F.pmod(F.xxhash64("word", F.lit(12)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample: dict[int, list] = {k: [] for k in counts}
    rows = words.select("word", size).where(chance < share[F.col("size")]).select(F.col("word").cast("binary").alias("word"), "size")
    for r in rows.mapInArrow(_bits, "bits binary, size int").toLocalIterator():
        sample[r["size"]].append(r["bits"])
    out = {}
    for k, found in sample.items():
        bits = np.frombuffer(b"".join(sorted(found)), np.uint64).reshape(-1, 2)
        depth = max(0, (-(-counts[k] // CELL) - 1).bit_length())
        out[k] = upper_tree(bits, min(depth, max(0, (len(bits) // 16).bit_length() - 1)))
    return out


def _near(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best_word) of the words that have near ones; ``words``: (word, n) with words as bytes."""
    trees = _trees(words.select(F.decode("word", "ISO-8859-1").alias("word")))
    schema = "word binary, n_near long, best_n long, best_word binary"
    if not trees:
        return words.sparkSession.createDataFrame([], schema)
    shipped = words.sparkSession.sparkContext.broadcast(trees)  # a number for each cell, of which there are at most SAMPLE / 16 a length
    cells = (
        words.mapInArrow(lambda batches: _sizes(batches, shipped.value), "tree int, cell long, points long, questions long")
        .groupBy("tree", "cell").agg(F.sum("points").alias("points"), F.sum("questions").alias("questions"))
    )
    blocks = cells.select(
        "tree", "cell", F.ceil(F.col("points") / MOST_POINTS).alias("by_point"), F.ceil(F.col("questions") / MOST_QUESTIONS).alias("by_question"),
    ).where("by_point > 1 OR by_question > 1")
    blocks = cut(blocks)
    dealt = words.mapInArrow(lambda batches: _dealt(batches, shipped.value), "tree int, cell long, kind int, word binary, n long")
    # At most one row for every MOST_POINTS words; broadcast while that is few.
    few = blocks.limit(100_001).count() <= 100_000
    dealt = dealt.join(F.broadcast(blocks) if few else blocks, ["tree", "cell"], "left")

    def block(of: str, is_own: Column) -> Column:
        """The word's own block of its kind, and all blocks of the other kind."""
        n = F.coalesce(of, F.lit(1)).cast("long")
        own = F.pmod(F.xxhash64("word"), n)
        return F.explode(F.when(is_own | (n == 1), F.array(own)).otherwise(F.sequence(F.lit(0).cast("long"), n - 1)))

    point = F.col("kind") == POINT
    dealt = dealt.withColumn("p", block("by_point", point)).withColumn("q", block("by_question", ~point))
    return (
        dealt.select("tree", "cell", "p", "q", "kind", "word", "n").groupBy("tree", "cell", "p", "q").applyInArrow(_found, schema)
    )


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n).

    ``n_near``: words exactly one inserted, deleted or replaced code point away. ``form``: the near word of largest n (ties: first
    in code-point order) if that n is at least ``ratio`` times the word's, else null; ``form_n`` its n. ``root``: where
    following forms ends. Words are distinct, of letters a-z and U+00C0 to U+00FF; null words and counts are left out; other columns are
    ignored. An empty table gives no rows. No pair is left out, however many words have the same letters.
    """
    rows = cut(words.where("word IS NOT NULL AND n IS NOT NULL").select(F.encode("word", "ISO-8859-1").alias("word"), F.col("n").cast("long").alias("n")))
    first = F.min(F.struct((-F.col("best_n")).alias("order"), F.col("best_word").alias("best")))
    near = _near(rows).groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first"))
    near = near.select("word", "n_near", F.col("first.best").alias("best"), (-F.col("first.order")).alias("best_n"))
    has_form = F.col("best_n") >= ratio * F.col("n")
    found = cut(rows.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(has_form, F.col("best")).alias("form"), F.when(has_form, F.col("best_n")).alias("form_n"),
    ))
    roots = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # n grows by the ratio at each step, so a chain is short, and every round halves what is left of it
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = cut(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = roots.where("moved").limit(1).count()
        roots = roots.select("word", "root")
        if not moved:
            break
    text = lambda c: F.decode(c, "ISO-8859-1").alias(c)
    return found.join(roots, "word", "left").select(
        text("word"), text("form"), F.decode(F.coalesce("root", "word"), "ISO-8859-1").alias("root"), "n", "n_near", "form_n"
    )
