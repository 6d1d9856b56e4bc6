"""Hierarchical packing of tokenized documents into windows of several lengths.

Every document is cut into full windows of the longest context and a remainder, which is routed to the smallest tier that holds it. Tiers are
packed from the longest to the shortest: a tier's longest waiting piece opens a window of the tier's length, and its gap is filled from the shorter
tiers, then from its own, by the longest piece that fits; where none fits, the smallest that does not is cut. So windows are full, and as
tiers are powers of two none needs padding. Pieces that no longer fill a window of their tier wait for more; at a task's
end they go to windows of smaller powers of two. A task holds at most ``PENDING`` remainders, and texts are not shuffled.

Windows of all tasks are dealt to step groups of about ``group`` windows, length by length and from the costliest (sum of squared piece
lengths, in ``GRADES``) to the cheapest, back and forth, so that groups hold equally many windows of every length and cost about the same.
"""

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from clinfeat.llm import tokens
from clinfeat.sources.stages import materialize

PENDING = 2048
GRADES = 16
MOST_BROADCAST = 500_000  # rows of 40 bytes


def _length(piece) -> int:
    return len(piece[2])


class Packer:
    """Fills windows; ``full`` collects (window length, [(document, start, ids), ...])."""

    def __init__(self, context: int, tiers: int):
        self.context = context
        self.limits = [context >> (tiers - 1 - i) for i in range(tiers)]
        self.waiting: list[list] = [[] for _ in self.limits]  # by length
        self.tokens, self.pieces, self.full = [0] * tiers, 0, []

    def add(self, document, ids: np.ndarray) -> None:
        start = 0
        while len(ids) - start >= self.context:
            self.full.append((self.context, [(document, start, ids[start:start + self.context])]))
            start += self.context
        if start < len(ids):
            self._wait((document, start, ids[start:]))

    def _wait(self, piece) -> None:
        tier = bisect_left(self.limits, _length(piece))
        queue = self.waiting[tier]
        queue.insert(bisect_right(queue, _length(piece), key=_length), piece)
        self.tokens[tier] += _length(piece)
        self.pieces += 1

    def _out(self, tier: int, at: int):
        piece = self.waiting[tier].pop(at)
        self.tokens[tier] -= _length(piece)
        self.pieces -= 1
        return piece

    def _filler(self, top: int, room: int):
        """Of the tiers up to ``top`` the longest piece that fits, shorter tiers first; else a part of the smallest that does not."""
        for tier in [*range(top - 1, -1, -1), top]:
            at = bisect_right(self.waiting[tier], room, key=_length) - 1
            if at >= 0:
                return self._out(tier, at)
        tier = next(t for t in range(top + 1) if self.waiting[t])
        document, start, ids = self._out(tier, 0)
        self._wait((document, start + room, ids[room:]))
        return document, start, ids[:room]

    def _window(self, top: int, size: int) -> None:
        window = []
        if size == self.limits[top] and self.waiting[top]:
            window.append(self._out(top, len(self.waiting[top]) - 1))
        room = size - sum(map(_length, window))
        while room:
            window.append(self._filler(top, room))
            room -= _length(window[-1])
        self.full.append((size, window))

    def pack(self, last: bool = False) -> None:
        """All full windows of the tiers; at the end also smaller ones of powers of two, until nothing waits."""
        for top in range(len(self.limits) - 1, -1, -1):
            while self.waiting[top] and sum(self.tokens[:top + 1]) >= self.limits[top]:
                self._window(top, self.limits[top])
        while last and sum(self.tokens):
            self._window(len(self.limits) - 1, min(self.context // 2, 1 << sum(self.tokens).bit_length() - 1))


def _packed(batches, path: str, context: int, tiers: int, end: int):
    encode, packer = tokens.encoder(path, special=True), Packer(context, tiers)
    part, number = TaskContext.get().partitionId(), 0
    counts: dict[tuple, int] = {}
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "window", "grade", "part", "nth"]
    types = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 7

    def out():
        nonlocal number
        columns = [[] for _ in names]
        windows, packer.full = packer.full, []
        for size, pieces in windows:
            grade = min(GRADES - 1, GRADES * sum(_length(p) ** 2 for p in pieces) // size ** 2)
            offset, nth = 0, counts.get((size, grade), 0)
            counts[size, grade] = nth + 1
            for (doc, total), start, ids in pieces:
                row = (doc, start, len(ids), ids.tobytes(), total, part << 32 | number, offset, size, grade, part, nth)
                for column, x in zip(columns, row):
                    column.append(x)
                offset += len(ids)
            number += 1
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            ids = np.array([*encode(text.as_py() or ""), end], "<u4")
            packer.add((doc, len(ids)), ids)
            if packer.pieces >= PENDING or len(packer.full) >= PENDING:
                packer.pack()
                yield out()
    packer.pack(last=True)
    if packer.full:
        yield out()


def pack(docs: DataFrame, path: str, context: int = 1024, tiers: int = 4, group: int = 64, end: int = 0) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset, window, step_group) of ``docs`` (doc_id, text).

    A document is the ids that the tokenizer file's plain call gives (strings of special tokens are those tokens) and then ``end``; null text
    is empty, so it is one token. ``ids``: little-endian 32-bit numbers. Each id lies in exactly one piece; ``offset`` counts in
    the sequence from 0 without gaps; ``window`` is the sequence's length, a power of two up to ``context``. Step groups are numbered from 0, and
    their numbers of windows of one length differ by one at most. A null doc_id and rows that repeat one are packed like any others. Other
    columns are ignored; an empty table gives no rows. ``context`` is a power of two; ``path`` must be readable on the executors.
    """
    if context & (context - 1) or not 0 < tiers <= context.bit_length():
        raise ValueError("context: a power of two; tiers: halvings of it")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialize(rows.mapInArrow(
        lambda batches: _packed(batches, path, context, tiers, end),
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, window long, grade long, part long, nth long",
    ), "packed")
    counts = pieces.where("offset = 0").groupBy("window", "grade", "part").agg(F.count("*").alias("n"))  # some rows for each task
    own, longer = W.partitionBy("window").orderBy(F.desc("grade"), "part"), W.orderBy(F.desc("window"))
    before = own.rowsBetween(W.unboundedPreceding, -1)
    sums = counts.groupBy("window").agg(F.sum("n").alias("total")).withColumn("shift", F.sum("total").over(longer) - F.col("total"))
    first = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n").join(F.broadcast(sums), "window")
    windows, rows = counts.agg(F.sum("n"), F.count("*")).first()
    groups = F.lit(max(1, -(-(windows or 0) // group)))
    # Lap by lap over the groups, so a length's last lap, which is not full, goes forth and the next length goes on behind it.
    at = F.col("first") + F.col("nth")
    lap, place = F.floor(at / groups), F.pmod(at, groups)
    forth = (F.floor((F.col("total") - 1) / groups) - lap) % 2 == 0
    step = F.pmod(F.when(forth, place).otherwise(groups - 1 - place) + F.col("shift"), groups)
    return pieces.join(F.broadcast(first) if rows <= MOST_BROADCAST else first, ["window", "grade", "part"]).select(
        "doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "window", step.cast("long").alias("step_group")
    )
