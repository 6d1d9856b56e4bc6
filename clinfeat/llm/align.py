"""Alignment of two tokenizers over the same bytes, with corpus-wide counts of linked id pairs.

Tokenizer A is a byte-level BPE file and reads a space and the text; tokenizer B is a sentence-piece file, which adds that space
itself. Where tokens of both end at the same byte a group ends; every A token of a group is linked with every B token of it.

No token of either crosses from a word to the white space behind it (read off B's vocabulary when it is loaded), so a text falls
into units, a run of white space and a word, whose tokens and groups do not depend on their neighbours. Each
distinct unit of a block is aligned once.

1. Texts are written in blocks of about ``BLOCK`` bytes. The first pass gives each block's distinct id pairs with the number of its documents
   that hold them, by bucket (a hash of the A id).
2. In each bucket the distinct keys are united in a tree, and a minimal perfect hash is built on them: levels of bit arrays,
   where keys that meet nobody take a place and the others go on to the next level; the rank of a key's bit is its index.
3. Every part of a bucket's blocks becomes a dense count vector under that hash, and the vectors are summed in a tree. Keys are verified
   against the table at their index.
4. The blocks' keys are looked up, and the second pass aligns each block's texts again beside its counts.

A group of a shuffle holds one block, or ``FAN`` blocks' entries of one bucket; nothing is broadcast.
"""

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from clinfeat.llm import tokens, words
from clinfeat.llm.shared import cut
from clinfeat.sources.stages import materialize

BLOCK = 8 << 20  # bytes of text
STRING = 1024
MANY_LINKS = 1 << 16  # beyond so many links of a group, its distinct ids are paired instead of its tokens
BUCKETS = 64
FAN = 256
_HASH_LEVELS, _ROOM = 64, 2


_MARK = "\x1f"
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: White space in front, at the end, or beside other white space; also the mark.
_BLANKS = rf"^{_SPACE}|{_SPACE}{_SPACE}|{_SPACE}$|{_MARK}"


class Aligner:
    """Cuts texts into units and aligns both tokenizers' tokens of a unit."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.encode_a = tokens.encoder(path_a, special=False)
        self.bytes_a = tokens.byte_level_bytes(path_a)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b, plain = [], []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes_b.append(bytes([int(piece[3:5], 16)]))
            elif self.model.is_control(i) or self.model.is_unknown(i):
                self.bytes_b.append(b"")
            else:
                plain.append(piece.replace("▁", " "))
                self.bytes_b.append(plain[-1].encode())
        self.size_a, self.size_b = (np.array([len(x) for x in side]) for side in (self.bytes_a, self.bytes_b))
        # A unit begins at one of these characters behind a word, if no piece holds the character anywhere but in front.
        self.fronts = "".join(c for c in " \n\t" if not any(re.search(rf"\S{c}" if c == " " else rf".{c}", x, re.S) for x in plain))
        self.plain = {" ", "\n"} <= set(self.fronts)
        inner = rf"[^\S{self.fronts}]"
        self.units = re.compile(rf"\s*+\S++(?:{inner}\s*+\S*+)*+(?:\s++\Z)?+|\s++" if self.fronts else r"[\s\S]+")

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct units, unit numbers, first and last + 1 of each text's numbers); null and empty texts have none.

        Texts without white space in front, at the end, or side by side are cut by Arrow at every space and line break.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        plain = pc.fill_null(pc.invert(pc.match_substring_regex(texts, _BLANKS)), False).to_numpy(zero_copy_only=False) & self.plain
        plain &= pc.binary_length(texts).to_numpy() > 0
        easy, hard = np.flatnonzero(plain), np.flatnonzero(~plain)
        marked = texts.take(pa.array(easy))
        for c in " \n":
            marked = pc.replace_substring(marked, c, _MARK + c)
        front, nothing = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
        cuts = pc.split_pattern(pc.binary_join_element_wise(front, marked, nothing), _MARK)
        own = [self.units.findall(" " + x) if x else [] for x in texts.take(pa.array(hard)).to_pylist()]
        rest = pa.array(list(chain.from_iterable(own)), pa.large_string())
        found = pa.concat_arrays([cuts.flatten(), rest]).dictionary_encode()
        sizes = np.concatenate([pc.list_value_length(cuts).to_numpy(), [len(x) for x in own]]).astype(np.int64)
        first, stop, order = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64), np.concatenate([easy, hard])
        stop[order] = np.cumsum(sizes)
        first[order] = stop[order] - sizes
        return found.dictionary, found.indices.to_numpy().astype(np.int64), first, stop

    def _ids_b(self, strings: list[str]) -> list[list[int]]:
        """The model puts a space in front; no piece joins it with another front character."""
        own = self.model.encode([x[1:] if x[0] == " " else x for x in strings], num_threads=1)
        return [ids if x[0] == " " else ids[1:] for x, ids in zip(strings, own)]

    def tokens(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(A ids, B ids, lost): the tokens of all units on end, and which units a tokenizer does not give back (these have none).

        Units are encoded in strings of about ``STRING`` bytes; one that ends in white space ends its string.
        """
        if not len(units):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        _, offsets, data = units.buffers()
        offsets = np.frombuffer(offsets, np.int64)[units.offset:units.offset + len(units) + 1]
        blank = pc.match_substring_regex(units, _SPACE + "$").to_numpy(zero_copy_only=False)
        lap = (offsets[1:] - offsets[0]) // STRING
        last = np.flatnonzero(blank | (lap != np.append(lap[1:], -1))) + 1
        out, lost = ([], []), np.zeros(len(units), bool)
        first = [0, *last.tolist()]
        raws = [data[offsets[i]:offsets[j]].to_pybytes() for i, j in zip(first, first[1:])]
        strings = [x.decode() for x in raws]
        for k, (string, raw, b) in enumerate(zip(strings, raws, self._ids_b(strings))):
            a = self.encode_a(string)
            if b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b)):
                out[0].append(a)
                out[1].append(b)
            elif first[k + 1] - first[k] == 1:
                lost[first[k]] = True
            else:
                for i in range(first[k], first[k + 1]):
                    *own, gone = self.tokens(units.slice(i, 1))
                    lost[i] = gone[0]
                    out[0].append(own[0])
                    out[1].append(own[1])
        return *(np.fromiter(chain.from_iterable(side), np.int64) for side in out), lost


class Units:
    """Aligned distinct units: sums, digest text, and links of each: ``keys`` from ``starts[i]`` on, linked ``often`` times (may repeat)."""

    def __init__(self, units: pa.Array, aligner: Aligner, texts: bool):
        a, b, self.lost = aligner.tokens(units)
        sizes = np.where(self.lost, 0, pc.binary_length(units).to_numpy())
        ends_a, ends_b, last = np.cumsum(aligner.size_a[a]), np.cumsum(aligner.size_b[b]), np.cumsum(sizes)
        ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
        to_a, to_b = (np.concatenate([[0], np.searchsorted(x, ends, "right")]) for x in (ends_a, ends_b))
        of = np.concatenate([[0], np.searchsorted(ends, last, "right")])  # the groups of unit i are of[i]:of[i + 1]
        if len(units) and (ends[of[1:][~self.lost] - 1] != last[~self.lost]).any():
            raise ValueError("a token crosses units")
        n_a, n_b = np.diff(to_a), np.diff(to_b)
        running = np.concatenate([[0], np.cumsum(n_a * n_b)])
        self.sums = np.stack([np.diff(to_a[of]), np.diff(to_b[of]), np.diff(of), np.diff(running[of])])

        unit_of = np.repeat(np.arange(len(units)), np.diff(of))
        small = n_a * n_b <= MANY_LINKS
        links = np.where(small, n_a * n_b, 0)
        group = np.repeat(np.arange(len(ends)), links)
        at = np.arange(len(group)) - np.repeat(np.cumsum(links) - links, links)
        unit, key = [unit_of[group]], [a[to_a[group] + at // n_b[group]] << 32 | b[to_b[group] + at % n_b[group]]]
        often = [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(~small):
            x, n = np.unique(a[to_a[g]:to_a[g + 1]], return_counts=True)
            y, m = np.unique(b[to_b[g]:to_b[g + 1]], return_counts=True)
            key.append((x[:, None] << 32 | y).ravel())
            often.append((n[:, None] * m).ravel())
            unit.append(np.full(len(key[-1]), unit_of[g]))
        unit, self.keys, self.often = np.concatenate(unit), np.concatenate(key), np.concatenate(often)
        if not small.all():
            order = np.argsort(unit, kind="stable")
            unit, self.keys, self.often = unit[order], self.keys[order], self.often[order]
        self.starts = np.searchsorted(unit, np.arange(len(units) + 1))

        self.texts = None
        if texts:
            groups, of = _group_texts(a, b, to_a, to_b), of.tolist()
            self.texts = np.array([";".join(groups[i:j]) for i, j in zip(of, of[1:])], object)


def _group_texts(a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> np.ndarray:
    """``a1,a2|b1`` of every group. Groups of a shape whose ids fit one number together are written once for all that are equal."""
    n_a, n_b = np.diff(to_a), np.diff(to_b)
    bits = [max(1, int(x.max()).bit_length()) if len(x) else 1 for x in (a, b)]
    out = np.empty(len(n_a), object)
    fits = n_a * bits[0] + n_b * bits[1] < 63
    for shape in np.unique((n_a << 8 | n_b)[fits]).tolist() if fits.any() else []:
        of = np.flatnonzero(fits & (n_a == shape >> 8) & (n_b == shape & 255))
        number = np.zeros(len(of), np.int64)
        for k in range(shape >> 8):
            number = number << bits[0] | a[to_a[of] + k]
        for k in range(shape & 255):
            number = number << bits[1] | b[to_b[of] + k]
        _, first, back = np.unique(number, return_index=True, return_inverse=True)
        out[of] = _written(a, b, to_a, to_b, of[first])[back]
    rest = np.flatnonzero(~fits)
    out[rest] = _written(a, b, to_a, to_b, rest)
    return out


def _written(a, b, to_a, to_b, groups: np.ndarray) -> np.ndarray:
    out = np.empty(len(groups), object)
    for i, g in enumerate(groups.tolist()):
        out[i] = "|".join(",".join(map(str, x[to[g]:to[g + 1]].tolist())) for x, to in ((a, to_a), (b, to_b)))
    return out


class Texts:
    """Aligned texts of a block. A text without tokens has no units: null, empty, or not given back by both tokenizers."""

    def __init__(self, texts: pa.Array, aligner: Aligner, digests: bool):
        units, self.numbers, self.first, self.stop = aligner.cut(texts)
        self.units = Units(units, aligner, digests)
        if self.units.lost.any():
            gone = np.concatenate([[0], np.cumsum(self.units.lost[self.numbers])])
            self.stop = np.where(gone[self.stop] > gone[self.first], self.first, self.stop)
        self.keys, self.key_of = np.unique(self.units.keys, return_inverse=True)

    def documents(self) -> np.ndarray:
        """For each distinct pair, the number of texts that hold it linked."""
        counts, starts = np.zeros(len(self.keys), np.int64), self.units.starts
        sizes = np.diff(starts)
        for i, j in zip(self.first.tolist(), self.stop.tolist()):
            units = self.numbers[i:j]
            n = sizes[units]
            first = np.repeat(starts[units] - np.cumsum(n) + n, n)
            counts[np.unique(self.key_of[first + np.arange(len(first))])] += 1
        return counts

    def totals(self, counts: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """((n_a, n_b, n_groups, n_links, n_best, count_sum), digest text) of each text, given every pair's count and its A id's highest."""
        units, sums = self.units, [*self.units.sums]
        for each in (units.often * (counts == best)[self.key_of], units.often * counts[self.key_of]):
            running = np.concatenate([[0], np.cumsum(each)])
            sums.append(running[units.starts[1:]] - running[units.starts[:-1]])
        out = []
        for x in sums:
            running = np.concatenate([[0], np.cumsum(x[self.numbers])])
            out.append(running[self.stop] - running[self.first])
        bounds = zip(self.first.tolist(), self.stop.tolist())
        return np.stack(out), [";".join(units.texts[self.numbers[i:j]]) if i < j else "" for i, j in bounds]


def build_hash(keys: np.ndarray) -> list[np.ndarray]:
    """Levels of a minimal perfect hash on distinct 64-bit keys: bit arrays, of about 5 bits a key together.

    A key's place in a level depends on the key and the level alone. Keys that are alone at their place stay there.
    """
    keys, levels = keys.astype(np.uint64), []
    while len(keys):
        size = max(64, _ROOM * len(keys))
        place = _places(keys, len(levels), size)
        count = np.bincount(place, minlength=size)
        levels.append(count == 1)
        keys = keys[count[place] > 1]
        if len(levels) > _HASH_LEVELS:  # chance does not reach it
            raise ValueError("keys are not distinct")
    return levels


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = words.mix(np.array([level + 1], np.uint64) * np.uint64(words._BASE))
    return (words.mix(keys ^ seed) % np.uint64(size)).astype(np.int64)


def index_of(keys: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The index of each key: for the keys of the build a permutation of 0..n-1; for others any index, or -1."""
    out, left, before = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    values = keys.astype(np.uint64)
    for level, bits in enumerate(levels):
        place = _places(values[left], level, len(bits))
        rank = np.cumsum(bits) - 1
        hit = bits[place]
        out[left[hit]] = before + rank[place[hit]]
        before += int(bits.sum())
        left = left[~hit]
    return out


def _verified(keys: np.ndarray, levels: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    index = index_of(keys, levels)
    if len(keys) and (index.min() < 0 or (table[index] != keys).any()):
        raise ValueError("a pair that the hash was not built on")
    return index


def _packed(levels: list[np.ndarray]) -> bytes:
    sizes = np.array([len(levels), *map(len, levels)], "<i8")
    return sizes.tobytes() + b"".join(np.packbits(x).tobytes() for x in levels)


def _unpacked(raw: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    out, at = [], 8 * (n + 1)
    for size in np.frombuffer(raw, "<i8", n, 8).tolist():
        stop = at + -(-size // 8)
        out.append(np.unpackbits(np.frombuffer(raw[at:stop], np.uint8), count=size).astype(bool))
        at = stop
    return out


def _longs(cell) -> np.ndarray:
    return np.frombuffer(cell.as_py(), "<i8")


def _blocks(batches):
    """Rows with their block: the number of the task and that of the block in it."""
    part, filled, number = TaskContext.get().partitionId() << 32, 0, 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False) + 64
        block = np.empty(len(sizes), np.int64)
        for i, size in enumerate(sizes.tolist()):
            if filled and filled + size > BLOCK:
                number, filled = number + 1, 0
            block[i] = part | number
            filled += size
        yield pa.RecordBatch.from_arrays([pa.array(block), *batch.columns], ["block", *batch.schema.names])


def _first_pass(batches, paths: tuple):
    """(block, bucket, keys, counts) of each block in a task's rows; a block may come in several pieces."""
    aligner = Aligner(*paths)

    def out(block, texts):
        found = Texts(texts, aligner, digests=False)
        counts = found.documents()
        keys, counts = found.keys[counts > 0], counts[counts > 0]  # texts that are not given back have no pairs
        bucket = _bucket(keys)
        order = np.argsort(bucket, kind="stable")
        keys, counts, stops = keys[order], counts[order], np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        held = np.flatnonzero(np.diff(stops))
        parts = [slice(stops[k], stops[k + 1]) for k in held]
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(held), block)), pa.array(held.astype(np.int32)),
            pa.array([keys[x].astype("<i8").tobytes() for x in parts], pa.binary()),
            pa.array([counts[x].astype("<i8").tobytes() for x in parts], pa.binary()),
        ], ["block", "bucket", "keys", "counts"])

    now, texts = None, []
    for batch in batches:
        block = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for i, j in zip(cuts, cuts[1:]):
            if i < j and block[i] != now and texts:
                yield out(now, pa.concat_arrays(texts))
                texts = []
            if i < j:
                now = int(block[i])
                texts.append(batch.column("text").slice(i, j - i))
    if texts:
        yield out(now, pa.concat_arrays(texts))


def _bucket(keys: np.ndarray) -> np.ndarray:
    """All pairs of an A id lie in one bucket, so its highest count is known there."""
    return (words.mix((keys >> 32).astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


def _table(rows: list[tuple], schema: list[tuple]) -> pa.Table:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.table({name: pa.array(list(c), kind) for (name, kind), c in zip(schema, columns)})


_KEYED = [("bucket", pa.int32()), ("part", pa.int64()), ("data", pa.binary())]


def _united(group: pa.Table) -> pa.Table:
    keys = np.unique(np.concatenate([_longs(x) for x in group.column("data")]))
    return _table([(group.column("bucket")[0].as_py(), group.column("part")[0].as_py(), keys.tobytes())], _KEYED)


def _hashed(group: pa.Table) -> pa.Table:
    keys = _longs(group.column("data")[0])
    levels = build_hash(keys)
    table = np.empty_like(keys)
    table[index_of(keys, levels)] = keys
    return _table(
        [(group.column("bucket")[0].as_py(), _packed(levels), table.tobytes())],
        [("bucket", pa.int32()), ("hash", pa.binary()), ("table", pa.binary())],
    )


def _vector(entries: pa.Table, hashes: pa.Table) -> pa.Table:
    levels, table = _unpacked(hashes.column("hash")[0].as_py()), _longs(hashes.column("table")[0])
    total = np.zeros(len(table), np.int64)
    for keys, counts in zip(entries.column("keys"), entries.column("counts")):
        total[_verified(_longs(keys), levels, table)] += _longs(counts)
    return _table([(hashes.column("bucket")[0].as_py(), hashes.column("part")[0].as_py(), total.tobytes())], _KEYED)


def _summed(group: pa.Table) -> pa.Table:
    total = np.sum([_longs(x) for x in group.column("data")], axis=0)
    return _table([(group.column("bucket")[0].as_py(), group.column("part")[0].as_py(), total.tobytes())], _KEYED)


def _looked_up(entries: pa.Table, hashes: pa.Table) -> pa.Table:
    """(block, keys, counts, best) for each block's keys of a bucket."""
    rows = []
    if len(entries):
        levels, table, total = _unpacked(hashes.column("hash")[0].as_py()), _longs(hashes.column("table")[0]), _longs(hashes.column("data")[0])
        ids, number = np.unique(table >> 32, return_inverse=True)
        highest = np.zeros(len(ids), np.int64)
        np.maximum.at(highest, number, total)
        for block, keys in zip(entries.column("block"), entries.column("keys")):
            index = _verified(_longs(keys), levels, table)
            rows.append((block.as_py(), keys.as_py(), total[index].tobytes(), highest[number[index]].tobytes()))
    return _table(rows, [("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("best", pa.binary())])


_RESULT = ["_n_a", "_n_b", "_n_groups", "_n_links", "_n_best", "_count_sum"]


class _Once:
    """An aligner that each task loads when it first needs it."""

    def __init__(self, paths: tuple):
        self.paths, self.made = paths, None

    def aligner(self) -> Aligner:
        self.made = self.made or Aligner(*self.paths)
        return self.made


def _second_pass(docs: pa.Table, answers: pa.Table, once: _Once) -> pa.Table:
    found = Texts(docs.column("text").combine_chunks(), once.aligner(), digests=True)
    counts, best = np.zeros((2, len(found.keys)), np.int64)
    for keys, n, most in zip(answers.column("keys"), answers.column("counts"), answers.column("best")):
        at = np.searchsorted(found.keys, _longs(keys))
        counts[at], best[at] = _longs(n), _longs(most)
    sums, digests = found.totals(counts, best)
    made = docs.drop_columns(["block", "text"])
    for k, name in enumerate(_RESULT):
        made = made.append_column(name, pa.array(sums[k]))
    return made.append_column("_groups", pa.array(digests, pa.string()))


def _tree(rows: DataFrame, fold, parts: int) -> DataFrame:
    """(bucket, part, data) folded to one row a bucket, ``FAN`` parts at a time."""
    schema = "bucket int, part long, data binary"
    while True:
        rows = rows.groupBy("bucket", "part").applyInArrow(fold, schema)
        if parts == 1:
            return rows
        parts = -(-parts // FAN)
        rows = rows.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(parts)))


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``docs`` (text, any others) without text, with _n_a, _n_b, _n_groups, _n_links, _n_best, _count_sum and _groups.

    ``_groups``: the ids of both tokenizers by group, as ``a1,a2|b1;a3|b2,b3``. ``_n_best``: links whose pair is held linked by as many
    documents as any pair of its A id; ``_count_sum``: the sum of those numbers over all links. Each row counts as a document, also rows
    that repeat others or have no id. Texts that are null, empty, or whose bytes one tokenizer does not give back
    have no tokens: zeros and an empty text. Columns whose names begin with an underscore, and one named ``block``, are left out.
    An empty table gives no rows. Files at ``path_a`` and ``path_b`` must be readable on the executors.
    """
    paths = (path_a, path_b)
    others = [c for c in docs.columns if not c.startswith("_") and c.lower() not in ("text", "block")]
    rows = docs.select(F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`") for c in others])
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.select(*[f"`{c}`" for c in others]).schema)
    rows = materialize(rows.mapInArrow(_blocks, f"block long, text string{kept}"), "align-texts")
    entries = cut(
        rows.select("block", "text")
        .mapInArrow(lambda batches: _first_pass(batches, paths), "block long, bucket int, keys binary, counts binary")
    )
    parts = max(1, -(-entries.select("block").distinct().count() // FAN))
    entries = entries.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)))
    united = _tree(entries.select("bucket", "part", F.col("keys").alias("data")), _united, parts)
    hashes = cut(united.groupBy("bucket").applyInArrow(_hashed, "bucket int, hash binary, table binary"))

    def by_part(table: DataFrame) -> DataFrame:
        return table.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).groupBy("bucket", "part")

    vectors = (
        entries.groupBy("bucket", "part").cogroup(by_part(hashes)).applyInArrow(_vector, "bucket int, part long, data binary")
    )
    counted = cut(hashes.join(_tree(vectors, _summed, parts).select("bucket", "data"), "bucket"))
    answers = (
        entries.groupBy("bucket", "part").cogroup(by_part(counted))
        .applyInArrow(_looked_up, "block long, keys binary, counts binary, best binary")
    )
    once = _Once(paths)
    schema = kept + "".join(f", {c} long" for c in _RESULT) + ", _groups string"
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        lambda texts, found: _second_pass(texts, found, once), schema[2:]
    )
