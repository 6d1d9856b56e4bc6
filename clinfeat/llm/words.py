"""Words of whole texts as numpy arrays, and 64-bit hashes of words and word runs.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text. A batch of texts is worked
through in blocks of about ``BLOCK`` bytes (one text at least), so memory follows the longest text, not the batch.
Hashes are polynomial over the bytes, then mixed; sixty-four bits, seeds fixed below.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_BASE, _RUN = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_POWERS: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64, for i below n."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BLOCK + (BLOCK >> 3))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Block:
    """Texts ``first_row`` to ``first_row + rows`` of a batch; null counts as empty.

    ``starts``/``ends``: bytes of each word in ``data``. ``bounds``: the words of row i are bounds[i]:bounds[i + 1].
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first_row: int, between: np.ndarray = _SPACE):
        self.data, self.offsets, self.first_row, self.rows = data, offsets, first_row, len(offsets) - 1
        inside = ~between[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        before[edges], after[edges - 1] = False, False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        up, down = powers(len(self.data) + 1)
        table = _BYTE[_LOWER] if lower else _BYTE
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(table[self.data] * up[:-1], out=total[1:])
        size = (self.ends - self.starts).astype(np.uint64)
        return mix((total[self.ends] - total[self.starts]) * down[self.starts] + size * np.uint64(_RUN))


def blocks(texts: pa.Array, between: np.ndarray = _SPACE):
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, "right")) - 1)
        stop = min(stop, len(texts))
        yield Block(data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row], row, between)
        row = stop


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on, also across texts; mind the bounds."""
    size = max(0, len(hashes) - n + 1)
    out = np.full(size, n, np.uint64)
    for j in range(n):
        out = out * np.uint64(_RUN) + hashes[j:j + size]
    return mix(out)


def shingles(block: Block, n: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text, sorted: (hashes, bounds by row).

    A text with fewer than n words has its whole sequence as its only shingle; one without words has none.
    """
    hashes = block.word_hashes(lower)
    row, place = block.row_of_word(), np.arange(len(hashes))
    left = block.bounds[1:][row] - place
    rows, found = [], []
    whole = run_hashes(hashes, n)
    fits = left[:len(whole)] >= n
    rows.append(row[:len(whole)][fits]), found.append(whole[fits])
    for k in range(1, n):
        at = block.bounds[:-1][block.counts == k]
        if len(at):
            rows.append(row[at]), found.append(run_hashes(hashes, k)[at])
    rows, found = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((found, rows))
    rows, found = rows[order], found[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
    rows, found = rows[new], found[new]
    return found, np.searchsorted(rows, np.arange(block.rows + 1))
