"""Language ID of words by a linear-chain conditional random field.

A word is a run of ASCII letters and bytes of other scripts. Its features are hashed: the word itself (lexicon), its prefixes and
suffixes of two to four bytes (affixes) and inner three-byte grams. Weights of features, transitions and first labels are learned by
gradient steps on the conditional likelihood, the expectations by forward-backward, on a bounded sample of labelled
documents whose words are strung together in pieces of changing language, so that transitions learn to switch.

Forward-backward runs over a block of texts at once: it is cut into chunks of equal length, the products of the chunks' step
matrices carry the state from chunk to chunk, and a text's first word forgets what came before. A document's prediction is the
language with the largest expected number of words; the score is that language's share.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clinfeat.llm import words
from clinfeat.llm.shared import map_batches

TABLE_BITS = 18
SAMPLE_PER_LANGUAGE = 150  # expected number of labelled documents of each language to learn from
EPOCHS = 4
BATCH_WORDS = 6000
CHUNK = 64
RATE, PENALTY = 0.5, 1e-6

_BETWEEN = np.ones(256, bool)
_BETWEEN[65:91] = _BETWEEN[97:123] = _BETWEEN[128:] = False


def features(block: words.Block) -> np.ndarray:
    """Table places of each word's features, a row for each kind; 0 stands for none."""
    text = np.concatenate([words._LOWER[block.data].astype(np.uint64), np.zeros(8, np.uint64)])
    starts, ends = block.starts, block.ends
    size = ends - starts
    mask = np.uint64((1 << TABLE_BITS) - 1)
    rows = [block.word_hashes(lower=True) & mask]

    def gram(at, n, kind, fits):
        value = np.full(len(at), kind, np.uint64)
        for j in range(n):
            value = value * np.uint64(257) + text[at + j]
        rows.append(np.where(fits, words.mix(value) & mask, np.uint64(0)))

    for n in (2, 3, 4):
        gram(starts, n, n, size >= n)
        gram(np.maximum(ends - n, 0), n, 8 + n, size >= n)
    for j in (1, 2, 4):
        gram(starts + j, 3, 16, size >= j + 3)
    return np.stack(rows).astype(np.int32)


class Field:
    """The model: ``table`` (places, labels), ``transition`` (from, to), ``first`` (labels)."""

    def __init__(self, labels: list[str]):
        n = len(labels)
        self.labels = labels
        self.table = np.zeros((1 << TABLE_BITS, n), np.float32)
        self.transition = np.zeros((n, n))
        self.first = np.zeros(n)

    def emissions(self, places: np.ndarray) -> np.ndarray:
        out = self.table[places[0]]
        for row in places[1:]:
            out += self.table[row]
        return out.astype(float)

    def marginals(self, emission: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(P(label of a word), expected transitions); ``begins`` marks the first word of each text."""
        total, n = emission.shape
        chunks = -(-total // CHUNK)
        weight = np.ones((chunks * CHUNK, n))
        weight[:total] = np.exp(emission - emission.max(1, keepdims=True))
        fresh = np.ones(chunks * CHUNK, bool)
        fresh[:total] = begins
        weight, fresh = weight.reshape(chunks, CHUNK, n), fresh.reshape(chunks, CHUNK)
        move, start = np.exp(self.transition - self.transition.max()), np.exp(self.first - self.first.max())

        def onward(state, t):  # (..., n) before word t of each chunk -> after it
            fresh_t = fresh[:, t].reshape((chunks,) + (1,) * (state.ndim - 1))
            weight_t = weight[:, t].reshape((chunks,) + (1,) * (state.ndim - 2) + (n,))
            return np.where(fresh_t, state.sum(-1, keepdims=True) * start, state @ move) * weight_t

        product = np.broadcast_to(np.eye(n), (chunks, n, n))
        for t in range(CHUNK):
            product = onward(product, t)
            product = product / product.max((1, 2), keepdims=True)
        ahead, behind = np.empty((chunks, n)), np.empty((chunks, n))
        state = np.full(n, 1 / n)
        for c in range(chunks):
            ahead[c] = state
            state = state @ product[c]
            state = state / state.sum()
        state = np.full(n, 1 / n)
        for c in range(chunks - 1, -1, -1):
            behind[c] = state
            state = product[c] @ state
            state = state / state.sum()
        forward = np.empty((chunks, CHUNK, n))
        state = ahead
        for t in range(CHUNK):
            state = onward(state, t)
            state = state / state.sum(1, keepdims=True)
            forward[:, t] = state
        backward = np.empty((chunks, CHUNK, n))
        state = behind
        for t in range(CHUNK - 1, -1, -1):
            backward[:, t] = state
            carried = weight[:, t] * state
            state = np.where(fresh[:, t, None], (carried * start).sum(1, keepdims=True), carried @ move.T)
            state = state / state.sum(1, keepdims=True)
        forward, backward = forward.reshape(-1, n)[:total], backward.reshape(-1, n)[:total]
        label = forward * backward
        label /= label.sum(1, keepdims=True)
        carried = weight.reshape(-1, n)[1:total] * backward[1:]
        pair = forward[:-1, :, None] * move[None] * carried[:, None, :]
        pair[begins[1:]] = 0
        sums = pair.sum((1, 2), keepdims=True)
        return label, (pair / np.where(sums > 0, sums, 1)).sum(0)

    def learn(self, places: np.ndarray, label: np.ndarray, begins: np.ndarray, memory: dict) -> None:
        """One adaptive gradient step on the likelihood of a batch."""
        n, total = len(self.labels), len(label)
        share, moves = self.marginals(self.emissions(places), begins)
        error = -share
        error[np.arange(total), label] += 1
        inside = ~begins[1:]
        seen = np.zeros((n, n))
        np.add.at(seen, (label[:-1][inside], label[1:][inside]), 1)
        self._step("transition", seen - moves, memory)
        self._step("first", error[begins].sum(0), memory)
        used, back = np.unique(places, return_inverse=True)
        back = back.reshape(places.shape)
        gradient = np.zeros((len(used), n))
        for k in range(n):
            gradient[:, k] = np.bincount(back.reshape(-1), np.tile(error[:, k], len(places)), len(used))
        gradient[used == 0] = 0
        gradient -= PENALTY * total * self.table[used]
        past = memory.setdefault("table", np.zeros(self.table.shape, np.float32))
        past[used] += gradient ** 2
        self.table[used] += (RATE * gradient / np.sqrt(past[used] + 1e-6)).astype(np.float32)

    def _step(self, name: str, gradient: np.ndarray, memory: dict) -> None:
        past = memory.setdefault(name, np.full(gradient.shape, 1e-6))
        past += gradient ** 2
        setattr(self, name, getattr(self, name) + RATE * gradient / np.sqrt(past))


def trained(texts: pa.Array, languages: list[str], labels: list[str]) -> Field:
    """A field learned from whole texts with one language each."""
    field, memory, chance = Field(labels), {}, np.random.default_rng(7)
    places, label = [], []
    number = {x: i for i, x in enumerate(labels)}
    of_row = np.array([number[x] for x in languages])
    for block in words.blocks(texts, _BETWEEN):
        places.append(features(block))
        label.append(of_row[block.first_row + block.row_of_word()])
    places, label = np.concatenate(places, 1), np.concatenate(label)
    for _ in range(EPOCHS):
        cuts, at = [], 0
        while at < len(label):  # pieces of 5 to 60 words, strung together in chance order
            cuts.append(np.arange(at, min(len(label), at + chance.integers(5, 61))))
            at += len(cuts[-1])
        order = np.concatenate([cuts[i] for i in chance.permutation(len(cuts))]) if cuts else np.zeros(0, int)
        for at in range(0, len(order), BATCH_WORDS):
            part = order[at:at + BATCH_WORDS]
            begins = np.zeros(len(part), bool)
            begins[0] = True
            begins[np.flatnonzero(chance.random(len(part)) < 0.005)] = True
            field.learn(places[:, part], label[part], begins, memory)
    return field


def _train(batches, labels: list[str]):
    rows = pa.Table.from_batches(batches, pa.schema([("text", pa.string()), ("lang", pa.string())]))
    field = trained(rows.column("text").combine_chunks(), rows.column("lang").to_pylist(), labels)
    yield pa.RecordBatch.from_arrays(
        [pa.array([x.astype(np.float32).tobytes()]) for x in (field.table, field.transition, field.first)],
        ["table", "transition", "first"],
    )


def fit(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> Field:
    """Learn from rows (doc_id, text, lang) with text and lang; one task sees about ``sample`` whole texts a language.

    The choice is by a hash of doc_id, so the same rows are chosen on every run. Without labelled rows the field has no labels.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}") & F.col("doc_id").isNotNull())
    counts = usable.groupBy("lang").count()
    totals = {r["lang"]: r["count"] for r in counts.collect()}  # one row a language
    field = Field(sorted(totals))
    if not totals:
        return field
    share = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, min(1.0, sample / n))])
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = usable.where(chance < share[F.col("lang")]).select("doc_id", "text", "lang")
    labels = field.labels
    made = (
        chosen.repartition(1).sortWithinPartitions("doc_id", F.xxhash64("text")).select("text", "lang")
        .mapInArrow(lambda batches: _train(batches, labels), "table binary, transition binary, first binary").first()
    )
    n = len(labels)
    field.table = np.frombuffer(made["table"], np.float32).reshape(-1, n)
    field.transition = np.frombuffer(made["transition"], np.float32).reshape(n, n).astype(float)
    field.first = np.frombuffer(made["first"], np.float32).astype(float)
    return field


def labelled_words(field: Field, texts: pa.Array):
    """For each block of texts: (block, P(label) of each word); of the block's words in order."""
    for block in words.blocks(texts, _BETWEEN):
        begins = np.zeros(len(block.starts), bool)
        begins[block.bounds[:-1][block.counts > 0]] = True
        yield block, field.marginals(field.emissions(features(block)), begins)[0] if len(begins) and field.labels else np.zeros((len(begins), len(field.labels)))


def _predicted(batch, field: Field):
    texts = batch.column("_text")
    for block, share in labelled_words(field, texts):
        names, scores = [], []
        mass = np.add.reduceat(np.concatenate([share, np.zeros((1, share.shape[1]))]), block.bounds[:-1]) if share.size else None
        for i in range(block.rows):
            n = block.counts[i]
            raw = block.data[block.offsets[i]:block.offsets[i + 1]]
            letters = n > 0 and (bool(((raw | 32) - 97 < 26).any()) or any(c.isalpha() for c in raw.tobytes().decode()))
            if letters and field.labels:
                best = int(mass[i].argmax())
                names.append(field.labels[best]), scores.append(min(1.0, float(mass[i, best]) / n))
            else:
                names.append("und"), scores.append(0.0)
        part = batch.slice(block.first_row, block.rows)
        keep = [f.name for f in batch.schema if not f.name.startswith("_")]
        yield pa.RecordBatch.from_arrays(
            [part.column(c) for c in keep] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())],
            keep + ["_lang", "_score"],
        )


def predict(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` (text, any others) with ``_lang`` and ``_score`` from the whole text and nothing else.

    Null text, text without a letter, and a field without labels give ``und`` and 0. Equal texts get equal answers;
    of equal masses the first label counts. Columns whose names begin with an underscore are left out.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(field)  # 2 ** TABLE_BITS places for each language
    others = [c for c in docs.columns if not c.startswith("_")]
    rows = docs.select(*others, F.col("text").cast("string").alias("_text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*others).schema)
    return map_batches(rows, lambda batch: _predicted(batch, shipped.value), schema + "_lang string, _score double")
