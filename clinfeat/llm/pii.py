"""Personal data by fixed patterns and a semi-Markov conditional random field that adds what they miss.

Patterns find the plain forms (``base_spans``). The field reads chains: runs of digits with separators between them, and words around an
``@`` or a written-out one. It cuts a chain into segments; a part outside is a segment of its own, an entity spans up to ``MOST_PARTS``
parts. The features describe a whole candidate span (number and lengths of its parts, digits, separators, the check digit, octets, what stands
around it), so boundaries and kinds are chosen together, by dynamic programming over the chain's parts.

It learns from the plain forms of a bounded sample: around each, the span is rewritten into forms that the patterns miss (without
plus sign, dots or blanks between groups, bracketed ``at`` and ``dot``), and into ones that are no personal data (a wrong check digit, an octet
over 255, too few or too many digits); weights and transitions follow the gradient of the conditional likelihood by forward-backward.
"""

import json
import re
import zlib
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from clinfeat.llm.shared import cut, map_batches

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["", *KINDS]  # the first: outside
MOST_PARTS = 8
SAMPLE_PER_KIND = 300  # expected number of plain spans of each kind to learn from, and of short chains without any
AROUND, LONGEST = 32, 100  # characters of a learned window beside a span, and of the longest span in one
EPOCHS, RATE, PENALTY = 4, 0.3, 1e-3

#: Rows that hold none of these hold no candidate.
_TRIGGER = r"[0-9@]|[\[({<] ?(?i:at) ?[\])}>]"

# The patterns of plain forms. They never give back what they took, so each is linear in the text.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_NUMBER = re.compile(r"[0-9]++(?:(?:\[\.\]|[ .()/\xa0-]{1,3})[0-9]++)*+")
_RUN = re.compile(r"[0-9]++")
_AT = re.compile(r" ?[\[({<] ?(?:at|At|AT|@) ?[\])}>] ?| ?@ ?")
_BEFORE = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
_DOT = r"(?:\.| ?[\[({<] ?(?:dot|Dot|DOT|\.) ?[\])}>] ?)"
_LABEL = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,6}}")
_DOTS = re.compile(_DOT)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octet(digits: str) -> bool:
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def _digits(text: str) -> str:
    return "".join(_RUN.findall(text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain forms, leftmost and without overlaps within a kind; matches that fail their test are dropped."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        domain, start = _DOMAIN.match(text, at + 1), at
        while domain and start > done and text[start - 1] in _LOCAL:
            start -= 1
        if domain and start < at:
            done = domain.end()
            out.append(("email", start, done))
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(map(_octet, m.group().split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group()) if m.end() - m.start() < 40 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(b - a for a, b in (r.span() for r in _RUN.finditer(m.group()))) <= 15:
            out.append(("phone", *m.span()))
    return out


class Chain:
    """``parts``: (start, end) of each; ``between``: the separators; ``kind``: "number" or "address"."""

    def __init__(self, kind: str, parts: list, text: str):
        self.kind, self.parts, self.text = kind, parts, text
        self.between = [text[a[1]:b[0]] for a, b in zip(parts, parts[1:])]
        self.sizes = [b - a for a, b in parts]

    def span(self, i: int, j: int) -> tuple[int, int]:
        """Start and end of parts i to j - 1, with a plus sign or bracket in front."""
        start, end = self.parts[i][0], self.parts[j - 1][1]
        if self.kind == "number":
            floor = self.parts[i - 1][1] if i else 0
            for c in "(+":
                start -= start > floor and self.text[start - 1] == c
        return start, end

    def fits(self, i: int, j: int) -> list[int]:
        """Labels that parts i to j - 1 may have together, apart from outside."""
        start, end = self.span(i, j)
        before, after = self.text[start - 1:start] if start else "", self.text[end:end + 1]
        if before.isalnum() or before == "_" or after.isalnum() or after == "_":
            return []
        if self.kind == "address":
            return [1] if i == 0 and j > 2 else []
        digits = sum(self.sizes[i:j])
        out = [3, 4] if 7 <= digits <= 19 else []
        if j - i == 4 and all(x in (".", "[.]") for x in self.between[i:j - 1]) and max(self.sizes[i:j]) <= 4:
            out.append(2)
        return out

    def features(self, i: int, j: int) -> list[str]:
        """Of the whole span from part i to j - 1."""
        start, end = self.span(i, j)
        inside, n = self.text[start:end], j - i
        before, after = self.text[start - 1:start] if start else "", self.text[end:end + 1]
        out = [
            "one", f"n{n}", f"left{_class(before)}", f"right{_class(after)}", f"first{i == 0}last{j == len(self.parts)}",
            "between" + "|".join(sorted(set(self.between[i:j - 1]))),
        ]
        if self.kind == "address":
            return [*out, f"ends{min(self.sizes[j - 1], 6)}{inside[-1:].isalpha()}", f"labels{n - 1}", f"local{min(self.sizes[0], 8)}", "at" + self.between[0]]
        digits = _digits(inside)
        octets = n == 4 and all(_octet(self.text[a:b]) for a, b in self.parts[i:j])
        check = luhn(digits) if 12 <= len(digits) <= 19 else None
        return [
            *out, f"digits{len(digits)}", f"shape{'-'.join(str(min(x, 9)) for x in self.sizes[i:j])}", f"octets{octets}", f"luhn{check}",
            f"plus{inside[0]}", f"n{n}digits{len(digits)}", f"digits{len(digits)}luhn{check}", f"plus{inside[0]}digits{len(digits)}",
        ]


def _class(c: str) -> str:
    return "none" if not c else "letter" if c.isalpha() else "digit" if c.isdigit() else "blank" if c.isspace() else c


def chains(text: str) -> list[Chain]:
    """Addresses and runs of numbers that could be personal data, in order of kind and place."""
    out = []
    for at in _AT.finditer(text):
        local = _BEFORE.search(text[max(0, at.start() - 64):at.start()])
        domain = _LABEL.match(text, at.end())
        if local and domain:
            parts, place = [(at.start() - len(local.group()), at.start())], at.end()
            for dot in _DOTS.finditer(domain.group()):
                parts.append((place, at.end() + dot.start()))
                place = at.end() + dot.end()
            out.append(Chain("address", [*parts, (place, domain.end())], text))
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() >= 7:
            out.append(Chain("number", [r.span() for r in _RUN.finditer(text, *m.span())], text))
    return out


class Field:
    """``number`` of each feature, ``weights`` (features, labels) and ``moves`` (from, to), where the first row of ``moves`` also starts a chain."""

    def __init__(self, known: list[int]):
        self.known = set(known)
        self.number: dict[str, int] = {}
        self.weights = np.zeros((0, len(LABELS)))
        self.moves = np.zeros((len(LABELS), len(LABELS)))

    def lattice(self, chain: Chain, grow: bool = False) -> list[tuple[int, int, int, list[int]]]:
        """(start, end, label, feature numbers) of every candidate segment."""
        out, n = [], len(chain.parts)
        for j in range(1, n + 1):
            for i in range(max(0, j - MOST_PARTS), j):
                labels = [x for x in chain.fits(i, j) if x in self.known]
                if i + 1 == j:
                    labels = [0, *labels]
                if labels:
                    names = chain.features(i, j)
                    if grow:
                        for x in names:
                            self.number.setdefault(x, len(self.number))
                    own = [self.number[x] for x in names if x in self.number]
                    out += [(i, j, x, own) for x in labels]
        return out

    def best(self, chain: Chain) -> list[tuple[int, int, int]]:
        """The entities (start part, end part, label) of the likeliest segmentation."""
        top = [[0.0] + [-np.inf] * (len(LABELS) - 1)] + [[-np.inf] * len(LABELS) for _ in chain.parts]
        way: list[dict] = [{} for _ in top]
        for i, j, label, own in self.lattice(chain):
            score = float(self.weights[own, label].sum())
            last = max(range(len(LABELS)), key=lambda k: top[i][k] + self.moves[k, label])
            value = top[i][last] + self.moves[last, label] + score
            if value > top[j][label]:
                top[j][label] = value
                way[j][label] = (i, last)
        j, label, out = len(chain.parts), max(range(len(LABELS)), key=lambda k: top[-1][k]), []
        while j:
            i, last = way[j][label]
            if label:
                out.append((i, j, label))
            j, label = i, last
        return out[::-1]

    def marginals(self, lattice: list, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(P(segment) of every candidate, expected moves)."""
        size = len(LABELS)
        scores = np.array([self.weights[own, label].sum() for _, _, label, own in lattice])
        ahead, behind = np.full((n + 1, size), -np.inf), np.full((n + 1, size), -np.inf)
        ahead[0, 0], behind[n] = 0, 0
        entry = np.empty(len(lattice))
        for k, (i, j, label, _) in enumerate(lattice):  # by end, so all ways to i are known
            entry[k] = np.logaddexp.reduce(ahead[i] + self.moves[:, label])
            ahead[j, label] = np.logaddexp(ahead[j, label], entry[k] + scores[k])
        total = np.logaddexp.reduce(ahead[n])
        moved = np.zeros((size, size))
        for k in sorted(range(len(lattice)), key=lambda k: -lattice[k][0]):
            i, j, label, _ = lattice[k]
            onward = scores[k] + behind[j, label]
            behind[i] = np.logaddexp(behind[i], self.moves[:, label] + onward)
        share = np.empty(len(lattice))
        for k, (i, j, label, _) in enumerate(lattice):
            onward = scores[k] + behind[j, label] - total
            share[k] = np.exp(entry[k] + onward)
            moved[:, label] += np.exp(ahead[i] + self.moves[:, label] + onward)
        return share, moved

    def learn(self, examples: list[tuple[Chain, list]]) -> None:
        """``examples``: chains with their entities (start part, end part, label)."""
        rows = []
        for chain, entities in examples:
            lattice = self.lattice(chain, grow=True)
            true = {*entities, *((i, i + 1, 0) for i in range(len(chain.parts)) if not any(a <= i < b for a, b, _ in entities))}
            at = [k for k, x in enumerate(lattice) if x[:3] in true]
            if len(at) == len(true):
                rows.append((lattice, len(chain.parts), at))
        self.weights = np.zeros((len(self.number), len(LABELS)))
        past, past_moves = np.full(self.weights.shape, 1e-6), np.full(self.moves.shape, 1e-6)
        chance = np.random.default_rng(11)
        for _ in range(EPOCHS):
            for r in chance.permutation(len(rows)):
                lattice, n, at = rows[r]
                share, moved = self.marginals(lattice, n)
                error = -share
                error[at] += 1
                gradient: dict[tuple, float] = {}
                for k in np.flatnonzero(np.abs(error) > 1e-6):
                    _, _, label, own = lattice[k]
                    for f in own:
                        gradient[f, label] = gradient.get((f, label), 0.0) + error[k]
                seen, label = np.zeros_like(moved), 0
                for k in sorted(at, key=lambda k: lattice[k][0]):
                    seen[label, lattice[k][2]] += 1
                    label = lattice[k][2]
                for place, g in gradient.items():
                    g -= PENALTY * self.weights[place]
                    past[place] += g * g
                    self.weights[place] += RATE * g / np.sqrt(past[place])
                g = seen - moved
                past_moves += g * g
                self.moves += RATE * g / np.sqrt(past_moves)

    def added(self, text: str, base: list[tuple]) -> list[tuple[str, int, int]]:
        """Spans that the field finds beside the plain ones; no two overlap. Addresses go before numbers."""
        out, found = [], chains(text) if self.known else []
        for kind in ("address", "number"):
            taken = _Taken([*base, *out])
            for chain in found:
                if chain.kind == kind:
                    own = [(KINDS[label - 1], *chain.span(i, j)) for i, j, label in self.best(chain)]
                    out += [x for x in own if taken.free(*x[1:])]
        return out

    def packed(self) -> bytes:
        return json.dumps([sorted(self.known), self.number, self.weights.tolist(), self.moves.tolist()]).encode()

    @staticmethod
    def unpacked(raw: bytes) -> "Field":
        known, number, weights, moves = json.loads(raw)
        field = Field(known)
        field.number, field.weights, field.moves = number, np.array(weights).reshape(-1, len(LABELS)), np.array(moves)
        return field


class _Taken:
    """Places that spans cover."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        own = sorted((a, b) for _, a, b in spans)
        self.starts, self.reach = [a for a, _ in own], list(accumulate((b for _, b in own), max))

    def free(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)
        return at == 0 or self.reach[at - 1] <= start


def rewritten(kind: str, span: str, pick: int) -> list[tuple[str, str]]:
    """(kind or "", text): the span itself, one form of it that the patterns miss, and one that is no personal data."""
    digits = _digits(span)
    if kind == "email":
        local, domain = span.rsplit("@", 1)
        at = (" (at) ", "[at]", " [at] ", " @ ", "(at)", " {at} ")[pick % 6]
        dot = (".", "[dot]", " (dot) ", " [dot] ", ".", "(dot)")[pick // 6 % 6]
        return [(kind, span), (kind, local + at + domain.replace(".", dot))]
    if kind == "ip":
        parts = span.split(".")
        k = pick % 4
        wrong = ".".join([*parts[:k], str(256 + int(parts[k]) + pick % 500), *parts[k + 1:]])
        return [(kind, span), (kind, "[.]".join(parts)), ("", (wrong, ".".join(parts[:3]), "[.]".join(wrong.split(".")))[pick // 4 % 3])]
    if kind == "card":
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + pick % 9) % 10)
        join = (".", "  ", "/", "\xa0", " - ", ".", "-")
        own, other = join[pick % 6], join[pick // 6 % 7]
        groups = lambda x, sep: sep.join(x[i:i + 4] for i in range(0, len(x), 4))
        return [(kind, span), (kind, groups(digits, own)), ("", (wrong, groups(wrong, other), groups(wrong, " "))[pick // 7 % 3])]
    country, rest = digits[:-10], digits[-10:]
    if len(digits) < 10:
        return [(kind, span)]
    form = (
        f"({rest[:3]}) {rest[3:6]}-{rest[6:]}", f"{rest[:3]}-{rest[3:6]}-{rest[6:]}", f"{rest[:3]}.{rest[3:6]}.{rest[6:]}",
        f"{country} ({rest[:3]}) {rest[3:6]}-{rest[6:]}" if country else f"({rest[:3]}) {rest[3:6]} {rest[6:]}", f"00{country or '1'} {rest[:3]} {rest[3:6]} {rest[6:]}",
        f"+{country or '1'}/{rest[:3]}/{rest[3:6]}{rest[6:]}",
    )[pick % 6]
    wrong = (
        rest[:8], f"{rest[:4]}-{rest[4:6]}-{rest[6:8]}", rest, f"{rest[:3]}.{rest[3:5]}", digits + rest, f"{rest[:4]} - {rest[4:8]}",
        f"{rest[:2]}/{rest[2:4]}/{rest[4:8]}", f"{rest[:6]}-{rest[6:9]}{digits}",
    )[pick // 6 % 8]
    return [(kind, span), (kind, form), ("", wrong)]


def _examples(left: str, kind: str, span: str, right: str) -> list[tuple[Chain, list]]:
    """Chains of a window and its rewritten forms, with the parts that are entities."""
    pick = zlib.crc32((left + span + right).encode())
    out = []
    for own, text in rewritten(kind, span, pick) if kind else [("", span)]:
        start, end = len(left), len(left) + len(text)
        for chain in chains(left + text + right):
            parts = [k for k, (a, b) in enumerate(chain.parts) if start <= a and b <= end]
            if not parts or sum(chain.sizes) - sum(chain.sizes[parts[0]:parts[-1] + 1]) > 6:
                continue  # also what may be another span beside this one
            i, j = parts[0], parts[-1] + 1
            if not own:
                out.append((chain, []))
            elif chain.span(i, j) == (start, end) and j - i <= MOST_PARTS and (chain.kind == "address") == (own == "email"):
                out.append((chain, [(i, j, LABELS.index(own))]))
    return out


def _windows(batch):
    """(left, kind, span, right) of the plain spans of a batch, and of short chains without any (kind "")."""
    rows = []
    for text in batch.column("text").filter(pc.match_substring_regex(batch.column("text"), _TRIGGER)).to_pylist():
        base = base_spans(text)
        taken = _Taken(base)
        short = [("", *x.span(0, len(x.parts))) for x in chains(text) if x.kind == "number" and sum(x.sizes) < 9]
        short = [x for x in short if taken.free(*x[1:])]
        for kind, start, end in [*base, *short]:
            if end - start <= LONGEST:
                rows.append((text[max(0, start - AROUND):start], kind, text[start:end], text[end:end + AROUND]))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], ["left", "kind", "span", "right"])


def _learned(batches):
    rows = pa.Table.from_batches(batches).to_pylist()
    known = sorted({LABELS.index(r["kind"]) for r in rows if r["kind"]})
    field = Field(known)
    field.learn([x for r in rows for x in _examples(r["left"], r["kind"], r["span"], r["right"])])
    yield pa.RecordBatch.from_arrays([pa.array([field.packed()], pa.binary())], ["field"])


def fit(docs: DataFrame, sample: int = SAMPLE_PER_KIND) -> Field:
    """A field learned from the plain spans of ``docs`` (text): one task sees about ``sample`` windows of each kind.

    The choice is by a hash of the window, so the same ones are chosen on every run; a window that repeats is taken once. Kinds without plain
    spans are not learned, and without any the field finds nothing.
    """
    texts = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    windows = cut(map_batches(texts, _windows, "`left` string, kind string, span string, `right` string").distinct())
    counts = {r["kind"]: r["count"] for r in windows.groupBy("kind").count().collect()}
    if not set(counts) - {""}:
        return Field([])
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / n))])
    chance = F.pmod(F.xxhash64(*windows.columns), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = windows.where(chance < share[F.col("kind")]).repartition(1).sortWithinPartitions(*windows.columns)
    return Field.unpacked(bytes(chosen.mapInArrow(_learned, "field binary").first()["field"]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


def _searched(batch, field: Field):
    texts = pc.fill_null(batch.column("_text"), "")
    rows = np.flatnonzero(pc.match_substring_regex(texts, _TRIGGER).to_numpy(zero_copy_only=False))
    counts, found = np.zeros(len(texts), np.int64), []
    for row, text in zip(rows.tolist(), texts.take(pa.array(rows)).to_pylist()):
        base = base_spans(text)
        own = [(*x, True) for x in base] + [(*x, False) for x in field.added(text, base)]
        own.sort(key=lambda x: (x[1], KINDS.index(x[0])))
        counts[row] = len(own)
        found += own
    spans = pa.StructArray.from_arrays(
        [pa.array([x[k] for x in found], _SPAN.field(k).type) for k in range(4)], fields=[_SPAN.field(k) for k in range(4)]
    )
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), spans)
    keep = [f.name for f in batch.schema if not f.name.startswith("_")]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lists], [*keep, "_spans"])


def spans(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` (text, any others) without text, with ``_spans``: (kind, start, end, base) by start, then kind.

    Offsets count code points, the end is exclusive. ``base`` marks the plain forms; the others are the field's and overlap none of them. Null
    and empty texts have none. Rows that repeat others are searched like any. Columns whose names begin with an underscore
    are left out. An empty table gives no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(field)  # some hundred features, whatever the table
    others = [c for c in docs.columns if not c.startswith("_") and c.lower() != "text"]
    rows = docs.select(*[F.col(f"`{c}`") for c in others], F.col("text").cast("string").alias("_text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.drop("_text").schema)
    return map_batches(rows, lambda batch: _searched(batch, shipped.value), kept + "_spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
