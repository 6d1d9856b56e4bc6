"""Spelling variants against every pair of words."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from clinfeat.llm import spelling
from clinfeat.llm.catalogue import QUERIES
from clinfeat.llm.oracles import ORACLES
from compare import connect, difference

FOLDER = "/root/testdata/sf0.001"


def edit_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words, ratio=10):
    near = {w: [v for v in words if edit_one(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    rows = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return rows


def table(spark, words):
    return spark.createDataFrame([(w, n, "x") for w, n in words.items()], "word string, n long, root string").repartition(4)


def rows_of(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def made_words(seed, letters, sizes, many):
    chance = random.Random(seed)
    words = {}
    while len(words) < many:
        w = "".join(chance.choice(letters) for _ in range(chance.choice(sizes)))
        for _ in range(3):
            words[w] = chance.choice([2, 3, 20, 30, 400, 5000])
            at, kind = chance.randrange(len(w)), chance.randrange(3)
            w = w[:at] + ("", chance.choice(letters), chance.choice(letters) + w[at])[kind] + w[at + 1:]
    return words


@pytest.mark.parametrize("letters, sizes", [("abcdefghijklmnopqrstuvwxyzéñ÷×ÿ", range(7, 12)), ("ab", range(7, 10)), ("aéc", range(38, 44))])
def test_variants_equal_brute_force(spark, monkeypatch, letters, sizes):
    """Deep upper trees, few letters (many words of the same counts), and lengths around where trees are shared."""
    monkeypatch.setattr(spelling, "CELL", 16)
    monkeypatch.setattr(spelling, "LEAF", 4)
    words = made_words(5, letters, sizes, 600 if len(letters) > 2 else 400)
    assert rows_of(spelling.variants(table(spark, words))) == brute(words)


def test_blocks_of_a_crowded_cell(spark, monkeypatch):
    """All words have the same letters or one letter more: cells beyond the limits are compared block by block."""
    monkeypatch.setattr(spelling, "MOST_POINTS", 20)
    monkeypatch.setattr(spelling, "MOST_QUESTIONS", 30)
    words = {"".join(p): 2 + 50 * (i % 7 == 0) for i, p in enumerate(itertools.islice(itertools.permutations("abcdefgh"), 150))}
    words |= {w + "x": 2 for w in list(words)[:40]} | {"y" + w[1:]: 700 for w in list(words)[:30]}
    assert rows_of(spelling.variants(table(spark, words))) == brute(words)


def test_chain_ties_long_words_and_empty(spark):
    chain = {"aaaaaaaa" + "b" * k: 10 ** (6 - k) for k in range(6)}
    ties = {"tiewords": 2, "tiewordz": 50, "tieworda": 50, "tiewordsé": 50}
    long = {"q" * 3000: 100, "q" * 3001: 1000, "q" * 1500 + "r" + "q" * 1500: 9, "zz" * 2000: 2}
    words = chain | ties | long
    assert rows_of(spelling.variants(table(spark, words))) == brute(words)
    assert spelling.variants(table(spark, words).limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, 5), ("lonelyword", 4), ("nocount", None)], "word string, n long")
    assert rows_of(spelling.variants(nulls)) == {("lonelyword", None, "lonelyword", 4, 0, None)}


def words_of(rows, one_in):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if one_in and h % one_in == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def test_words_are_counted(spark):
    rows = [
        (1, "Wordlike wordlike, ÉCOLIERS écoliers ÉCOLIERS wordlikEāwordlike x" * 3), (2, None), (3, ""), (None, "nothing nothing Nothing"),
        (4, "seven77seven sevenly_sevenly  naïveté÷naïveté " * 50), (4, "repeated repeated"), (4, "repeated repeated"), (5, "a" * 100_000 + " " + "a" * 100_000),
    ] + [(i, "alphabet betalphabet gammaray gammaray deltawing") for i in range(10, 90)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int").repartition(3)
    for one_in in (0, 3):
        found = {r.word: r.n for r in spelling.counted_words(df, one_in=one_in).collect()}
        assert found == words_of(rows, one_in)
    assert spelling.counted_words(df.limit(0)).count() == 0


def test_query(spark):
    name = "op12_kd_spelling_variants"
    with connect(FOLDER) as con:
        assert not difference(QUERIES[name](spark, FOLDER), con, ORACLES[name])


def test_steps_never_part_near_words():
    """A word's cell is among those that a near word reaches."""
    words = made_words(8, "abcdé", range(7, 12), 500)
    names = sorted(words)
    own = spelling.Words(pa.array([w.encode("latin-1") for w in names]))
    tree = spelling.upper_tree(own.bits, 6)
    cell = spelling.cells_of(own.bits, tree)
    row, reach = spelling.reached(own.bits, tree, 1, 1)
    held = set(zip(row.tolist(), reach.tolist()))
    assert len(held) == len(row)
    for i, j in itertools.combinations(range(len(names)), 2):
        if edit_one(names[i], names[j]):
            assert (i, int(cell[j])) in held and (j, int(cell[i])) in held
    assert len(np.unique(cell)) > 16
