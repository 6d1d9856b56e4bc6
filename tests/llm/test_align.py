"""Alignment of two tokenizers against a plain version, and the perfect hash."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clinfeat.llm import align, tokens
from clinfeat.llm.catalogue import PIECES, QUERIES, TOKENIZER

FOLDER = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "   ", "\n", "\nword", " \n word", "a  b", "a b ", "a\n", "two\r\nlines\r\n\r\nmore", "tab\tand \t mixed", "▁x and ▁",
    "<s>hi</s> <|endoftext|> <unk> <0x41>", "ﬁ ½ é é \x00 \x1f \x1c x", "漢字 かな 🙂🙃  nb em　", "it's, we'll; e.g. x.y::z>>a",
    "a" * 5000, " " * 5000 + "x", "word " * 3000, "ab\n\n\ncd" * 50, "\t\ta",
]


@pytest.fixture(scope="module")
def tools():
    a, b = Tokenizer.from_file(TOKENIZER), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    return a, b, tokens.byte_level_bytes(TOKENIZER)


def brute(texts, tools):
    """Rows of the query for whole texts, one at a time."""
    a_tool, b_tool, a_bytes = tools

    def b_bytes(i):
        piece = b_tool.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_tool.is_byte(i) else piece.replace("▁", " ").encode()

    found, counts, best = [], Counter(), Counter()
    for text in texts:
        a, b, groups = [], [], []
        if text:
            a, b = a_tool.encode(" " + text, add_special_tokens=False).ids, b_tool.encode(text)
            parts = [a_bytes[i] for i in a], [b_bytes(i) for i in b]
            if b"".join(parts[0]) == b"".join(parts[1]) == (" " + text).encode():
                ends = [np.cumsum([len(x) for x in side]).tolist() for side in parts]
                i = j = 0
                for end in sorted(set(ends[0]) & set(ends[1])):
                    p, q = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
                    groups.append((a[i:p], b[j:q]))
                    i, j = p, q
            else:
                a, b = [], []
        found.append((a, b, groups))
        counts.update({(x, y) for u, v in groups for x in u for y in v})
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    rows = []
    for a, b, groups in found:
        links = [(x, y) for u, v in groups for x in u for y in v]
        text = ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in groups)
        rows.append((
            len(a), len(b), len(groups), len(links), sum(counts[k] == best[k[0]] for k in links), sum(counts[k] for k in links),
            hashlib.sha256(text.encode()).hexdigest() if text else "",
        ))
    return rows


def rows_of(df):
    cells = ["_n_a", "_n_b", "_n_groups", "_n_links", "_n_best", "_count_sum"]
    digest = F.when(F.col("_groups") == "", "").otherwise(F.sha2("_groups", 256))
    return {r[0]: tuple(r)[1:] for r in df.select("doc_id", *cells, digest).collect()}


def test_query_equals_brute_force(spark, tools):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    found = {r[0]: tuple(r)[1:] for r in QUERIES["op13_hashed_token_alignment"](spark, FOLDER).collect()}
    assert found == dict(zip([r.doc_id for r in docs], brute([r.text for r in docs], tools)))


@pytest.mark.parametrize("block, fan, many", [(16 << 20, 256, 1 << 16), (2000, 2, 1)])
def test_odd_texts_small_blocks_and_trees(spark, tools, monkeypatch, block, fan, many):
    """Clashing column names, repeated rows, texts that a tokenizer does not give back; blocks, trees and large groups of any size."""
    for name, value in (("BLOCK", block), ("FAN", fan), ("MANY_LINKS", many)):
        monkeypatch.setattr(align, name, value)
    texts = ODD + ODD[:6] + ["plain words, and more."] * 40
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keys string, bucket int").repartition(5)
    made = align.aligned(df, TOKENIZER, PIECES)
    assert {"keys", "bucket", "doc_id"} <= set(made.columns)
    assert rows_of(made) == dict(enumerate(brute(texts, tools)))


def test_null_and_repeated_ids_and_empty_table(spark, tools):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b"), (1, None)], "doc_id long, text string")
    found = sorted((r.doc_id or 0, r._n_a, r._count_sum) for r in align.aligned(df, TOKENIZER, PIECES).collect())
    assert found == [(0, 2, 6), (0, 2, 6), (1, 0, 0), (1, 2, 6)]
    assert align.aligned(df.limit(0), TOKENIZER, PIECES).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 50, 20_000))
    levels = align.build_hash(keys)
    assert sorted(align.index_of(keys, levels).tolist()) == list(range(len(keys)))
    assert sum(map(len, levels)) < 8 * len(keys)
    again = align._unpacked(align._packed(levels))
    assert all((x == y).all() for x, y in zip(levels, again, strict=True))
    table = np.empty_like(keys)
    table[align.index_of(keys, levels)] = keys
    assert (align._verified(keys[::7], levels, table) == align.index_of(keys[::7], levels)).all()
    with pytest.raises(ValueError):
        align._verified(keys[:5] + (1 << 51), levels, table)


def test_long_runs_encode_as_the_library_does():
    slow = Tokenizer.from_file(TOKENIZER)
    for special in (False, True):
        slow.encode_special_tokens = not special
        fast = tokens.encoder(TOKENIZER, special)
        for text in (" " * 9999 + "x", "\n" * 5000, "a" + "\t" * 3000 + "\n<|endoftext|> b" + " " * 2000, "<|endoftext|>" * 3, "x　" * 10 + " " * 1500 + "é"):
            assert fast(text) == slow.encode(text, add_special_tokens=False).ids
    for text in (" " * 2_000_000 + "x", "\n" * 1_500_000):
        assert len(fast(text)) > 0
