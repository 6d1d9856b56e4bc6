"""Packing, chat formatting and linked vectors, the pipeline and the queries."""

import hashlib
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from clinfeat.llm import chat, packing, tokens, vectors
from clinfeat.llm.catalogue import QUERIES, TOKENIZER
from clinfeat.llm.oracles import ORACLES
from compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
ENCODERS: dict = {}


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def check_packed(rows, ids, context):
    """Every id in one piece, offsets without gaps, no padding; returns the sequences' lengths."""
    pieces, sequences = {}, {}
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.length > 0
        assert r.ids == own[r.start:r.start + r.length].tobytes()
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.window))
    for doc, own in ids.items():
        at = 0
        for start, length in sorted(pieces[doc]):
            assert start == at
            at += length
        assert at == len(own)
    for found in sequences.values():
        at = 0
        for offset, length, window in sorted(found):
            assert offset == at
            at += length
        assert at == window <= context and at & (at - 1) == 0
    return sequences


def test_packing(spark, plain):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", F.lit("clash").alias("ids"))
    odd = [(-1, None), (-2, ""), (-3, "<|endoftext|> it's<|endoftext|><|endoftext|>"), (-6, " " * 3000 + "x"), (-4, "a" * 3000 + " \n\t  é漢字🙂\u00a0\r\n x"), (-5, "word " * 200_000)]
    all_ = docs.union(spark.createDataFrame([(i, t, "x") for i, t in odd], docs.schema)).repartition(5, "doc_id")
    ids = {r.doc_id: np.array([*plain(r.text), 0], "<u4") for r in all_.collect()}
    for context, tiers in ((1024, 4), (64, 1)):
        rows = packing.pack(all_, TOKENIZER, context, tiers).collect()
        check_packed(rows, ids, context)
    assert packing.pack(all_.limit(0), TOKENIZER).count() == 0


def test_step_groups_of_the_whole_job(spark):
    """Every group has as many windows of each length as any other, give or take one, and costs about the same."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(7, "doc_id")
    rows = packing.pack(docs, TOKENIZER, group=16).collect()
    windows, cost = {}, {}
    for r in rows:
        windows[r.sequence_id] = (r.window, r.step_group)
        cost[r.step_group] = cost.get(r.step_group, 0) + r.length ** 2
    counts = {}
    for size, group in windows.values():
        counts.setdefault(size, {}).setdefault(group, 0)
        counts[size][group] += 1
    groups = sorted({g for _, g in windows.values()})
    assert groups == list(range(-(-len(windows) // 16)))
    for size, own in counts.items():
        n = [own.get(g, 0) for g in groups]
        assert max(n) - min(n) <= 1, (size, n)
    assert max(cost.values()) < 1.25 * min(cost.values())
    assert len(counts) > 4 and sum(n for size, own in counts.items() if size < 128 for n in own.values()) <= 7 * 7


def packed_by_hand(lengths, limits):
    """[(window, sorted pieces as (document, length))] of all full windows and those at the end, by searching everything for each step."""
    context, out = limits[-1], []
    waiting = []
    for doc, n in enumerate(lengths):
        out += [(context, [(doc, context)])] * (n // context)
        if n % context:
            waiting.append([doc, n // context * context, n % context])

    def tier(n):
        return min(i for i, limit in enumerate(limits) if n <= limit)

    def fill(window, room, top):
        while room:
            fits = [p for p in waiting if p[2] <= room and tier(p[2]) <= top]
            if fits:
                short = [p for p in fits if tier(p[2]) < top]
                best = max(short, key=lambda p: (tier(p[2]), p[2])) if short else max(fits, key=lambda p: p[2])
                waiting.remove(best)
                window.append((best[0], best[2]))
                room -= best[2]
            else:
                best = min((p for p in waiting if tier(p[2]) <= top), key=lambda p: p[2])
                window.append((best[0], room))
                best[1], best[2] = best[1] + room, best[2] - room
                room = 0

    for top in range(len(limits) - 1, -1, -1):
        while any(tier(p[2]) == top for p in waiting) and sum(p[2] for p in waiting if tier(p[2]) <= top) >= limits[top]:
            first = max((p for p in waiting if tier(p[2]) == top), key=lambda p: p[2])
            waiting.remove(first)
            window = [(first[0], first[2])]
            fill(window, limits[top] - first[2], top)
            out.append((limits[top], window))
    while waiting:
        size = min(context // 2, 1 << sum(p[2] for p in waiting).bit_length() - 1)
        window = []
        fill(window, size, len(limits) - 1)
        out.append((size, window))
    return sorted((size, sorted(n for _, n in w)) for size, w in out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 150), max_size=40, unique=True), st.integers(1, 4))
def test_tiers_and_gaps_equal_a_plain_search(lengths, tiers):
    packer = packing.Packer(64, tiers)
    for doc, n in enumerate(lengths):
        packer.add((doc, n), np.arange(n))
    packer.pack(last=True)
    found = sorted((size, sorted(len(p[2]) for p in w)) for size, w in packer.full)
    assert all(sum(own) == size for size, own in found)
    assert not packer.pieces and not any(packer.tokens)
    # Pieces of the same length are alike, so the windows are the same as long as cuts make no new equals.
    if len({n % 64 for n in lengths}) == len(lengths):
        assert [size for size, _ in found] == [size for size, _ in packed_by_hand(lengths, packer.limits)]


def test_windows_of_every_tier():
    """Long windows take short pieces into their gaps; what is left of a tier fills windows of the tier's length."""
    packer = packing.Packer(1024, 4)
    for doc, n in enumerate([900, 100, 20, 400, 100, 300, 200, 250, 6]):
        packer.add((doc, n), np.arange(n))
    packer.pack()
    assert [(size, [len(p[2]) for p in w]) for size, w in packer.full][0] == (1024, [900, 100, 20, 4])
    assert {size for size, _ in packer.full} == {1024, 512, 256} or {size for size, _ in packer.full} == {1024, 512}


def test_very_long_runs(spark, plain):
    """Texts that the fast encoder's pattern gives up on."""
    rows = [(1, " " * 1_000_000 + "x"), (2, "\n" * 1_200_000), (3, "a" * 2_000_000), (4, " \t" * 800_000 + "<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    own = {r.doc_id: r.doc_tokens for r in packing.pack(df, TOKENIZER).select("doc_id", "doc_tokens").distinct().collect()}
    assert own == {i: len(plain(t)) + 1 for i, t in rows}


def test_packing_repeated_and_null_ids(spark, plain):
    df = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "no id")], "doc_id long, text string").coalesce(1)
    rows = packing.pack(df, TOKENIZER).collect()
    assert sum(r.length for r in rows) == 2 * (len(plain("same text")) + 1) + len(plain("no id")) + 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("ab'S te<|>9 \n\t\u00a0é漢🙂\u0301-_") + ["<|endoftext|>", "'ll", "  "]), max_size=60).map("".join))
def test_encoder_equals_tokenizers(text):
    if "made" not in ENCODERS:
        ENCODERS["made"] = Tokenizer.from_file(TOKENIZER), {x: tokens.encoder(TOKENIZER, x) for x in (False, True)}
    tokenizer, made = ENCODERS["made"]
    for special, encode in made.items():
        tokenizer.encode_special_tokens = not special
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_of_another_kind():
    path = public_tokenizers.path("word_bpe_49k.json")
    assert tokens.encoder(path, True)("Hello wide world") == Tokenizer.from_file(path).encode("Hello wide world", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(*[st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/s>", "a", " ", "\n", "é"]), max_size=8).map("".join)] * 2), max_size=5))
def test_chat_round_trip(turns):
    made = "".join(chat.render(role, text) for role, text in turns)
    assert [x[:2] for x in chat.parse(made)] == turns
    for role, text in turns:
        assert chat.unescape(chat.escape(text)) == text


@pytest.mark.parametrize("bad", ["x", "<s>[INST] user", "<s>[INST] user [/INST]no end", "<s>[INST] u [/INST]a[INST]</s>", chat.render("u", "a") + " "])
def test_chat_grammar_refuses(bad):
    with pytest.raises(ValueError):
        chat.parse(bad)


def test_conversations(spark):
    rows = [
        (1, 2, "assistant", "b </s>"), (1, 1, "user", "a"), (1, 2, "assistant", "b </s>"), (2, 1, None, None), (2, None, "assistant", "first"),
        (None, 1, "assistant", "é🙂"), (3, 1, "Assistant", "[INST] no loss"), (4, 1, "assistant", None), (5, 1, "</s>", "x\\"),
    ] + [(6, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash")).repartition(4)
    got = {r.conv_id: r for r in chat.conversation_digests(chat.formatted_turns(df)).collect()}
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss) and got[c].loss_sha256 == digest(loss)
        assert got[c].turns_sha256 == digest("".join(f"{r}\n{x}\n" for *_, r, x in turns))
    assert chat.conversation_digests(chat.formatted_turns(df.limit(0))).count() == 0


def grouped_vectors(dim=16):
    rng = np.random.default_rng(6)
    rows = [rng.normal(size=dim) for _ in range(300)]
    for spread in (0.02, 0.12, 0.2):
        centre = rng.normal(size=dim)
        rows += [centre + spread * rng.normal(size=dim) for _ in range(60)]
    rows += [rows[0]] * 4 + [3 * rows[1], -rows[2]]
    return [(7 * i % 1000, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


@pytest.mark.parametrize("shard", [2048, 40])
def test_linked_vectors(spark, shard, monkeypatch):
    """Exact below the search's slack here; large clusters are split and searched in all parts."""
    monkeypatch.setattr(vectors, "SHARD_ROWS", shard)
    monkeypatch.setattr(vectors, "CLUSTER_ROWS", 100)
    rows = grouped_vectors()
    odd = [(2001, None), (2002, []), (2003, [0.0] * 16), (2004, [1.0] * 15 + [float("nan")]), (2005, [1.0, None] * 8), (2006, [float("inf")] * 16), (2007, [1.0, 2.0]), (2008, [2.0, 4.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("shard", F.lit("clash"))
    result = vectors.linked(df)
    got = {r.vec_id: (r.n_links, r.component_id) for r in result.collect()}
    expected = brute.links(rows + odd, 0.9)
    assert set(got) == set(expected)
    found, true = sum(n for n, _ in got.values()), sum(n for n, _ in expected.values())
    assert all(got[i][0] <= expected[i][0] for i in got) and found >= 0.98 * true
    assert got[2007] == (1, 2007) and got[2008] == (1, 2007) and got[2001] == (0, 2001)
    if shard == 2048:
        assert vectors.audit_recall(df.where("vec_id < 2000"), result) >= 0.98


def test_linked_vectors_repeated_null_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.linked(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, True)], key=str)
    assert vectors.linked(df.limit(0)).count() == 0


def test_no_group_of_vectors_holds_a_hot_cluster(spark, monkeypatch):
    """A third of the vectors are close together, and every one of their links counts."""
    found = vectors._found

    def bounded(group, threshold):
        assert group.num_rows <= 400
        return found(group, threshold)

    monkeypatch.setattr(vectors, "_found", bounded)
    monkeypatch.setattr(vectors, "SHARD_ROWS", 100)
    monkeypatch.setattr(vectors, "CLUSTER_ROWS", 50)
    rng = np.random.default_rng(8)
    centre, noise = rng.normal(size=32), rng.normal(size=(800, 32))
    rows = [(i, v.tolist()) for i, v in enumerate([*noise, *(centre + 0.05 * rng.normal(size=(400, 32)))])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == brute.links(rows, 0.9)


def test_pairs_at_the_threshold_are_linked_both_ways(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CLUSTER_ROWS", 20)
    rng = np.random.default_rng(9)
    one, other = rng.normal(size=(2, 1500, 64))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other -= (other * one).sum(1, keepdims=True) * one
    pair = 0.905 * one + (1 - 0.905 ** 2) ** 0.5 * other / np.linalg.norm(other, axis=1, keepdims=True)
    rows = [(2 * i + j, v.tolist()) for i, two in enumerate(zip(one, pair)) for j, v in enumerate(two)]
    got = {r.vec_id: r.n_links for r in vectors.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[2 * i] == got[2 * i + 1] for i in range(1500)) and sum(got.values()) >= 0.998 * 3000


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) == ""


def test_pipeline(spark):
    """Each stage against what it says, on its own input."""
    from clinfeat.llm import langid

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    added = spark.createDataFrame([(10_001, "%%% 123 ---", "en", "s", 11), (10_002, None, "en", "s", 0), (10_003, docs.first().text, None, "s", 1)], docs.schema)
    docs = docs.union(added)
    names, last = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        made = stage(spark, docs, FOLDER)
        rows = made.collect()
        if name == "tiered_packing":
            last = rows
            assert {r.doc_id for r in rows} == set(before)
            assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in rows)
            break
        assert made.columns == names
        after = {r.doc_id: r.text for r in rows}
        if name == "crf_language_id":
            assert set(before) - set(after) == {10_001, 10_002} and {r.lang for r in rows} <= {"en", "fr", "de", "es"}
        elif name == "minmax_near_dedup":
            assert set(after) == {i for i, (_, c) in brute.near(list(before.items()), 5, 80).items() if i == c}
        elif name == "fm_substring_dedup":
            kept = brute.without_repeats(list(before.items()), 20)
            assert {i: brute.words(t) for i, t in after.items()} == kept
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            hit = {d for d, _ in brute.contained(list(before.items()), items, 5, 0.8)}
            assert set(after) == set(before) - hit
        docs = spark.createDataFrame(rows, made.schema)
    assert last and langid.SAMPLE_PER_LANGUAGE


def test_queries_are_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert "pipeline" in found and all(any(q.startswith(f"op{n}_") for q in found) for n in range(1, 11))
