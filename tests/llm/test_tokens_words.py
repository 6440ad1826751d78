"""Token alignment, spelling variants and the BPE codec against brute force, with edge cases."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from brute import aligned, slipped_words, variants
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle_compare import duck
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from recoflow.llm import align, bpe, fragments, mph, spelling

SF = "/root/testdata/sf0.001"
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Extra columns named like columns that the operators make themselves.
EXTRA = ["id", "ids", "text_", "word", "n", "row", "file", "key", "shard", "fine", "_text", "_doc", "_run", "prefix"]
#: Letters, white space of every kind, apostrophes, special strings, marks, halves of astral pairs.
BITS = ["a", "b", "s", "'", "'s", "'ll", "'re", "r", "e", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ", " ", "　",
        "é", "ß", "Ж", "日", "。", "ا", "😀", "\U000f0000", "´", "!", "§", "…", "1", "23", "́", "\0", "�", "<|endoftext|>", "<|end", "▁", "<0x0A>", "</s>"]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs():
    return duck(SF).execute("SELECT doc_id, text FROM documents").fetchall()


@pytest.fixture(scope="module")
def odd():
    """(doc_id, text): nulls, empties, repeated rows, mixed signs and a very long text."""
    rng = random.Random(5)
    texts = [None, "", " ", "▁", "a▁b", "same same", "same same", "<|endoftext|>", " x<|endoftext|>  y", "it's  'll\n\nwe've", "   x", "é" * 500]
    texts += ["".join(rng.choices(BITS, k=rng.randint(1, 30))) for _ in range(120)]
    texts.append(" ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(60_000)))
    texts.append("x" * 30_000)
    rows = [(k, t) for k, t in enumerate(texts)]
    return rows + [rows[5], (None, "no id here"), (None, None)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit("x") for c in EXTRA})


def plain_a():
    t = Tokenizer.from_file(BYTES)
    t.encode_special_tokens = True
    own = fragments.ByteTokenizer(BYTES, False).token_bytes

    def encode(text):
        ids = t.encode(text, add_special_tokens=False).ids
        return ids, [own[i] for i in ids]

    return encode


def plain_b():
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def encode(text):
        ids = sp.encode(text)
        return ids, [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in ids]

    return encode


# -- codec -----------------------------------------------------------------------------


def check_codec(got, rows):
    t = Tokenizer.from_file(BYTES)
    want = Counter()
    for doc, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[doc, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want


def test_codec_query(spark, docs):
    check_codec(entry.queries()["op13_bpe_codec"](spark, SF).collect(), docs)


def test_codec_edges(spark, odd):
    got = bpe.round_trip(frame(spark, odd), BYTES).withColumnRenamed("id", "doc_id")
    check_codec(got.collect(), odd)
    assert bpe.round_trip(frame(spark, odd).limit(0), BYTES).collect() == []


def test_codec_keeps_columns_and_decodes_any_ids(spark):
    t = Tokenizer.from_file(BYTES)
    rng = random.Random(2)
    ids = [rng.choices(range(50_257), k=rng.randint(0, 6)) for _ in range(300)]
    df = spark.createDataFrame([(k, i) for k, i in enumerate(ids)] + [(-1, None)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in bpe.decode(df, BYTES).collect()}
    assert got == {k: t.decode(i, skip_special_tokens=False) for k, i in enumerate(ids)} | {-1: ""}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(BITS) | st.characters(exclude_categories=["Cs"]), max_size=25).map("".join))
def test_fragments_encode_as_the_whole_text(text):
    own = fragments.shared(fragments.ByteTokenizer, BYTES, True)
    whole = fragments.shared(Tokenizer.from_file, BYTES)
    assert own.encode([text])[0].tolist() == whole.encode(text, add_special_tokens=False).ids
    assert b"".join(own.fragments(text.encode())) == text.encode()


def test_texts_are_cut_and_memories_bounded(docs, monkeypatch):
    own = fragments.shared(fragments.ByteTokenizer, BYTES, True)
    text = max((t for _, t in docs if t), key=len)
    assert len(own.fragments(text.encode())) > len(text) / 20
    monkeypatch.setattr(fragments, "REMEMBERED_BYTES", 2_000)
    memory = own.memory = fragments.Memory(own.encode_fragments)
    ids = own.encode([text])[0].tolist()
    assert memory.look_up([b"one", b"two"]) and len(memory) <= 4 + 2 * len(set(own.fragments(text.encode())))
    assert ids == Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids


# -- alignment ---------------------------------------------------------------------------


def check_alignment(got, rows):
    a, b = plain_a(), plain_b()
    each = [(doc, aligned(text, a, b)) for doc, text in rows]
    df = Counter()
    for _, x in each:
        if x:
            df.update(set(x[3]))
    best = {}
    for (i, _), n in df.items():
        best[i] = max(best.get(i, 0), n)
    want = Counter()
    for doc, x in each:
        if not x:
            want[doc, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        ids_a, ids_b, groups, links = x
        want[doc, len(ids_a), len(ids_b), len(groups), len(links), sum(df[p] == best[p[0]] for p in links),
             sum(df[p] for p in links), sha(";".join(groups))] += 1
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r[c] for c in columns) for r in got) == want


def test_alignment_query(spark, docs):
    short = [(d, t) for d, t in docs if len(t or "") < 3000]  # the brute force is quadratic
    df = spark.createDataFrame(short, "doc_id long, text string")
    check_alignment(align.align(spark, df, BYTES, PIECES).withColumnRenamed("id", "doc_id").collect(), short)
    got = entry.queries()["op11_token_alignment"](spark, SF).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in docs)


@pytest.mark.parametrize("sizes", [{}, {"slice_pairs": 64, "shard_pairs": 16}])
def test_alignment_edges(spark, odd, sizes):
    rows = [(d, t) for d, t in odd if len(t or "") < 3000]
    got = align.align(spark, frame(spark, rows), BYTES, PIECES, **sizes).withColumnRenamed("id", "doc_id")
    check_alignment(got.collect(), rows)


def test_alignment_of_long_and_empty_tables(spark, odd):
    assert align.align(spark, frame(spark, odd).limit(0), BYTES, PIECES).collect() == []
    got = align.align(spark, frame(spark, [(1, None), (2, "")]), BYTES, PIECES).collect()
    assert [r["n_a"] for r in got] == [0, 0]
    text = max((t for _, t in odd if t), key=len)
    [r] = align.align(spark, frame(spark, [(1, text)]), BYTES, PIECES).collect()
    assert r["n_a"] == len(plain_a()(" " + text)[0]) and r["n_b"] == len(plain_b()(text)[0])


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**40), max_size=400), st.integers(1, 9))
def test_hash_is_minimal_and_verifies(keys, n_shards):
    keys = np.array(sorted(keys), np.int64)
    shard = mph.shard_of(mph.fine_bucket(keys), n_shards)
    shards = []
    for s in sorted(set(shard.tolist())):
        sizes, words, placed = mph.build(keys[shard == s])
        shards.append((s, sizes, words, placed.astype("<i8").tobytes()))
    index = mph.Index.join(0, n_shards - 1, n_shards, shards)
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))
    others = np.setdiff1d(np.arange(2**40, 2**40 + 500), keys)
    assert (index.slots(others) == -1).all()


def test_tree_sum_of_many_parts(spark):
    from recoflow.llm.common import Work

    rows = [(s, p, np.array([p, s, 1], "<i8").tobytes()) for s in range(3) for p in range(0, 2500, s + 1)]
    vectors = spark.createDataFrame([(s, p, bytearray(c)) for s, p, c in rows], "shard long, part long, counts binary")
    got = {r["shard"]: np.frombuffer(bytes(r["counts"]), "<i8").tolist() for r in align.tree_sum(Work(spark, "t"), vectors, "v").collect()}
    assert got == {s: [sum(range(0, 2500, s + 1)), s * len(range(0, 2500, s + 1)), len(range(0, 2500, s + 1))] for s in range(3)}


# -- spelling ----------------------------------------------------------------------------


def as_variants(rows):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def test_spelling_query(spark, docs):
    rows = entry.queries()["op12_spelling_variants"](spark, SF).collect()
    counts = slipped_words(docs, zlib.crc32)
    assert len(rows) == len(counts) and as_variants(rows) == variants(counts)


def test_spelling_edges(spark):
    rng = random.Random(11)
    base = ["spelling", "mississippi", "aaaaaaa", "ÀÀÀÀÀÀé", "straße×", "bananas"]
    rows = [(None, "lonely lonely"), (None, None), (7, None), (8, ""), (9, "12 -- ☃")]
    k = 100
    for w in base:
        forms = [w] * 40 + [w[:i] + w[i + 1 :] for i in range(len(w))] + [w[:i] + "q" + w[i:] for i in range(len(w) + 1)]
        forms += [w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in "xé"]
        for f in forms:
            for _ in range(6 if f != w else 4):
                rows.append((k, f"{f.upper() if f.isascii() and rng.random() < 0.3 else f} {f}, {f}"))
                k += 1
    rows += [(k, "chainaa " * 5 + "chainab " * 25 + "chainbb " * 125 + "cheinbb " * 625)] * 2
    got = as_variants(spelling.group_variants(spark, frame(spark, rows)).collect())
    want = variants(slipped_words(rows, zlib.crc32))
    assert got == want
    assert got["chainaa"][:2] == ("chainab", "cheinbb") and any(v[0] is None and v[3] for v in got.values())
    assert spelling.group_variants(spark, frame(spark, rows).limit(0)).collect() == []
    assert spelling.group_variants(spark, frame(spark, [(1, None)])).collect() == []


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.text("abÀ", min_size=6, max_size=8), st.integers(5, 400), min_size=1, max_size=30))
def test_near_words_of_close_words(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: r["n_near"] for r in spelling.near_words(df).collect()}
    assert got == {w: v[3] for w, v in variants(counts).items() if v[3]}
