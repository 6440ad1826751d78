"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra
columns with clashing names, for every operator."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from brute import later_words, link_components, repeated_bytes, spans
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recoflow.llm import chat, debruijn, exact_dedup, fingerprints, html_extract, mixing, packing, rlbwt, setjoin, toxicity
from recoflow.llm.common import settings as session_settings
from recoflow.llm.tokens import WordTokenizer
from recoflow.llm.windows import merged, runs

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Extra columns named like columns that operators make themselves.
EXTRA = ["id", "key", "n", "size", "score", "start", "spans", "target", "row", "digest", "hash", "part", "_text"]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def frame(spark, rows, partitions=3):
    """(doc_id, text, source) rows with clashing extra columns."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(partitions)
    return df.withColumns({c: F.lit("x") for c in EXTRA})


def word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages, periodic and very long ones."""
    rng = random.Random(7)
    words = [word(rng) for _ in range(3000)]
    passage = " ".join(rng.choices(words, k=60))
    base = rng.choices(words, k=300)
    texts = ["", " \n\t", None, "one", "one two", "a " * 400, "b" * 1000, "ab" * 700, "x y " * 300, passage, passage]
    for k in range(40):
        near = list(base)
        for _ in range(k // 8):
            near[rng.randrange(len(near))] = word(rng)
        texts.append(" ".join(near))
    for k in range(40):
        texts.append(" ".join(rng.choices(words, k=80)) + "\n" + passage + "\n" + " ".join(rng.choices(words, k=k)))
    texts.append(" ".join(rng.choices(words, k=30_000)))
    texts += ["Ünïcode ☃ " * 60, "é" * 300, "the same ten words in a row are said here again " * 30]
    for n in (8, 9, 10, 11, 18, 19, 20, 21, 30):  # sizes around the subset boundary
        some = rng.choices(words, k=n + 2)
        texts += [" ".join(some), " ".join(some[:-1]), " ".join([*some, "more"])]
    return [(3 * k + 1, t, f"s{k % 4}" if k % 5 else None) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def test_exact_dedup(spark, corpus, empty):
    rows = corpus + [(1, "", "s0"), (None, "nobody", None)]  # a repeated row and a row without id
    for digest in (exact_dedup.sha256, lambda c: F.substring(exact_dedup.sha256(c), 1, 1)):
        got = exact_dedup.exact_dedup(spark, frame(spark, rows), digest=digest).collect()
        assert len(got) == len(rows)
        groups = {}
        for d, t, _ in rows:
            groups.setdefault(t or "", []).append(d)
        texts = {sha(t): ids for t, ids in groups.items()}
        for r in got:
            ids = texts[r.text_sha256]
            assert r.group_size == len(ids) and r.keep_id == max(ids, key=lambda d: (d is not None, d or 0))
        assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_dedup(spark, empty).collect() == []
    kept = exact_dedup.kept_rows(spark, frame(spark, rows))
    assert kept.count() == len(groups) and kept.columns == frame(spark, rows).columns


def test_mixing(spark, empty):
    rows = [(k, "w " * (k % 7), f"s{k % 3}") for k in range(300)] + [(1000, None, None), (1001, "a b", None), (1001, "a b", None), (None, "c", "z")]
    got = mixing.mix(spark, frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(sum(r.size for r in got))
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    assert mixing.mix(spark, empty).collect() == []
    assert mixing.mixed_rows(spark, empty).collect() == []
    silent = mixing.mix(spark, frame(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r.size, r.taken) for r in silent] == [(0, 0)] * 2


def test_mixing_hot_source_refines(spark):
    """One source with most rows: nested thresholds come as near as one document."""
    rows = [(k, "w " * (1 + k % 50), "hot" if k % 10 else f"s{k % 30}") for k in range(6000)]
    got = mixing.mix(spark, frame(spark, rows)).collect()
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 25.5


def test_packing(spark, corpus, empty):
    pieces, tokens = packing.pack(spark, frame(spark, corpus), TOKENIZER)
    got = pieces.collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for d, t, _ in corpus}
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u2").tolist() for r in packing.sequences(tokens).collect()}
    assert sum(map(len, whole.values())) == sum(map(len, ids.values()))
    assert all(len(whole[s]) == 4096 for s in range(len(whole) - 1))
    for r in got:
        part = ids[r.id][r.start : r.start + r.length]
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == part
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    assert packing.pack(spark, empty, TOKENIZER)[0].collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aB ß'sİΣ \u0085\u001c\n\té́<|>")), max_size=40))
def test_word_tokenizer_equals_the_tokenizer(text):
    text = text + " <|endoftext|> don't We'LL 12 ÀÉ ﬁ"
    ids = np.frombuffer(WordTokenizer.shared(TOKENIZER).encode(text), "<u2").tolist()
    assert ids == Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids


def test_fingerprints(spark, corpus, empty):
    rows = corpus + [(1, "", "s0"), (None, "first", None)]
    got = fingerprints.fingerprint_with_next(spark, frame(spark, rows)).collect()
    assert len(got) == len(rows)
    order = sorted(((d is not None, d or 0, t or "") for d, t, _ in rows))
    want = []
    for (_, d, t), (_, _, f) in zip(order, order[1:] + order[:1]):
        edited = t[: len(t) - len(t) // 4] + f[: len(t) // 4]
        want.append((d, len(t), sha(edited)))
    assert sorted(want) == sorted((r.doc_id or 0, r.n_chars, r.edited_sha256) for r in got)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.fingerprint_with_next(spark, empty).collect() == []
    alone = fingerprints.fingerprint_with_next(spark, frame(spark, [(5, "abcd", None)])).collect()
    assert (alone[0].edited_sha256, alone[0].near_next) == (sha("abca"), 1.0)


def test_changed_spans_locate_an_edit():
    rng = random.Random(3)
    lines = [" ".join(word(rng) for _ in range(30)) for _ in range(40)]
    a = "\n".join(lines)
    lines[17] = lines[17][:50] + " EDIT " + lines[17][50:]
    b = "\n".join(lines)
    found = fingerprints.changed(str(fingerprints.Tree(a)), str(fingerprints.Tree(b)))
    at = b.encode().index(b" EDIT ")
    assert found and all(lo >= at - 200 and hi <= at + 200 for lo, hi in found) and any(lo <= at < hi for lo, hi in found)
    assert fingerprints.changed(str(fingerprints.Tree(b)), str(fingerprints.Tree(b))) == []


@settings(max_examples=200, deadline=None)
@given(st.text("<\\|im_startend>a\n", max_size=30), st.text("<\\|\nn", max_size=6))
def test_chat_escapes_are_reversible(text, role):
    escaped = text.replace("\x00", "")
    import re

    escaped = re.sub(r"<(\\*)\|", lambda m: "<\\" + m[1] + "|", text)
    assert "<|" not in escaped and chat.unescape(escaped) == text


def contexts(turns):
    """Examples, turns of their contexts, digest of the contexts and broken ones, over (role, text) in order."""
    targets = [k for k, (role, _) in enumerate(turns) if role == "assistant"]
    digests = [sha("".join(f"{a}\n{b}\n" for a, b in turns[:k])) for k in targets]
    return len(targets), sum(targets), sha("".join(f"{k}:{k}:{d}\n" for k, d in zip(targets, digests))), 0


def test_chat(spark):
    turns = [(1, 0, "user", "a <\\| b <|im_end|>"), (1, 1, "assistant", None), (1, 1, "assistant", "<"), (2, 5, None, "x\n\n"),
             (2, 6, "we\nird\\n", "y"), (None, 0, "user", "n"), (None, 1, "assistant", "m" * 100_000), (3, 0, "assistant", "☃"), (3, 0, "assistant", "☃")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("pos", "start", "segment", "at")})
    segments = chat.format_turns(spark, df)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted(((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        loss = "".join(t for _, r, t in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{a}\n{b}\n" for _, a, b in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert (r.n_examples, r.context_turns, r.contexts_sha256, r.n_broken_contexts) == contexts([(a, b) for _, a, b in own])
    assert {(r.conv, r.target): len(r.text) for r in chat.example_texts(segments).collect()} == {
        (r.conv, r.target): r.chars for r in chat.examples(segments).collect()}
    texts = {(r.conv, r.target): r for r in chat.example_texts(segments, 1000).collect()}
    assert len(texts) == 4  # the long reply stays a span
    last = texts[1, 2]
    assert last.text.startswith("<|im_start|>user\n") and last.text[last.loss_start : last.loss_end] == "<" and len(last.text) == last.chars
    assert chat.examples(segments).count() == 5
    assert chat.format_turns(spark, df.limit(0)).collect() == []


def test_chat_loss_is_read_from_the_examples(spark):
    """Read back from the expansion: a missing or shortened example shows in the loss columns."""
    turns = [(1, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(7)]
    segments = chat.format_turns(spark, spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    made = chat.examples(segments)
    assert [(r.target, r.context_end < r.loss_start < r.loss_end < r.chars) for r in made.orderBy("target").collect()] == [(1, True), (3, True), (5, True)]
    loss = lambda ex: [(r.n_turns, r.loss_chars, r.loss_sha256) for r in chat.read_back(segments, ex).collect()]
    assert loss(made) == [(7, 18, sha("turn 1turn 3turn 5"))]
    assert loss(made.where("target != 3")) == [(7, 12, sha("turn 1turn 5"))]
    assert loss(made.withColumn("chars", F.col("loss_end") - 1)) == [(7, 15, sha("turn turn turn "))]


def test_chat_contexts_are_read_from_the_examples(spark):
    """A context that lacks a turn, has one too many or ends inside one shows in the context columns."""
    turns = [(1, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(7)]
    segments = chat.format_turns(spark, spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    made = chat.examples(segments)
    names = ("n_examples", "context_turns", "contexts_sha256", "n_broken_contexts")
    read = lambda ex: [tuple(r[c] for c in names) for r in chat.read_back(segments, ex).collect()]
    right = contexts([(role, text) for _, _, role, text in turns])
    assert read(made) == [right] and right[:2] == (3, 9)
    starts = {r.pos: r.start for r in segments.collect()}
    moved = lambda at: made.withColumn("context_end", F.when(F.col("target") == 3, F.lit(at).cast("long")).otherwise(F.col("context_end")))
    for pos, n_turns in ((2, 8), (4, 10), (0, 6)):
        (got,) = read(moved(starts[pos]))
        assert got[:2] == (3, n_turns) and got[2] != right[2] and got[3] == 0
    (inside,) = read(moved(starts[3] - 1))
    assert inside[3] == 1
    assert read(made.where("target != 3"))[0][:2] == (2, 6)


def test_chat_long_conversation_over_many_partitions(spark):
    turns = [(7, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(2000)] + [(8, 0, "user", "z")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    rows = chat.format_turns(spark, df).where("conv = 7").orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(2000))
    assert all(a.end == b.start for a, b in zip(rows, rows[1:])) and rows[0].start == 0
    assert "".join(r.segment for r in rows)[rows[1].loss_start : rows[1].loss_end] == "turn 1"


def test_toxicity_edges(spark, empty):
    rows = [(k, ("you idiot moron " if k % 4 == 0 else "kind words only ") * (1 + k % 5), "s") for k in range(200)] + [(None, None, None), (900, "", "s"), (901, "ok", "s")]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)] + [(3, None), (5, 0), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.fit(spark, docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, [docs["doc_id"]]).collect()}
    assert len(got) == len(rows) and all(got[k] > 0.7 for k in range(0, 200, 4)) and all(got[k] < 0.3 for k in range(1, 200, 4))
    assert got[None] == got[900] < 0.7
    clean = toxicity.clean_rows(spark, docs, model, 0.7)
    assert clean.columns == docs.columns and clean.count() == sum(s < 0.7 for s in got.values())
    none = toxicity.fit(spark, docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none, [docs["doc_id"]]).collect()} < {0.0, 1e-9} or max(
        r.score for r in toxicity.score(docs, none, [docs["doc_id"]]).collect()
    ) < 1e-9
    assert toxicity.score(empty, model, [empty["doc_id"]]).collect() == []
    assert toxicity.clean_rows(spark, empty, model, 0.7).collect() == []


def test_toxicity_short_texts_blocks_and_lookups(monkeypatch):
    grams = lambda t: np.concatenate(list(toxicity.ngrams(t)))
    assert [len(grams(t)) for t in ("a", "ab", "abc")] == [1, 3, 6] and list(toxicity.ngrams("")) == []
    text = "".join(random.Random(1).choices("abc Ü☃", k=5000))
    whole = np.sort(grams(text))
    monkeypatch.setattr(toxicity, "BLOCK", 97)
    assert np.array_equal(np.sort(grams(text)), whole)
    known = np.unique(np.concatenate([whole[::3], np.arange(50, dtype=np.uint64)]))  # many share their first bits
    model = toxicity.Model.of(0.0, known, np.ones(len(known)))
    assert np.array_equal(np.sort(known[model.find(whole)]), whole[np.isin(whole, known)])


def test_toxicity_of_joined_texts_is_their_mean():
    rng = np.random.default_rng(1)
    known = np.unique(np.concatenate(list(toxicity.ngrams("some clean words and an idiot"))))
    model = toxicity.Model.of(-1.0, known, rng.normal(size=len(known)))
    one = model.log_odds("clean words")
    many = model.log_odds(" ".join(["clean words"] * 300_000))  # 3.6 MB
    n = sum(map(len, toxicity.ngrams("clean words"))) + 1.0
    assert abs(many - one) < abs(one) + 60 / n and abs(many - model.log_odds(" ".join(["clean words"] * 1000))) < 0.1


def test_minimise_finds_the_minimum():
    a = np.diag([1.0, 30.0, 0.5]) + 0.2
    x = toxicity.minimise(lambda x: (0.5 * x @ a @ x - x.sum(), a @ x - 1), np.zeros(3))
    assert np.allclose(a @ x, 1, atol=1e-3)


@pytest.mark.parametrize("rule", [(3, 90, 100), (5, 80, 100), (2, 60, 100)])
def test_setjoin(spark, corpus, empty, rule):
    rows = corpus + [(1, "", "s0"), (None, "one two", None)]
    groups, links = setjoin.link_groups(spark, frame(spark, rows), *rule)
    got = groups.collect()
    assert len(got) == len(rows) and all(r.component_id is None for r in got if r.id is None)
    want = link_components([(d, t) for d, t, _ in corpus], *rule)
    assert {r.id: (r.n_shingles, r.component_id) for r in got if r.id is not None} == want
    if rule[0] == 3:
        assert setjoin.link_groups(spark, empty, *rule)[0].collect() == []


def test_setjoin_pairs_of_a_group_of_near_copies(spark, monkeypatch):
    """Copies with different numbers of changed words: most do not link with the smallest id, and many not with each other."""
    rng, rows, verified, seen = random.Random(3), [], setjoin.verified, []
    base = [f"w{i}" for i in range(300)]
    for doc in range(240):
        text = list(base)
        for at in rng.sample(range(300), 9 if doc < 40 else rng.randint(2, 7)):
            text[at] = f"d{doc}x{at}"
        rows.append((doc, " ".join(text), None))

    def counted(work, texts, pairs, *more):
        seen.append(pairs.count())
        return verified(work, texts, pairs, *more)

    monkeypatch.setattr(setjoin, "verified", counted)
    groups, _ = setjoin.link_groups(spark, frame(spark, rows), 5, 80, 100)
    want = link_components([(d, t) for d, t, _ in rows], 5, 80, 100)
    assert {r.id: (r.n_shingles, r.component_id) for r in groups.collect()} == want
    assert sum(seen) <= 10 * len(rows), seen


def test_subsets_meet_exactly_at_the_overlap():
    rule = setjoin.Rule(3, 80, 100)
    rng = np.random.default_rng(1)
    for n in range(1, 13):
        for m in rule.sizes(n):
            if not 0 < m <= 13:
                continue
            c = rule.overlap(n, m)
            for common in (c, c - 1):
                if 0 <= common <= min(n, m):
                    h = rng.integers(0, 2**63, n + m, dtype=np.uint64)
                    x, y = np.sort(h[:n]), np.sort(np.concatenate([h[:common], h[n : n + m - common]]))
                    meet = np.intersect1d(setjoin.subset_hashes(x, rule.subset_sizes(n, 13)), setjoin.subset_hashes(y, rule.subset_sizes(m, 13)))
                    if common == c:
                        assert len(meet)


@pytest.mark.parametrize("shard", [rlbwt.SHARD_BYTES, 0])
def test_rlbwt(spark, corpus, empty, shard):
    """With a shard size of 0 every key takes the way of very large ones."""
    rows = corpus + [(None, corpus[11][1], None)]
    got = {r.id: r for r in rlbwt.remove_repeats(spark, frame(spark, rows), shard_bytes=shard).collect()}
    assert len(got) == len(rows) and got[None].n_removed == 0
    for d, (data, gone) in repeated_bytes([(d, t) for d, t, _ in corpus], 200).items():
        kept = bytes(b for b, g in zip(data, gone) if not g)
        r = got[d]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), sum(gone), spans(gone), sha(kept)), d
    if shard:
        assert rlbwt.remove_repeats(spark, empty).collect() == []


def test_debruijn(spark, corpus, empty):
    rows = corpus + [(None, corpus[11][1], None)]
    got = {r.id: r for r in debruijn.remove_repeats(spark, frame(spark, rows)).collect()}
    assert len(got) == len(rows) and got[None].n_removed == 0
    for d, (words, gone) in later_words([(d, t) for d, t, _ in corpus], 20).items():
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        r = got[d]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(words), sum(gone), sha(kept)), d
        assert sum(s.b - s.a for s in r.spans) == sum(gone)
    assert debruijn.remove_repeats(spark, empty).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=60), max_size=6), st.booleans())
def test_runs_hold_every_window_once(texts, first_stays):
    data = [t.encode() for t in texts]
    doc, start, n, key, again = (x.tolist() for x in runs(*rlbwt.text_bytes(data), 8, 3, first_stays))
    held, marked, keys = [], set(), {}
    for d, s, c, k, a in zip(doc, start, n, key, again):
        places = [(d, s + i) for i in range(c)]
        if a:
            marked |= set(places)
            continue
        own = [data[d][i : i + 8] for _, i in places]
        assert len(set(own)) == len(own)  # no window twice in a run
        held += places
        for w in own:
            assert keys.setdefault(w, k) == k
    every = [(d, k) for d, t in enumerate(data) for k in range(len(t) - 7)]
    text = lambda p: data[p[0]][p[1] : p[1] + 8]
    assert len(held) == len(set(held)) and set(held) | marked == set(every)
    for d, k in marked:  # each marked window is at another place of its document, with first_stays an earlier one
        others = [p for p in every if p[0] == d and p != (d, k) and text(p) == text((d, k))]
        assert others and (not first_stays or min(others) < (d, k))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=40), min_size=1, max_size=5))
def test_matching_statistics(texts):
    text = np.frombuffer(b"\xff".join(t.encode() for t in texts) + b"\xff", np.uint8)
    got = rlbwt.RunLengthIndex(text).matching_statistics()
    raw = text.tobytes()

    def common(a, b):
        k = 0
        while max(a, b) + k < len(raw) and raw[a + k] == raw[b + k]:
            k += 1
        return k

    assert got.tolist() == [max([common(i, j) for j in range(len(raw)) if j != i], default=0) for i in range(len(raw))]


def test_merged():
    assert merged([(5, 7), (0, 2), (2, 3), (6, 9)]) == [(0, 3), (5, 9)]


PAGE = """<html><head><title>T</title></head><body><header class='site-header'>Site name</header>
<div class="cookie-notice">We use cookies</div><div id=menu-main>Menu</div>{}
<aside>Side</aside><section class="comments"><p>First!</p></section><form>Search</form><footer>Foot</footer></body></html>"""


def test_html_pages(spark):
    body = "<div class='post'><h2>Title {0}</h2><p>Own&nbsp;text&#32;of  page {0} &amp; more<br>here <i>it</i>alic<p>Second<ul><li>i{0}<li>j</ul></div><div>Shared strip</div>"
    article = "<article><header><h1>Head</h1><p>by me</p></header><p>Same text</p><div class='ad'>Buy</div><script>if (a < b) x('</p>')</script><!-- c > d --></article>"
    pages = [(k, f"http://h.example/a/{k}", PAGE.format(body.format(k))) for k in range(6)]
    pages += [(10, "http://g.example/1", PAGE.format(article)), (11, "http://g.example/2", PAGE.format(article)), (12, None, None), (13, "http://x", "plain &lt;text&gt; only"),
              (14, "http://y", ""), (14, "http://y", ""), (15, "http://z", "<article><p>" + "long text " * 50_000 + "</p></article>"), (16, "http://w", "<p>unclosed <b>bold <div")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("host", "path", "kind", "lines", "id")})
    got = html_extract.extract(spark, df).collect()
    assert len(got) == len(pages)
    text = {r.page_id: r.text for r in got}
    assert text[0] == "Title 0\nOwn text of page 0 & more here italic\ni0"  # lines that the nearest page has too are gone
    assert text[10] == text[11] == "Head\nSame text"
    assert text[12] == text[14] == "" and text[13] == "plain <text> only" and text[15] == ("long text " * 50_000).strip()
    assert text[16].startswith("unclosed bold")
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(spark, df.limit(0)).collect() == []


def test_html_lines_beside_an_article():
    """Differencing decides lines outside the article too: own ones stay, shared ones go."""
    page = "<body><h1>Title {0}</h1><p>Lead {0}</p><p>Terms of use</p><article><p>Body {0}</p></article><p>More {0}</p></body>"
    lines = [html_extract.page_lines(page.format(k)) for k in range(2)]
    shared = {i for i, _ in html_extract.common_lines(*([x for x, _ in p] for p in lines))}
    assert html_extract.main_text(lines[0], shared) == "Title 0\nLead 0\nBody 0\nMore 0"
    teasers = html_extract.page_lines("<h1>Title</h1><p>Text</p><article><a>Card</a></article>")
    assert html_extract.main_text(teasers, set()) == "Title\nText\nCard"


def test_html_names_around_the_article():
    """A wrapper's name or a page-wide form does not rule out the article; names count whole."""
    def text(page):
        return html_extract.main_text(html_extract.page_lines(page), set())

    article = "<article><header class='header'><h1>Head</h1></header><p>One long line of text</p><p class='social-history'>Two</p><div class='share-buttons'>Like</div></article>"
    want = "Head\nOne long line of text\nTwo"
    for open_, close in (("<div class='layout no-sidebar'>", "</div>"), ("<div class='with-sidebar'>", "</div>"), ("<div class=sidebar>", "</div>"),
                         ("<form id=aspnetForm>", "</form>"), ("<form><div class='widget'>", "</div></form>")):
        assert text(f"<body>{open_}{article}<div class='ad'>Buy</div>{close}<div id='comments-thread'><article class='comment'>I think {'x ' * 99}</article></div>") == want
    plain = "<h1>Head</h1><p>One long line of text</p><p>Two</p><div class='ad'>Buy</div>"
    assert text(f"<form><div class='sidebar-layout'>{plain}</div><input></form>") == want
    assert text("<div class='ad'>Buy</div><div class='sidebar-left'><p>a</p></div><p>All of the text</p><form>Search</form>") == "All of the text"


COPY = "<p>News of h.example</p><p>Contact and terms</p><h1>{0}</h1><p>{0} has one long paragraph of its own, said nowhere else</p><p>{0} has a second one too</p><p>Printed {1}</p>"


@pytest.mark.parametrize("parts", [1, 2, 5, 16])
@pytest.mark.parametrize("held", [html_extract.HELD_CHARS, 1])
def test_html_copies(spark, parts, held, monkeypatch):
    """Copies next to each other keep their article and lose what pages outside share, in any partitioning."""
    monkeypatch.setattr(html_extract, "HELD_CHARS", held)
    names = ["Ants", "Bees", "Bees", "Bees", "Bees", "Bees", "Crows", "Crows", "Dogs"]
    pages = [(k, f"http://h.example/{n}/{k}", COPY.format(n, k)) for k, n in enumerate(names)]
    pages += [(20, "http://i.example/1", COPY.format("Elks", 1)), (21, "http://i.example/1/print", COPY.format("Elks", 2))]
    order = [html_extract.Page(k, u, u[7:16], html_extract.page_lines(p)) for k, u, p in pages]
    here = {p.id: p.result()[2] for g, after, right in html_extract.groups(iter(order)) for p in g.closed(after, right)}
    with session_settings(spark, {"spark.sql.shuffle.partitions": str(parts)}):
        df = spark.createDataFrame(pages, "page_id long, url string, html string")
        got = {r.page_id: r.text for r in html_extract.extract(spark, df).collect()}
    assert got == here
    for k, n in enumerate(names):
        assert got[k].split("\n") == [n, f"{n} has one long paragraph of its own, said nowhere else", f"{n} has a second one too", f"Printed {k}"]
    assert got[20].startswith("News") and "Elks has a second one too" in got[21]  # copies alone on a host: nothing to compare with


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=9), st.lists(st.sampled_from("abcd"), max_size=9))
def test_common_lines_are_longest(a, b):
    pairs = sorted(html_extract.common_lines(a, b))
    assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    assert len(pairs) == best[-1][-1]


def text_of(page):
    return html_extract.main_text(html_extract.page_lines(page), set())


def test_html_comments_with_articles_of_their_own():
    story = "<article><h1>Title</h1><p>Body</p>{}</article>"
    said = '<section id="comments"><article><p>reader says</p></article><article><p>so do I</p></article></section>'
    assert text_of(story.format(said)) == "Title\nBody"
    assert text_of("<main><h1>Title</h1><p>Body</p>" + said + "</main>") == "Title\nBody"
    # a layout name around the only article does not rule it out
    assert text_of('<main><div class="sidebar-right"><article><p>Body</p><p>More</p></article></div></main>') == "Body\nMore"


@pytest.mark.parametrize("name", ["user-comments", "article-body__comments", "maintenance-notice", "sticky-advertisement",
                                  "inline-promo-box", "story-sidebar"])
def test_html_names_that_end_in_boilerplate(name):
    page = f'<main><h1>Title</h1><p>A long first paragraph.</p><div class="{name}"><p>gone</p></div><p>Last</p></main>'
    assert text_of(page) == "Title\nA long first paragraph.\nLast"


@pytest.mark.parametrize("name", ["no-sidebar", "with-sidebar", "market-share", "social-history", "commentary", "story-body"])
def test_html_names_that_only_mention_it(name):
    page = f'<main><h1>Title</h1><div class="{name}"><p>stays</p></div><p>A longer last paragraph of the text.</p></main>'
    assert text_of(page) == "Title\nstays\nA longer last paragraph of the text."


def test_html_forgotten_end_tags():
    for element in ("nav", "header", "aside"):
        assert text_of(f"<{element}><ul><li><a>Home</a></li><main><h1>Title</h1><p>Body</p></main>") == "Title\nBody"
        assert text_of(f"<{element}><a>Home</a><article><h1>Title</h1><p>Body</p></article>") == "Title\nBody"
    # a card inside an aside that ends is no article text
    assert text_of("<main><p>Body</p><aside><article><p>Card</p></article></aside></main>") == "Body"


def test_html_what_is_not_seen_does_not_end_a_block():
    assert text_of("<article><p>a<script>x()</script>b <style>p{}</style>c</p><p>d</p></article>") == "ab c\nd"
    assert text_of("<article><p>one <button type=button>Copy</button> two</p></article>") == "one two"
    assert text_of("<article><p>one</p><button>never closed<p>two</p></article>") == "one"
