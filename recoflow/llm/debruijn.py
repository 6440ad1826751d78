"""Substring deduplication by de Bruijn compaction (operator 9).

Tokens are words. Every ``WINDOW`` consecutive words are an edge of the graph, from
the node of their first to the node of their last ``WINDOW - 1`` words. Edges of one
document with one minimizer lie behind one another on a nonbranching path, and only
paths whose minimizer recurs can be repeated (see ``windows``). Paths with equal words
are one path of the graph with several source coordinates; a 128-bit digest of the
words at each coordinate verifies that. Where paths with one minimizer differ
(a repeat begins or ends there) they are taken apart into their edges. Spark
joins then compact: a path followed by one path only, which follows that one
only, is joined to it, by pointer doubling, into maximal nonbranching paths, and
each occurrence of such a path is one span of its document.

A word is removed if a window that covers it starts earlier too (smaller id, or same
document and earlier start).

Defined results: a null text has no words; a text shorter than a window loses
nothing; rows that repeat an id are the same document, not its copies; a row without
id is compared with nothing; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.llm.common import WORD, Work
from recoflow.llm.windows import merged, mixed, repeated_runs, with_runs

WINDOW, GRAM = 20, 5
_WORDS = re.compile(WORD)
_BYTE_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, from prefix sums of b[i] * B**i; where each text's words lie."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    with np.errstate(over="ignore"):
        power = np.full(len(data) + 1, np.uint64(_BASE))
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * power[:-1], out=total[1:])
        space = np.concatenate([[True], _SPACE[data]])
        edge = np.flatnonzero(space[1:] != space[:-1])
        begin, end = edge[0::2], edge[1::2]
        back = np.full(len(data) + 1, _INVERSE)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        h = mixed((total[end] - total[begin]) * back[begin])
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    starts = np.searchsorted(begin, bounds[:-1])
    lengths = np.searchsorted(begin, bounds[1:]) - starts
    return h, starts, lengths


def _words(text: bytes) -> list[bytes]:
    return _BYTE_WORDS.findall(text)


def _strong(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, runs) -> (key, path, doc, start, n): the digest of each run's words at its coordinate."""
    for b in batches:
        cols: list[list] = [[], [], [], [], []]
        for doc, text, runs in zip(*(c.to_pylist() for c in b.columns)):
            words = _words(text.encode("utf-8", "surrogatepass"))
            for r in runs:
                start, n = r["start"], r["n"]
                for c, v in zip(cols, (r["key"], _strong(words[start : start + n + WINDOW - 1]), doc, start, n)):
                    c.append(v)
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["key", "path", "doc", "start", "n"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, runs) -> (edge, doc, start): every window of the runs by its own digest."""
    for b in batches:
        edge, docs, starts = [], [], []
        for doc, text, runs in zip(*(c.to_pylist() for c in b.columns)):
            words = _words(text.encode("utf-8", "surrogatepass"))
            for r in runs:
                for s in range(r["start"], r["start"] + r["n"]):
                    edge.append(_strong(words[s : s + WINDOW]))
                    docs.append(doc)
                    starts.append(s)
        yield pa.RecordBatch.from_arrays(
            [pa.array(edge, pa.binary()), pa.array(docs, pa.int64()), pa.array(starts, pa.int32())], ["edge", "doc", "start"]
        )


def compacted(work: Work, paths: DataFrame) -> DataFrame:
    """(path, whole, lead): the maximal nonbranching path each path is part of, named
    by its last piece, and how many windows of it lie before the path's own.

    ``paths``: (path, doc, start, n) of all occurrences. Path y follows path x where
    an occurrence of y starts in the document where one of x ends."""
    here = paths.select("path", "doc", "start", (F.col("start") + F.col("n")).alias("until"))
    after = here.select(F.col("path").alias("next"), F.col("doc").alias("_doc"), F.col("start").alias("_start"))
    steps = here.join(after.hint("merge"), (F.col("doc") == F.col("_doc")) & (F.col("until") == F.col("_start")), "left")
    # A path leads on if every occurrence is followed by one and the same path ...
    out = steps.groupBy("path").agg(
        F.min("next").alias("next"), F.max("next").alias("_max"), F.count("next").alias("_followed"), F.count(F.lit(1)).alias("_all")
    ).where("next = _max and _followed = _all and next != path").select("path", "next", F.col("_all").alias("times"))
    # ... whose own occurrences all follow it: then both occur equally often.
    counts = paths.groupBy("path").agg(F.count(F.lit(1)).alias("n_times"), F.first("n").alias("n"))
    counts = work.keep(counts, "path-counts")
    links = out.join(
        counts.select(F.col("path").alias("next"), F.col("n_times")).hint("merge"), "next"
    ).where("times = n_times").select("path", "next")
    state = work.keep(
        counts.join(links.hint("merge"), "path", "left").select(
            "path", "n", F.coalesce("next", "path").alias("whole"), F.when(F.col("next").isNotNull(), F.col("n")).otherwise(0).cast("long").alias("ahead")
        ),
        "chain0",
    )
    # Pointer doubling: after r rounds a path knows the piece 2**r places on.
    rounds = 0
    while True:
        to = state.select(F.col("path").alias("_p"), F.col("whole").alias("_w"), F.col("ahead").alias("_a"))
        moved = work.keep(
            state.join(to.hint("merge"), F.col("whole") == F.col("_p")).select(
                "path", "n", F.col("_w").alias("whole"), (F.col("ahead") + F.col("_a")).alias("ahead"), (F.col("_w") != F.col("whole")).alias("moved")
            ),
            f"chain{rounds + 1}",
        )
        work.drop(f"chain{rounds}")
        rounds += 1
        state = moved.drop("moved")
        if moved.where("moved").isEmpty():  # documents end, so links form no cycle
            return state


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_words", "n_removed", "kept_sha256", "spans"]
    for b in batches:
        cols: list[list] = [[] for _ in names]
        for doc, text, spans in zip(*(c.to_pylist() for c in b.columns)):
            words = _WORDS.findall(text)
            cut = merged([(s["a"], s["b"]) for s in spans or ()])
            kept, at = [], 0
            for a, e in cut:
                kept += words[at:a]
                at = e
            kept += words[at:]
            digest = hashlib.sha256(" ".join(kept).encode("utf-8", "surrogatepass")).hexdigest()
            for c, v in zip(cols, (doc, len(words), len(words) - len(kept), digest, [{"a": a, "b": e} for a, e in cut])):
                c.append(v)
        span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, spans) of every row; spans are word ranges."""
    work = Work(spark, "debruijn")
    texts = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    found, within = repeated_runs(work, texts.where("id is not null"), word_hashes, WINDOW, GRAM, first_stays=True)
    sources = with_runs(work, texts, found, "sources")
    work.drop("repeated")
    paths = work.keep(
        sources.mapInArrow(_paths, "key long, path binary, doc long, start int, n int").distinct(), "paths"
    )
    place = F.struct("doc", "start")
    firsts = work.keep(paths.groupBy("key", "path", "n").agg(F.min(place).alias("first")), "firsts")
    # Keys under which different paths lie: their first occurrences are taken apart into edges.
    mixed_keys = firsts.groupBy("key").agg(F.min("path").alias("lo"), F.max("path").alias("hi")).where("lo != hi").select("key")
    apart = firsts.join(mixed_keys.hint("merge"), "key").select(
        F.col("first.doc").alias("doc"), F.struct(F.col("first.start").alias("start"), "n").alias("run")
    ).groupBy("doc").agg(F.collect_list("run").alias("apart"))
    edges = work.keep(
        sources.drop("runs").join(apart.hint("merge"), sources["id"] == apart["doc"]).select("id", "text", "apart")
        .mapInArrow(_edges, "edge binary, doc long, start int"),
        "edges",
    )
    work.drop("sources")
    earliest = edges.groupBy("edge").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
    later = edges.join(earliest.hint("merge"), "edge").where(place > F.col("first"))
    single = later.select("doc", F.col("start").alias("a"), (F.col("start") + WINDOW).alias("b"))
    # Occurrences after the first of whole paths, compacted: one span per occurrence of a nonbranching path.
    repeats = work.keep(
        paths.join(firsts.select("path", "first").hint("merge"), "path").where(place > F.col("first")).select("path", "doc", "start", "n"),
        "repeats",
    )
    chains = compacted(work, repeats)
    whole = repeats.join(chains.select("path", "whole", "ahead").hint("merge"), "path").groupBy(
        "doc", "whole", (F.col("start") + F.col("ahead")).alias("last")
    ).agg(F.min("start").alias("a"), (F.max(F.col("start") + F.col("n")) + WINDOW - 1).cast("int").alias("b")).select("doc", "a", "b")
    own = within.select("doc", F.col("start").alias("a"), (F.col("start") + F.col("n") + WINDOW - 1).alias("b"))
    spans = work.keep(
        whole.unionByName(single).unionByName(own).groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans"
    )
    work.drop("paths", "firsts", "edges", "repeats", "path-counts", "again")
    return texts.join(spans.hint("merge"), texts["id"] == spans["doc"], "left").select("id", "text", "spans").mapInArrow(
        _removed, "id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<a:int,b:int>>"
    )
