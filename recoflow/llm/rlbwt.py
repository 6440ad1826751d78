"""Repeated byte strings through run-length compressed Burrows-Wheeler transforms (operator 8).

A string of ``LENGTH`` bytes that starts at two places is removed at both. Minimizer
runs (see ``windows``) deal the corpus's windows out so that equal windows share a
key; only keys that occur at more than one place are kept, and equal contents under
one key are one text of the index with its places. The contents of many keys
form a shard's text, every window of the corpus lying in it once. For a shard,

* the suffixes are sorted by prefix doubling, giving the transform;
* its runs are found, and at the run ends the text position is sampled and the
  match length with the neighbouring suffix computed;
* matching statistics are streamed along the text from these samples: inside a run
  the match at a position is the previous position's less one;
* windows whose longest match elsewhere reaches ``LENGTH`` bytes are marked.

A key whose contents exceed ``SHARD_BYTES`` (one passage in very many documents)
is not gathered: its windows are counted by digest in Spark instead, which gives the
same marks.

Defined results: a null text is empty; texts shorter than ``LENGTH`` lose nothing;
rows that repeat an id are the same document, not its copies; a row without
id is compared with nothing; an empty table gives
an empty result; further columns are ignored; removal may cut UTF-8 characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.llm.common import Work
from recoflow.llm.windows import merged, repeated_runs, with_runs

LENGTH, GRAM = 200, 32
#: Bytes of text of one index; a key with more is counted by digest.
SHARD_BYTES = 2 << 20
#: A byte that UTF-8 text never holds, between the contents of an index.
END = 0xFF


def text_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths, lengths


class RunLengthIndex:
    """Burrows-Wheeler transform of ``text`` in runs, with sampled run ends."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        self.text = text
        padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
        first = np.zeros(n, np.uint64)
        for k in range(8):
            first = (first << np.uint64(8)) | padded[k : n + k]
        self.ranks: list[tuple[int, np.ndarray]] = []  # (prefix length, rank of each suffix by that prefix)
        width, rank, order = 8, None, None
        keys = first
        while True:
            order = np.argsort(keys)
            sorted_ = keys[order]
            new = np.empty(n, bool)
            new[0] = True
            np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)  # from 1; 0 stands for the end of the text
            self.ranks.append((width, rank.astype(np.int32)))
            if rank.max() == n:
                break
            behind = np.zeros(n, np.int64)
            behind[: n - width] = rank[width:]
            keys = rank * np.int64(n + 1) + behind
            width *= 2
        self.suffixes = order
        before = text[order - 1]  # of the whole text: its last byte
        change = np.empty(n, bool)
        change[0] = True
        np.not_equal(before[1:], before[:-1], out=change[1:])
        start = int(rank[0]) - 1  # nothing precedes the text: a run by itself
        change[start] = True
        if start + 1 < n:
            change[start + 1] = True
        self.heads = np.flatnonzero(change)
        self.symbols = before[self.heads]

    def match(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``a`` and ``b``."""
        n = len(self.text)
        length = np.zeros(len(a), np.int64)
        for width, rank in reversed(self.ranks):
            at, bt = a + length, b + length
            inside = (at < n) & (bt < n)
            same = np.zeros(len(a), bool)
            same[inside] = rank[at[inside]] == rank[bt[inside]]
            # equal ranks at the text's end can stand for shorter prefixes
            same &= np.maximum(at, bt) + width <= n
            length[same] += width
        for _ in range(7):
            at, bt = a + length, b + length
            inside = np.flatnonzero((at < n) & (bt < n))
            inside = inside[self.text[at[inside]] == self.text[bt[inside]]]
            length[inside] += 1
        return length

    def matching_statistics(self) -> np.ndarray:
        """For each text position, the longest match that starts anywhere else."""
        n = len(self.text)
        best = np.zeros(n, np.int64)
        tails = np.append(self.heads[1:], n) - 1
        for ranks, step in ((self.heads[self.heads > 0], -1), (tails[tails < n - 1], 1)):
            at = self.suffixes[ranks]
            reach = np.zeros(n, np.int64)  # text position up to which the sampled match extends
            reach[at] = at + self.match(at, self.suffixes[ranks + step])
            stream = np.maximum.accumulate(reach) - np.arange(n)
            np.maximum(best, stream, out=best)
        return best


def repeated_windows(contents: list[tuple[bytes, int]]) -> list[np.ndarray]:
    """Per (content, windows): which of its windows occur at another place of the contents."""
    text = np.frombuffer(b"\xff".join(c for c, _ in contents) + b"\xff", np.uint8)
    statistics = RunLengthIndex(text).matching_statistics()
    out, at = [], 0
    for content, n in contents:
        out.append(np.flatnonzero(statistics[at : at + n] >= LENGTH))
        at += len(content) + 1
    return out


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, runs) -> (key, content, doc, start, n): each run's bytes by digest."""
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32()]
    for b in batches:
        cols: list[list] = [[] for _ in kinds]
        for doc, text, runs in zip(*(c.to_pylist() for c in b.columns)):
            data = text.encode("utf-8", "surrogatepass")
            for r in runs:
                start, n = r["start"], r["n"]
                digest = hashlib.blake2b(data[start : start + n + LENGTH - 1], digest_size=16).digest()
                for c, v in zip(cols, (r["key"], digest, doc, start, n)):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["key", "content", "doc", "start", "n"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, wanted) -> (key, doc, start, n, many, bytes)."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    for b in batches:
        cols: list[list] = [[] for _ in kinds]
        for doc, text, wanted in zip(*(c.to_pylist() for c in b.columns)):
            data = text.encode("utf-8", "surrogatepass")
            for w in wanted:
                row = (w["key"], doc, w["start"], w["n"], w["many"], data[w["start"] : w["start"] + w["n"] + LENGTH - 1])
                for c, v in zip(cols, row):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["key", "doc", "start", "n", "many", "bytes"])


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents in key order -> spans (doc, a, b) of marked windows of contents with one place."""
    held: list[tuple] = []
    size, last = 0, None

    def flush() -> pa.RecordBatch:
        rows: list[tuple[int, int, int]] = []
        for (_, doc, start, _, many, _), marked in zip(held, repeated_windows([(h[5], h[3]) for h in held])):
            if not many and len(marked):
                rows += [(doc, a, b) for a, b in merged([(start + m, start + m + LENGTH) for m in marked.tolist()])]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.int32()) for k in (1, 2))], ["doc", "a", "b"]
        )

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if size >= SHARD_BYTES and row[0] != last:
                yield flush()
                held, size = [], 0
            held.append(row)
            size += len(row[5])
            last = row[0]
    if held:
        yield flush()


def _window_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, doc, start, n, many, data in zip(*(c.to_pylist() for c in b.columns)):
            digests = [hashlib.blake2b(data[k : k + LENGTH], digest_size=16).digest() for k in range(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), pa.array([doc] * n, pa.int64()), pa.array(range(start, start + n), pa.int32()),
                 pa.array([many] * n, pa.bool_())], ["window", "doc", "a", "many"],
            )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_removed", "kept_sha256", "spans"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))]
    for b in batches:
        cols: list[list] = [[] for _ in names]
        for doc, text, spans in zip(*(c.to_pylist() for c in b.columns)):
            data = text.encode("utf-8", "surrogatepass")
            cut = merged([(s["a"], s["b"]) for s in spans])
            digest, at = hashlib.sha256(), 0
            for a, e in cut:
                digest.update(data[at:a])
                at = e
            digest.update(data[at:])
            row = (doc, sum(e - a for a, e in cut), digest.hexdigest(), [{"a": a, "b": e} for a, e in cut])
            for c, v in zip(cols, row):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row; spans are byte ranges."""
    work = Work(spark, "rlbwt")
    texts = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    found, within = repeated_runs(work, texts.where("id is not null"), text_bytes, LENGTH, GRAM, first_stays=False)
    sources = with_runs(work, texts, found, "sources")
    work.drop("repeated")
    rows = work.keep(sources.mapInArrow(_contents, "key long, content binary, doc long, start int, n int"), "contents")
    place = F.struct("doc", "start")
    # Contents with several places: all their windows recur.
    contents = work.keep(
        rows.groupBy("key", "content", "n").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .withColumn("many", F.col("first") != F.col("last")),
        "distinct",
    )
    several = contents.where("many").select("content")
    whole = rows.join(several.hint("merge"), "content").select("doc", F.col("start").alias("a"), (F.col("start") + F.col("n") + LENGTH - 1).alias("b"))
    # Keys with different contents are indexed; keys with too many bytes for one index are counted.
    per_key = contents.groupBy("key").agg(
        F.min("content").alias("lo"), F.max("content").alias("hi"), F.sum(F.col("n") + LENGTH).alias("bytes")
    ).where("lo != hi").select("key", (F.col("bytes") > shard_bytes).alias("large"))
    wanted = contents.join(per_key.hint("merge"), "key").select(
        F.col("first.doc").alias("doc"), "large", F.struct(F.col("first.start").alias("start"), "n", "key", "many").alias("w")
    )
    per_doc = work.keep(
        wanted.groupBy("doc").agg(
            F.collect_list(F.when(~F.col("large"), F.col("w"))).alias("small"), F.collect_list(F.when(F.col("large"), F.col("w"))).alias("large")
        ),
        "wanted",
    )
    cut = "key long, doc long, start int, n int, many boolean, bytes binary"
    at = sources.drop("runs").join(per_doc.hint("merge"), sources["id"] == per_doc["doc"])
    marked = work.keep(
        at.where(F.size("small") > 0).select("id", "text", "small").mapInArrow(_cut, cut)
        .repartition("key").sortWithinPartitions("key").mapInArrow(_marks, "doc long, a int, b int"),
        "marked",
    )
    windows = work.keep(
        at.where(F.size("large") > 0).select("id", "text", "large").mapInArrow(_cut, cut)
        .mapInArrow(_window_digests, "window binary, doc long, a int, many boolean"),
        "windows",
    )
    again = windows.groupBy("window").agg(F.min(F.struct("doc", "a")).alias("lo"), F.max(F.struct("doc", "a")).alias("hi")).where("lo != hi").select("window")
    counted = windows.where(~F.col("many")).join(again.hint("merge"), "window").select("doc", "a", (F.col("a") + LENGTH).alias("b"))
    own = within.select("doc", F.col("start").alias("a"), (F.col("start") + F.col("n") + LENGTH - 1).alias("b"))
    spans = work.keep(
        whole.unionByName(marked).unionByName(counted).unionByName(own).groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias("spans")),
        "spans",
    )
    work.drop("contents", "distinct", "wanted", "marked", "windows", "again", "sources")
    kept = texts.join(spans.hint("merge"), texts["id"] == spans["doc"]).select("id", "text", "spans").mapInArrow(
        _kept, "id long, n_removed long, kept_sha256 string, spans array<struct<a:int,b:int>>"
    ).dropDuplicates(["id"])
    every = texts.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
    kept = kept.withColumnRenamed("id", "_id")
    return every.join(kept.hint("merge"), every["id"].eqNullSafe(kept["_id"]), "left").select(
        "id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), "spans",
    )
