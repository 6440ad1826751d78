"""Cross-tokenizer alignment with corpus-wide counts of linked id pairs (operator 11).

Every text is encoded by a byte-level tokenizer A (a space put in front) and a piece
tokenizer B (which adds that space itself). Byte offsets where a token of A and one of B end
together cut them into groups; tokens of A and B whose byte ranges overlap are linked.

Counting: (1) the texts are encoded once, and the corpus's distinct linked pairs are collected by
Spark and put into a minimal perfect hash, shard by shard; the key of every slot verifies a
lookup. (2) Every task aligns its documents and adds them to a dense vector indexed by that
hash; the tasks' vectors are summed in a tree, ``FAN_IN`` at a time. (3) A second pass
re-aligns the documents and looks their pairs up. The number of distinct pairs is
bounded by the product of the vocabularies, whatever the corpus; what one task holds at a time is
bounded by ``SLICE_PAIRS``: the index is broadcast in slices of that many, one pass each.

A position where both vocabularies have a forced boundary (``fragments``) ends a token in both, so
texts are encoded in fragments, each once while it is remembered. Every stretch between two neighbouring token
ends (of either side) is one link: the tokens of A and B that cover it.

Defined results: null and empty texts, and texts whose joined token bytes of A or B are not
those of the space and the text (such as texts with U+2581, which B reads as a space), have no tokens: zeros and an
empty digest; repeated rows are documents of their own, null ids are carried along; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.llm import mph
from recoflow.llm.common import Work
from recoflow.llm.exact_dedup import from_files, located
from recoflow.llm.fragments import ByteTokenizer, Cutter, Memory, PieceTokenizer, shared, slices

#: Pairs of one broadcast slice of the index (about 25 bytes each with counts).
SLICE_PAIRS = 4_000_000
#: Pairs that a shard holds on average.
SHARD_PAIRS = 16_384
#: Vectors that one step of the tree adds up.
FAN_IN = 32
#: Pairs that a task gathers before repeats among them are removed.
GATHERED = 2_000_000
#: Bytes of text, and tokens, taken on at a time (whole documents; a longer one is taken alone).
TEXT_BYTES, TOKENS = 1 << 20, 1 << 19


class Vocabularies:
    """Both tokenizers; ids are stored as ``dtype``, a pair's key is A id * ``width`` + B id."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteTokenizer(path_a, False), PieceTokenizer(path_b)
        self.width = len(self.b.token_bytes)
        self.bytes_a, self.bytes_b = (np.array([len(t) for t in v.token_bytes], np.int64) for v in (self.a, self.b))
        self.code = "H" if max(self.width, len(self.bytes_a)) <= 1 << 16 else "I"
        self.dtype = np.dtype(self.code)
        self.memory = Memory(self._encode)
        self.cutter = Cutter(self.a.inside | self.b.inside)
        decimal = [str(i).encode() for i in range(max(self.width, len(self.bytes_a)))]
        self.digits = np.array([len(d) for d in decimal])
        #: The decimal form of every id, in eight bytes taken as one number.
        self.decimal = np.frombuffer(b"".join(d.ljust(8) for d in decimal), np.uint64)

    def _encode(self, fragments: list[bytes]) -> list[bytes]:
        """Per fragment the number of A's ids (in two numbers), these, and B's ids, all as ``dtype``;
        nothing if the bytes of either are not the fragment's."""
        out = []
        known_a, known_b = self.a.token_bytes, self.b.token_bytes
        for f, a, ids_b in zip(fragments, self.a.encode_fragments(fragments), self.b.encode_fragments(fragments)):
            ids_a = array("i", a).tolist()
            same = b"".join([known_a[i] for i in ids_a]) == f == b"".join([known_b[i] for i in ids_b])
            out.append(array(self.code, [len(ids_a) & 0xFFFF, len(ids_a) >> 16, *ids_a, *ids_b]).tobytes() if same else b"")
        return out

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """A's and B's ids of every text, nothing for a text that has no tokens."""
        cut = [self.cutter.cut(b" " + t.encode("utf-8", "surrogatepass")) if t and "▁" not in t else [] for t in texts]
        values = self.memory.look_up(list(chain.from_iterable(cut)))
        doc = np.repeat(np.arange(len(texts)), list(map(len, cut)))
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // self.dtype.itemsize
        bad = np.zeros(len(texts), bool)
        bad[doc[sizes == 0]] = True
        doc, sizes = doc[sizes > 0], sizes[sizes > 0]
        words = np.frombuffer(b"".join(values), self.dtype)
        starts = np.cumsum(sizes) - sizes
        of_a = words[starts].astype(np.int64) + (words[starts + 1].astype(np.int64) << 16)
        at = np.arange(len(words)) - np.repeat(starts + 2, sizes)
        is_a = at >= 0
        is_b = at >= np.repeat(of_a, sizes)
        is_a &= ~is_b
        out = []
        for chosen, counts in ((is_a, of_a), (is_b, sizes - 2 - of_a)):
            ids = words[chosen].tobytes()
            ends = np.cumsum(np.bincount(doc, counts, minlength=len(texts)).astype(np.int64)) * self.dtype.itemsize
            out.append([b"" if no else ids[lo:hi] for no, lo, hi in zip(bad, [0, *ends], ends)])
        return out[0], out[1]


class Alignment:
    """Encoded documents behind one another, aligned."""

    def __init__(self, v: Vocabularies, ids_a: list[bytes], ids_b: list[bytes]):
        self.v, self.n = v, len(ids_a)
        self.ids_a, self.ids_b = (np.frombuffer(b"".join(x), v.dtype).astype(np.int64) for x in (ids_a, ids_b))
        step = v.dtype.itemsize
        self.n_a, self.n_b = (np.array([len(i) // step for i in x], np.int64) for x in (ids_a, ids_b))
        self.doc_a, self.doc_b = (np.repeat(np.arange(self.n), k) for k in (self.n_a, self.n_b))
        ends_a, ends_b = np.cumsum(v.bytes_a[self.ids_a]), np.cumsum(v.bytes_b[self.ids_b])
        size = int(max(ends_a[-1:].max(initial=0), ends_b[-1:].max(initial=0))) + 1
        closes_a, closes_b = np.zeros(size, np.int32), np.zeros(size, np.int32)
        closes_a[ends_a], closes_b[ends_b] = 1, 1
        points = np.flatnonzero(closes_a | closes_b)
        at_a, at_b = np.cumsum(closes_a)[points] - closes_a[points], np.cumsum(closes_b)[points] - closes_b[points]
        self._closes_a, self._closes_b = closes_a[points] == 1, closes_b[points] == 1
        self._common = self._closes_a & self._closes_b
        #: Of every link: its pair's key, and its document's place.
        self.keys = self.ids_a[at_a] * v.width + self.ids_b[at_b]
        self.doc = self.doc_a[at_a]

    def n_links(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n)

    def n_groups(self) -> np.ndarray:
        return np.bincount(self.doc[self._common], minlength=self.n)

    def distinct_keys(self) -> np.ndarray:
        """The keys of all documents, each once per document."""
        span = len(self.v.bytes_a) * self.v.width
        return np.unique(self.doc * span + self.keys) % span

    def group_digests(self) -> list[str]:
        """SHA-256 of each document's groups, written as ``a,a|b;a|b,b``."""
        group = np.cumsum(self._common) - self._common
        side = np.concatenate([2 * group[self._closes_a], 2 * group[self._closes_b] + 1])
        order = np.argsort(side, kind="stable")
        side, doc = side[order], np.concatenate([self.doc_a, self.doc_b])[order]
        ids = np.concatenate([self.ids_a, self.ids_b])[order]
        behind = np.full(len(ids), ord(","), np.uint8)
        last = np.diff(side, append=-1) != 0
        behind[last] = np.where(side[last] % 2 == 0, ord("|"), ord(";"))
        text, digits = self.v.decimal[ids].view(np.uint8).reshape(-1, 8), self.v.digits[ids]
        text[np.arange(len(ids)), digits] = behind
        written = text[np.arange(8) <= digits[:, None]].tobytes()
        ends = np.cumsum(np.bincount(doc, digits + 1, minlength=self.n)).astype(np.int64).tolist()
        return [hashlib.sha256(written[lo : hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip([0, *ends], ends)]


def _aligned(v: Vocabularies, batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, Alignment]]:
    """Rows whose columns ``at`` and ``at`` + 1 hold A's and B's ids, about ``TOKENS`` at a time."""
    step = v.dtype.itemsize
    for whole in batches:
        sizes = pc.add(pc.binary_length(whole.column(at)), pc.binary_length(whole.column(at + 1))).to_numpy() // step
        for b in slices(whole, sizes, TOKENS):
            yield b, Alignment(v, b.column(at).to_pylist(), b.column(at + 1).to_pylist())


def _encoder(path_a: str, path_b: str):
    """(id, file, row, text) -> (id, file, row, a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared(Vocabularies, path_a, path_b)
        for whole in batches:
            for b in slices(whole, pc.binary_length(whole.column(3)).to_numpy(), TEXT_BYTES):
                a, p = v.encode(b.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:3], pa.array(a, pa.binary()), pa.array(p, pa.binary())], ["id", "file", "row", "a", "b"]
                )

    return run


def _pairs(path_a: str, path_b: str):
    """(a, b) -> (key, fine): each task's distinct pairs (some again when it gathered many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)
        for _, aligned in _aligned(shared(Vocabularies, path_a, path_b), batches, 0):
            held = np.union1d(held, aligned.keys)
            if len(held) >= GATHERED:
                yield _pair_batch(held)
                held = held[:0]
        if len(held):
            yield _pair_batch(held)

    return run


def _pair_batch(keys: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(mph.fine_bucket(keys))], ["key", "fine"])


def _build(table: pa.Table) -> pa.Table:
    """A shard's pairs -> its part of the hash."""
    sizes, words, keys = mph.build(np.sort(table.column("key").to_numpy()))
    return pa.table({
        "shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "sizes": pa.array([sizes], pa.list_(pa.int64())),
        "words": pa.array([words], pa.binary()), "keys": pa.array([keys.astype("<i8").tobytes()], pa.binary()),
    })


def _slots(own: mph.Index, keys: np.ndarray) -> np.ndarray:
    slots = own.slots(keys)
    if (slots < 0).any():
        raise ValueError("a linked pair is missing from the hash")
    return slots


def _count(path_a: str, path_b: str, index):
    """(a, b) -> (shard, part, counts): the task's dense vector, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        counts = np.zeros(len(own), np.int64)
        for _, aligned in _aligned(shared(Vocabularies, path_a, path_b), batches, 0):
            keys, times = np.unique(aligned.distinct_keys(), return_counts=True)
            mine = own.own(keys)
            counts[_slots(own, keys[mine])] += times[mine]
        part = TaskContext.get().partitionId()
        for k, (lo, hi) in enumerate(zip(own.starts[:-1], own.starts[1:])):
            if counts[lo:hi].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own.first + k]), pa.array([part], pa.int64()), pa.array([counts[lo:hi].tobytes()], pa.binary())],
                    ["shard", "part", "counts"],
                )

    return run


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c.as_py(), "<i8") for c in table.column("counts"))
    return table.slice(0, 1).select(["shard", "part"]).append_column("counts", pa.array([total.tobytes()], pa.binary()))


def tree_sum(work: Work, vectors: DataFrame, name: str) -> DataFrame:
    """One vector per shard: (shard, counts)."""
    leaves = work.keep(vectors, name)
    parts = (leaves.agg(F.max("part")).first()[0] or 0) + 1
    summed = leaves
    for _ in range(max(1, math.ceil(math.log(parts, FAN_IN) - 1e-9))):
        up = summed.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long"))
        summed = up.groupBy("shard", "part").applyInArrow(_add, leaves.schema)
    return work.keep(summed.select("shard", "counts"), name + "-summed")


def _best(width: int):
    """(keys, counts) of shards -> (a, best): the largest count of each A id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a, counts = np.frombuffer(k, "<i8") // width, np.frombuffer(c, "<i8")
                ids, at = np.unique(a, return_inverse=True)
                best = np.zeros(len(ids), np.int64)
                np.maximum.at(best, at, counts)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(best)], ["a", "best"])

    return run


def _look_up(path_a: str, path_b: str, index, counts, best):
    """(id, file, row, a, b) -> the columns of ``FOUND``; the last two over the pairs of this slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, own, seen, most = shared(Vocabularies, path_a, path_b), index.value, counts.value, best.value
        for b, aligned in _aligned(v, batches, 3):
            mine = own.own(aligned.keys)
            doc, keys = aligned.doc[mine], aligned.keys[mine]
            found = seen[_slots(own, keys)]
            n_best = np.bincount(doc[found == most[keys // v.width]], minlength=aligned.n)
            total = np.zeros(aligned.n, np.int64)
            np.add.at(total, doc, found)
            numbers = (aligned.n_a, aligned.n_b, aligned.n_groups(), aligned.n_links())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], *map(pa.array, numbers), pa.array(aligned.group_digests()), pa.array(n_best), pa.array(total)],
                [c.split()[0] for c in FOUND],
            )

    return run


FOUND = ("id long", "file string", "row long", "n_a long", "n_b long", "n_groups long", "n_links long", "groups_sha256 string",
         "n_best long", "count_sum long")


def align(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
          slice_pairs: int = SLICE_PAIRS, shard_pairs: int = SHARD_PAIRS) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    work = Work(spark, "alignment")
    rows = located(from_files(work, docs), id_col, text_col).select("id", "file", "row", "text")
    schema = rows.drop("text").schema.add("a", "binary").add("b", "binary")
    encoded = work.keep_small(rows.mapInArrow(_encoder(path_a, path_b), schema), "encoded")
    ids = encoded.select("a", "b")
    pairs = work.keep(ids.mapInArrow(_pairs(path_a, path_b), "key long, fine long").distinct(), "pairs")
    n_pairs = pairs.count()
    # Shards per slice and slices from the number of pairs, which the vocabularies bound.
    n_shards = max(1, math.ceil(n_pairs / shard_pairs))
    per_slice = max(1, slice_pairs // shard_pairs)
    dealt = pairs.select("key", F.shiftright(F.col("fine") * n_shards, mph.FINE_BITS).alias("shard"))
    index = work.keep(
        dealt.groupBy("shard").applyInArrow(_build, "shard long, sizes array<long>, words binary, keys binary"), "index"
    )
    work.drop("pairs")
    slices = [(lo, min(lo + per_slice, n_shards) - 1) for lo in range(0, n_shards, per_slice)]

    def indexed(lo: int, hi: int):
        found = index.where(F.col("shard").between(lo, hi)).orderBy("shard").collect()  # at most about slice_pairs keys
        return spark.sparkContext.broadcast(
            mph.Index.join(lo, hi, n_shards, [(r["shard"], r["sizes"], bytes(r["words"]), bytes(r["keys"])) for r in found])
        )

    sums = []
    for k, (lo, hi) in enumerate(slices):
        handle = indexed(lo, hi)
        counted = ids.mapInArrow(_count(path_a, path_b, handle), "shard long, part long, counts binary")
        sums.append(tree_sum(work, counted, f"counts-{k}"))
        handle.destroy()
    v = shared(Vocabularies, path_a, path_b)
    best = np.zeros(len(v.bytes_a), np.int64)  # one number per A id
    top = reduce(DataFrame.unionByName, sums).join(index.select("shard", "keys"), "shard").select("keys", "counts")
    largest = top.mapInArrow(_best(v.width), "a long, best long").groupBy("a").agg(F.max("best").alias("best"))
    for r in largest.collect():
        best[r["a"]] = r["best"]
    most = spark.sparkContext.broadcast(best)
    schema = rows.select("id", "file", "row").schema
    for c in FOUND[3:]:
        schema = schema.add(*c.split())
    found = []
    for k, (lo, hi) in enumerate(slices):
        handle = indexed(lo, hi)
        vector = b"".join(bytes(r["counts"]) for r in sums[k].orderBy("shard").collect())  # at most about slice_pairs numbers
        seen = spark.sparkContext.broadcast(np.frombuffer(vector, "<i8"))
        one = encoded.mapInArrow(_look_up(path_a, path_b, handle, seen, most), schema)
        found.append(work.keep(one, f"found-{k}"))
        handle.destroy()
        seen.destroy()
    work.drop("index", "encoded", *[f"counts-{k}{s}" for k in range(len(slices)) for s in ("", "-summed")])
    return reduce(DataFrame.unionByName, found).groupBy("file", "row").agg(
        F.first("id").alias("id"), *[F.max(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")],
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), F.max("groups_sha256").alias("groups_sha256"),
    ).select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
