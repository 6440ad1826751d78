"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces (operator 3).

A paragraph is a line; its leaves are pieces cut after words whose checksum says so
(so an insertion moves no later cut); a section ends after a paragraph whose digest
says so. Every inner digest covers its children's digests, so equal roots mean
equal texts, and descending only into branches that differ locates an edit.

A fingerprint is ``root.tree``: the root in hex and, in base 64, the tree in preorder
as (kind and length, digest) pairs. ``likeness`` is the share of leaf bytes that
two trees have in common, 1 for equal roots.

Defined results: a null text counts as empty (the root of no sections; two empty
texts are alike 1, an empty and another text 0); repeated rows have equal
fingerprints; rows order by (id, text), null ids first; the only row of a table is
its own next row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word in so many ends a piece, one paragraph in so many ends a section.
PIECE_WORDS = 4
SECTION_PARAGRAPHS = 8
LONG_PIECE = 64
SECTION, PARAGRAPH, LEAF = 0, 1, 2
NODE = np.dtype([("kind", "u1"), ("length", "<u4"), ("digest", "S8")])


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=8).digest()


@lru_cache(maxsize=4096)
def _paragraph(line: str) -> tuple[bytes, tuple[tuple[int, bytes], ...]]:
    """The paragraph's digest and its leaves (length in bytes, digest)."""
    data = line.encode("utf-8", "surrogatepass")
    leaves, start, at = [], 0, 0
    for word in data.split(b" "):
        at += len(word) + 1
        if zlib.crc32(word) % PIECE_WORDS == 0:
            leaves.append(data[start:at])
            start = at
    if start < len(data) or not leaves:
        leaves.append(data[start:])
    if max(map(len, leaves)) > 2 * LONG_PIECE:  # text without words is cut by length
        leaves = [x[k : k + LONG_PIECE] for x in leaves for k in range(0, len(x), LONG_PIECE)]
    pairs = tuple((len(x), _digest(x)) for x in leaves)
    return _digest(b"P" + b"".join(d for _, d in pairs)), pairs


class Tree:
    """The Merkle tree of one text."""

    __slots__ = ("root", "nodes")

    def __init__(self, text: str):
        self.nodes: list[tuple[int, int, bytes]] = []
        sections: list[bytes] = []
        here: list[tuple[bytes, tuple]] = []
        lines = text.split("\n") if text else []
        for k, line in enumerate(lines):
            p = _paragraph(line)
            here.append(p)
            if p[0][0] % SECTION_PARAGRAPHS == 0 or k == len(lines) - 1:
                sections.append(_digest(b"S" + b"".join(d for d, _ in here)))
                self.nodes.append((SECTION, len(here), sections[-1]))
                for d, leaves in here:
                    self.nodes.append((PARAGRAPH, len(leaves), d))
                    self.nodes.extend((LEAF, n, x) for n, x in leaves)
                here = []
        self.root = hashlib.blake2b(b"R" + b"".join(sections), digest_size=16).hexdigest()

    def __str__(self) -> str:
        packed = b"".join(bytes((kind,)) + n.to_bytes(4, "little") + d for kind, n, d in self.nodes)
        return f"{self.root}.{base64.b64encode(packed).decode()}"

    def leaves(self) -> list[tuple[int, bytes]]:
        return [(n, d) for kind, n, d in self.nodes if kind == LEAF]


def parse(fingerprint: str) -> tuple[str, np.ndarray]:
    """(root, nodes) of a written fingerprint."""
    root, _, tree = fingerprint.partition(".")
    return root, np.frombuffer(base64.b64decode(tree), NODE)


def likeness(a: Tree, b: Tree) -> float:
    if a.root == b.root:
        return 1.0
    left: dict[bytes, int] = {}
    total = common = 0
    for n, d in a.leaves():
        left[d] = left.get(d, 0) + 1
        total += n
    for n, d in b.leaves():
        total += n
        if left.get(d, 0):
            left[d] -= 1
            common += n
    return 2.0 * common / total if total else 0.0


def changed(a: str, b: str) -> list[tuple[int, int]]:
    """Byte spans of the second text that lie in leaves its first text has not:
    sections and paragraphs with a known digest are skipped whole."""
    (root_a, na), (root_b, nb) = parse(a), parse(b)
    if root_a == root_b:
        return []
    known = {(int(k), d) for k, d in zip(na["kind"], na["digest"])}
    spans: list[tuple[int, int]] = []
    at, skip_section, skip_paragraph, left, first = 0, False, False, 0, True
    for kind, n, d in nb.tolist():
        if kind == SECTION:
            skip_section = (kind, d) in known
        elif kind == PARAGRAPH:
            skip_paragraph, left = (kind, d) in known, n
            at += 0 if first else 1  # the newline before it
            first = False
        else:
            if not (skip_section or skip_paragraph or (kind, d) in known):
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + n)
                else:
                    spans.append((at, at + n))
            at += n
    return spans


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [c.split()[0] for c in RESULT.split(", ")]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
#: The order key of rows without an id: before all others.
NO_ID = -(1 << 63)


def _compare(doc: int | None, text: str, tree: Tree, follower: str, next_tree: Tree) -> tuple:
    k = len(text) // 4
    edited = text[: len(text) - k] + follower[:k]
    edited_tree = Tree(edited)
    return (
        doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), str(tree), str(edited_tree),
        likeness(tree, edited_tree), likeness(tree, next_tree),
    )


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, guest, id, text) in order: compare each row with the next of its
    part; a part's first guest is the next part's first row."""
    waiting: tuple | None = None
    part = None
    for b in batches:
        out = []
        for here, guest, doc, text in zip(*(c.to_pylist() for c in b.columns)):
            if guest and waiting is None:
                continue  # a further row with the guest's id
            tree = Tree(text)
            if waiting is not None and here == part:
                out.append(_compare(*waiting, text, tree))
            waiting, part = (None if guest else (doc, text, tree)), here
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(KINDS)], NAMES)


def fingerprint_with_next(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text, its edit towards the next row, and their likeness.

    The ids' quantiles cut the rows into parts; each part also gets the first row of
    the part behind it (the last part that of the first), so one shuffle of the
    texts brings every row together with its next one."""
    key = F.coalesce(F.col("id"), F.lit(NO_ID))
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).withColumn("key", key)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.select("key").agg(F.percentile_approx("key", [k / parts for k in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    bounds = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))]).cast("array<bigint>")
    rows = rows.withColumn("part", F.size(F.filter(bounds, lambda c: c <= F.col("key"))))
    firsts = rows.groupBy("part").agg(F.min("key").alias("first")).orderBy("part").collect()  # one row per part
    before = [firsts[-1]["part"], *(r["part"] for r in firsts[:-1])] if firsts else []
    guest_of = F.lit(None).cast("int")
    if firsts:
        pairs = [F.lit(x) for r, p in zip(firsts, before) for x in (r["first"], p)]
        guest_of = F.element_at(F.create_map(*pairs), F.col("key"))
    own = F.struct(F.col("part"), F.lit(False).alias("guest"))
    places = F.when(guest_of.isNull(), F.array(own)).otherwise(F.array(own, F.struct(guest_of.alias("part"), F.lit(True).alias("guest"))))
    dealt = rows.select("id", "text", "key", F.explode(places).alias("at")).select("at.part", "at.guest", "id", "text", "key")
    return (
        dealt.repartition(parts, "part").sortWithinPartitions("part", "guest", "key", "text").drop("key").mapInArrow(_pairs, RESULT)
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [str(Tree(t or "")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(
        run, "doc_id long, fingerprint string"
    )
