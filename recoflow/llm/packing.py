"""Concatenate-and-cut packing (operator 2).

Pass 1 tokenizes each partition's documents and writes them with their offset
inside the partition; the partitions' token totals then give each partition's
global offset (a prefix sum over one row per partition). Pass 2 cuts the documents
at multiples of the sequence length: a document that crosses a boundary gives one
record per sequence. No document is shuffled and only the last sequence is short.

Defined results: a null or empty text has only its end token; a text longer than a
sequence has one piece per sequence; repeated rows are packed as often as they
occur; an empty table gives no piece; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recoflow.llm.common import Work
from recoflow.llm.tokens import WordTokenizer

SEQUENCE = 4096
END = 2
#: Token ids a batch of pass 1 holds back before it is handed to Spark.
BATCH_IDS = 4_000_000


def _encode(path: str, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.shared(path)
        encode = tokenizer.encode
        tail = np.array([end], "<u2").tobytes()
        part, at = TaskContext.get().partitionId(), 0
        ids: list = []
        starts: list[int] = []
        out: list[bytes] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(ids, pa.int64()),
                 pa.array(out, pa.binary())], ["part", "at", "id", "ids"],
            )

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = encode(text or "") + tail
                ids.append(doc)
                starts.append(at)
                out.append(data)
                at += len(data) // 2
                held += len(data)
                if held >= 2 * BATCH_IDS:
                    yield batch()
                    ids, starts, out, held = [], [], [], 0
        tokenizer.forget()
        if ids:
            yield batch()

    return run


def tokenized(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end: int) -> DataFrame:
    """(part, at, id, ids): ids as little-endian 16-bit numbers, ``at`` counted within the partition."""
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(
        _encode(tokenizer, end), "part int, at long, id long, ids binary"
    )


def _cut(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc, at, data in zip(b.column("id").to_pylist(), b.column("at").to_pylist(), b.column("ids")):
                ids = np.frombuffer(data.as_buffer(), "<u2").astype("<u4")
                start = 0
                while start < len(ids):
                    sequence, offset = divmod(at + start, length)
                    piece = ids[start : start + length - offset]
                    row = (doc, start, len(piece), zlib.crc32(piece), len(ids), sequence, offset)
                    for c, v in zip(cols, row):
                        c.append(v)
                    start += len(piece)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in cols],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack(
    spark: SparkSession,
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = SEQUENCE,
    end: int = END,
) -> tuple[DataFrame, DataFrame]:
    """(pieces, tokens): where every piece of every document lies, and the token
    table (part, at, id, ids with global ``at``) from which sequences are read."""
    work = Work(spark, "pack")
    tokens = work.keep(tokenized(docs, tokenizer, id_col, text_col, end), "tokens")
    totals = tokens.groupBy("part").agg(F.max(F.col("at") + F.octet_length("ids") / 2).cast("long").alias("n"))
    # One row per partition of the input: the running sum is over a bounded table.
    base = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    tokens = tokens.join(F.broadcast(work.keep(base, "base")), "part").withColumn("at", F.col("base") + F.col("at")).drop("base", "part")
    return tokens.mapInArrow(
        _cut(length),
        "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    ), tokens


def sequences(tokens: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, ids as 16-bit numbers.
    A sequence holds at most ``length`` ids, so its pieces are a bounded group."""
    last = F.floor((F.col("at") + F.octet_length("ids") / 2 - 1) / length)
    pieces = tokens.select("at", "ids", F.explode(F.sequence(F.floor(F.col("at") / length), last)).alias("sequence_id"))
    lo = F.greatest(F.col("sequence_id") * length, F.col("at"))
    hi = (F.col("sequence_id") + 1) * length
    piece = F.expr(f"substring(ids, cast(2 * (greatest(sequence_id * {length}, at) - at) + 1 as int), "
                   f"cast(2 * ((sequence_id + 1) * {length} - greatest(sequence_id * {length}, at)) as int))")
    return pieces.withColumns({"lo": lo, "hi": hi, "piece": piece}).groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("lo", "piece"))).alias("pieces")
    ).select("sequence_id", F.aggregate(F.transform("pieces", lambda p: p["piece"]), F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
