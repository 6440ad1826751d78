"""BPE encoding and decoding by forced-boundary splitting (operator 13).

``encode`` gives the ids of whole texts, equal to the ``tokenizers`` library's with
``add_special_tokens=False`` (no truncation, no padding); ``decode`` turns ids back
into text as its ``decode(ids, skip_special_tokens=False)`` does. Byte pairs that no
vocabulary token holds cut a text into fragments, which are encoded independently and
concatenated (see ``fragments``). Both are row-local: no shuffle, and one row's
text and ids are all that a task holds beside a bounded memory of fragments.

Defined results: a null or empty text has no ids, and no ids (or null) give the empty
text; null ids and repeated rows stay as they are, each row by itself; special
strings in a text are their special ids; an empty table gives an empty result; other columns are carried
along by ``encode`` and ``decode`` only if named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from recoflow.llm.common import ship_code
from recoflow.llm.fragments import ByteTokenizer, shared, slices

#: Ids (or code points) that one outgoing batch holds before it is sent, one row's more at most.
BATCH_UNITS = 1 << 20


def _value_lengths(column: pa.Array) -> np.ndarray:
    count = pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length
    return count(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def encode(docs: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` and ``ids`` (array<int>) of every row."""
    ship_code(docs.sparkSession)
    rows = docs.select(*[docs[c] for c in keep], docs[text_col].alias("_text"))
    names = [*keep, "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared(ByteTokenizer, path, True)
        for whole in batches:
            for b in slices(whole, _value_lengths(whole.column(len(keep))), BATCH_UNITS):
                ids = tokenizer.encode(b.column(len(keep)).to_pylist())
                ends = np.cumsum([0, *map(len, ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], lists], names)

    return rows.mapInArrow(run, rows.drop("_text").schema.add("ids", ArrayType(IntegerType())))


def decode(encoded: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """``keep`` and ``text`` of every row."""
    ship_code(encoded.sparkSession)
    rows = encoded.select(*[encoded[c] for c in keep], encoded[ids_col].alias("_ids"))
    names = [*keep, "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared(ByteTokenizer, path, True)
        for whole in batches:
            for b in slices(whole, _value_lengths(whole.column(len(keep))), BATCH_UNITS):
                texts = [tokenizer.decode(ids or []) for ids in b.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string())], names)

    return rows.mapInArrow(run, rows.drop("_ids").schema.add("text", "string"))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256."""
    encoded = encode(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), path, ["id"])
    written = encoded.select("id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(
        F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"))
    back = decode(written, path, ["id", "n_tokens", "ids_sha256"])
    return back.select("id", "n_tokens", "ids_sha256", F.sha2(F.col("text"), 256).alias("decoded_sha256"))
