"""Registered queries of the training-data operators, with DuckDB SQL where SQL
can express them. Each query applies its operator with production parameters to
its whole table and derives the contract's columns from the operator's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from recoflow.llm import align, bpe, chat, debruijn, fingerprints, html_extract, mixing, packing, rlbwt, setjoin, spelling, toxicity
from recoflow.llm.common import table
from recoflow.llm.exact_dedup import exact_dedup

#: The tokenizer that packing uses, and a score from which a document counts as toxic.
TOKENIZER = "word_bpe_49k.json"
TOXIC_SCORE = 0.7
#: The byte-level and the piece tokenizer that are aligned; the former also encodes and decodes.
BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by nearest-URL page differencing."""
    return html_extract.extract(spark, table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concatenate-and-cut packing of whole documents into sequences of 4096 tokens."""
    pieces, _ = packing.pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return pieces.withColumnRenamed("id", "doc_id")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of every text and of its edit towards the next document."""
    return fingerprints.fingerprint_with_next(spark, table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix-target expansion of all conversations plus one that holds control strings, read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    segments = chat.format_turns(spark, turns.unionByName(extra))
    return chat.read_back(segments, chat.examples(segments))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed at weights 5, 2, 1 to the size of all documents, none repeated more than 3 times."""
    out = mixing.mix(spark, table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 3 == 1


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score; fitted on labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(spark, docs, labels.where(~held_out(F.col("doc_id"))))
    out = toxicity.score(docs, model, [docs["doc_id"]])
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted"),
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    groups, _ = setjoin.link_groups(spark, table(spark, sf_dir, "documents"), width=3, num=90, den=100)
    return groups.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by 200-byte strings that start elsewhere too, removed from every text."""
    return rlbwt.remove_repeats(spark, table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("spans")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by 20-word windows that start earlier too, removed from every text."""
    return debruijn.remove_repeats(spark, table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("spans")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateful streaming deduplication of whole texts; the largest doc_id of equal texts stays."""
    out = exact_dedup(spark, table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokenizers aligned on every text, with corpus-wide counts of linked id pairs."""
    out = align.align(
        spark, table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_TOKENIZER)
    )
    return out.withColumnRenamed("id", "doc_id")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word's near words by permuterm rotations, the form it is a variant of, and that form's root."""
    return spelling.group_variants(spark, table(spark, sf_dir, "documents"))


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded between forced boundaries and decoded again."""
    out = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER))
    return out.withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_packing": op2_packing,
    "op3_fingerprints": op3_fingerprints,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_token_alignment": op11_token_alignment,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_bpe_codec": op13_bpe_codec,
}

ORACLE_SQL = {
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
}
