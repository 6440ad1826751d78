"""Spelling variants by permuterm rotations (operator 12).

A word with a terminator behind it is written in all its rotations. Two words that
differ by one replaced code point have rotations that agree but for that code point
at the end; of two words that differ by one inserted code point, the longer one has a
rotation that is a rotation of the shorter one with that code point behind. So every
rotation is cut before its last code point (the edited one; the terminator is never
edited), the whole rotations are added, and equal rows lie together when sorted: each
group is one prefix range that skips the edited code point. A group holds a word
at most once per code point, so its size is bounded by the alphabet.

Per group a word's neighbours are counted and the most frequent one other than itself kept
(two running maxima); the group's rows are never gathered. Words are counted
with a partial aggregate before the shuffle.

Defined results: null and empty texts have no words; a null id counts as an empty one;
repeated rows are counted each; among near words of equal frequency the smallest in
code-point order is the form; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recoflow.llm.common import Work

RUN = r"([A-Za-zÀ-ÿ]+)"
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form is at least this many times as frequent as its variant.
RATIO = 5
#: Runs whose hash this divides lose a code point.
SLIP = 199
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = "$"


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the runs of letters of all texts, some with a code point dropped by their hash."""
    runs = docs.select(
        F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("_doc"),
        F.explode(F.regexp_extract_all(F.translate(docs[text_col], _UPPER, _LOWER), F.lit(RUN), F.lit(1))).alias("_run"),
    )
    h = F.crc32(F.encode(F.concat("_doc", F.lit(":"), "_run"), "UTF-8"))
    at = (F.col("_hash") % F.length("_run")).cast("int")
    slipped = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))
    word = F.when(F.col("_hash") % SLIP == 0, slipped).otherwise(F.col("_run"))
    return runs.withColumn("_hash", h).select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, edited, n, opens) of every ``word``: ``edited`` is the code point behind the prefix,
    null for a whole rotation; ``opens`` unless the code point repeats the one before it."""
    k, length = F.col("_k"), F.length("word")
    whole = k >= length
    i = F.when(whole, k - length).otherwise(k)  # rotations start at i, those without their last code point behind it
    tail = F.substring("word", F.when(whole, i + 1).otherwise(i + 2), length)
    edited = F.when(~whole, F.substring("word", i + 1, F.lit(1)))
    return words.select("word", "n", F.explode(F.sequence(F.lit(0), 2 * length)).alias("_k")).select(
        F.concat(tail, F.lit(END), F.substring("word", F.lit(1), i)).alias("prefix"), edited.alias("edited"), "n",
        (~whole & ((i == 0) | (edited != F.substring("word", i, F.lit(1))))).alias("opens"),
    )


def _rotated_word(prefix: Column, edited: Column) -> Column:
    """The word that a rotation without its last code point comes from."""
    return F.concat(F.substring_index(prefix, END, -1), F.coalesce(edited, F.lit("")), F.substring_index(prefix, END, 1))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best: (n, form)) of the words that have a near word."""
    group = Window.partitionBy("prefix")
    ranked = group.orderBy(F.desc("n"), "word")
    rows = rotations(words).withColumn("_size", F.count(F.lit(1)).over(group)).where("_size > 1")
    rows = rows.withColumn("word", _rotated_word(F.col("prefix"), F.col("edited")))
    whole = F.col("edited").isNull()
    rows = rows.withColumns({
        "_edited": F.count("edited").over(group), "_opening": F.count(F.when(F.col("opens"), 1)).over(group),
        "_place": F.row_number().over(ranked), "_first": F.first(F.struct("n", F.col("word").alias("form"))).over(ranked),
        "_next": F.lead(F.struct("n", F.col("word").alias("form"))).over(ranked),
    })
    has_whole = F.col("_size") > F.col("_edited")
    near = F.when(whole, F.col("_opening")).otherwise(F.col("_edited") - 1 + F.when(has_whole & F.col("opens"), 1).otherwise(0))
    return rows.select(
        "word", near.alias("near"), F.when(F.col("_place") == 1, F.col("_next")).otherwise(F.col("_first")).alias("best")
    ).groupBy("word").agg(
        F.sum("near").alias("n_near"), F.max("best.n").alias("best_n"),
        F.min(F.struct((-F.col("best.n")).alias("n"), F.col("best.form").alias("form"))).alias("best"),
    ).select("word", "n_near", "best_n", F.col("best.form").alias("best_form"))


def group_variants(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    work = Work(spark, "spelling")
    words = work.keep(corpus_words(docs, id_col, text_col).where(
        (F.col("n") >= least_count) & (F.length("word") >= least_length)), "words")
    near = work.keep(near_words(words), "near")
    is_form = F.col("best_n") >= F.col("n") * ratio
    forms = work.keep(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best_form")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"),
    ), "forms")
    # Each step multiplies the frequency by ``ratio``, so chains are short: doubled until none can be longer.
    most = words.agg(F.max("n")).first()[0] or 1
    longest = max(1, math.floor(math.log(max(1, most / least_count), ratio) + 1e-9)) if ratio > 1 else None
    if longest is None:
        raise ValueError("ratio must be above 1")
    roots = forms.where("form is not null").select("word", F.col("form").alias("root"))
    for k in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        roots = work.keep(roots.join(onward, "root", "left").select("word", F.coalesce("_further", "root").alias("root")), f"roots-{k}")
    return forms.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
