"""Chat formatting by prefix-target expansion (operator 4).

Every turn becomes one segment of its conversation's text; every assistant turn
becomes one training example whose context is all preceding segments and whose
only trainable span is that reply. All examples of a conversation are prefixes of
one text, so an example is kept as its end and its loss span in that text: the
expansion is linear in the turns, not quadratic. ``example_texts`` writes the
examples out for readers that need each as a string of its own.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside texts are
escaped reversibly: a backslash goes between ``<`` and ``|``, one more where there
are some already; a role's backslashes and newlines are written ``\\\\`` and ``\\n``.

Defined results: null text and role count as empty; turns order by (turn, role,
text), so ties and repeated rows have one order; null conversations form one
conversation; a conversation without an assistant turn has segments but no
example; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recoflow.llm.common import Work

# Fixed values of the template.
START, END, TARGET_ROLE = "<|im_start|>", "<|im_end|>\n", "assistant"
#: Leading characters of a text that take part in dealing out the rows.
KEY_CHARS = 64


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(
    spark: SparkSession, turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """(conv, pos, role, segment, start, end, loss_start, loss_end): the segments in
    order; offsets count code points of the conversation's text; the loss span is
    null for turns that are not trained on."""
    work = Work(spark, "chat")
    role, text = F.coalesce(turns[role_col], F.lit("")), F.coalesce(turns[text_col], F.lit(""))
    rows = turns.select(
        turns[conv_col].alias("conv"), turns[turn_col].alias("turn"), role.alias("role"), text.alias("text"),
        F.concat(F.lit(START), escape_role(role), F.lit("\n")).alias("head"), escape(text).alias("body"),
    ).withColumn("segment", F.concat("head", "body", F.lit(END)))
    # Range partitions cut a long conversation; rows number themselves within their partition ...
    deal = ["conv", "turn", "role", F.substring("text", 1, KEY_CHARS)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = work.keep(
        rows.repartitionByRange(parts, *deal).sortWithinPartitions("conv", "turn", "role", "text").select(
            "conv", "role", "segment", F.length("segment").cast("long").alias("chars"),
            F.length("head").alias("skip"), F.length("body").alias("reply"),
            F.monotonically_increasing_id().alias("at"),
        ),
        "rows",
    ).withColumn("part", F.shiftright("at", 33))
    # ... and a conversation's earlier partitions shift its numbers (one row per partition and conversation).
    here = Window.partitionBy("part", "conv").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy("part", "conv").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("c"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = whole.select(
        F.col("part").alias("_part"), F.col("conv").alias("_conv"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c0"),
    )
    out = rows.withColumns({
        "n": F.count(F.lit(1)).over(here), "c": F.coalesce(F.sum("chars").over(here), F.lit(0)),
    }).join(base, (F.col("part") == F.col("_part")) & F.col("conv").eqNullSafe(F.col("_conv")))
    start = F.col("c0") + F.col("c")
    loss = F.when(F.col("role") == TARGET_ROLE, start + F.col("skip"))
    return out.select(
        "conv", (F.col("n0") + F.col("n")).alias("pos"), "role", "segment", start.alias("start"),
        (start + F.col("chars")).alias("end"), loss.alias("loss_start"), (loss + F.col("reply")).alias("loss_end"),
    )


def examples(segments: DataFrame) -> DataFrame:
    """(conv, target, chars, context_end, loss_start, loss_end): one row per assistant turn;
    the example's text is the first ``chars`` characters of the conversation's text, its
    context the first ``context_end`` of them."""
    return segments.where("loss_start is not null").select(
        "conv", F.col("pos").alias("target"), F.col("end").alias("chars"), F.col("start").alias("context_end"), "loss_start", "loss_end"
    )


def example_texts(segments: DataFrame, max_context_chars: int | None = None) -> DataFrame:
    """The examples, each as one string: all of them (their texts together are quadratic in a
    conversation's turns), or those of at most ``max_context_chars`` characters for readers that
    take no longer ones (the rest stay spans: see ``examples``)."""
    ex, short = examples(segments), segments.select(F.col("conv").alias("_conv"), "pos", "segment", F.col("end").alias("_end"))
    if max_context_chars is not None:
        ex, short = ex.where(F.col("chars") <= max_context_chars), short.where(F.col("_end") <= max_context_chars)
    return ex.join(short, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("pos") <= F.col("target"))).groupBy(
        "conv", "target", "chars", "loss_start", "loss_end"
    ).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "segment"))), lambda s: s["segment"]), "").alias("text"))


READ_BACK = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "n_examples long, context_turns long, contexts_sha256 string, n_broken_contexts long"
)


def read_back(segments: DataFrame, expanded: DataFrame | None = None) -> DataFrame:
    """Per conversation, from the written segments and the examples (``examples`` of the
    segments by default) alone: turns and their digest, characters and digest of the loss
    texts read from each example, characters of the conversation's text; examples, turns of all their contexts
    together, the digest of the contexts in order (``target:turns:digest of the turns before context_end`` and a newline
    each; turns as in ``turns_sha256``), and contexts that do not end where a turn does. A context
    is a prefix, so it is read where it ends in the stream of its conversation's segments: linear, and
    independent of the segment that holds the reply. A digest is sequential, so a conversation
    streams through one task; nothing is held."""
    made = examples(segments) if expanded is None else expanded
    reply = made.select(
        F.col("conv").alias("_conv"), "target", "chars", "context_end", F.col("loss_start").alias("lo"), F.col("loss_end").alias("hi")
    )
    turns = segments.select("conv", F.col("start").alias("at"), F.lit(1).alias("turn"), "pos", "segment", "start", "end").join(
        reply, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("pos") == F.col("target")), "left"
    ).drop("_conv", "target")
    # A context ends before the turn that starts at the same place.
    contexts = made.select("conv", F.col("context_end").alias("at"), F.lit(0).alias("turn"), F.col("target").alias("pos"))
    rows = turns.unionByName(contexts, allowMissingColumns=True)
    return rows.repartition("conv").sortWithinPartitions("conv", "at", "turn", "pos").select(
        "conv", "at", "turn", "pos", "segment", "start", "end", "chars", "context_end", "lo", "hi"
    ).mapInArrow(_digests, READ_BACK)


class _Conversation:
    """What is read of one conversation so far."""

    def __init__(self, conv: int | None):
        self.conv, self.n_turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.n_examples = self.context_turns = self.n_broken = 0
        self.turns, self.loss, self.contexts = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()

    def context(self, at: int, target: int) -> None:
        self.n_examples += 1
        self.context_turns += self.n_turns
        self.n_broken += at != self.chars
        self.contexts.update(f"{target}:{self.n_turns}:{self.turns.hexdigest()}\n".encode())

    def turn(self, segment: str, start: int, end: int, cut: int | None, context: int | None, lo: int | None, hi: int | None) -> None:
        role, _, text = segment[len(START) : -len(END)].partition("\n")
        self.turns.update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
        self.n_turns, self.chars = self.n_turns + 1, end
        if lo is not None:
            # the last turn of the example: what lies between its context and its end
            reply = unescape(segment[context - start : cut - start][lo - context : hi - context])
            self.loss.update(reply.encode())
            self.loss_chars += len(reply)

    def row(self) -> tuple:
        return (
            self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars,
            self.n_examples, self.context_turns, self.contexts.hexdigest(), self.n_broken,
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [field.split()[0] for field in READ_BACK.split(", ")]
    kinds = [pa.string() if name.endswith("sha256") else pa.int64() for name in names]

    def batch(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*done), kinds)], names)

    now: _Conversation | None = None
    for b in batches:
        done = []
        for conv, at, is_turn, pos, *turn in zip(*(c.to_pylist() for c in b.columns)):
            if now is None or conv != now.conv:
                if now is not None:
                    done.append(now.row())
                now = _Conversation(conv)
            if is_turn:
                now.turn(*turn)
            else:
                now.context(at, pos)
        if done:
            yield batch(done)
    if now is not None:
        yield batch([now.row()])
