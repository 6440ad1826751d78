"""Toxicity: a linear classifier over character n-grams whose features are scaled
by naive Bayes log-count ratios, trained on labelled text (operator 6).

A text is lower-cased and gets a space at both ends. A feature is the share, in percent, of one
n-gram (n = 3 to 5) among all n-grams of the whole text, scaled by r: the log of the ratio
of the n-gram's smoothed shares in toxic and in clean training documents. Every n-gram that at
least ``LEAST_DOCS`` training documents hold is a feature, whichever sign its r has; an
L2-regularised logistic regression weighs them, fitted by L-BFGS whose losses and gradients
are Spark jobs over the training vectors (MLlib scales every feature to unit deviation first, which undoes r). Shares make the score independent
of length: the log-odds of two texts joined are the mean of theirs by length. N-grams are known by
64-bit hashes, and a hit is compared with the whole hash. Scoring is row-local: no shuffle.

Training uses a bounded sample: at most ``TRAIN_ROWS`` labelled rows, those of the
smallest id hash. Labels, language, source and ids are no inputs of a score.

Defined results: a null or empty text has no features and gets the model's base score (as does
a text without any known n-gram); documents labelled twice with both labels count as toxic; null labels
are left out; without toxic or without clean training rows every score is the
share of toxic ones (0 without any label); repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.llm.common import Work, settings, ship_code
from recoflow.llm.exact_dedup import from_files
from recoflow.llm.fragments import slices
from recoflow.llm.windows import mixed

ORDERS = (3, 4, 5)
#: Labelled rows a fit reads at most, and documents an n-gram must occur in.
TRAIN_ROWS = 8_000
LEAST_DOCS = 3
SMOOTHING = 1.0
REGULARISATION = 1e-6
ITERATIONS, MEMORY, TOLERANCE = 36, 8, 1e-5
#: Tasks of one evaluation; each sends one gradient to the driver.
GRADIENTS = 8
#: Hashes are found by their first bits, then compared whole.
TOP_BITS = 21
#: Code points hashed at a time (whole blocks overlap by the longest n-gram), and bytes of text of one batch.
BLOCK, TEXT_BYTES = 1 << 18, 4 << 20
#: Bytes of training text whose vectors make one row of the vector table.
VECTOR_BYTES = 1 << 15
#: N-grams of training texts that a task adds up at a time.
GATHERED = 1_000_000
#: Batches that tasks read, and exchange with Python, while fitting and filtering.
SMALL_BATCHES = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.parquet.columnarReaderBatchSize": "64",
}
#: Share of a text, in units of which a feature is measured.
PERCENT = 100.0
_STEP = np.uint64(0x100000001B3)


def ngrams(text: str | None) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of the text between two spaces, with repeats, block by block."""
    if not text:
        return
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    reach = max(ORDERS) - 1
    with np.errstate(over="ignore"):
        for lo in range(0, len(c), BLOCK):
            block = c[lo : lo + BLOCK + reach]
            h = block
            for n in range(2, max(ORDERS) + 1):
                h = h[:-1] * _STEP + block[n - 1 :]
                if n in ORDERS and len(h):
                    yield mixed(h[:BLOCK] + np.uint64(n))


@dataclass(frozen=True)
class Model:
    """score = sigmoid(base + percent shares of the n-grams times their weights)."""

    base: float
    hashes: np.ndarray
    weights: np.ndarray
    #: First hash of every value of the top bits.
    first: np.ndarray = field(repr=False)

    @classmethod
    def of(cls, base: float, hashes: np.ndarray, weights: np.ndarray) -> Model:
        """``hashes`` ascending."""
        first = np.searchsorted(hashes, np.arange(1 << TOP_BITS, dtype=np.uint64) << np.uint64(64 - TOP_BITS))
        return cls(base, hashes, weights, np.append(first, len(hashes)).astype(np.int32))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The places of the hashes that the model knows."""
        top = (h >> np.uint64(64 - TOP_BITS)).astype(np.int64)
        at, until = self.first[top], self.first[top + 1]
        out = []
        while True:
            some = at < until
            h, at, until = h[some], at[some], until[some]
            if not len(h):
                return np.concatenate(out) if out else np.zeros(0, np.int32)
            hit = self.hashes[at] == h
            out.append(at[hit])
            h, at, until = h[~hit], at[~hit] + 1, until[~hit]

    def log_odds(self, text: str | None) -> float:
        total, n = 0.0, 0
        for h in ngrams(text):
            total += float(self.weights[self.find(h)].sum())
            n += len(h)
        return self.base + (PERCENT * total / n if n else 0.0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip([self.log_odds(t) for t in texts], -60, 60)))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on ``labels`` (the caller has left out what must not be learnt from)."""
    with settings(spark, SMALL_BATCHES):
        return _fit(spark, docs, labels, id_col, text_col, label_col, train_rows)


def _fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_rows: int) -> Model:
    work = Work(spark, "toxicity")
    rows = labels.where(labels[label_col].isNotNull()).groupBy(labels[id_col].alias("_id")).agg(
        F.max(labels[label_col].cast("int")).alias("_y")
    ).orderBy(F.xxhash64("_id"), "_id").limit(train_rows)
    # At most train_rows small rows: the bound of this broadcast.
    train = work.keep(
        docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).join(F.broadcast(rows), "_id"),
        "train",
    )
    n = train.groupBy().agg(F.sum("_y").alias("toxic"), F.count(F.lit(1)).alias("all")).first()
    toxic, clean = n["toxic"] or 0, n["all"] - (n["toxic"] or 0)
    none = np.zeros(0, np.uint64), np.zeros(0)
    if not toxic or not clean:
        share = toxic / n["all"] if n["all"] else 0.0
        return Model.of(50.0 if share else -50.0, *none)
    held = train.select("text", "_y").mapInArrow(_held, "feature long, toxic long, n long").groupBy("feature").agg(
        F.sum("toxic").alias("p"), F.sum("n").alias("n")
    ).where(F.col("n") >= LEAST_DOCS)
    ratio = F.log((F.col("p") + SMOOTHING) / (toxic + SMOOTHING)) - F.log((F.col("n") - F.col("p") + SMOOTHING) / (clean + SMOOTHING))
    # N-grams of at most train_rows documents.
    found = held.select("feature", ratio.alias("r")).toArrow()
    hashes, ratios = found.column("feature").to_numpy().view(np.uint64), found.column("r").to_numpy()
    if not len(hashes):
        return Model.of(float(np.log(toxic / clean)), *none)
    order = np.argsort(hashes)
    known = spark.sparkContext.broadcast(Model.of(0.0, hashes[order], ratios[order]))
    vectors = work.keep(train.select("text", F.col("_y").cast("double").alias("label")).mapInArrow(
        _vectors(known), "labels binary, sizes binary, at binary, value binary"), "vectors")
    known.destroy()
    start = np.append(np.zeros(len(hashes)), np.log(toxic / clean))
    weights = minimise(lambda w: _loss(vectors, w, n["all"]), start)
    work.drop("train", "vectors")
    return Model.of(float(weights[-1]), hashes[order], weights[:-1] * ratios[order])


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """L-BFGS with backtracking; ``f`` gives value and gradient of a convex function."""
    value, gradient = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(ITERATIONS):
        if np.abs(gradient).max() < TOLERANCE:
            break
        d, shares = -gradient, []
        for s, y in reversed(steps):
            shares.append(s @ d / (y @ s))
            d = d - shares[-1] * y
        d = d * (steps[-1][0] @ steps[-1][1] / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, np.linalg.norm(gradient)))
        for (s, y), share in zip(steps, reversed(shares)):
            d = d + (share - y @ d / (y @ s)) * s
        slope, step = gradient @ d, 1.0
        while True:
            new_value, new_gradient = f(x + step * d)
            if new_value <= value + 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        s, y = step * d, new_gradient - gradient
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-MEMORY:]
        x, value, gradient = x + s, new_value, new_gradient
    return x


def _loss(vectors: DataFrame, w: np.ndarray, n: int) -> tuple[float, np.ndarray]:
    """Mean logistic loss with the penalty, and its gradient; the last weight is the base."""
    shared = vectors.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        loss, gradient = 0.0, np.zeros(len(own))
        for b in batches:
            for cells in zip(*b.columns):
                labels, sizes, at, value = (np.frombuffer(c.as_buffer(), kind) for c, kind in zip(cells, ("<f4", "<i4", "<i4", "<f4")))
                sign = 2.0 * labels - 1.0
                row = np.repeat(np.arange(len(sign)), sizes)
                margin = sign * (np.bincount(row, value * own[at], len(sign)) + own[-1])
                loss += float(np.logaddexp(0.0, -margin).sum())
                pull = -sign / (1.0 + np.exp(np.clip(margin, -60, 60)))
                np.add.at(gradient, at, value * pull[row])
                gradient[-1] += pull.sum()
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([gradient.astype("<f4").tobytes()], pa.binary())], ["loss", "gradient"])

    parts = vectors.coalesce(GRADIENTS).mapInArrow(run, "loss double, gradient binary").collect()  # GRADIENTS rows
    shared.destroy()
    loss = sum(p["loss"] for p in parts) / n
    gradient = sum(np.frombuffer(p["gradient"], "<f4").astype(np.float64) for p in parts) / n
    return loss + REGULARISATION / 2 * float(w[:-1] @ w[:-1]), gradient + REGULARISATION * np.append(w[:-1], 0.0)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) -> (feature, toxic, n): in how many texts, toxic ones and all, an n-gram is held;
    added up for about ``GATHERED`` n-grams at a time."""
    held: dict[int, list[np.ndarray]] = {0: [], 1: []}
    size = 0

    def added() -> pa.RecordBatch:
        both = np.concatenate([*held[1], *held[0]])
        seen, at, n = np.unique(both, return_inverse=True, return_counts=True)
        toxic = np.bincount(at[: sum(map(len, held[1]))], minlength=len(seen))
        return pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(toxic), pa.array(n)], ["feature", "toxic", "n"])

    for b in batches:
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            parts = list(ngrams(text))
            if parts:
                held[y].append(np.unique(np.concatenate(parts)))
                size += len(held[y][-1])
            if size >= GATHERED:
                yield added()
                held, size = {0: [], 1: []}, 0
    if size:
        yield added()


def _vectors(known):
    """(text, label) -> labels, n-grams per row, their places and values (percent shares times the ratios that
    ``known`` holds as weights), some rows at a time as binary columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        for whole in batches:
            for b in slices(whole, pc.binary_length(whole.column(0)).to_numpy(), VECTOR_BYTES):
                sizes, places, values = [], [], []
                for text in b.column(0).to_pylist():
                    parts = list(ngrams(text))
                    found = model.find(np.concatenate(parts)) if parts else np.zeros(0, np.int32)
                    at, times = np.unique(found, return_counts=True)
                    sizes.append(len(at))
                    places.append(at)
                    values.append(PERCENT * times / max(1, sum(map(len, parts))) * model.weights[at])
                columns = (b.column(1).to_numpy().astype("<f4"), np.array(sizes, "<i4"),
                           np.concatenate(places).astype("<i4"), np.concatenate(values).astype("<f4"))
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["labels", "sizes", "at", "value"])

    return run


def score(docs: DataFrame, model: Model, id_cols: list[Column], text_col: str = "text") -> DataFrame:
    """``id_cols`` and ``score`` (0 to 1) of every row."""
    spark = docs.sparkSession
    ship_code(spark)
    keys = docs.select(*id_cols, docs[text_col].alias("_text"))
    names = [c for c in keys.columns if c != "_text"]
    shared = spark.sparkContext.broadcast(model)  # as many numbers as the training rows hold n-grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            texts = whole.column(len(names))
            for b in slices(whole, pc.binary_length(texts).fill_null(0).to_numpy(), TEXT_BYTES):
                value = own.scores(b.column(len(names)).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(value)], [*names, "score"])

    schema = keys.drop("_text").schema.add("score", "double")
    return keys.mapInArrow(run, schema)


def clean_rows(spark: SparkSession, docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``least``, all columns. Only positions and texts go through
    Python; what is rejected (file, row) is anti-joined, so the rows themselves never leave the JVM."""
    work = Work(spark, "toxic")
    docs = from_files(work, docs)
    meta = docs.metadataColumn("_metadata")
    scored = score(docs, model, [meta["file_path"].alias("_toxic_file"), meta["row_index"].alias("_toxic_row")], text_col)
    with settings(spark, SMALL_BATCHES):
        rejected = work.keep(scored.where(F.col("score") >= least).drop("score"), "rejected")
    return docs.join(
        rejected, (meta["file_path"] == F.col("_toxic_file")) & (meta["row_index"] == F.col("_toxic_row")), "left_anti"
    )
