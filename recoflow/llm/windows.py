"""Windows that occur more than once, found through minimizers.

A window is ``length`` consecutive units (bytes or words) of one document. Its key is
the smallest hash among the ``gram``-unit grams it holds, so equal windows have
equal keys wherever they lie. Consecutive windows with one key form a run; only runs
whose key occurs in another run can hold repeated windows, so one small row per run
is all of the corpus that is shuffled. In a run that could repeat a window within itself
(its smallest gram occurs in it twice, as in periodic text) the repeats are found at
once; only its first occurrences go on as runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.llm.common import Work

#: Bytes of text that one numpy pass takes on (whole documents; a longer one is taken alone).
CHUNK_BYTES = 2 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def gram_hashes(units: np.ndarray, n: int) -> np.ndarray:
    """A polynomial hash of every ``n`` consecutive units, built by doubling."""
    out, have, h, width = None, 0, units, 1
    left = n
    power = _ODD
    while True:
        if left & 1:
            if out is None:
                out, have = h, width
            else:  # append this block behind what is there
                m = len(units) - have - width + 1
                out = out[:m] * power + h[have : have + m]
                have += width
        left >>= 1
        if not left:
            return mixed(out)
        m = len(units) - 2 * width + 1
        h = h[:m] * power + h[width : width + m]
        power = power * power
        width *= 2


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` consecutive values."""
    m = len(values) - width + 1
    if m <= 0:
        return values[:0]
    blocks = -(-len(values) // width)
    padded = np.empty(blocks * width, values.dtype)
    padded[: len(values)] = values
    padded[len(values) :] = values[-1]
    rows = padded.reshape(blocks, width)
    fore = pick.accumulate(rows, axis=1).ravel()
    back = pick.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[:m], fore[width - 1 : width - 1 + m])


def runs(
    units: np.ndarray, starts: np.ndarray, lengths: np.ndarray, length: int, gram: int, first_stays: bool
) -> tuple[np.ndarray, ...]:
    """(document index, first window, windows, key, again) of every run; ``units``
    holds the documents behind one another, ``starts`` and ``lengths`` say where.

    Rows with ``again`` are no runs: their windows occur twice within one run (with
    ``first_stays`` the first occurrence is not among them)."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    if len(units) < length:
        return none
    units = units.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = gram_hashes(units, gram)
    width = length - gram + 1
    low = sliding(h, width, np.minimum)
    valid = np.zeros(len(low) + 1, np.int32)
    has = lengths >= length
    np.add.at(valid, starts[has], 1)
    np.add.at(valid, starts[has] + lengths[has] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[:-1]))
    if not len(at):
        return none
    key = low[at]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    # Grams that are the smallest of some window, and those among them that recur within a window's reach.
    reach = np.concatenate([np.full(width - 1, low[0]), low, np.full(width - 1, low[-1])])
    smallest = np.flatnonzero(h == sliding(reach, width, np.maximum))
    recurs = np.zeros(len(h) + 1, np.int32)
    twice = (h[smallest[1:]] == h[smallest[:-1]]) & (smallest[1:] - smallest[:-1] <= width)
    recurs[smallest[1:][twice]] = 1
    seen = np.concatenate([[0], np.cumsum(recurs)])
    start = at[first]
    count = np.diff(np.append(first, len(at)))
    key = key[first]
    inside = seen[np.minimum(start + count + width - 1, len(h))] > seen[start]
    plain = ~inside
    begin, n, keys, again = [start[plain]], [count[plain]], [key[plain]], [np.zeros(plain.sum(), bool)]
    for s, c, k in zip(start[inside].tolist(), count[inside].tolist(), key[inside]):
        with np.errstate(over="ignore"):
            windows = gram_hashes(units[s : s + c + length - 1], length)
        _, where, which, times = np.unique(windows, return_index=True, return_inverse=True, return_counts=True)
        opening = np.zeros(c, bool)
        opening[where] = True
        marked = ~opening if first_stays else times[which] > 1
        for flags, flag in ((opening, False), (marked, True)):
            edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
            begin.append(s + edge[0::2])
            n.append(edge[1::2] - edge[0::2])
            keys.append(np.full(len(edge) // 2, k))
            again.append(np.full(len(edge) // 2, flag))
    begin = np.concatenate(begin)
    doc = np.searchsorted(starts, begin, side="right") - 1
    return doc, begin - starts[doc], np.concatenate(n), np.concatenate(keys), np.concatenate(again)


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``CHUNK_BYTES``."""
    a, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_BYTES:
            yield a, k + 1
            a, size = k + 1, 0
    if a < len(texts):
        yield a, len(texts)


#: texts (UTF-8) -> units behind one another, starts, lengths
Units = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]


def run_rows(units_of: Units, length: int, gram: int, first_stays: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text) batches -> (key, doc, start, n, again) batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            texts = [t.encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            for lo, hi in chunks(texts):
                doc, start, n, key, again = runs(*units_of(texts[lo:hi]), length, gram, first_stays)
                if len(doc):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(ids[lo + doc]), pa.array(start.astype(np.int32)),
                         pa.array(n.astype(np.int32)), pa.array(again)],
                        ["key", "doc", "start", "n", "again"],
                    )

    return run


def repeated_runs(work: Work, texts: DataFrame, units_of: Units, length: int, gram: int, first_stays: bool) -> tuple[DataFrame, DataFrame]:
    """(runs, marked): runs (key, doc, start, n) whose key occurs at more than one place,
    and (doc, start, n) of windows that one run repeats. ``texts``: (id, text)."""
    every = work.keep(
        texts.mapInArrow(run_rows(units_of, length, gram, first_stays), "key long, doc long, start int, n int, again boolean"), "runs"
    )
    place = F.struct("doc", "start")
    single = every.where("not again").drop("again")
    many = single.groupBy("key").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo != hi").select("key")
    found = work.keep(single.join(many.hint("merge"), "key"), "repeated")
    marked = work.keep(every.where("again").select("doc", "start", "n"), "again")
    work.drop("runs")
    return found, marked


def with_runs(work: Work, texts: DataFrame, runs_: DataFrame, name: str) -> DataFrame:
    """(id, text, runs): documents that have runs, each with its own (bounded by its length)."""
    per_doc = runs_.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("start", "n", "key"))).alias("runs"))
    return work.keep(texts.join(per_doc.hint("merge"), texts["id"] == per_doc["doc"]).drop("doc"), name)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint spans that cover the same units; touching spans become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out
