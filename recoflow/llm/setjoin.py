"""N-gram Jaccard join, size-aware and heavy-light (operator 7).

A document's set is its distinct word shingles, as 64-bit hashes. Two sets link if
``den * |x & y| >= num * |x | y|``. Equal sets are one representative from the start.
The others find each other by size:

* small sets enumerate their subsets of the sizes that the overlap with a partner
  of each possible size must reach; partners share such a subset;
* large sets are entered in inverted lists: linked sets share one of the first
  ``n - ceil(n * num / den) + 1`` shingles under any common order. The order puts heavy
  shingles (by counts over all documents, in a table of fixed size) last, so that
  lists stay short;
* the boundary between the two is the size at which the total of subset rows and
  list entries, weighed by their cost, is least for the corpus's size histogram. A
  set near it takes part in both.

A list is not expanded into pairs. First every member is compared with the list's
smallest member only. Members linked so form components; from then on only pairs of
different components within a list are compared, prefiltered by size and by lower bounds
of the difference (the Hamming distances of 256, then of 1024 parity bits), all exact.
While these pairs are many for an entry, the lists that have so many of them are first compared
with a few more of their members, drawn by a hash of the ids, so that alike members join
one component without meeting each other. A last round compares what is left in
different components. Candidates of all rounds are verified on their whole sets.

Defined results: texts are lower-cased A-Z; a text with fewer words than a shingle
is one shingle; a text without words (null too) has an empty set, links with
nothing and is its own component; rows that repeat an id are the same document; a row
without id links with nothing and has no component; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.llm.common import Work
from recoflow.llm.debruijn import word_hashes
from recoflow.llm.windows import chunks, gram_hashes, mixed

#: Counters of the table that tells heavy shingles; a counter is heavy above so many times the mean, plus.
SLOT_BITS, HEAVY_TIMES, HEAVY_LEAST = 21, 4, 64
SLOT_CHUNK = 1 << 13
#: Largest size that may enumerate subsets; cost of a list entry in subset rows (it has to be verified).
MOST_SMALL, ENTRY_COST = 48, 8
SKETCH_BITS, SECOND_BITS, WIDE_BITS = 256, 1 << 10, 1 << 14
#: Rows that one copy of a set is compared with before it is replicated.
PAIRS_PER_COPY = 256
#: While entries are in more pairs of different components than this on average, and each round leaves less than
#: this share of them, lists with so many for their own entries meet so many more of their members.
PAIRS_PER_ENTRY, WORTH, HOT_PAIRS, HUBS = 64, 0.8, 8, 4


class Rule:
    """Jaccard of at least num/den over shingles of ``width`` words."""

    def __init__(self, width: int, num: int, den: int):
        self.width, self.num, self.den = width, num, den

    def overlap(self, n: int, m: int) -> int:
        """Least common shingles of linked sets of sizes n and m."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def sizes(self, n: int) -> range:
        """Sizes that a set of size n can link with."""
        return range(-(-self.num * n // self.den), self.den * n // self.num + 1)

    def entries(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def subset_sizes(self, n: int, most: int) -> set[int]:
        return {c for m in self.sizes(n) if 0 < m <= most and (c := self.overlap(n, m)) <= min(n, m)}

    def subset_rows(self, n: int, most: int) -> int:
        return sum(comb(n, c) for c in self.subset_sizes(n, most))

    def boundary(self, histogram: dict[int, int]) -> int:
        """The size up to which enumerating subsets is cheapest for the whole corpus."""
        best, cost = 0, None
        for b in range(MOST_SMALL + 1):
            small = sum(k * self.subset_rows(n, b) for n, k in histogram.items() if n <= b)
            large = sum(k * self.entries(n) * ENTRY_COST for n, k in histogram.items() if self.sizes(n)[-1] > b)
            if cost is None or small + large < cost:
                best, cost = b, small + large
        return best


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    words, starts, lengths = word_hashes([t.lower() for t in texts])
    with np.errstate(over="ignore"):
        grams = {w: gram_hashes(words, w) + np.uint64(width - w) for w in range(1, width + 1) if len(words) >= w}
    for s, n in zip(starts.tolist(), lengths.tolist()):
        w = min(n, width)
        yield np.unique(grams[w][s : s + n - w + 1]) if n else np.zeros(0, np.uint64)


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    ids = batch.column(0).to_pylist()
    texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
    for lo, hi in chunks(texts):
        yield from zip(ids[lo:hi], shingle_sets(texts[lo:hi], width))


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def heavy_slots(texts: DataFrame, width: int) -> tuple[np.ndarray, dict[int, int]]:
    """Which counters are heavy, and how many sets have each size (all documents count)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, sizes = np.zeros(1 << SLOT_BITS, np.uint32), {}
        for b in batches:
            for _, h in _sets(b, width):
                np.add.at(slots, _slots(h), 1)
                sizes[len(h)] = sizes.get(len(h), 0) + 1
        if sizes:
            parts = np.minimum(slots, np.iinfo(np.uint16).max).astype(np.uint16).reshape(-1, SLOT_CHUNK)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([0] * len(parts), pa.int64())],
                ["at", "counts", "n"],
            )
            at, n = zip(*sorted(sizes.items()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1 - a for a in at], pa.int32()), pa.array([None] * len(at), pa.binary()), pa.array(n, pa.int64())], ["at", "counts", "n"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for at, counts in zip(b.column(0).to_pylist(), b.column(1)):
                c = np.frombuffer(counts.as_buffer(), np.uint16).astype(np.uint64)
                total[at] = total[at] + c if at in total else c
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], ["at", "counts"])

    work = Work(texts.sparkSession, "setjoin-counts")
    parts = work.keep(texts.mapInArrow(count, "at int, counts binary, n long"), "parts")
    # The counters come back whole: a table of fixed size, however large the corpus.
    slots = np.zeros(1 << SLOT_BITS, np.uint64)
    summed = parts.where("at >= 0").select("at", "counts").repartition("at").mapInArrow(add, "at int, counts binary")
    for r in summed.collect():
        slots[r["at"] * SLOT_CHUNK : (r["at"] + 1) * SLOT_CHUNK] = np.frombuffer(r["counts"], np.uint64)
    sizes = parts.where("at < 0").groupBy("at").agg(F.sum("n").alias("n")).where(F.col("at") >= -1 - 4 * MOST_SMALL)
    histogram = {-1 - r["at"]: r["n"] for r in sizes.collect()}
    histogram.pop(0, None)
    work.drop("parts")
    return slots > HEAVY_TIMES * slots.mean() + HEAVY_LEAST, histogram


def _described(rule: Rule, heavy_bits: bytes, most_small: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = np.unpackbits(np.frombuffer(heavy_bits, np.uint8)).astype(bool)
        names = ["id", "n", "digest", "sketch", "second", "tokens"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for doc, h in _sets(b, rule.width):
                n = len(h)
                tokens = []
                if n and rule.sizes(n)[-1] > most_small:
                    late = heavy[_slots(h)]
                    tokens.append(np.concatenate([h[~late], h[late]])[: rule.entries(n)])
                if n and n <= most_small:
                    tokens.append(subset_hashes(h, rule.subset_sizes(n, most_small)))
                all_tokens = np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, np.int64)
                sketch, second = (parity(h, bits).view(">i8").tolist() for bits in (SKETCH_BITS, SECOND_BITS))
                row = (doc, n, hashlib.blake2b(h.tobytes(), digest_size=16).digest(), sketch, second, all_tokens)
                for c, v in zip(cols, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return run


def parity(h: np.ndarray, bits: int) -> np.ndarray:
    """One bit per hash bucket: whether an odd number of members fall into it."""
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1)


def subset_hashes(h: np.ndarray, sizes: set[int]) -> np.ndarray:
    """A hash of every subset of the given sizes, from the sum of its members' hashes."""
    out = []
    with np.errstate(over="ignore"):
        m = mixed(h)
        whole = m.sum(dtype=np.uint64)
        for size in sorted(sizes):
            left_out = len(h) - size
            gone = np.array(list(combinations(range(len(h)), left_out)), np.int64).reshape(comb(len(h), left_out), left_out)
            out.append(mixed(whole - m[gone].sum(axis=1, dtype=np.uint64) + np.uint64(size)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def components(work: Work, links: DataFrame, name: str) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the smallest node that
    it reaches, by alternating large-star and small-star steps on the edge table."""
    edges = work.keep(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), f"{name}0"
    )
    state, rounds = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = work.keep(large, f"{name}-large{rounds}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.*").where("u != v").distinct()
        rounds += 1
        edges = work.keep(small, f"{name}{rounds}")
        work.drop(f"{name}{rounds - 1}", f"{name}-large{rounds - 1}")
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == state:
            break
        state = found
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _possible(rule: Rule, n: Column, m: Column, a: list[Column], b: list[Column]) -> Column:
    """False only for pairs that cannot link: by size, or by more parity bits that
    differ than the sets' difference may have members."""
    differ = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)), F.lit(0))
    sizes = (F.least(n, m) * rule.den) >= (F.greatest(n, m) * rule.num)
    return sizes & (differ * (rule.num + rule.den) <= (n + m) * (rule.den - rule.num))


def _second_possible(rule: Rule, n: Column, m: Column, a: Column, b: Column) -> Column:
    """``_possible`` by the second sketch: for pairs that the first one lets pass."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return differ * (rule.num + rule.den) <= (n + m) * (rule.den - rule.num)


def split_lists(members: DataFrame) -> DataFrame:
    """(token, major, size, pairs, hot) of every list with several components: its largest component,
    a bound of the pairs of different components, and whether these are many for its size."""
    parts = members.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"))
    size = F.sum("k")
    return parts.groupBy("token").agg(
        F.max_by("component", F.struct("k", "component")).alias("major"), size.alias("size"), ((size - F.max("k")).cast("double") * size).alias("pairs"),
        F.count(F.lit(1)).alias("parts"),
    ).where("parts > 1").drop("parts").withColumn("hot", F.col("pairs") > HOT_PAIRS * F.col("size"))


def _against(work: Work, pairs: DataFrame, values: DataFrame, value: str, test, name: str) -> DataFrame:
    """The pairs (a, b) whose values pass ``test``. A value that many pairs need is
    replicated, one copy per ``PAIRS_PER_COPY`` pairs."""
    copies = work.keep(
        pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PAIRS_PER_COPY).cast("int").alias("copies")), f"{name}-copies"
    )
    right = values.join(copies.hint("merge"), values["id"] == copies["b"]).select(
        "b", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col(value).alias("value_b")
    )
    left = pairs.join(copies.hint("merge"), "b").withColumn("copy", F.pmod(F.xxhash64("a"), "copies").cast("int")).join(
        values.select(F.col("id").alias("a"), F.col(value).alias("value_a")).hint("merge"), "a"
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [test(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    joined = left.join(right.hint("merge"), ["b", "copy"]).select("a", "b", "value_a", "value_b")
    out = work.keep(joined.mapInArrow(check, "a long, b long"), name)
    work.drop(f"{name}-copies")
    return out


def verified(work: Work, texts: DataFrame, pairs: DataFrame, rule: Rule, name: str) -> DataFrame:
    """The pairs (a, b) whose whole sets link. Long sets differ in more members than
    the short parity sketch has bits, so a wide one goes before the sets."""
    pairs = work.keep(pairs, f"{name}-pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(_sets(b, rule.width))
            wide = [len(h).to_bytes(8, "little") + parity(h, WIDE_BITS).tobytes() for _, h in got]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in got], pa.int64()), pa.array([h.tobytes() for _, h in got], pa.binary()), pa.array(wide, pa.binary())],
                ["id", "set", "wide"],
            )

    def may_link(x: bytes, y: bytes) -> bool:
        differ = np.bitwise_count(np.frombuffer(x, np.uint8, offset=8) ^ np.frombuffer(y, np.uint8, offset=8)).sum()
        n = int.from_bytes(x[:8], "little") + int.from_bytes(y[:8], "little")
        return int(differ) * (rule.num + rule.den) <= n * (rule.den - rule.num)

    def link(x: bytes, y: bytes) -> bool:
        hx, hy = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        common = len(np.intersect1d(hx, hy, assume_unique=True))
        return rule.den * common >= rule.num * (len(hx) + len(hy) - common)

    whole = work.keep(
        texts.join(ids.hint("merge"), "id", "left_semi").dropDuplicates(["id"]).mapInArrow(sets, "id long, set binary, wide binary"), f"{name}-sets"
    )
    likely = _against(work, pairs, whole, "wide", may_link, f"{name}-likely")
    out = _against(work, likely, whole, "set", link, f"{name}-links")
    work.drop(f"{name}-sets", f"{name}-likely", f"{name}-pairs")
    return out


def link_groups(
    spark: SparkSession, docs: DataFrame, width: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(groups, links): (id, n_shingles, representative, component_id) of every row, and
    the verified links (a, b) between representatives that the components rest on."""
    work, rule = Work(spark, "setjoin"), Rule(width, num, den)
    texts = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    known = texts.where("id is not null")
    heavy, histogram = heavy_slots(known, width)
    described = work.keep(
        texts.mapInArrow(
            _described(rule, np.packbits(heavy).tobytes(), rule.boundary(histogram)),
            "id long, n long, digest binary, sketch array<long>, second array<long>, tokens array<long>",
        ),
        "sets",
    )
    # Equal sets: the smallest id stands for all.
    filled = described.where("n > 0 and id is not null")
    equal = work.keep(filled.groupBy("digest").agg(F.min("id").alias("rep")), "equal")
    own = filled.join(equal.hint("merge"), "digest").where("id = rep").dropDuplicates(["id"])
    words = SKETCH_BITS // 64
    reps = work.keep(own.select("id", "n", *[F.col("sketch")[k].alias(f"s{k}") for k in range(words)], "second", "tokens"), "reps")
    ids = work.keep(described.select("id", "n", "digest"), "ids")
    work.drop("sets")
    entries = reps.select("id", F.explode("tokens").alias("token"))
    many = entries.groupBy("token").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    lists = work.keep(entries.join(many.hint("merge"), "token"), "lists")
    light = work.keep(reps.drop("tokens"), "light")
    work.drop("reps")
    sketch = [f"s{k}" for k in range(words)]

    def renamed(df: DataFrame, key: str, suffix: str) -> DataFrame:
        return df.select(F.col("id").alias(key), *[F.col(c).alias(f"{c}{suffix}") for c in ("n", *sketch)])

    def possible(suffix_a: str, suffix_b: str) -> Column:
        return _possible(
            rule, F.col(f"n{suffix_a}"), F.col(f"n{suffix_b}"), [F.col(f"{c}{suffix_a}") for c in sketch], [F.col(f"{c}{suffix_b}") for c in sketch]
        )

    # First round: every member of a list against its smallest member.
    star = lists.where("id != hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    star = star.join(renamed(light, "a", "_a").hint("merge"), "a").join(renamed(light, "b", "_b").hint("merge"), "b")
    first = verified(work, known, star.where(possible("_a", "_b")).select("a", "b"), rule, "first")
    linked = work.keep(components(work, first, "first-component"), "linked")
    # From here on: pairs of different components within a list.
    # (A list of two has been compared, one of a single component needs no more.)
    columns = ["token", "id", "component", "n", *sketch, "second"]
    members, links, left, rounds = lists.where("size > 2").select("token", "id", "hub"), first, None, 0

    def labelled(members: DataFrame) -> DataFrame:
        return members.join(linked.withColumnRenamed("node", "id").hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id"))

    def side(df: DataFrame, suffix: str, *more: Column) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{c}{suffix}") for c in columns], *more)

    apart = (
        (F.col("token_a") == F.col("token_b")) & (F.col("component_a") != F.col("component_b")) & possible("_a", "_b")
        & _second_possible(rule, F.col("n_a"), F.col("n_b"), F.col("second_a"), F.col("second_b"))
    )

    def met(a: DataFrame, b: DataFrame, on: Column) -> DataFrame:
        return a.join(b.hint("merge"), on).select(F.greatest("id_a", "id_b").alias("a"), F.least("id_a", "id_b").alias("b")).distinct()

    while True:
        # Lists whose members are all in one component by now leave.
        named = work.keep(labelled(members.drop("component", "major", "hot")), f"named{rounds}")
        work.drop("lists")
        split = work.keep(split_lists(named), f"apart{rounds}")
        found = split.agg(F.coalesce(F.sum("pairs"), F.lit(0.0)), F.coalesce(F.sum("size"), F.lit(0))).first()
        members = named.join(split.select("token", "major", "hot").hint("merge"), "token")
        members = work.keep(members if left is not None else members.join(light.hint("merge"), "id"), f"split{rounds}")
        work.drop(f"named{rounds}", f"apart{rounds}", f"split{rounds - 1}")
        if found[0] <= PAIRS_PER_ENTRY * found[1] or (left is not None and found[0] > WORTH * left):
            break
        left, rounds = found[0], rounds + 1
        # The same members serve most lists of a group of alike documents.
        hot = members.where("hot")
        hubs = hot.groupBy("token").agg(
            *[F.min_by(F.struct(*columns[1:]), F.xxhash64("id", F.lit(HUBS * rounds + k))).alias(f"h{k}") for k in range(HUBS)]
        ).select("token", F.explode(F.array_distinct(F.array(*[f"h{k}" for k in range(HUBS)]))).alias("h")).select("token", "h.*")
        star = met(side(hot, "_a"), side(hubs, "_b"), apart)
        links = work.keep(links.unionByName(verified(work, known, star, rule, f"star{rounds}")), f"links{rounds}")
        linked = work.keep(components(work, links, f"star{rounds}-component"), f"linked{rounds}")
    a = side(members.where("component != major"), "_a")
    b = side(members.where("id != hub"), "_b", (F.col("component") == F.col("major")).alias("in_major"))
    last = met(a, b, apart & (F.col("in_major") | (F.col("id_a") < F.col("id_b"))))
    links = work.keep(links.unionByName(verified(work, known, last, rule, "second")), "links")
    work.drop(f"split{rounds}")
    linked = work.keep(components(work, links, "component"), "components")
    groups = ids.join(equal.hint("merge"), "digest", "left").join(
        linked.withColumnRenamed("node", "rep").hint("merge"), "rep", "left"
    )
    own_id = F.col("id").isNotNull()
    return groups.select(
        "id", F.col("n").alias("n_shingles"), F.when(own_id, F.coalesce("rep", "id")).alias("representative"),
        F.when(own_id, F.coalesce("component", "rep", "id")).alias("component_id"),
    ), links
