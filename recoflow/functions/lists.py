"""Array / list-string expressions (all JVM-side, no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recoflow.config import ITEM_PREFIX, TRUTH_PAD


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_item_prefix(col: Column | str) -> Column:
    """"I123" -> 123 (int): a plain string replace (no regex). A string that is
    no id gives null, so it can be counted; it never ends a job."""
    return item_id(_c(col))


def item_id(token: Column) -> Column:
    return F.replace(token, F.lit(ITEM_PREFIX), F.lit("")).try_cast("int")


def join_items(arr: Column | str, prefix: str = "") -> Column:
    """array<int> -> "1,2,3" (optionally each id prefixed, e.g. "I1,I2")."""
    a = _c(arr)
    if prefix:
        a = F.transform(a, lambda x: F.concat(F.lit(prefix), x.cast("string")))
    else:
        a = F.transform(a, lambda x: x.cast("string"))
    return F.array_join(a, ",")


def split_items(col: Column | str) -> Column:
    """"1,2,3" -> array<string>."""
    return F.split(_c(col), ",")


def struct_field(arr: Column | str, field: str) -> Column:
    """array<struct<field,...>> -> array of that field (e.g. ALS recommendations.item_id)."""
    return F.transform(_c(arr), lambda s: s[field])


def empty_int_array() -> Column:
    return F.array().cast("array<int>")


def or_empty(arr: Column | str) -> Column:
    return F.coalesce(_c(arr), empty_int_array())


def pad_to(arr: Column | str, k: int, pad: str = TRUTH_PAD) -> Column:
    """Pad an array<string> with ``pad`` up to length k; longer arrays are kept whole."""
    a = _c(arr)
    n_pad = F.greatest(F.lit(k) - F.size(a), F.lit(0))
    return F.concat(a, F.array_repeat(F.lit(pad), n_pad))


def interleave(a: Column | str, b: Column | str, half: int) -> Column:
    """[a0, b0, a1, b1, ...] over the first ``half`` items of each list,
    stopping at the shorter one (Python ``zip`` semantics)."""
    a2 = F.slice(_c(a), 1, half)
    b2 = F.slice(_c(b), 1, half)
    m = F.least(F.size(a2), F.size(b2))
    head = F.slice(a2, F.lit(1), m)
    return F.flatten(F.transform(head, lambda x, i: F.array(x, F.element_at(b2, i + 1))))
