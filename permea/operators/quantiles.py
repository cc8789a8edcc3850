"""Exact quantiles of many columns, for several row sets at once, by narrowing ranges.

A double's bits, its sign mended, order like the double itself.  Each pass cuts the open
range of every (set, column) into ``BUCKETS`` equal parts of these 64-bit keys; the tasks
count the rows of each part and keep its least and greatest key, and Spark adds the
parts up.  The wanted rank lies in one part, whose least and greatest key are the
next range.  A range ends when the two neighbours of the rank lie in different parts
(the greatest of one, the least of the other) or when it is a single value, however many
rows share it.  So no task ever holds or sorts values, ties need no other way, and
at most 64 / log2(``BUCKETS``) + 2 passes answer for all sets, usually four.

The row sets are any conditions, such as "not in fold i" for every fold: all of them
take one set of passes together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 512


def keys_of(x: np.ndarray) -> np.ndarray:
    """Signed 64-bit integers in the order of the doubles (-0.0 as 0.0)."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def _value(key: int) -> float:
    bits = np.array([key], np.int64)
    return float(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits).view(np.float64)[0])


def exact_quantiles(df: DataFrame, columns: dict[str, Column], prob: float = 0.5) -> dict[str, float | None]:
    """Quantile ``prob`` (linear between neighbours) of every column; NULL and NaN
    don't count, and a column without values gives None."""
    return exact_quantiles_of(df, columns, [F.lit(True)], prob)[0]


def exact_quantiles_without(df: DataFrame, columns: dict[str, Column], fold: Column, left_out: list[int | None],
                            prob: float = 0.5) -> list[dict[str, float | None]]:
    """For each entry of ``left_out`` the quantiles over all rows but those of that ``fold`` (None: all rows).
    Rows without a fold are in every set."""
    return exact_quantiles_of(df, columns, [F.lit(True) if i is None else ~fold.eqNullSafe(F.lit(i)) for i in left_out], prob)


def exact_quantiles_of(df: DataFrame, columns: dict[str, Column], sets: list[Column],
                       prob: float = 0.5) -> list[dict[str, float | None]]:
    """For each condition the quantiles over the rows for which it holds."""
    names, n_sets = list(columns), len(sets)
    n_cols = len(names)
    data = df.select(*[F.coalesce(c.cast("boolean"), F.lit(False)).alias(f"s{i}") for i, c in enumerate(sets)],
                     *[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns.values())])
    out = narrow(n_sets * n_cols, lambda *state: _counts(data, n_cols, *state), [prob] * (n_sets * n_cols))
    return [{name: out[s * n_cols + i] for i, name in enumerate(names)} for s in range(n_sets)]


def narrow(total: int, counts: Callable, probs: list[float]) -> list[float | None]:
    """The quantile of each of ``total`` groups of values.  ``counts(open groups, least keys, greatest keys,
    parts)`` gives rows, least and greatest key of the non-empty parts of each open group, in order."""
    low, high = np.full(total, np.iinfo(np.int64).min), np.full(total, np.iinfo(np.int64).max)
    place, out = np.zeros(total), [None] * total
    below = np.zeros(total, np.int64)
    open_ = list(range(total))
    first = True
    while open_:
        found = counts(open_, low, high, 1 if first else BUCKETS)
        still = []
        for slot in open_:
            if slot not in found:  # no values
                continue
            n, lo, hi = found[slot]
            if first:
                place[slot] = probs[slot] * (int(n.sum()) - 1)
                low[slot], high[slot] = lo[0], hi[0]
                if lo[0] == hi[0]:
                    out[slot] = _value(lo[0])
                else:
                    still.append(slot)
                continue
            ends = below[slot] + np.cumsum(n)
            rank = int(place[slot])
            a = int(np.searchsorted(ends, rank, "right"))
            b = int(np.searchsorted(ends, min(rank + 1, int(ends[-1]) - 1), "right")) if place[slot] > rank else a
            if a != b or lo[a] == hi[a]:
                left, right = _value(hi[a]), _value(lo[b])
                out[slot] = float(left + (place[slot] - rank) * (right - left)) if a != b else left
            else:
                below[slot] = ends[a] - n[a]
                low[slot], high[slot] = lo[a], hi[a]
                still.append(slot)
        open_, first = still, False
    return out


class Parts:
    """What a task counts: rows, least and greatest key of each part of some groups' ranges."""

    def __init__(self, groups: np.ndarray, low: np.ndarray, high: np.ndarray, parts: int):
        self.groups, self.parts = groups, parts
        self.low, self.high = low[groups], high[groups]
        self.n = np.zeros(len(groups) * parts, np.int64)
        self.lo, self.hi = np.full(len(self.n), np.iinfo(np.int64).max), np.full(len(self.n), np.iinfo(np.int64).min)

    def add(self, at: np.ndarray, keys: np.ndarray) -> None:
        """``at``: the place of each key's group among ``groups``."""
        inside = (keys >= self.low[at]) & (keys <= self.high[at])
        at, keys = at[inside], keys[inside]
        if self.parts == 1:
            flat = at
        else:
            begin = self.low.view(np.uint64)
            width = (self.high.view(np.uint64) - begin) // np.uint64(self.parts) + np.uint64(1)
            flat = at * self.parts + ((keys.view(np.uint64) - begin[at]) // width[at]).astype(np.int64)
        self.n += np.bincount(flat, minlength=len(self.n))
        np.minimum.at(self.lo, flat, keys)
        np.maximum.at(self.hi, flat, keys)

    def add_sorted(self, i: int, keys: np.ndarray) -> None:
        """Ascending keys of the ``i``-th group: a part is then a run, so nothing is looked up row by row."""
        keys = keys[np.searchsorted(keys, self.low[i], "left"):np.searchsorted(keys, self.high[i], "right")]
        if not len(keys):
            return
        part = np.zeros(1, np.int64)
        starts = np.zeros(1, np.int64)
        if self.parts > 1:
            begin, end = self.low[i:i + 1].view(np.uint64), self.high[i:i + 1].view(np.uint64)
            width = (end - begin) // np.uint64(self.parts) + np.uint64(1)
            each = (keys.view(np.uint64) - begin) // width[0]
            starts = np.flatnonzero(np.append(True, each[1:] != each[:-1]))
            part = each[starts].astype(np.int64)
        flat = i * self.parts + part
        ends = np.append(starts[1:], len(keys))
        self.n[flat] += ends - starts
        self.lo[flat] = np.minimum(self.lo[flat], keys[starts])
        self.hi[flat] = np.maximum(self.hi[flat], keys[ends - 1])

    def batch(self) -> pa.RecordBatch:
        used = np.flatnonzero(self.n)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.groups[used // self.parts], pa.int32()), pa.array(used % self.parts, pa.int32()),
             pa.array(self.n[used]), pa.array(self.lo[used]), pa.array(self.hi[used])], ["slot", "part", "n", "lo", "hi"])


PARTS = "slot int, part int, n long, lo long, hi long"


def added(parts: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The parts of all tasks together, by group."""
    got = parts.groupBy("slot", "part").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow()
    cols = [got.column(c).to_numpy() for c in ("slot", "part", "n", "lo", "hi")]
    order = np.lexsort((cols[1], cols[0]))
    slot, _, *rest = (c[order] for c in cols)
    starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else []
    ends = [*starts[1:], len(slot)] if len(slot) else []
    return {int(slot[a]): tuple(c[a:b] for c in rest) for a, b in zip(starts, ends, strict=True)}


def _counts(data: DataFrame, n_cols: int, open_: list[int], low: np.ndarray, high: np.ndarray,
            buckets: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The parts of each open (set, column)."""
    by_set = {s: np.array([k for k in open_ if k // n_cols == s]) for s in sorted({k // n_cols for k in open_})}
    at: dict[int, list[tuple[int, int]]] = {}  # the sets of each column, and its place among their slots
    for s, slots in by_set.items():
        for i, k in enumerate(slots.tolist()):
            at.setdefault(k % n_cols, []).append((s, i))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {s: Parts(slots, low, high, buckets) for s, slots in by_set.items()}
        for batch in batches:
            rows = {s: batch.column(f"s{s}").to_numpy(zero_copy_only=False) for s in by_set}
            rows = {s: None if r.all() else r for s, r in rows.items()}
            for c, own in at.items():
                x = batch.column(f"x{c}").to_numpy(zero_copy_only=False)
                known = ~np.isnan(x)
                keys, whole = keys_of(x), None
                for s, i in own:
                    if rows[s] is None:  # the same for all sets that hold every row
                        whole = np.sort(keys[known]) if whole is None else whole
                        found[s].add_sorted(i, whole)
                    else:
                        found[s].add_sorted(i, np.sort(keys[known & rows[s]]))
        for part in found.values():
            yield part.batch()

    return added(data.mapInArrow(run, PARTS))
