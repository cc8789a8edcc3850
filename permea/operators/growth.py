"""Extremely randomised trees of many fits, grown together.

One table holds every row once: its features, labels and group numbers as packed
numbers (``pack``).  A fit names its label, the rows it trains on (by group
numbers, so folds, holdouts and seeds need no copies of rows), its features and the
medians that fill them.  All trees of all fits grow level by level over that table, and
a level is two passes for as many nodes as fit ``CELLS``:

1. *ranges*: rows walk down the trees so far; every task gives the least and greatest
   value of each feature and the label sums of each open node, and these are merged by
   a shuffle on the node.  The merge draws the node's features and, for each, a
   cut uniform between its least and greatest value.
2. *splits*: every task gives the label sums left of each drawn cut; the merge takes
   the cut that reduces the squared error most.

What is random is a hash of (seed, tree, node, feature), so a lost task gives the same again.
Features that are constant in a node are passed over, a node ends when it is pure, at the
greatest depth, or when no cut leaves ``min_leaf`` rows on both sides.  A classifier is the
same tree on a 0/1 label with class weights (Gini impurity is twice the variance).

The driver holds trees and the chosen cuts only: nodes of one group of fits, or of some trees of one,
bounded by ``NODES`` or a single tree; tasks hold sums of at most ``CELLS`` (node, feature) cells.

A table that fits in a task is grown from there instead (``whole``): the same trees without the passes.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_path, materialize

#: (node, feature) cells of one pass, nodes of the trees that are held at once, bytes of a merge.
CELLS, NODES, MERGE_BYTES = 1 << 21, 1 << 22, 64 << 20
#: Rows that a task looks at together, rows of a node that are added up at once, rows a node must have
#: on average to be added up by itself, and filled matrices (of folds, mostly) that a task holds.
CHUNK, BLOCK, LONG, MATRICES = 1 << 16, 1 << 10, 24, 8
#: Rows of a node that are led on together; fewer walk one by one.
LED = 128


@dataclass(frozen=True)
class Rows:
    """Rows by group numbers: all of ``(group, equal, number)`` hold."""
    tests: tuple[tuple[int, bool, int], ...]

    def mask(self, groups: np.ndarray) -> np.ndarray:
        out = np.ones(len(groups), bool)
        for g, equal, number in self.tests:
            out &= (groups[:, g] == number) == equal
        return out


@dataclass(frozen=True)
class Fit:
    """One forest: what it learns from and its sizes."""
    label: int
    train: Rows
    features: tuple[int, ...]
    fill: tuple[float, ...]             # of its features
    trees: int
    max_features: float = 1.0
    min_leaf: int = 1
    max_depth: int = 30
    seed: int = 42
    weights: tuple[float, float] | None = None   # of labels 0 and 1
    first: int = 0                      # the number of its first tree
    bins: bool = False                  # a random forest on numbers of bins (``whole`` only)

    @property
    def drawn(self) -> int:
        return max(1, int(self.max_features * len(self.features)))

    def matrix(self, x: np.ndarray) -> np.ndarray:
        x = x.take(self.features, axis=1) if self.features else np.zeros((len(x), 0), x.dtype)
        np.copyto(x, np.array(self.fill, x.dtype), where=x == 255 if x.dtype == np.uint8 else np.isnan(x))
        return x


@dataclass
class Tree:
    """Nodes in the order they were made; children are ``left`` and ``left + 1``."""
    fit: int
    number: int
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    rows: list[int] = field(default_factory=lambda: [0])
    weight: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def arrays(self, cuts: type = np.float32) -> tuple[np.ndarray, ...]:
        return (np.array(self.feature, np.int32), np.array(self.cut, cuts), np.array(self.left, np.int32))

    def add(self, rows: int, weight: float, total: float) -> None:
        self.feature.append(-1)
        self.cut.append(0.0)
        self.left.append(-1)
        self.gain.append(0.0)
        self.rows.append(rows)
        self.weight.append(weight)
        self.value.append(total / weight if weight else 0.0)


def walk(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, begun: np.ndarray | None = None) -> np.ndarray:
    """The node that each row ends in; rows begin at the root or at an inner node of their own."""
    node = np.zeros(len(x), np.int32) if begun is None else begun
    if feature[0] < 0 or not len(x):
        return node
    flat, begin = x.ravel(), np.arange(0, x.size, x.shape[1])  # of the rows still on their way
    at, here = np.arange(len(x)), node.copy()
    while len(at):
        here = left.take(here) + (flat.take(begin + feature.take(here)) > cut.take(here))
        inner = feature.take(here) >= 0
        if not inner.all():
            ended = ~inner
            node[at[ended]] = here[ended]
            at, begin, here = at[inner], begin[inner], here[inner]
    return node


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash step (splitmix64's finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def node_hash(seed: int, number: int, node: int, n_features: int) -> np.ndarray:
    """One 64-bit hash for every feature of a node."""
    base = _mix(_mix(np.array([seed], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(number + 1)) + np.uint64(node + 1))
    return _mix(base + np.arange(1, n_features + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def draw(hashes: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` features, in the order of their hashes, that are not constant
    (-1 where there are fewer), and a cut in each: at least the least value, below the greatest."""
    order = np.where(high > low, hashes >> np.uint64(1), np.uint64(1 << 63))
    chosen = np.argsort(order, axis=1, kind="stable")[:, :n]
    take = lambda a: np.take_along_axis(a, chosen, axis=1)
    share = (_mix(take(hashes)) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
    lo, hi = take(low), take(high)
    with np.errstate(invalid="ignore", over="ignore"):
        cut = (lo + share * (hi.astype(np.float64) - lo)).astype(np.float32)
        cut = np.where((cut >= hi) | (cut < lo), lo, cut)
    return np.where(hi > lo, chosen, -1), cut


def pack(df: DataFrame, features: dict[str, Column], labels: dict[str, Column], groups: dict[str, Column],
         keep: list[str], x_type: type = np.float32, edges: list[np.ndarray] | None = None) -> DataFrame:
    """The written table: rid, row (struct of ``keep``), x, y, g (packed ``x_type``, doubles, 32-bit integers).
    With ``edges`` x holds the number of each value's bin (255: NULL), a byte each."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, math.ceil(df.count() / 50_000))
    cols = [c.cast("double").alias(f"x{i}") for i, c in enumerate(features.values())]
    cols += [c.cast("double").alias(f"y{i}") for i, c in enumerate(labels.values())]
    cols += [F.coalesce(c.cast("int"), F.lit(-1)).alias(f"g{i}") for i, c in enumerate(groups.values())]
    rows = df.repartition(n).select(F.monotonically_increasing_id().alias("rid"), F.struct(F.lit(0).alias("_"), *keep).alias("row"), *cols)
    sizes = {"x": (len(features), np.uint8 if edges else x_type), "y": (len(labels), np.float64), "g": (len(groups), np.int32)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [batch.column("rid"), batch.column("row")]
            for kind, (count, dtype) in sizes.items():
                flat = np.column_stack([batch.column(f"{kind}{i}").to_numpy(zero_copy_only=False) for i in range(count)]
                                       ) if count else np.zeros((batch.num_rows, 0))
                if kind == "x" and edges:
                    flat = np.column_stack([np.where(np.isnan(flat[:, i]), 255, np.searchsorted(e, flat[:, i])) for i, e in enumerate(edges)])
                flat = np.ascontiguousarray(flat.astype(dtype))
                width = flat.itemsize * count
                offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * width
                out.append(pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows,
                                                       [None, pa.py_buffer(offsets), pa.py_buffer(flat)]))
            yield pa.RecordBatch.from_arrays(out, ["rid", "row", "x", "y", "g"])

    kind = rows.schema["row"].dataType.simpleString()
    return materialize(rows.mapInArrow(run, f"rid long, row {kind}, x binary, y binary, g binary"), "packed-rows")


def unpack(batch: pa.RecordBatch, name: str, dtype: type = np.float64) -> np.ndarray:
    col = batch.column(name)
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1]
    flat = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return flat.view(dtype).reshape(len(col), -1)


def _blob(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features, labels and group numbers of about ``CHUNK`` rows at a time."""
    kinds, held, rows = {"x": np.float32, "y": np.float64, "g": np.int32}, [], 0
    for batch in batches:
        if batch.num_rows:
            held.append([unpack(batch, name, kind) for name, kind in kinds.items()])
            rows += batch.num_rows
        if rows >= CHUNK:
            yield tuple(np.concatenate(parts) for parts in zip(*held, strict=True))
            held, rows = [], 0
    if held:
        yield tuple(np.concatenate(parts) for parts in zip(*held, strict=True))


def _living(left: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Whether a node is open or has open nodes below it (children come after their parents)."""
    live = (slots >= 0).tolist()
    for node, child in reversed(list(enumerate(left.tolist()))):
        if child >= 0 and (live[child] or live[child + 1]):
            live[node] = True
    return np.array(live)


def _placed(x: np.ndarray, columns: np.ndarray, nodes: tuple, slots: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in open nodes, those of a node together, and their slots.  ``columns`` is ``x`` by features.
    The rows of a node are led on together, by one column and one cut, until they are few."""
    feature, cut, left = nodes
    rows_of: list[np.ndarray] = []
    slot_of: list[np.ndarray] = []
    few: list[tuple[int, np.ndarray]] = []
    todo = [(0, np.arange(len(x)))] if live[0] else []
    while todo:
        node, rows = todo.pop()
        if slots[node] >= 0:
            rows_of.append(rows)
            slot_of.append(np.full(len(rows), slots[node]))
        elif len(rows) < LED:
            few.append((node, rows))
        else:
            right = columns[feature[node]].take(rows) > cut[node]
            for child, side in ((left[node] + 1, right), (left[node], ~right)):
                if live[child]:
                    own = rows[side]
                    if len(own):
                        todo.append((child, own))
    if few:
        rows = np.concatenate([r for _, r in few])
        slot = slots.take(walk(x.take(rows, axis=0), *nodes, np.repeat([n for n, _ in few], [len(r) for _, r in few])))
        rows, slot = rows[slot >= 0], slot[slot >= 0]
        if len(rows):
            near = slot - slot.min()
            order = np.argsort(near.astype(np.uint16) if near.max() < 1 << 16 else near, kind="stable")
            rows_of.append(rows.take(order))
            slot_of.append(slot.take(order))
    if not rows_of:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows_of), np.concatenate(slot_of)


def _nodes(batches: Iterator[pa.RecordBatch], fits: list[Fit], trees: list[tuple]) -> Iterator[tuple]:
    """For every chunk of rows and tree with rows in open nodes: the nodes' slots, where each begins
    among the rows (sorted by slot), the fit's features, the rows among them, and the rows' labels and weights.
    ``trees``: fit, node arrays and the slot of every node (-1: not open)."""
    living = [_living(nodes[2], slots) for _, nodes, slots in trees]
    for x, y, g in _chunks(batches):
        matrices: dict[tuple, tuple] = {}
        held, own = -1, ()
        for (at, nodes, slots), live in zip(trees, living, strict=True):  # in the order of fits
            fit = fits[at]
            if held != at:
                key = (fit.train, fit.features, fit.fill)
                if key not in matrices:
                    if len(matrices) == MATRICES:
                        matrices.pop(next(iter(matrices)))
                    rows = np.flatnonzero(fit.train.mask(g))
                    xf = fit.matrix(x if len(rows) == len(x) else x.take(rows, axis=0))
                    matrices[key] = rows, xf, np.ascontiguousarray(xf.T)
                rows, xf, columns = matrices[key]
                label = y[rows, fit.label]
                known = ~np.isnan(label)
                held, own = at, (xf, columns, label) if known.all() else (xf[known], columns[:, known], label[known])
            xf, columns, label = own
            rows, slot = _placed(xf, columns, nodes, slots, live)
            if not len(rows):
                continue
            starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
            ly = label.take(rows)
            w = None if fit.weights is None else np.where(ly > 0.5, fit.weights[1], fit.weights[0])
            yield at, slot[starts], starts, xf, rows, ly, w


def _sums(starts: np.ndarray, y: np.ndarray, w: np.ndarray | None) -> np.ndarray:
    """Rows, weight, and weighted sums of the label and its square, of each node."""
    n = np.diff(starts, append=len(y)).astype(np.float64)
    wy = y if w is None else w * y
    return np.stack([n, n if w is None else np.add.reduceat(w, starts), np.add.reduceat(wy, starts), np.add.reduceat(wy * y, starts)], axis=1)


def _pieces(starts: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """The node and the bounds of each run of at most ``BLOCK`` rows."""
    for i, (a, b) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True)):
        for c in range(a, b, BLOCK):
            yield i, c, min(c + BLOCK, b)


def _extremes(x: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of every feature in each node."""
    if len(rows) < LONG * len(starts):
        x = x.take(rows, axis=0)
        return np.minimum.reduceat(x, starts, axis=0), np.maximum.reduceat(x, starts, axis=0)
    low, high = np.full((len(starts), x.shape[1]), np.inf, x.dtype), np.full((len(starts), x.shape[1]), -np.inf, x.dtype)
    for i, a, b in _pieces(starts, len(rows)):
        piece = x.take(rows[a:b], axis=0)
        np.minimum(low[i], piece.min(axis=0), out=low[i])
        np.maximum(high[i], piece.max(axis=0), out=high[i])
    return low, high


def _left_sums(x: np.ndarray, rows: np.ndarray, starts: np.ndarray, cuts: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The sums of ``terms`` (term, row) over the rows at or below every node's cuts: (term, node, feature)."""
    out = np.zeros((len(terms), len(starts), x.shape[1]))
    if len(rows) < LONG * len(starts):
        side = x.take(rows, axis=0) <= np.repeat(cuts, np.diff(starts, append=len(rows)), axis=0)
        for term, own in zip(terms, out, strict=True):
            np.add.reduceat(side * term[:, None], starts, axis=0, out=own)
        return out
    for i, a, b in _pieces(starts, len(rows)):
        out[:, i] += terms[:, a:b] @ (x.take(rows[a:b], axis=0) <= cuts[i]).astype(np.float64)
    return out


def _gather(group: pa.Table, names: dict[str, tuple[np.ufunc, type]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The slots of a merge and, for each packed column, its rows of a slot combined."""
    slot = group.column("slot").to_numpy()
    order = np.argsort(slot, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(slot[order]) != 0]))
    out = []
    for name, (combine, dtype) in names.items():
        rows = np.concatenate([unpack(b, name, dtype) for b in group.to_batches() if b.num_rows])
        rows = rows[order].astype(np.float64) if combine is np.add else rows[order]  # counts of many tasks
        out.append(combine.reduceat(rows, starts, axis=0))
    return slot[order][starts], out


def _merged(table: DataFrame, part, merge, n_slots: int, width: int, schema: str, out: str,
            columns: tuple | list = ("x", "y", "g")) -> list:
    """Runs ``part`` in every task and ``merge`` on what they give of the same nodes."""
    tasks = max(1, len(table.inputFiles()))  # a file or less in each
    buckets = max(1, math.ceil(n_slots * tasks * width * 16 / MERGE_BYTES), min(n_slots, 8))
    got = table.select(*columns).mapInArrow(part, schema).withColumn("bucket", F.col("slot") % buckets)
    return got.groupBy("bucket").applyInArrow(merge, out).collect()


def _range_pass(table: DataFrame, fits: list[Fit], trees: list[tuple], slots: list[tuple[int, int, int]], width: int) -> list:
    n_slots = len(slots)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full((n_slots, width), np.inf, np.float32), np.full((n_slots, width), -np.inf, np.float32)
        sums = np.zeros((n_slots, 4))
        for _, ids, starts, x, rows, y, w in _nodes(batches, fits, trees):
            f = x.shape[1]
            least, greatest = _extremes(x, rows, starts)
            low[ids, :f], high[ids, :f] = np.minimum(low[ids, :f], least), np.maximum(high[ids, :f], greatest)
            sums[ids] += _sums(starts, y, w)
        used = np.flatnonzero(sums[:, 0])
        for k in range(0, len(used), 4096):
            u = used[k:k + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int32()), _blob(low[u]), _blob(high[u]), _blob(sums[u])],
                                             ["slot", "low", "high", "sums"])

    def merge(group: pa.Table) -> pa.Table:
        ids, (low, high, sums) = _gather(group, {"low": (np.minimum, np.float32), "high": (np.maximum, np.float32), "sums": (np.add, np.float64)})
        feats, cuts = np.full((len(ids), width), -1, np.int16), np.zeros((len(ids), width), np.float32)
        own_fit = np.array([slots[i][0] for i in ids])
        for k in np.unique(own_fit):
            fit, mine = fits[k], np.flatnonzero(own_fit == k)
            f = len(fit.features)
            hashes = np.stack([node_hash(fit.seed, slots[ids[i]][1], slots[ids[i]][2], f) for i in mine])
            chosen, cut = draw(hashes, low[mine, :f], high[mine, :f], fit.drawn)
            feats[mine, :chosen.shape[1]], cuts[mine, :chosen.shape[1]] = chosen, cut
        return pa.table({"slot": pa.array(ids, pa.int32()), "feats": _blob(feats), "cuts": _blob(cuts), "sums": _blob(sums)})

    return _merged(table, part, merge, n_slots, width, "slot int, low binary, high binary, sums binary",
                   "slot int, feats binary, cuts binary, sums binary")


def _split_pass(table: DataFrame, fits: list[Fit], trees: list[tuple], slots: list, width: int, feats: np.ndarray,
                cuts: np.ndarray, totals: np.ndarray) -> list:
    """``feats``: the drawn features of each node, ascending, then -1."""
    n_slots, drawn = len(slots), feats.shape[1]
    weighted = any(f.weights is not None for f in fits)
    names = ("n", "s", "w") if weighted else ("n", "s")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.full((n_slots, width), -np.inf, np.float32)
        at, col = np.nonzero(feats >= 0)
        dense[at, feats[at, col]] = cuts[at, col]
        left = {name: np.zeros((n_slots, width), np.float32 if name == "n" else np.float64) for name in names}
        seen = np.zeros(n_slots, bool)
        for _, ids, starts, x, rows, y, w in _nodes(batches, fits, trees):
            f = x.shape[1]
            terms = np.stack([np.ones(len(y)), y] if w is None else [np.ones(len(y)), w * y, w])
            for name, own in zip(names, _left_sums(x, rows, starts, dense[ids, :f], terms), strict=False):
                left[name][ids, :f] += own  # numbers of rows are whole: exact
            seen[ids] = True
        used = np.flatnonzero(seen)
        for k in range(0, len(used), 4096):
            u = used[k:k + 4096]
            own = np.maximum(feats[u], 0).astype(np.int64)  # what was drawn is all that is sent
            yield pa.RecordBatch.from_arrays(
                [pa.array(u, pa.int32()), *(_blob(np.take_along_axis(left[name][u], own, axis=1)) for name in names)], ["slot", *names])

    def merge(group: pa.Table) -> pa.Table:
        ids, sums = _gather(group, {name: (np.add, np.float32 if name == "n" else np.float64) for name in names})
        n, s, w = sums[0], sums[1], sums[2] if weighted else sums[0].copy()
        own_fit = [fits[slots[i][0]] for i in ids]
        even = np.array([f.weights is None for f in own_fit])
        w[even] = n[even]
        n[feats[ids] < 0] = 0  # no feature: nothing on the left, so no cut
        best, gain = best_cut(n, w, s, totals[ids], np.array([f.min_leaf for f in own_fit]))
        pick = lambda a: np.take_along_axis(a, np.maximum(best, 0)[:, None], axis=1)[:, 0]
        return pa.table({"slot": pa.array(ids, pa.int32()), "feature": pa.array(np.where(best < 0, -1, pick(feats[ids])), pa.int32()),
                         "gain": pa.array(gain), "n": pa.array(pick(n)), "w": pa.array(pick(w)), "s": pa.array(pick(s))})

    return _merged(table, part, merge, n_slots, 3 * drawn, "slot int, " + ", ".join(f"{name} binary" for name in names),
                   "slot int, feature int, gain double, n double, w double, s double")


def best_cut(n: np.ndarray, w: np.ndarray, s: np.ndarray, totals: np.ndarray, min_leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The feature whose cut reduces the squared error most (ties, up to rounding: the first; -1: none), and
    by how much, from the rows, weights and label sums left of the cuts and the nodes' totals."""
    all_n, all_w, all_s = (totals[:, [i]] for i in range(3))
    fits = (n >= min_leaf[:, None]) & (all_n - n >= min_leaf[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(fits, s * s / w + (all_s - s) ** 2 / (all_w - w), -np.inf)
    parts = np.where(np.isnan(parts), -np.inf, parts)
    top = parts.max(axis=1, keepdims=True)
    best = (parts >= top - 1e-10 * np.where(np.isfinite(top), np.abs(top), 0.0)).argmax(axis=1)
    found = np.isfinite(top[:, 0])
    return np.where(found, best, -1), np.where(found, np.maximum(top - all_s * all_s / all_w, 0.0)[:, 0], 0.0)


def grow(table: DataFrame, fits: list[Fit]) -> list[list[Tree]]:
    """The trees of every fit."""
    trees = [Tree(i, f.first + t) for i, f in enumerate(fits) for t in range(f.trees)]
    open_ = [[0] for _ in trees]
    for depth in range(max(f.max_depth for f in fits) + 1):
        todo = [(k, node) for k, nodes in enumerate(open_) for node in nodes]
        if not todo:
            break
        open_ = [[] for _ in trees]
        width = max(len(f.features) for f in fits)
        for start in range(0, len(todo), max(1, CELLS // width)):
            _grow_nodes(table, fits, trees, todo[start:start + max(1, CELLS // width)], width, depth, open_)
    out: list[list[Tree]] = [[] for _ in fits]
    for t in trees:
        out[t.fit].append(t)
    return out


def _grow_nodes(table: DataFrame, fits: list[Fit], trees: list[Tree], todo: list[tuple[int, int]], width: int, depth: int,
                open_: list[list[int]]) -> None:
    """Splits the open nodes ``todo`` (tree, node) where a cut is found; their children go to ``open_``."""
    def shipped(wanted: list[tuple[int, int]]) -> tuple[list[tuple], list[tuple[int, int, int]]]:
        by_tree: dict[int, list[tuple[int, int]]] = {}
        for slot, (k, node) in enumerate(wanted):
            by_tree.setdefault(k, []).append((slot, node))
        out = []
        for k in sorted(by_tree):
            slots = np.full(len(trees[k].feature), -1, np.int32)
            for slot, node in by_tree[k]:
                slots[node] = slot
            out.append((trees[k].fit, trees[k].arrays(), slots))
        return out, [(trees[k].fit, trees[k].number, node) for k, node in wanted]

    send, slots = shipped(todo)
    ranges = {r.slot: r for r in _range_pass(table, fits, send, slots, width)}
    go, feats, cuts, totals = [], [], [], []
    for slot, (k, node) in enumerate(todo):
        r, tree = ranges.get(slot), trees[k]
        if r is None:  # no rows at all
            continue
        n, w, s, q = np.frombuffer(r.sums)
        tree.rows[node], tree.weight[node], tree.value[node] = int(n), float(w), float(s / w) if w else 0.0
        f = np.frombuffer(r.feats, np.int16)
        fit = fits[tree.fit]
        pure = w <= 0 or q - s * s / w <= 1e-12 * max(abs(q), 1e-300)
        if not pure and f[0] >= 0 and depth < fit.max_depth and n >= 2 * fit.min_leaf:
            go.append((k, node))
            feats.append(f)
            cuts.append(np.frombuffer(r.cuts, np.float32))
            totals.append((n, w, s))
    if not go:
        return
    send, slots = shipped(go)
    feats, cuts, totals = np.array(feats), np.array(cuts), np.array(totals)
    drawn = max(int((feats >= 0).sum(axis=1).max()), 1)
    order = np.argsort(np.where(feats < 0, np.iinfo(np.int16).max, feats), axis=1, kind="stable")[:, :drawn]
    feats, cuts = np.take_along_axis(feats, order, axis=1), np.take_along_axis(cuts, order, axis=1)
    found = {r.slot: r for r in _split_pass(table, fits, send, slots, width, feats, cuts, totals)}
    for slot, (k, node) in enumerate(go):  # in the order of the nodes, so that numbers don't depend on tasks
        r, tree = found.get(slot), trees[k]
        if r is None or r.feature < 0:
            continue
        tree.feature[node], tree.gain[node], tree.left[node] = r.feature, r.gain, len(tree.feature)
        tree.cut[node] = float(cuts[slot][np.flatnonzero(feats[slot] == r.feature)[0]])
        n, w, s = totals[slot]
        for rows, weight, total in ((r.n, r.w, r.s), (n - r.n, w - r.w, s - r.s)):
            tree.add(int(rows), weight, total)
            # A child that can't be split needs no further pass.
            if depth + 1 < fits[tree.fit].max_depth and rows >= 2 * fits[tree.fit].min_leaf and rows > 1:
                open_[k].append(len(tree.feature) - 1)


def predict(x: np.ndarray, forest: list[tuple]) -> np.ndarray:
    """Mean leaf value over the trees (node arrays and values) for the rows of a fit's matrix."""
    out = np.zeros(len(x))
    for nodes, value in forest:
        out += value[walk(x, *nodes)]
    return out / max(len(forest), 1)


def _nodes_of(fit: Fit, rows: int) -> int:
    """Nodes that a tree may have."""
    return min(2 ** min(fit.max_depth + 1, 40), 2 * max(rows, 1))


def groups_of(fits: list[Fit], rows: int) -> list[list[int]]:
    """Consecutive fits whose trees together have at most about ``NODES`` nodes."""
    out: list[list[int]] = []
    size = 0
    for i, f in enumerate(fits):
        own = f.trees * _nodes_of(f, rows)
        if not out or size + own > NODES:
            out.append([])
            size = 0
        out[-1].append(i)
        size += own
    return out


def pieces_of(fit: Fit, rows: int) -> list[Fit]:
    """The fit in runs of trees that have at most about ``NODES`` nodes together, or one tree."""
    step = max(1, min(fit.trees, NODES // _nodes_of(fit, rows)))
    return [replace(fit, first=fit.first + a, trees=min(step, fit.trees - a)) for a in range(0, fit.trees, step)]


def predict_held_out(table: DataFrame, jobs: list[tuple[str, Fit, Rows]]) -> DataFrame:
    """Grows every job's fit and predicts its held-out rows: rid, row and one column per
    name (a name's jobs, its folds, share the column and no rows)."""
    from . import whole
    n = table.count()
    if whole.fits_in(n, max((len(f.features) for _, f, _ in jobs), default=0)):
        return whole.held_out(table, jobs)
    pieces = [(name, p, held, p.trees / fit.trees) for name, fit, held in jobs for p in pieces_of(fit, n)]
    groups = groups_of([p for _, p, _, _ in pieces], n)
    parts = []
    for group in groups:
        mine = [pieces[i] for i in group]
        forests = [[(t.arrays(), np.array(t.value)) for t in trees] for trees in grow(table, [f for _, f, _, _ in mine])]
        parts.append(_predicted(table, mine, forests))
    names = list(dict.fromkeys(name for name, _, _ in jobs))
    if len(parts) == 1:
        return parts[0].select("row.*", *[F.col("preds")[i].alias(c) for i, c in enumerate(names)]).drop("_")
    long = [p.select("rid", F.posexplode("preds").alias("at", "p"), F.lit(i).alias("part")) for i, p in enumerate(parts)]
    kept = []
    for i, group in enumerate(groups):
        own = list(dict.fromkeys(pieces[j][0] for j in group))
        kept.append(long[i].filter("p IS NOT NULL").select("rid", F.element_at(F.array(*map(F.lit, own)), F.col("at") + 1).alias("name"), "p"))
    rows = kept[0]
    for k in kept[1:]:
        rows = rows.unionByName(k)
    wide = rows.groupBy("rid").agg(*[F.sum(F.when(F.col("name") == c, F.col("p"))).alias(c) for c in names])
    return table.select("rid", "row").join(wide, "rid", "left").select("row.*", *names).drop("_")


def _predicted(table: DataFrame, jobs: list[tuple[str, Fit, Rows, float]], forests: list[list[tuple]]) -> DataFrame:
    """The jobs' predictions, each times its share (of the trees of its fit), added up by name."""
    names = list(dict.fromkeys(name for name, *_ in jobs))
    kind = table.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, g = unpack(batch, "x", np.float32), unpack(batch, "g", np.int32)
            out = np.full((len(x), len(names)), np.nan)
            for (name, fit, held, share), forest in zip(jobs, forests, strict=True):
                rows, at = np.flatnonzero(held.mask(g)), names.index(name)
                if len(rows):
                    out[rows, at] = np.nan_to_num(out[rows, at]) + share * predict(fit.matrix(x[rows]), forest)
            flat = pa.array(out.ravel(), from_pandas=True)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(names))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("row"), pa.ListArray.from_arrays(offsets, flat)],
                                             ["rid", "row", "preds"])

    return materialize(table.mapInArrow(run, f"rid long, row {kind}, preds array<double>"), "held-out")


def _preorder(left: np.ndarray) -> np.ndarray:
    """The nodes of a tree, parents first and the left side before the right."""
    out, stack = [], [0]
    while stack:
        node = stack.pop()
        out.append(node)
        if left[node] >= 0:
            stack += [left[node] + 1, left[node]]
    return np.array(out)


def _node_arrays(tree: Tree, classes: bool) -> list[pa.Array]:
    """A tree in the columns in which Spark ML saves one."""
    feature, cut, left = tree.arrays(np.float64)
    order = _preorder(left)
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(len(order))
    feature, cut, left = feature[order], cut[order], left[order]
    inner = left >= 0
    child = [np.where(inner, number[np.where(inner, left + side, 0)], -1) for side in (0, 1)]
    value, weight = np.array(tree.value)[order], np.array(tree.weight)[order]
    if classes:
        value = np.clip(value, 0.0, 1.0)  # a sum's rounding
    stats = np.stack([weight * (1 - value), weight * value] if classes else [weight, weight * value, weight * value * value], axis=1)
    shares = lambda flat, sizes: pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
    split = pa.StructArray.from_arrays(
        [pa.array(feature), shares(cut[inner], inner.astype(int)), pa.array(np.full(len(order), -1, np.int32))],
        ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    gain = np.where(inner, np.array(tree.gain)[order] / np.maximum(weight, 1e-300), -1.0)
    data = pa.StructArray.from_arrays(
        [pa.array(np.arange(len(order), dtype=np.int32)), pa.array((value > 0.5).astype(np.float64) if classes else value),
         pa.array(np.zeros(len(order))), shares(stats.ravel(), np.full(len(order), stats.shape[1])),
         pa.array(np.array(tree.rows, np.int64)[order]), pa.array(gain), pa.array(child[0].astype(np.int32)),
         pa.array(child[1].astype(np.int32)), split],
        ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
    return [pa.array(np.full(len(order), tree.number, np.int32)), data]


NODE_SCHEMA = ("treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,"
               "leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>")


class Stored:
    """A written Spark ML model, loaded when it is first used."""

    def __init__(self, kind, path: str):
        self._kind, self._path, self._model = kind, path, None

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        if self._model is None:
            self._model = self._kind.load(self._path)
        return getattr(self._model, name)


def forest(table: DataFrame, fit: Fit, n_features: int, classes: bool = False, edges: list[np.ndarray] | None = None) -> Stored:
    """A fit's forest as a Spark ML model.  The driver holds ``NODES`` nodes of it, none of a table that fits in a task."""
    from . import whole
    n = table.count()
    kind, path = _metadata(table.sparkSession, fit.trees, n_features, None, classes)
    if whole.fits_in(n, len(fit.features)):
        whole.write_forest(table, fit, path, classes, edges)
    else:
        for piece in pieces_of(fit, n):
            _write_nodes(table.sparkSession, path, grow(table, [piece])[0], classes, piece.first)
    return Stored(kind, path)


def spark_model(spark, trees: list[Tree], n_features: int, weights: list[float] | None = None, classes: bool = False,
                features: str = "_x", prediction: str = "_pred") -> Stored:
    """The trees as a Spark ML model, by way of its saved form: a forest (mean of the trees), or with
    ``weights`` a boosted sum.  Leaves are numbered as in any Spark ML model."""
    kind, path = _metadata(spark, len(trees), n_features, weights, classes, features, prediction)
    _write_nodes(spark, path, trees, classes)
    return Stored(kind, path)


def _metadata(spark, n_trees: int, n_features: int, weights: list[float] | None, classes: bool,
              features: str = "_x", prediction: str = "_pred") -> tuple:
    """Writes all of a model but its nodes: its class and folder."""
    from pyspark.ml.classification import RandomForestClassificationModel
    from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
    kind = GBTRegressionModel if weights else RandomForestClassificationModel if classes else RandomForestRegressionModel
    side = "classification" if classes else "regression"
    params = {"featuresCol": features, "predictionCol": prediction, "maxDepth": 30}
    if not weights:
        params["numTrees"] = n_trees
    if classes:
        params |= {"probabilityCol": f"{prediction}_prob", "rawPredictionCol": f"{prediction}_raw"}
    common = {"timestamp": 0, "sparkVersion": spark.version, "paramMap": params,
              "defaultParamMap": {"leafCol": "", "labelCol": "label", "impurity": "gini" if classes else "variance"}}
    one = common | {"paramMap": {k: v for k, v in params.items() if k != "numTrees"}} | {"class": f"org.apache.spark.ml.{side}.DecisionTree{side.capitalize()}Model", "numFeatures": n_features}
    if classes:
        one |= {"numClasses": 2}
    top = common | {"class": f"org.apache.spark.ml.{side}.{kind.__name__}", "uid": f"grown_{uuid.uuid4().hex[:12]}",
                    "numFeatures": n_features, "numTrees": n_trees} | ({"numClasses": 2} if classes else {})
    path = checkpoint_path(spark, f"grown-{uuid.uuid4().hex[:12]}")
    spark.createDataFrame([(json.dumps(top),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame([(i, json.dumps(one | {"uid": f"tree_{i}_{uuid.uuid4().hex[:8]}"}), float(weights[i] if weights else 1.0))
                           for i in range(n_trees)], "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    return kind, path


def _write_nodes(spark, path: str, trees: list[Tree], classes: bool, first: int = 0) -> None:
    for start in range(0, len(trees), 256):
        parts = [_node_arrays(t, classes) for t in trees[start:start + 256]]
        for i, p in enumerate(parts, first + start):
            p[0] = pa.array(np.full(len(p[0]), i, np.int32))
        nodes = pa.table({"treeID": pa.chunked_array([p[0] for p in parts]), "nodeData": pa.chunked_array([p[1] for p in parts])})
        spark.createDataFrame(nodes).write.mode("append").parquet(f"{path}/data")
