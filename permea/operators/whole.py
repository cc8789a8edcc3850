"""Fits of a small table: a task has all of its rows and grows whole trees.

A packed table (``growth.pack``) of at most ``BYTES`` of features goes to every task once.  A task then
grows some trees of a fit from the root to the last leaf, or one boosted model, without a pass over Spark
for each level.  Trees of full depth have about as many nodes as rows, so neither the driver nor a task
holds a forest: a task adds the predictions of the held-out rows up tree by tree, and a forest that is
kept is written by the tasks in the form in which Spark ML saves one.  Larger tables take the
passes of ``growth`` and ``boost``, which draw the same features and cuts.

Random forests are grown here, too: a tree's rows are drawn with replacement (Poisson counts), a node's
features by hash, and the best cut lies between two bins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import growth as G

#: Bytes of a table's features that a task holds; trees of a task; rows that are looked at together.
BYTES, TREES, TOGETHER = 64 << 20, 8, 1 << 12


def fits_in(rows: int, width: int) -> bool:
    return rows * width * 4 <= BYTES


@dataclass
class Table:
    """The rows of a packed table, by row number."""
    rid: np.ndarray
    x: np.ndarray
    y: np.ndarray
    g: np.ndarray

    @classmethod
    def read(cls, table: DataFrame, x_type: type) -> Table:
        got = [b for b in table.select("rid", "x", "y", "g").toArrow().to_batches() if b.num_rows]
        if not got:
            return cls(np.zeros(0, np.int64), np.zeros((0, 0), x_type), np.zeros((0, 0)), np.zeros((0, 0), np.int32))
        parts = [[b.column("rid").to_numpy(), G.unpack(b, "x", x_type), G.unpack(b, "y"), G.unpack(b, "g", np.int32)] for b in got]
        rid, *rest = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.argsort(rid)
        return cls(rid[order], *(a[order] for a in rest))

    def training(self, fit: G.Fit) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """The filled features, labels and weights of a fit's rows with a label."""
        rows = np.flatnonzero(fit.train.mask(self.g))
        rows = rows[~np.isnan(self.y[rows, fit.label])]
        y = self.y[rows, fit.label]
        return fit.matrix(self.x[rows]), y, None if fit.weights is None else np.where(y > 0.5, fit.weights[1], fit.weights[0])


def _hashes(seed: int, number: int, nodes: np.ndarray, n_features: int) -> np.ndarray:
    """``growth.node_hash`` of several nodes."""
    base = G._mix(G._mix(np.array([seed], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(number + 1)) + nodes.astype(np.uint64) + np.uint64(1))
    return G._mix(base[:, None] + np.arange(1, n_features + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _groups(starts: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring nodes of about ``TOGETHER`` rows, or one node of more."""
    ends = np.append(starts[1:], n)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + TOGETHER, "right")))
        yield a, b
        a = b


def grow_tree(fit: G.Fit, number: int, x: np.ndarray, y: np.ndarray, w: np.ndarray | None) -> G.Tree:
    """The tree that ``growth.grow`` gives (``fit.bins``: a random forest's), its columns as arrays."""
    rows = np.arange(len(y))
    if fit.bins:
        rows = np.repeat(rows, np.random.default_rng((fit.seed, number)).poisson(1.0, len(y)))
    most = max(1, 2 * len(rows))
    feature, left, counts = np.full(most, -1, np.int32), np.full(most, -1, np.int32), np.zeros(most, np.int64)
    cut, value, weight, gain = (np.zeros(most) for _ in range(4))
    ids, starts, made = np.zeros(min(len(rows), 1), np.int64), np.zeros(min(len(rows), 1), np.int64), 1
    for depth in range(fit.max_depth + 1):
        if not len(ids):
            break
        sums = G._sums(starts, y.take(rows), None if w is None else w.take(rows))
        n, total, s, q = sums.T
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(total != 0, s / total, 0.0)
            pure = (total <= 0) | (q - s * s / total <= 1e-12 * np.maximum(np.abs(q), 1e-300))
        counts[ids], weight[ids], value[ids] = n, total, mean
        go = ~pure & (n >= 2 * fit.min_leaf)
        if depth >= fit.max_depth or not go.any():
            break
        rows, ids, sums = rows[np.repeat(go, n.astype(np.int64))], ids[go], sums[go]
        sizes = sums[:, 0].astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        next_rows, next_ids, next_sizes = [], [], []
        for a, b in _groups(starts, len(rows)):
            begin, end = int(starts[a]), int(starts[b]) if b < len(starts) else len(rows)
            own, at = rows[begin:end], starts[a:b] - begin
            f, c, nl, wl, sl, best = (_binned_cuts if fit.bins else _drawn_cuts)(fit, number, ids[a:b], x, own, at, y, w, sums[a:b])
            split = f >= 0
            if not split.any():
                continue
            node, child = ids[a:b][split], made + 2 * np.arange(int(split.sum()))
            feature[node], cut[node], gain[node], left[node] = f[split], c[split], best[split], child
            for side, (rn, rw, rs) in enumerate(((nl, wl, sl), (sums[a:b, 0] - nl, sums[a:b, 1] - wl, sums[a:b, 2] - sl))):
                counts[child + side], weight[child + side] = rn[split], rw[split]
                value[child + side] = np.where(rw[split] != 0, rs[split] / np.where(rw[split] != 0, rw[split], 1.0), 0.0)
            made += 2 * len(node)
            kept = np.repeat(split, sizes[a:b])
            own, of = own[kept], np.repeat(np.arange(len(node)), sizes[a:b][split])
            slot = 2 * of + (x[own, f[split][of]] > c[split][of])
            n_child = counts[(child[:, None] + [0, 1]).ravel()]
            open_ = (n_child >= max(2 * fit.min_leaf, 2)) & (depth + 1 < fit.max_depth)
            own, slot = own[open_[slot]], slot[open_[slot]]
            order = np.argsort(slot.astype(np.uint16) if 2 * len(node) < 1 << 16 else slot, kind="stable")
            next_rows.append(own[order])
            next_ids.append((child[:, None] + [0, 1]).ravel()[open_])
            next_sizes.append(n_child[open_])
        if not next_ids:
            break
        rows, ids, sizes = np.concatenate(next_rows), np.concatenate(next_ids), np.concatenate(next_sizes)
        starts = np.cumsum(sizes) - sizes
    return G.Tree(0, number, feature[:made], cut[:made], left[:made], value[:made], counts[:made], weight[:made], gain[:made])


def _drawn_cuts(fit: G.Fit, number: int, ids: np.ndarray, x: np.ndarray, rows: np.ndarray, at: np.ndarray, y: np.ndarray,
                w: np.ndarray | None, sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Feature (-1: none), cut, and rows, weight and label sum on the left, and gain of each node's best drawn cut."""
    xs = x.take(rows, axis=0)
    one = len(at) == 1
    low, high = (xs.min(axis=0)[None], xs.max(axis=0)[None]) if one else (np.minimum.reduceat(xs, at, axis=0), np.maximum.reduceat(xs, at, axis=0))
    width = xs.shape[1]
    chosen, cuts = G.draw(_hashes(fit.seed, number, ids, width), low, high, fit.drawn)
    dense = np.full((len(at), width), -np.inf, np.float32)
    node, col = np.nonzero(chosen >= 0)
    dense[node, chosen[node, col]] = cuts[node, col]
    ly = y.take(rows)
    lw = None if w is None else w.take(rows)
    terms = [np.ones(len(rows)), ly] if w is None else [np.ones(len(rows)), lw * ly, lw]
    if one:
        n, s, *rest = (np.stack(terms) @ (xs <= dense))[:, None, :]
    else:
        side = xs <= np.repeat(dense, np.diff(at, append=len(rows)), axis=0)
        n, s, *rest = (np.add.reduceat(side * t[:, None], at, axis=0) for t in terms)
    wl = rest[0] if rest else n
    best, gain = G.best_cut(n, wl, s, sums[:, :3], np.full(len(at), fit.min_leaf))
    pick = lambda a: np.take_along_axis(a, np.maximum(best, 0)[:, None], axis=1)[:, 0]
    return best, pick(dense).astype(np.float64), pick(n), pick(wl), pick(s), gain


def _binned_cuts(fit: G.Fit, number: int, ids: np.ndarray, x: np.ndarray, rows: np.ndarray, at: np.ndarray, y: np.ndarray,
                 w: np.ndarray | None, sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same of the best cut between two bins, of the node's drawn features."""
    width, k = x.shape[1], len(at)
    d = min(width, max(1, math.ceil(fit.max_features * width)))
    drawn = np.sort(np.argpartition(_hashes(fit.seed, number, ids, width), d - 1, axis=1)[:, :d], axis=1)  # ties: the first feature
    n, s = sums[:, 0], sums[:, 2]
    ly = y.take(rows)
    if k == 1 and len(rows) > 256:
        bins = x.take(rows, axis=0).take(drawn[0], axis=1)
        flat = (bins + np.arange(d) * 256).ravel()
        nl = np.cumsum(np.bincount(flat, minlength=d * 256).reshape(d, 256), axis=1).astype(np.float64)
        sl = np.cumsum(np.bincount(flat, np.repeat(ly, d), minlength=d * 256).reshape(d, 256), axis=1)
        parts = _parts(nl, sl, n[0], s[0], fit.min_leaf)
        top = parts.max()
        f, b = divmod(int(np.argmax(parts >= top - 1e-10 * abs(top))), 256) if np.isfinite(top) else (0, 0)
        best = np.array([top])
        pick = lambda a: np.array([a[f, b]])
        column, cut = np.array([f]), np.array([float(b)])
    else:
        sizes = np.diff(at, append=len(rows))
        of = np.repeat(np.arange(k), sizes)
        bins = x[rows[:, None], drawn[of]].astype(np.int64)
        keys = bins + (of * 256)[:, None]
        order = np.argsort(keys.astype(np.uint16) if k <= 256 else keys, axis=0, kind="stable")
        keys = np.take_along_axis(keys, order, axis=0)
        total = np.cumsum(ly.take(order), axis=0)
        before = np.where(at > 0, 1, 0)[:, None] * total[np.maximum(at - 1, 0)]
        sl = total - before[of]
        nl = (np.arange(len(rows)) - at[of] + 1.0)[:, None]
        last = np.vstack([keys[1:] != keys[:-1], np.ones((1, d), bool)])
        parts = np.where(last, _parts(nl, sl, n[of][:, None], s[of][:, None], fit.min_leaf), -np.inf)
        tops = np.maximum.reduceat(parts, at, axis=0)
        best = tops.max(axis=1)
        column = (tops >= (best - 1e-10 * np.where(np.isfinite(best), np.abs(best), 0.0))[:, None]).argmax(axis=1)
        mine = parts[np.arange(len(rows)), column[of]]
        place = np.flatnonzero(mine == tops[np.arange(k), column][of])
        place = place[np.unique(of[place], return_index=True)[1]]  # the first of each node
        cut = (keys[place, column] - np.arange(k) * 256).astype(np.float64)
        nl = np.broadcast_to(nl, sl.shape)
        pick = lambda a: a[place, column]
    gain = np.where(np.isfinite(best), best - s * s / n, 0.0)
    found = np.isfinite(best) & (gain > 1e-12 * np.maximum(np.abs(best), 1e-300))
    return np.where(found, drawn[np.arange(k), column], -1), cut, pick(nl), pick(nl), pick(sl), np.maximum(gain, 0.0)


def _parts(nl: np.ndarray, sl: np.ndarray, n: np.ndarray, s: np.ndarray, min_leaf: int) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((nl >= min_leaf) & (n - nl >= min_leaf), sl * sl / nl + (s - sl) ** 2 / (n - nl), -np.inf)


# ---- in tasks --------------------------------------------------------------
def _spread(spark, tasks: list, run, schema: str) -> DataFrame:
    """``run(task)`` gives record batches; every task by itself, so long ones don't wait for each other."""
    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column("id").to_pylist():
                yield from run(tasks[i])
    return spark.range(0, len(tasks), 1, max(1, min(len(tasks), 2000))).mapInArrow(some, schema)


def _tree_tasks(fits: list[G.Fit]) -> list[tuple[int, int, int]]:
    """(fit, first tree, end).  The first trees of all fits come first, so the last tasks are alike."""
    tasks = [(k, a, min(a + TREES, f.trees)) for k, f in enumerate(fits) for a in range(0, f.trees, TREES)]
    return sorted(tasks, key=lambda t: (t[1], t[0]))


def held_out(table: DataFrame, jobs: list[tuple[str, G.Fit, G.Rows]]) -> DataFrame:
    """``growth.predict_held_out`` of a small table."""
    spark = table.sparkSession
    fits = [f for _, f, _ in jobs]
    names = list(dict.fromkeys(n for n, _, _ in jobs))
    data = Table.read(table, np.uint8 if any(f.bins for f in fits) else np.float32)
    sent = spark.sparkContext.broadcast(data)
    tests = [t for _, _, t in jobs]

    def run(task: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
        k, a, b = task
        data, fit = sent.value, fits[k]
        rows = np.flatnonzero(tests[k].mask(data.g))
        if not len(rows):
            return
        x, held = data.training(fit), fit.matrix(data.x[rows])
        out = np.zeros(len(rows))
        for number in range(a, b):
            tree = grow_tree(fit, number, *x)
            out += tree.value[G.walk(held, *tree.arrays())]
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([a], pa.int32()), pa.array([out.tobytes()], pa.binary())],
                                         ["fit", "first", "sums"])

    def merge(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("first").to_numpy())
        sums = group.column("sums").to_pylist()
        total = sum(np.frombuffer(sums[i]) for i in order)  # always in the same order
        return pa.table({"fit": group.column("fit").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    preds = np.full((len(data.rid), len(names)), np.nan)
    if len(data.rid):
        got = _spread(spark, _tree_tasks(fits), run, "fit int, first int, sums binary").groupBy("fit").applyInArrow(merge, "fit int, sums binary")
        sums = {r.fit: np.frombuffer(r.sums) for r in got.collect()}
        for k, (name, fit, test) in enumerate(jobs):
            if k in sums:
                preds[np.flatnonzero(test.mask(data.g)), names.index(name)] = sums[k] / max(fit.trees, 1)
    sent.unpersist()
    found = spark.sparkContext.broadcast((data.rid, preds))
    kind = table.schema["row"].dataType.simpleString()

    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid, values = found.value
        for batch in batches:
            own = values[np.searchsorted(rid, batch.column("rid").to_numpy())]
            offsets = pa.array(np.arange(len(own) + 1, dtype=np.int32) * len(names))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.ListArray.from_arrays(offsets, pa.array(own.ravel(), from_pandas=True))],
                                             ["row", "preds"])

    out = materialize(table.select("rid", "row").mapInArrow(attach, f"row {kind}, preds array<double>"), "held-out")
    return out.select("row.*", *[F.col("preds")[i].alias(c) for i, c in enumerate(names)]).drop("_")


def write_forest(table: DataFrame, fit: G.Fit, path: str, classes: bool, edges: list[np.ndarray] | None = None) -> None:
    """Grows a forest and writes its nodes as Spark ML saves them, from the tasks."""
    spark = table.sparkSession
    sent = spark.sparkContext.broadcast(Table.read(table, np.uint8 if fit.bins else np.float32))

    def run(task: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
        _, a, b = task
        x = sent.value.training(fit)
        for number in range(a, b):
            tree = grow_tree(fit, number, *x)
            if fit.bins:  # cuts on the features' own values
                inner = np.flatnonzero(tree.feature >= 0)
                tree.cut[inner] = [edges[fit.features[tree.feature[i]]][int(tree.cut[i])] for i in inner]
            yield pa.RecordBatch.from_arrays(G._node_arrays(tree, classes), ["treeID", "nodeData"])

    _spread(spark, _tree_tasks([fit]), run, G.NODE_SCHEMA).write.mode("append").parquet(f"{path}/data")


def fit_boosted(table: DataFrame, fits: list, edges: list[np.ndarray]) -> list[tuple[float, list]]:
    """Start value and trees of every boosted model, each grown in a task of its own."""
    import pickle

    from .boost import Whole
    spark = table.sparkSession
    sent = spark.sparkContext.broadcast(Table.read(table, np.uint8))

    def run(k: int) -> Iterator[pa.RecordBatch]:
        data, fit = sent.value, fits[k]
        one = Whole(data, fit, edges)
        one.fit()
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pickle.dumps((one.start[0], one.trees[0]))], pa.binary())],
                                         ["fit", "model"])

    got = {r.fit: pickle.loads(r.model) for r in _spread(spark, list(range(len(fits))), run, "fit int, model binary").collect()}
    sent.unpersist()
    return [got[k] for k in range(len(fits))]
