"""Gradient boosting of many fits in lockstep.

All fits read one packed table whose features are bin numbers (``bin_edges``).  A round gives
every fit one tree; its passes serve all fits together:

* the sums of the negative gradients and the rows of every (node, feature, bin), from
  which each node's best cut follows (gain G^2 / (n + l2) left plus right);
* a tree is grown best gain first up to ``max_leaves`` (or to ``max_depth``).  Each pass
  evaluates the children that the present leaves would get, so a leaf can be split as
  soon as its turn comes, and a tree takes about as many passes as it is deep;
* squared loss: a leaf's value is its gradients' sum / (n + l2).  Quantile loss: the gradients
  are alpha or alpha - 1, and the leaf's value is the exact quantile of its residuals.
  Huber loss: the cut-off is the quantile ``alpha`` of the absolute residuals of the
  round, and the leaf's value is the median of its residuals plus the mean of what is
  left, cut at the cut-off.  Quantiles are exact ones by narrowed ranges (``quantiles``).

The rows' predictions so far are written every ``WRITTEN`` rounds; tasks add the trees since.
The driver holds trees of at most ``max_leaves`` leaves and one best cut per node.

Over a table that fits in a task each fit runs its rounds in one task (``Whole``), with the same sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .growth import Rows, Tree, _blob, _gather, _merged, unpack
from .quantiles import PARTS, Parts, added, keys_of, narrow

#: Rounds between written predictions; (node, feature, bin) cells of one pass.
WRITTEN, CELLS = 16, 1 << 22


@dataclass(frozen=True)
class Boost:
    """One boosted model: what it learns from and its sizes."""
    label: int
    train: Rows
    features: tuple[int, ...]
    fill: tuple[float, ...]
    rounds: int
    rate: float
    loss: str = "squared"        # squared, huber or quantile
    alpha: float = 0.9           # of huber's cut-off, or the quantile
    max_depth: int = 0           # 0: no bound
    max_leaves: int = 0          # 0: no bound but the depth
    min_leaf: int = 1
    l2: float = 0.0

    def gradient(self, residual: np.ndarray, cutoff: float) -> np.ndarray:
        """The negative gradient of the loss."""
        if self.loss == "quantile":
            return np.where(residual >= 0, self.alpha, self.alpha - 1.0)
        return np.clip(residual, -cutoff, cutoff) if self.loss == "huber" else residual


def bin_edges(df: DataFrame, features: dict[str, Column], bins: int) -> list[np.ndarray]:
    """At most ``bins`` - 1 cut points of every feature, its quantiles of all rows: a value is in
    the first bin whose edge is not below it."""
    probs = [(i + 1) / bins for i in range(bins - 1)]
    row = df.agg(*[F.percentile_approx(c.cast("double"), probs, 10_000).alias(f"x{i}") for i, c in enumerate(features.values())],
                 *[F.max(c.cast("double")).alias(f"m{i}") for i, c in enumerate(features.values())]).first()
    out = []
    for i in range(len(features)):
        e = np.unique(np.array(row[f"x{i}"] or [], np.float64))
        out.append(e[e < row[f"m{i}"]] if len(e) else e)
    return out


class Booster:
    """The state of all fits over one table."""

    def __init__(self, table: DataFrame, fits: list[Boost], edges: list[np.ndarray]):
        self.table, self.fits, self.edges = table, fits, edges
        self.fills = [np.array([np.searchsorted(edges[f], v) for f, v in zip(fit.features, fit.fill, strict=True)], np.uint8) for fit in fits]
        self.width = max((len(fit.features) for fit in fits), default=0)
        self.bins = max((len(e) for e in edges), default=0) + 1
        self.trees: list[list[Tree]] = [[] for _ in fits]
        self.cutoff = [0.0] * len(fits)
        self.start: list[float] = [0.0] * len(fits)
        self.since = 0  # trees before this one are in the written predictions
        self.base: DataFrame | None = None

    # -- what tasks do -------------------------------------------------------
    def _reader(self):
        """A function that gives, for a batch, each fit's training rows: bins, residuals and the present tree's node."""
        fits, fills, starts, since = self.fits, self.fills, list(self.start), self.since
        trees = [[_plain(t) for t in ts[since:]] for ts in self.trees]
        written = since > 0

        def read(batch: pa.RecordBatch, wanted: set[int], rows_of=None):
            x, y, g = unpack(batch, "x", np.uint8), unpack(batch, "y"), unpack(batch, "g", np.int32)
            done = unpack(batch, "p") if written else None
            cache: dict = {}
            for k, fit in enumerate(fits):
                if k not in wanted:
                    continue
                mask = (rows_of[k] if rows_of else fit.train).mask(g)
                rows = np.flatnonzero(mask if rows_of else mask & ~np.isnan(y[:, fit.label]))
                if not len(rows):
                    continue
                key = (fit.train, fit.label, fit.features, fit.fill)
                if key not in cache or rows_of:
                    own = x[rows][:, list(fit.features)]
                    cache[key] = np.where(own == 255, fills[k], own)
                bins = cache[key]
                pred = done[rows, k].copy() if written else np.full(len(rows), starts[k])
                for t in trees[k]:
                    pred += t[3][_walk(bins, t)]
                yield k, rows, bins, pred, y[rows, fit.label]
        return read

    def _data(self) -> DataFrame:
        return (self.base or self.table).select("x", "y", "g", *(["p"] if self.since else []))

    # -- the passes ----------------------------------------------------------
    def _quantiles(self, groups: list[tuple[int, int]], probs: list[float], kind: str, shapes: list | None = None) -> list[float | None]:
        """A quantile of every group (fit, leaf) of residuals: of the labels, absolute or plain residuals.
        ``shapes``: the new tree of every fit, whose nodes are the leaves (else leaf 0 has all rows)."""
        read, data = self._reader(), self._data()
        plain = [_plain(t) if t is not None else None for t in shapes] if shapes else None

        def counts(open_: list[int], low: np.ndarray, high: np.ndarray, parts: int) -> dict:
            index = np.array(open_)
            place = {groups[s]: i for i, s in enumerate(open_)}
            wanted = {k for k, _ in place}

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                found = Parts(index, low, high, parts)
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    for k, _, bins, pred, y in read(batch, wanted):
                        v = y if kind == "label" else np.abs(y - pred) if kind == "absolute" else y - pred
                        leaf = _walk(bins, plain[k]) if plain else np.zeros(len(v), np.int64)
                        table = np.full((len(plain[k][0]) if plain else 1), -1)
                        for (f, node), i in place.items():
                            if f == k:
                                table[node] = i
                        at = table[leaf]
                        found.add(at[at >= 0], keys_of(v[at >= 0]))
                yield found.batch()

            return added(data.mapInArrow(run, PARTS))
        return narrow(len(groups), counts, probs)

    def _sums(self, groups: list[tuple[int, int]], shapes: list, centre: dict[tuple[int, int], float]) -> dict[tuple[int, int], tuple[float, float]]:
        """Rows of every leaf and the sum of its residuals less ``centre``, cut at the cut-off."""
        read, data, cutoff = self._reader(), self._data(), list(self.cutoff)
        plain = [_plain(t) if t is not None else None for t in shapes]
        wanted = {k for k, _ in groups}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: dict[tuple[int, int], list[float]] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                for k, _, bins, pred, y in read(batch, wanted):
                    leaf = _walk(bins, plain[k])
                    mid = np.array([centre.get((k, node), 0.0) for node in range(len(plain[k][0]))])
                    rest = np.clip(y - pred - mid[leaf], -cutoff[k], cutoff[k])
                    n, s = np.bincount(leaf, minlength=len(mid)), np.bincount(leaf, rest, minlength=len(mid))
                    for node in np.flatnonzero(n):
                        now = out.setdefault((k, int(node)), [0.0, 0.0])
                        now[0] += float(n[node])
                        now[1] += float(s[node])
            cols = list(zip(*[(k, node, a, b) for (k, node), (a, b) in out.items()], strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.float64(), pa.float64()), strict=True)],
                                             ["fit", "node", "n", "s"])

        got = data.mapInArrow(run, "fit int, node int, n double, s double").groupBy("fit", "node").agg(
            F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
        return {(r.fit, r.node): (r.n, r.s) for r in got}

    def _best_cuts(self, shapes: list[Tree], nodes: list[tuple[int, int]]) -> dict[tuple[int, int], tuple]:
        """Best cut of each node (fit, node of the fit's tree under growth): gain, feature, bin, rows and
        gradient sum on the left, and the node's own rows and sum."""
        out: dict[tuple[int, int], tuple] = {}
        step = max(1, CELLS // max(1, self.width * self.bins))
        for at in range(0, len(nodes), step):
            some = nodes[at:at + step]
            for r in self._histograms(shapes, some):
                out[some[r.slot]] = (r.gain, r.feature, r.bin, r.nl, r.gl, r.n, r.g)
        return out

    def _histograms(self, shapes: list[Tree], some: list[tuple[int, int]]) -> list:
        read, fits, cutoff = self._reader(), self.fits, list(self.cutoff)
        width, bins, n_slots = self.width, self.bins, len(some)
        plain = [_plain(t) if t is not None else None for t in shapes]
        slot_of = [np.full(len(p[0]), -1) if p else None for p in plain]
        for slot, (k, node) in enumerate(some):
            slot_of[k][node] = slot
        wanted = {k for k, _ in some}

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size = n_slots * width * bins
            n, g = np.zeros(size), np.zeros(size)
            seen = np.zeros(n_slots, bool)
            for batch in batches:
                if not batch.num_rows:
                    continue
                for k, _, x, pred, y in read(batch, wanted):
                    slot = slot_of[k][_walk(x, plain[k])]
                    rows = np.flatnonzero(slot >= 0)
                    if not len(rows):
                        continue
                    slot, grad = slot[rows], fits[k].gradient(y[rows] - pred[rows], cutoff[k])
                    seen[slot] = True
                    at = (slot[:, None] * width + np.arange(x.shape[1])) * bins + x[rows]
                    lo = int(slot.min()) * width * bins
                    flat = at.ravel() - lo
                    top = (int(slot.max()) + 1) * width * bins - lo
                    n[lo:lo + top] += np.bincount(flat, minlength=top)
                    g[lo:lo + top] += np.bincount(flat, np.repeat(grad, x.shape[1]), minlength=top)
            n, g = n.reshape(n_slots, -1), g.reshape(n_slots, -1)
            for s in np.array_split(np.flatnonzero(seen), max(1, int(seen.sum()) // 256 + 1)):
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), _blob(n[s]), _blob(g[s])], ["slot", "n", "g"])

        def merge(group: pa.Table) -> pa.Table:
            slots, (n, g) = _gather(group, dict.fromkeys("ng", (np.add, np.float64)))
            own = [fits[some[s][0]] for s in slots]
            rows = [best_split(a.reshape(width, bins)[:len(f.features)], b.reshape(width, bins)[:len(f.features)], f.min_leaf, f.l2)
                    for a, b, f in zip(n, g, own, strict=True)]
            cols = list(zip(*rows, strict=True))
            kinds = [pa.float64(), pa.int32(), pa.int32(), *[pa.float64()] * 4]
            return pa.table({"slot": pa.array(slots, pa.int32())} | {
                name: pa.array(c, t) for name, c, t in zip(("gain", "feature", "bin", "nl", "gl", "n", "g"), cols, kinds, strict=True)})

        return _merged(self._data(), part, merge, n_slots, 2 * width * bins, "slot int, n binary, g binary",
                       "slot int, gain double, feature int, bin int, nl double, gl double, n double, g double",
                       ["x", "y", "g", *(["p"] if self.since else [])])

    # -- a round -------------------------------------------------------------
    def _grow(self, active: list[int]) -> list[Tree | None]:
        """The structure of one tree of every active fit, its nodes' rows and gradient sums as weight and value."""
        drafts = [Tree(k, 0) if k in active else None for k in range(len(self.fits))]  # with children ahead of their turn
        depth = [[0] for _ in self.fits]
        known: dict[tuple[int, int], tuple] = {}
        leaves = {k: [0] for k in active}          # of the tree proper
        taken: dict[int, set[int]] = {k: set() for k in active}
        todo = [(k, 0) for k in active]
        while todo:
            known |= self._best_cuts(drafts, todo)
            todo = []
            for k in active:
                fit, draft = self.fits[k], drafts[k]
                cap = fit.max_leaves or 1 << 30
                while len(leaves[k]) < cap:
                    ready = [v for v in leaves[k] if (k, v) in known and known[(k, v)][0] > 0]
                    pending = [v for v in leaves[k] if (k, v) not in known and not (fit.max_depth and depth[k][v] >= fit.max_depth)]
                    if pending or not ready:
                        break
                    best = max(ready, key=lambda v: (known[(k, v)][0], -v))
                    self._children(k, draft, depth[k], known, best)
                    taken[k].add(best)
                    leaves[k].remove(best)
                    leaves[k] += [draft.left[best], draft.left[best] + 1]
                room = cap - len(leaves[k])
                if room > 0:  # the children of every leaf that may still be split
                    for v in list(leaves[k]):
                        if (k, v) in known and known[(k, v)][0] > 0:
                            self._children(k, draft, depth[k], known, v)
                            nodes = (draft.left[v], draft.left[v] + 1)
                        else:
                            nodes = (v,)
                        todo += [(k, c) for c in nodes if (k, c) not in known and not (fit.max_depth and depth[k][c] >= fit.max_depth)]
            todo = list(dict.fromkeys(todo))
        out: list[Tree | None] = [None] * len(self.fits)
        for k in active:
            out[k] = _pruned(drafts[k], taken[k], known, k)
        return out

    def _children(self, k: int, draft: Tree, depth: list[int], known: dict, node: int) -> None:
        if draft.left[node] >= 0:
            return
        gain, feature, b, nl, gl, n, g = known[(k, node)]
        draft.feature[node], draft.cut[node], draft.left[node], draft.gain[node] = feature, float(b), len(draft.feature), gain
        for rows, total in ((nl, gl), (n - nl, g - gl)):
            draft.add(int(rows), rows, total)
            depth.append(depth[node] + 1)

    def fit(self) -> None:
        """Fits all models: in tasks of their own over a table that fits in a task, else in lockstep."""
        from . import whole
        if whole.fits_in(self.table.count(), self.width):
            for k, (start, trees) in enumerate(whole.fit_boosted(self.table, self.fits, self.edges)):
                self.start[k], self.trees[k] = start, trees
            most = max((len(t) for t in self.trees), default=0)
            for k, trees in enumerate(self.trees):  # a fit that has ended gets trees that add nothing
                trees += [Tree(k, turn) for turn in range(len(trees), most)]
            return
        self._fit()

    def _fit(self) -> None:
        fits = self.fits
        middle = [k for k, f in enumerate(fits) if f.loss != "squared"]
        if middle:
            got = self._quantiles([(k, 0) for k in middle], [0.5 if fits[k].loss == "huber" else fits[k].alpha for k in middle], "label")
            for k, v in zip(middle, got, strict=True):
                self.start[k] = v or 0.0
        mean = [k for k in range(len(fits)) if k not in middle]
        if mean:
            self.cutoff = [np.inf] * len(fits)
            roots = [Tree(k, 0) if k in mean else None for k in range(len(fits))]
            for (k, _), (n, s) in self._sums([(k, 0) for k in mean], roots, {}).items():
                self.start[k] = s / n
        for turn in range(max((f.rounds for f in fits), default=0)):
            active = [k for k, f in enumerate(fits) if turn < f.rounds]
            huber = [k for k in active if fits[k].loss == "huber"]
            if huber:
                for k, v in zip(huber, self._quantiles([(k, 0) for k in huber], [fits[k].alpha for k in huber], "absolute"), strict=True):
                    self.cutoff[k] = v or 0.0
            shapes = self._grow(active)
            self._leaf_values(active, shapes)
            for k in range(len(fits)):  # a fit that has ended gets a tree that adds nothing
                self.trees[k].append(shapes[k] if shapes[k] is not None else Tree(k, turn))
            if (turn + 1) % WRITTEN == 0 and turn + 1 < max(f.rounds for f in fits):
                self._write()

    def _leaf_values(self, active: list[int], shapes: list[Tree | None]) -> None:
        leaves = {k: [v for v, f in enumerate(shapes[k].feature) if f < 0] for k in active}
        groups = [(k, v) for k in active for v in leaves[k] if self.fits[k].loss != "squared"]
        value: dict[tuple[int, int], float] = {}
        if groups:
            probs = [0.5 if self.fits[k].loss == "huber" else self.fits[k].alpha for k, _ in groups]
            value = {g: v or 0.0 for g, v in zip(groups, self._quantiles(groups, probs, "plain", shapes), strict=True)}
            clipped = [g for g in groups if self.fits[g[0]].loss == "huber"]
            if clipped:
                for g, (n, s) in self._sums(clipped, shapes, value).items():
                    if g in value and self.fits[g[0]].loss == "huber":
                        value[g] += s / n
        for k in active:
            fit, tree = self.fits[k], shapes[k]
            for v in range(len(tree.feature)):
                own = value.get((k, v))
                if own is None:
                    own = tree.value[v] * tree.weight[v] / (tree.weight[v] + fit.l2) if tree.weight[v] else 0.0
                tree.value[v] = fit.rate * own

    def _write(self) -> None:
        """The predictions so far, beside the rows."""
        read, n_fits = self._reader(), len(self.fits)
        schema = self.table.select("rid", "row", "x", "y", "g").schema
        every = {k: Rows(()) for k in range(n_fits)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                p = np.zeros((batch.num_rows, n_fits))
                for k, rows, _, pred, _ in read(batch, set(range(n_fits)), every):
                    p[rows, k] = pred
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "row", "x", "y", "g")), _blob(p)],
                                                 ["rid", "row", "x", "y", "g", "p"])

        kind = schema["row"].dataType.simpleString()
        self.base = materialize((self.base or self.table).mapInArrow(
            run, f"rid long, row {kind}, x binary, y binary, g binary, p binary"), "boosted-so-far")
        self.since = len(self.trees[0])

    def held_out(self, names: list[str], tests: list[Rows]) -> DataFrame:
        """The columns of ``row`` and one per name: predictions of the fits' held-out rows."""
        read, kind = self._reader(), self.table.schema["row"].dataType.simpleString()
        cols = list(dict.fromkeys(names))
        rows_of = dict(enumerate(tests))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                out = np.full((batch.num_rows, len(cols)), np.nan)
                for k, rows, _, pred, _ in read(batch, set(rows_of), rows_of):
                    out[rows, cols.index(names[k])] = pred
                offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(cols))
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.ListArray.from_arrays(offsets, pa.array(out.ravel(), from_pandas=True))],
                                                 ["row", "preds"])

        out = materialize((self.base or self.table).mapInArrow(run, f"row {kind}, preds array<double>"), "boosted-held-out")
        return out.select("row.*", *[F.col("preds")[i].alias(c) for i, c in enumerate(cols)]).drop("_")

    def as_trees(self, k: int) -> list[Tree]:
        """The model as a sum of trees on the features' own values; the first is the start value."""
        first = Tree(k, 0)
        first.value[0] = self.start[k]
        out = [first]
        for t in self.trees[k]:
            c = Tree(k, len(out), list(t.feature), list(t.cut), list(t.left), list(t.value), list(t.rows), list(t.weight), list(t.gain))
            c.cut = [float(self.edges[self.fits[k].features[f]][int(b)]) if f >= 0 else 0.0 for f, b in zip(t.feature, t.cut, strict=True)]
            out.append(c)
        return out


class Whole(Booster):
    """One fit whose rows are all here (``whole.Table``): the same rounds without passes over Spark."""

    def __init__(self, data, fit: Boost, edges: list[np.ndarray]):
        super().__init__(None, [fit], edges)
        rows = np.flatnonzero(fit.train.mask(data.g))
        rows = rows[~np.isnan(data.y[rows, fit.label])]
        own, self.y = data.x[rows][:, list(fit.features)], data.y[rows, fit.label]
        self.x = np.where(own == 255, self.fills[0], own)
        self.flat = (self.x + np.arange(self.x.shape[1]) * self.bins).astype(np.int64)
        self.pred, self.added = None, 0

    def fit(self) -> None:
        if len(self.y):
            self._fit()

    def _write(self) -> None:
        """Nothing: the predictions so far are held."""

    def _residuals(self) -> np.ndarray:
        if not self.added:
            self.pred = np.full(len(self.y), self.start[0])
        for tree in self.trees[0][self.added:]:
            self.pred += np.array(tree.value)[_walk(self.x, _plain(tree))]
            self.added += 1
        return self.y - self.pred

    def _leaves(self, shapes: list | None) -> np.ndarray:
        return _walk(self.x, _plain(shapes[0])) if shapes else np.zeros(len(self.y), np.int64)

    def _quantiles(self, groups: list, probs: list[float], kind: str, shapes: list | None = None) -> list[float | None]:
        v = self.y if kind == "label" else self._residuals()
        v, leaf = np.abs(v) if kind == "absolute" else v, self._leaves(shapes)
        return [_quantile(v[leaf == node], p) for (_, node), p in zip(groups, probs, strict=True)]

    def _sums(self, groups: list, shapes: list, centre: dict) -> dict:
        v, leaf, cutoff = self._residuals(), self._leaves(shapes), self.cutoff[0]
        out = {}
        for key in groups:
            own = v[leaf == key[1]]
            if len(own):
                out[key] = float(len(own)), float(np.clip(own - centre.get(key, 0.0), -cutoff, cutoff).sum())
        return out

    def _histograms(self, shapes: list, some: list) -> list:
        grad, leaf = self.fits[0].gradient(self._residuals(), self.cutoff[0]), self._leaves(shapes)
        width, fit, out = self.x.shape[1], self.fits[0], []
        order = np.argsort(leaf, kind="stable")
        starts, ends = (np.searchsorted(leaf, [v for _, v in some], side, sorter=order) for side in ("left", "right"))
        for slot, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            if a == b:
                continue
            rows = np.sort(order[a:b])
            flat = self.flat[rows].ravel()
            n = np.bincount(flat, minlength=width * self.bins).astype(np.float64).reshape(width, self.bins)
            g = np.bincount(flat, np.repeat(grad[rows], width), minlength=width * self.bins).reshape(width, self.bins)
            out.append(_Cut(slot, *best_split(n, g, fit.min_leaf, fit.l2)))
        return out


class _Cut(NamedTuple):
    slot: int
    gain: float
    feature: int
    bin: int
    nl: float
    gl: float
    n: float
    g: float


def _quantile(v: np.ndarray, prob: float) -> float | None:
    """As ``quantiles.narrow``: linear between neighbours."""
    if not len(v):
        return None
    place = prob * (len(v) - 1)
    a = int(place)
    b = min(a + 1, len(v) - 1) if place > a else a
    v = np.partition(v, (a, b))
    return float(v[a] + (place - a) * (v[b] - v[a]))


def _plain(tree: Tree) -> tuple[np.ndarray, ...]:
    return (*tree.arrays(), np.array(tree.value))


def _walk(bins: np.ndarray, tree: tuple) -> np.ndarray:
    from .growth import walk
    return walk(bins, *tree[:3])


def _pruned(draft: Tree, taken: set[int], known: dict, k: int) -> Tree:
    """The draft without the children that were only looked at."""
    out = Tree(k, 0)
    place, queue = {0: 0}, [0]
    root = known.get((k, 0))
    out.rows[0], out.weight[0] = (int(root[5]), root[5]) if root else (0, 0.0)
    out.value[0] = root[6] / root[5] if root and root[5] else 0.0
    while queue:
        v = queue.pop(0)
        if v not in taken:
            continue
        at = place[v]
        out.feature[at], out.cut[at], out.left[at], out.gain[at] = draft.feature[v], draft.cut[v], len(out.feature), draft.gain[v]
        for c in (draft.left[v], draft.left[v] + 1):
            place[c] = len(out.feature)
            out.add(draft.rows[c], draft.weight[c], draft.value[c] * draft.weight[c])
            queue.append(c)
    return out


def best_split(n: np.ndarray, g: np.ndarray, min_leaf: int, l2: float) -> tuple:
    """(gain, feature, bin, rows and gradient sum on the left, rows and sum in all) of the best cut
    "bin <= b" (ties, up to rounding: the first feature, then the first bin); gain 0: none."""
    rows, total = float(n[0].sum()), float(g[0].sum())
    nl, gl = np.cumsum(n, axis=1)[:, :-1], np.cumsum(g, axis=1)[:, :-1]
    nr, gr = rows - nl, total - gl
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where((nl >= max(min_leaf, 1)) & (nr >= max(min_leaf, 1)), gl * gl / (nl + l2) + gr * gr / (nr + l2), -np.inf)
    if not parts.size or not np.isfinite(parts.max()):
        return 0.0, -1, -1, 0.0, 0.0, rows, total
    top = parts.max()
    f, b = divmod(int(np.argmax(parts >= top - 1e-10 * abs(top))), parts.shape[1])
    gain = float(top - total * total / (rows + l2))
    if gain <= 1e-12 * max(abs(top), 1e-300):
        return 0.0, -1, -1, 0.0, 0.0, rows, total
    return gain, f, b, float(nl[f, b]), float(gl[f, b]), rows, total
