"""Ridge regressions of many fits in three passes over one packed table.

The passes give each fit's means of its (filled) features, then their deviations, then the
products of the scaled features with each other and with the centred label; tasks give one small matrix per fit and Spark adds them up.  The driver solves k
systems of the number of features, which doesn't follow the rows:
min SSE + penalty * |w|^2 on features scaled by their population deviation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .growth import Fit, Rows, _blob, _gather, unpack


def _summed(table: DataFrame, fits: list[Fit], one) -> dict[int, np.ndarray]:
    """``one(k, x, y)`` of every fit's training rows, added up: one row of numbers per fit."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, g = unpack(batch, "x"), unpack(batch, "y"), unpack(batch, "g", np.int32)
            for k, fit in enumerate(fits):
                rows = np.flatnonzero(fit.train.mask(g) & ~np.isnan(y[:, fit.label]))
                if len(rows):
                    found = one(k, fit.matrix(x[rows]), y[rows, fit.label])
                    out[k] = out[k] + found if k in out else found
        for k, total in out.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), _blob(total[None])], ["slot", "sums"])

    def merge(group: pa.Table) -> pa.Table:
        slots, (sums,) = _gather(group, {"sums": (np.add, np.float64)})
        return pa.table({"slot": pa.array(slots, pa.int32()), "sums": _blob(sums)})

    schema = "slot int, sums binary"
    got = table.select("x", "y", "g").mapInArrow(part, schema).groupBy("slot").applyInArrow(merge, schema).collect()
    return {r.slot: np.frombuffer(r.sums) for r in got}


def fit_ridges(table: DataFrame, fits: list[Fit], penalty: float) -> list[tuple[np.ndarray, float]]:
    """Weights of the unscaled features and the intercept of every fit; ``table`` is packed in double precision."""
    first = _summed(table, fits, lambda k, x, y: np.concatenate([[len(y), y.sum()], x.sum(axis=0)]))
    means, scales, label_means = {}, {}, {}
    for k, s in first.items():
        f = len(fits[k].features)
        means[k], label_means[k] = s[2:2 + f] / s[0], s[1] / s[0]
    centred = _summed(table, fits, lambda k, x, y: ((x - means[k]) ** 2).sum(axis=0))
    for k, s in centred.items():
        deviation = np.sqrt(s / first[k][0])
        scales[k] = np.where(deviation > 0, deviation, 1.0)

    def products(k: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = (x - means[k]) / scales[k]
        return np.concatenate([(z.T @ z).ravel(), z.T @ (y - label_means[k])])

    out = []
    gram = _summed(table, fits, products)
    for k, fit in enumerate(fits):
        f = len(fit.features)
        if k not in gram:
            out.append((np.zeros(f), 0.0))
            continue
        a, b = gram[k][:f * f].reshape(f, f), gram[k][f * f:]
        w = np.linalg.solve(a + penalty * np.eye(f), b) / scales[k]
        out.append((w, float(label_means[k] - w @ means[k])))
    return out


def ridge_held_out(table: DataFrame, jobs: list[tuple[str, Fit, Rows]], penalty: float) -> DataFrame:
    """The columns of ``row`` and one per name: the predictions of its jobs' held-out rows."""
    models = fit_ridges(table, [f for _, f, _ in jobs], penalty)
    names = list(dict.fromkeys(n for n, _, _ in jobs))
    kind = table.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, g = unpack(batch, "x"), unpack(batch, "g", np.int32)
            out = np.full((len(x), len(names)), np.nan)
            for (name, fit, held), (w, b) in zip(jobs, models, strict=True):
                rows = np.flatnonzero(held.mask(g))
                if len(rows):
                    out[rows, names.index(name)] = fit.matrix(x[rows]) @ w + b
            flat = pa.array(out.ravel(), from_pandas=True)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(names))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.ListArray.from_arrays(offsets, flat)], ["row", "preds"])

    out = materialize(table.mapInArrow(run, f"row {kind}, preds array<double>"), "ridge-held-out")
    return out.select("row.*", *[F.col("preds")[i].alias(c) for i, c in enumerate(names)]).drop("_")
