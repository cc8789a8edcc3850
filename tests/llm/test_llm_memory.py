"""What the driver holds of a fitted toxicity model."""

import gc
import re
from pathlib import Path

import numpy as np

from permea.llm import toxicity
from permea.llm.common import release_memory


def test_plan_of_scores_holds_no_model(spark):
    """The result's plan lives as long as the next stage works; the model must not."""
    docs = spark.createDataFrame([(i, f"bad{i % 3} word{i}" if i % 2 else f"good{i % 3} word{i}") for i in range(40)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    kept = toxicity.keep_clean(docs, labels, toxicity.hash_mod("doc_id") != 0)
    gc.collect()
    assert not [o for o in gc.get_objects() if isinstance(o, (toxicity.Model, toxicity.Index, toxicity.Vocabulary))]
    assert {r.doc_id for r in kept.collect()} == set(range(0, 40, 2))


def _anonymous_mb() -> float:
    return int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def test_freed_memory_goes_back():
    """Arrays under the C library's mapping limit are freed into its heap, which keeps them under one that is alive."""
    held = [np.ones(60_000 // 8) for _ in range(2000)]
    last = np.ones(60_000 // 8)
    full = _anonymous_mb()
    del held
    release_memory()
    assert _anonymous_mb() < full - 80
    assert last.sum() == 60_000 // 8


def test_evidence_by_parts(monkeypatch):
    rng = np.random.default_rng(3)
    ends = np.cumsum(rng.integers(1, 9, 200))
    example = rng.integers(0, 50, ends[-1])
    toxic, weight = rng.random(50) < 0.4, rng.random(50)
    whole = toxicity.evidence_of(ends, example, toxic, weight)
    monkeypatch.setattr(toxicity, "PART", 7)
    assert np.array_equal(toxicity.evidence_of(ends, example, toxic, weight), whole)
    assert toxicity.evidence_of(np.zeros(0, np.int64), np.zeros(0, np.int64), toxic, weight).size == 0
    starts = np.append(0, ends[:-1])
    n = np.add.reduceat(weight[example], starts)
    a = np.add.reduceat((weight * toxic)[example], starts)
    p = (weight * toxic).sum() / weight.sum()
    rest = np.maximum(n - a, 1e-9)
    expected = 2 * (np.where(a > 1e-9, a * np.log(np.maximum(a, 1e-9) / (n * p)), 0)
                    + np.where(n - a > 1e-9, (n - a) * np.log(rest / (n * (1 - p))), 0))
    assert np.allclose(whole, np.where(a > n * p, np.maximum(expected, 0), 0))
