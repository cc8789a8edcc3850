"""Centres of op1 from all training texts; memory of op8's lists."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from permea.llm import lattice_lm, toxicity


def test_centres_from_all_texts(spark):
    """The plain k-means over every distinct text, more than a sample would hold."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [f"{letters[i % 26] * (1 + i % 17)} {letters[i * i % 23] * (i % 11)} {i}" for i in range(2600)]
    rows = spark.createDataFrame([(t,) for t in texts + texts[:50]] + [("",), (None,)], "text string").withColumn("learn", F.lit(True)).repartition(5)
    points = lattice_lm._histograms(rows).orderBy("key").collect()
    assert len(points) == len(set(texts)) > lattice_lm.SAMPLE
    plain = np.stack([np.frombuffer(r.p, np.float32) for r in points]).astype(float)
    got = lattice_lm.spread_centres(lattice_lm._histograms(rows).repartition(4).cache(), 8)
    assert np.allclose(got, lattice_lm.centres_of(plain, 8), atol=1e-9)
    few = lattice_lm.spread_centres(lattice_lm._histograms(rows.limit(3)), 8)
    assert len(few) <= 3
    assert lattice_lm.spread_centres(lattice_lm._histograms(rows.limit(0)), 8).shape == (1, 154)


def test_lists_weighed_in_parts(monkeypatch):
    """Small parts, also where they end with the lists, give the same vectors."""
    texts = pa.array([f"word{i % 7} other{i % 3} more{i}" for i in range(64)])
    terms, ends, example, times = toxicity.posting_lists(texts)
    idf = 1.0 + np.arange(len(terms)) % 5
    whole = toxicity.Index(ends, example, times, idf, len(texts))
    for part in (1, 7, len(example), len(example) // 2):
        monkeypatch.setattr(toxicity, "PART", part)
        some = toxicity.Index(ends, example, times, idf, len(texts))
        assert (some.vectors.weight == whole.vectors.weight).all() and (some.order == whole.order).all()
    norm = np.sqrt(np.bincount(example, ((1 + np.log(times)) * np.repeat(idf, np.diff(np.append(0, ends))))**2))
    assert np.bincount(example, whole.vectors.weight.astype(float)**2) == pytest.approx(np.ones(64), rel=1e-5) and (norm > 0).all()
    monkeypatch.setattr(toxicity, "READ_BYTES", 100)
    again = toxicity.posting_lists(texts)
    assert all((a == b).all() for a, b in zip(again, (terms, ends, example, times), strict=True))


def test_a_pass_over_histograms_has_no_more_tasks_than_they_fill(spark, monkeypatch):
    """A table written in many small files is read by a task a core: each task sends sums of every centre and letter."""
    rng = np.random.default_rng(5)
    p = rng.random((300, len(lattice_lm._LETTERS))).astype(np.float32)
    points = spark.createDataFrame([(i, bytes(x.tobytes())) for i, x in enumerate(p)], "key long, p binary").repartition(97)
    tasks, plain = [], type(points).mapInArrow

    def counted(self, *args, **kw):
        tasks.append(self.rdd.getNumPartitions())
        return plain(self, *args, **kw)

    monkeypatch.setattr(type(points), "mapInArrow", counted)
    got = lattice_lm.spread_centres(points, 3, rounds=2)
    assert tasks and max(tasks) <= spark.sparkContext.defaultParallelism
    assert np.allclose(got, lattice_lm.centres_of(p.astype(float), 3, rounds=2))


def test_a_lean_function_gives_back_memory_after_each_group(monkeypatch):
    from permea.llm import common
    done = []
    monkeypatch.setattr(common, "release_memory", lambda: done.append("freed"))
    assert common.lean(lambda group: group + 1)(1) == 2
    assert common.lean(lambda left, right: left - right)(3, 1) == 2
    assert done == ["freed", "freed"]
