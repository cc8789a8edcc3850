"""Near-duplicate classes by MinHash with tensored banding.

A document's set is its distinct two-word shingles.  Instead of one band of
minima for each table, ``HALVES`` small collections of ``ROWS`` minima (half-bands)
are computed, and every pair of two of them is a table key: HALVES * ROWS minima
(150) serve HALVES * (HALVES - 1) / 2 tables (435) of 2 * ROWS rows, where a band
for each table would take 4350.  At the threshold of 0.8 a pair shares a key with
probability 0.9999.

Copies with equal sets are one class from the start.  The classes' keys meet in
hash buckets (a run of classes sends a key at most twice, so a key that a third of
all classes has stays small), which link every class to the smallest of its
key.  These candidates are confirmed on full sets.  A key may still hold classes
that are not connected: their families are compared again, in blocks of
bounded size, every class outside a family's largest component against all of
the family that share a key with it.  Every pair that shares a key is so either
confirmed, refuted, or inside one component; nothing is capped.

Defined cases: NULL text and text without words has the empty set and is linked
with nothing; one word is the only element of its set; a NULL id is ignored for
the smallest id, and a component without any id has a NULL id and is not kept;
repeated rows share a component; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permea.llm.common import mix64, slices, space_words, word_hash
from permea.session import materialize

HALVES, ROWS, PERCENT = 30, 5, 80
BUCKET_KEYS, RUN = 700_000, 1536
BLOCK_BYTES, CENTRE_BYTES = 2 << 20, 1 << 19
_WIDE = np.uint16(1 << 15)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle numbers (54 bits) of each text, and row offsets;
    at most 1,024 texts."""
    flat, off = space_words(texts)
    h, n = word_hash(flat), len(off) - 1
    sizes = np.diff(off)
    row = np.repeat(np.arange(n), np.maximum(sizes - 1, 0))
    at = _firsts(off, sizes)
    ids = mix64(h[at] * np.uint64(3) + mix64(h[np.minimum(at + 1, max(len(h) - 1, 0))])) if len(at) else np.zeros(0, np.uint64)
    single = np.flatnonzero(sizes == 1)
    row = np.concatenate([row, single])
    ids = np.concatenate([ids, mix64(h[off[:-1][single]] ^ np.uint64(0xA5A5A5A5A5A5A5A5))])
    packed = np.sort((row.astype(np.uint64) << np.uint64(54)) | (ids >> np.uint64(10)))
    if len(packed):
        packed = packed[np.append(True, packed[1:] != packed[:-1])]
    ends = np.searchsorted(packed, np.arange(n + 1, dtype=np.uint64) << np.uint64(54)) if n < 1024 else \
        np.append(np.searchsorted(packed, np.arange(n, dtype=np.uint64) << np.uint64(54)), len(packed))
    return packed & np.uint64((1 << 54) - 1), ends.astype(np.int64)


def _firsts(off: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all words that have a successor in their text."""
    keep = np.ones(int(off[-1]), bool)
    keep[off[1:][sizes > 0] - 1] = False
    return np.flatnonzero(keep)


def _draws(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003))
    return x[:n], x[n:] | np.uint64(1)


def half_bands(ids: np.ndarray, ends: np.ndarray, halves: int = HALVES, rows: int = ROWS) -> np.ndarray:
    """(texts with a set, halves): the half-band hashes."""
    starts = ends[:-1][ends[:-1] < ends[1:]]
    out = np.zeros((len(starts), halves), np.uint64)
    if not len(starts):
        return out
    flip, times = _draws(halves * rows, 1)
    for k in range(halves * rows):
        least = np.minimum.reduceat((ids ^ flip[k]) * times[k], starts)
        out[:, k // rows] = mix64(out[:, k // rows] + least + np.uint64(k))
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, halves: int, rows: int) -> DataFrame:
    """doc_id, tkey, n_shingles, a, b (a digest of the set) and its half-bands."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .withColumn("tkey", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for at in range(0, part.num_rows, 1023):
                    some = part.slice(at, 1023)
                    ids, ends = shingle_sets(some.column("text"))
                    n = np.diff(ends)
                    has = np.flatnonzero(n)
                    a, b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                    if len(has):
                        a[has] = np.add.reduceat(mix64(ids), ends[:-1][has])
                        b[has] = np.add.reduceat(mix64(ids + np.uint64(1 << 60)), ends[:-1][has])
                    bands = half_bands(ids, ends, halves, rows)
                    held = np.zeros(len(n) + 1, np.int32)
                    held[1:] = np.cumsum(n > 0) * halves
                    yield pa.RecordBatch.from_arrays(
                        [some.column("doc_id"), some.column("tkey"), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                         pa.ListArray.from_arrays(pa.array(held), pa.array(bands.ravel().view(np.int64)))],
                        ["doc_id", "tkey", "n_shingles", "a", "b", "bands"])

    return base.mapInArrow(run, "doc_id long, tkey long, n_shingles long, a long, b long, bands array<long>")


def _tables(halves: int) -> int:
    return halves * (halves - 1) // 2


def _keys(bands: np.ndarray, halves: int) -> np.ndarray:
    """(classes, tables): the tensored keys, 48 bits."""
    i, j = np.triu_indices(halves, 1)
    table = mix64(np.arange(len(i), dtype=np.uint64) + np.uint64(77))
    return mix64(bands[:, i] ^ (bands[:, j] * np.uint64(0x9E3779B97F4A7C15)) ^ table) >> np.uint64(16)


def _bands(column: pa.Array, halves: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().view(np.uint64).reshape(len(column), halves)


_PAIR = np.dtype([("child", "<i8"), ("parent", "<i8"), ("n", "<i4"), ("wide", "?")])


def _packed(child: np.ndarray, parent: np.ndarray, n: np.ndarray, wide: np.ndarray, parts: int) -> pa.Table:
    """Pairs as one binary for each part of the children."""
    rows = np.empty(len(child), _PAIR)
    rows["child"], rows["parent"], rows["n"], rows["wide"] = child, parent, n, wide
    part = (mix64(child.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    full = [k for k in range(parts) if ends[k] < ends[k + 1]]
    return pa.table({"part": pa.array(full, pa.int32()),
                     "pairs": pa.array([rows[order[ends[k]:ends[k + 1]]].tobytes() for k in full], pa.binary())})


def star_pairs(nodes: DataFrame, halves: int) -> DataFrame:
    """child, parent, n (keys), wide (whether a key has a third class): each class with
    the smallest class of its keys, in its run and among the runs."""
    buckets = max(1, math.ceil(nodes.count() * _tables(halves) / BUCKET_KEYS))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, RUN):
                part = batch.slice(at, RUN)
                node = np.sort(part.column("node").to_numpy())
                turn = np.argsort(part.column("node").to_numpy())
                key = _keys(_bands(part.column("bands"), halves)[turn], halves).ravel()
                who = np.repeat(np.arange(len(node)), _tables(halves))
                # By bucket and key; in a key the smallest class comes first.
                order = np.argsort(key, kind="stable")
                key, who = key[order], who[order]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                size = np.diff(np.append(first, len(key)))
                rank = np.arange(len(key)) - np.repeat(first, size)
                large = np.repeat(size > 2, size)
                child = large & (rank > 0)
                pairs = np.unique((who[child] << 16) | np.repeat(who[first], size)[child])
                sent = ~child
                mark = who[sent].astype(np.uint16) | np.where(large[sent], _WIDE, np.uint16(0))
                key = key[sent]
                bucket = (key % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                key, mark, ends = key[order], mark[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
                out: dict[str, list] = {"bucket": [], "keys": [], "marks": [], "nodes": [], "pairs": []}
                for b in range(buckets):
                    k, m = key[ends[b]:ends[b + 1]], mark[ends[b]:ends[b + 1]]
                    if not len(k):
                        continue
                    own, place = np.unique(m & ~_WIDE, return_inverse=True)
                    out["bucket"].append(b)
                    out["keys"].append(k.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                    out["marks"].append((place.astype(np.uint16) | (m & _WIDE)).astype("<u2").tobytes())
                    out["nodes"].append(node[own].astype("<i8").tobytes())
                    out["pairs"].append(b"" if out["pairs"] else np.stack([node[pairs >> 16], node[pairs & 0xFFFF]]).astype("<i8").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["bucket"], pa.int32()), *(pa.array(out[c], pa.binary()) for c in ("keys", "marks", "nodes", "pairs"))],
                    ["bucket", "keys", "marks", "nodes", "pairs"])

    def meet(group: pa.Table) -> pa.Table:
        keys, who, wide, pairs = [], [], [], [np.zeros((2, 0), np.int64)]
        for k, m, n, p in zip(*(group.column(c).to_pylist() for c in ("keys", "marks", "nodes", "pairs")), strict=True):
            full = np.zeros((len(k) // 6, 8), np.uint8)
            full[:, :6] = np.frombuffer(k, np.uint8).reshape(-1, 6)
            keys.append(full.view("<u8")[:, 0])
            m = np.frombuffer(m, "<u2")
            who.append(np.frombuffer(n, "<i8")[m & ~_WIDE])
            wide.append(m >= _WIDE)
            pairs.append(np.frombuffer(p, "<i8").reshape(2, -1))
        key, who, wide = np.concatenate(keys), np.concatenate(who), np.concatenate(wide)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        many = np.flatnonzero(np.repeat(size > 1, size))
        who, wide = who[order][many], wide[order][many]
        size = size[size > 1]
        first = np.cumsum(size) - size
        least = np.repeat(np.minimum.reduceat(who, first), size) if len(first) else who
        wide = np.repeat((size > 2) | np.logical_or.reduceat(wide, first), size) if len(first) else wide
        own = who != least
        near = np.concatenate(pairs, axis=1)
        child, parent = np.concatenate([who[own], near[0]]), np.concatenate([least[own], near[1]])
        wide = np.concatenate([wide[own], np.ones(near.shape[1], bool)])
        order = np.lexsort((parent, child))
        child, parent, wide = child[order], parent[order], wide[order]
        new = np.append(True, (child[1:] != child[:-1]) | (parent[1:] != parent[:-1])) if len(child) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        return _packed(child[start], parent[start], np.diff(np.append(start, len(child))),
                       np.logical_or.reduceat(wide, start) if len(start) else np.zeros(0, bool), buckets)

    def merge(group: pa.Table) -> pa.Table:
        found = np.concatenate([np.frombuffer(x, _PAIR) for x in group.column("pairs").to_pylist()])
        found = found[np.lexsort((found["parent"], found["child"]))]
        start = np.flatnonzero(np.append(True, (found["child"][1:] != found["child"][:-1]) | (found["parent"][1:] != found["parent"][:-1])))
        return pa.table({"child": found["child"][start], "parent": found["parent"][start],
                         "n": np.add.reduceat(found["n"].astype(np.int64), start), "wide": np.logical_or.reduceat(found["wide"], start)})

    sent = nodes.select("node", "bands").mapInArrow(send, "bucket int, keys binary, marks binary, nodes binary, pairs binary")
    # A true pair shares keys of many buckets: their counts travel packed, by the child.
    met = sent.groupBy("bucket").applyInArrow(meet, "part int, pairs binary")
    return met.groupBy("part").applyInArrow(merge, "child long, parent long, n long, wide boolean")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _sets(texts: pa.Array) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for at in range(0, len(texts), 1023):
        ids, ends = shingle_sets(texts.slice(at, 1023))
        out += np.split(ids, ends[1:-1])
    return out


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets are similar."""
    one = lambda c: texts.select(F.col("node").alias(c), F.col("n").alias("n" + c), F.col("text").alias("t" + c))
    rows = pairs.join(one("x"), "x").join(one("y"), "y") \
        .filter((100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))).select("x", "y", "tx", "ty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "tx"):
                sets = [dict(zip(ids.tolist(), _sets(pa.chunked_array([t]).combine_chunks()), strict=True))
                        for ids, t in ((part.column(c).to_numpy(), part.column("t" + c)) for c in "xy")]
                x, y = part.column("x").to_pylist(), part.column("y").to_pylist()
                good = pa.array([_similar(sets[0][a], sets[1][b], percent) for a, b in zip(x, y, strict=True)], pa.bool_())
                yield part.select(["x", "y"]).filter(good)

    return rows.mapInArrow(run, "x long, y long")


def components(edges: DataFrame) -> DataFrame:
    """v, label (the smallest v reachable) of all ends of edges (x, y)."""
    both = materialize(edges.select("x", "y").union(edges.select("y", "x")).filter("x <> y").distinct(), "cc-edges")
    labels = materialize(both.groupBy(F.col("x").alias("v")).agg(F.least(F.min("y"), F.first("x")).alias("label")), "cc-labels")
    while True:
        near = both.join(labels, both.y == labels.v).groupBy(F.col("x").alias("w")).agg(F.min("label").alias("best"))
        step = labels.join(near, labels.v == near.w).select("v", F.col("label").alias("old"), F.least("label", "best").alias("to"))
        jump = labels.select(F.col("v").alias("u"), F.col("label").alias("further"))
        step = materialize(step.join(jump, step["to"] == jump["u"], "left").select(
            "v", "old", F.coalesce(F.least("to", "further"), F.col("to")).alias("label")), "cc-step")
        changed = not step.filter("old <> label").isEmpty()
        labels = step.select("v", "label")
        if not changed:
            return labels


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Component labels (node, comp) after further links (x, y) between nodes."""
    ends = links.join(labels.select(F.col("node").alias("x"), F.col("comp").alias("cx")), "x") \
        .join(labels.select(F.col("node").alias("y"), F.col("comp").alias("cy")), "y")
    merged = components(ends.select(F.col("cx").alias("x"), F.col("cy").alias("y")))
    return labels.join(merged, labels.comp == merged.v, "left").select("node", F.coalesce("label", "comp").alias("comp"))


def compare_families(labels: DataFrame, star: DataFrame, texts: DataFrame, bands: DataFrame, percent: int, halves: int) -> DataFrame:
    """Links (x, y) between components that share a key of three classes or more."""
    ends = star.filter("wide").join(labels.select(F.col("node").alias("child"), F.col("comp").alias("x")), "child") \
        .join(labels.select(F.col("node").alias("parent"), F.col("comp").alias("y")), "parent").filter("x <> y")
    family = components(ends.select("x", "y"))
    members = labels.join(family, labels.comp == family.v).select("node", "comp", F.col("label").alias("family")) \
        .join(texts, "node").join(bands.select("node", "bands"), "node")
    members = materialize(members, "dedup-members")
    sizes = members.groupBy("family", "comp").agg(F.count("*").alias("k"), F.sum(F.length("text")).alias("bytes"))
    plan = sizes.groupBy("family").agg(F.max_by("comp", F.struct("k", "comp")).alias("largest"), F.sum("bytes").alias("bytes"),
                                       (F.sum("bytes") - F.max_by("bytes", F.struct("k", "comp"))).alias("outside")) \
        .select("family", "largest", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int").alias("subs"),
                F.ceil(F.col("outside") / CENTRE_BYTES).cast("int").alias("parts"))
    rows = members.join(plan, "family")
    where = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.greatest(n, F.lit(1))).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1))
    cols = ["family", "part", "sub", "centre", "node", "comp", "text", "bands"]
    centres = rows.filter("comp <> largest").withColumn("part", where(F.col("parts"), 1)).withColumn("sub", spread(F.col("subs"))) \
        .withColumn("centre", F.lit(True)).select(cols)
    others = rows.withColumn("sub", where(F.col("subs"), 2)).withColumn("part", spread(F.col("parts"))) \
        .withColumn("centre", F.lit(False)).select(cols)

    def compare(group: pa.Table) -> pa.Table:
        node, comp = group.column("node").to_numpy(), group.column("comp").to_numpy()
        centre = group.column("centre").to_numpy(zero_copy_only=False)
        sets, bands_ = _sets(group.column("text").combine_chunks()), _bands(group.column("bands"), halves)
        size = np.array([len(s) for s in sets])
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while c in parent:
                c = parent[c]
            return c

        mine, rest = np.flatnonzero(centre), np.flatnonzero(~centre)
        links = []
        for i in mine.tolist():
            same = bands_[rest] == bands_[i]
            near = rest[(same.sum(1) > 1) & (comp[rest] != comp[i])
                        & (100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i]))]
            for j in near.tolist():
                a, b = root(int(comp[i])), root(int(comp[j]))
                if a != b and _similar(sets[i], sets[j], percent):
                    parent[max(a, b)] = min(a, b)
                    links.append((node[i], node[j]))
        return pa.table({"x": pa.array([a for a, _ in links], pa.int64()), "y": pa.array([b for _, b in links], pa.int64())})

    return centres.unionByName(others).groupBy("family", "part", "sub").applyInArrow(compare, "x long, y long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", halves: int = HALVES,
                    rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row, and its text's key (tkey)."""
    sig = materialize(signatures(docs, id_col, text_col, halves, rows), "dedup-signatures")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey"))
    nodes = sig.filter("n_shingles > 0").groupBy("a", "b", F.col("n_shingles").alias("n")).agg(
        best.alias("r"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "a", "b", "n", F.col("r.doc_id").alias("rep"),
                                     F.col("r.tkey").alias("tkey"), "bands"), "dedup-nodes")
    star = materialize(star_pairs(nodes, halves), "dedup-star")
    named = nodes.select("node", "rep")
    if not star.isEmpty():
        ends = star.select(F.col("child").alias("node")).union(star.select("parent")).distinct()
        wanted = materialize(nodes.join(ends, "node").select("node", "n", "rep", "tkey"), "dedup-wanted")
        body = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        # The candidates grow with the corpus: always by shuffle, never by broadcast.
        texts = body.join(wanted.hint("merge"), body.doc_id.eqNullSafe(wanted.rep) & (F.xxhash64(body.text) == wanted.tkey))
        texts = materialize(texts.select("node", "n", "text").dropDuplicates(["node"]), "dedup-texts")
        turn = Window.partitionBy("child").orderBy(F.desc("n"), "parent")
        pairs = star.withColumn("turn", F.row_number().over(turn)).filter("not wide or turn <= 3") \
            .select(F.col("child").alias("x"), F.col("parent").alias("y"))
        links = materialize(confirm(pairs, texts, percent), "dedup-links")
        labels = wanted.select("node", F.col("node").alias("comp"))
        labels = materialize(_relabel(labels, links), "dedup-labels")
        more = materialize(compare_families(labels, star, texts, nodes, percent, halves), "dedup-more")
        labels = materialize(_relabel(labels, more), "dedup-labels")
        least = labels.join(named, "node").groupBy("comp").agg(F.min("rep").alias("least"))
        named = named.join(labels.join(least, "comp").select("node", "least"), "node", "left") \
            .select("node", F.when(F.col("least").isNotNull(), F.col("least")).otherwise(F.col("rep")).alias("rep"))
    ids = nodes.select("node", "a", "b", F.col("n").alias("n_shingles")).join(named, "node").drop("node") \
        .withColumnRenamed("rep", "component_id")
    out = sig.drop("bands").join(ids, ["a", "b", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "tkey")


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component (its smallest id; of rows that repeat that id
    one), and all documents with an empty set or without an id, with their own columns."""
    found = near_duplicates(docs, percent, id_col, text_col)
    keep = materialize(found.filter("kept").groupBy("doc_id").agg(F.count("*").alias("times"), F.min("tkey").alias("tkey")), "dedup-kept")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                       F.xxhash64(F.col(text_col).cast("string")).alias("tkey"))
    joined = rows.join(keep, ["doc_id", "tkey"])
    several = joined.filter("times > 1").groupBy("doc_id").agg(F.first("row").alias("row"))
    whole = joined.filter("times = 1").select("row").unionByName(several.select("row"))
    return whole.unionByName(rows.filter("doc_id is null").select("row")).select("row.*")


def op3_tensored_minhash(spark, sf_dir: str) -> DataFrame:
    from permea.llm.common import table
    return near_duplicates(table(spark, sf_dir, "documents")).drop("tkey")
