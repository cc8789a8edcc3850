"""Toxicity from the nearest labelled examples by exact cosine of weighted TF-IDF vectors.

Fit, on a bounded sample (``n_toxic`` and ``n_clean`` labelled rows at most,
of texts of at most ``example_bytes``): terms are words and their first 5
bytes, and all terms of the examples are indexed.  A term weighs its idf,
with document frequencies counted over all documents, times 1 + the root of the
likelihood ratio with which it goes with the toxic label (0 if it does not), so
no term is left out and those that tell the classes apart say most.  The unit
vectors of the examples stand in an inverted index.  The lists of all but the ``HEAD``
commonest terms are short and are added up at once.  The long lists are cut in blocks of
``BLOCK`` examples (alike ones side by side) that keep each term's greatest weight: a
query's weights times these maxima, plus the block's best sum of short lists, bound
the cosines of a block.  The blocks of the highest bounds give a kth cosine, and a block
whose bound is below it is skipped.  Single precision only picks candidates, whose
cosines are summed again in double precision, so the neighbours are exact.  Their votes, weighted by the squared cotangent of the
angle (a copy outvotes all that are merely alike) and by what each class was
sampled down, are calibrated by isotonic regression on the examples, each left
out of its own vote.  Every document is scored on its whole text.

Defined cases: NULL or empty text, and text without a term of any example, has no
neighbour and gets the share of toxic rows among examples without one; a NULL
label or id teaches nothing; without labelled rows every score is 0;
every row gives one row, and repeated rows the same score; an id that repeats in
the labels counts once for each distinct label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permea.llm.common import LOWER, hash_mod, mix64, release_memory, row_schema, slices, some_of, span_hash, text_of, utf8, with_row

N_TOXIC, N_CLEAN, EXAMPLE_BYTES = 2500, 6500, 16384
HASH_PARTS = 8
K, HEAD, QUERIES, BLOCK = 15, 1024, 128, 32
#: Entries of the lists that are weighed at once, bytes of the examples that are read at once.
PART, READ_BYTES = 1 << 18, 1 << 19
#: Bytes of text that are scored together.
SCORE_BYTES = 1 << 20
#: More than the rounding of a sum of HEAD products in single precision.
MARGIN = 2e-4
PREFIX = 5

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each term of each word."""
    raw, off = utf8(texts)
    raw = LOWER[raw]
    inside = _LETTER[raw]
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    full = off[:-1] < off[1:]
    before[off[:-1][full]] = False
    after[off[1:][full] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(off, starts, "right") - 1
    sizes = ends - starts
    long = sizes > PREFIX
    return (np.concatenate([row, row[long]]),
            span_hash(raw, np.concatenate([starts, starts[long]]), np.concatenate([ends, starts[long] + PREFIX])))


class Vocabulary:
    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        # Where the terms of each value of the upper 20 bits start.
        self.first = np.searchsorted(self.hashes >> np.uint64(44), np.arange((1 << 20) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each term, -1 for those of no example."""
        slot = (h >> np.uint64(44)).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        out = np.full(len(h), -1, np.int64)
        live = np.flatnonzero(at < end)
        at, end, h = at[live], end[live], h[live]
        while len(live):
            same = self.hashes[at] == h
            out[live[same]] = at[same]
            at = at + 1
            on = ~same & (at < end)
            live, at, end, h = live[on], at[on], end[on], h[on]
        return out

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, times) of the terms of the vocabulary, by row and term."""
        row, h = term_hashes(texts)
        at = self.find(h)
        some = at >= 0
        if not some.any():
            return (np.zeros(0, np.int64),) * 3
        pair, times = np.unique(row[some] * len(self.hashes) + at[some], return_counts=True)
        return pair // len(self.hashes), pair % len(self.hashes), times


def _read(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(place of the first, texts): about ``READ_BYTES`` at a time."""
    at = 0
    for part in slices(pa.table({"text": texts}), "text", READ_BYTES) if len(texts) else ():
        yield at, part.column("text").combine_chunks()
        at += part.num_rows


def copy_weights(texts: pa.Array, tries: int = 4) -> np.ndarray:
    """1 / size of each example's group of near copies, which would otherwise vote
    for all of their words: examples that share three minima of the hashes of
    their long words, in one of ``tries`` draws."""
    n = len(texts)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    minima = np.full((3 * tries, n), np.iinfo(np.uint64).max, np.uint64)
    for at, part in _read(texts):
        row, h = term_hashes(part)
        for j in range(3 * tries):
            np.minimum.at(minima[j], at + row, mix64(h + np.uint64(j * 0x9E3779B97F4A7C15 % 2**64)))
    for j in range(0, 3 * tries, 3):
        key = mix64(minima[j]) + mix64(minima[j + 1] + np.uint64(1)) + mix64(minima[j + 2] + np.uint64(2))
        order = np.argsort(key, kind="stable")
        for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
            if key[a] == key[b]:
                parent[root(a)] = root(b)
    roots = np.array([root(i) for i in range(n)], np.int64)
    return 1.0 / np.bincount(roots, minlength=max(n, 1))[roots]


def posting_lists(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all terms of the examples, ascending, where each one's list ends,
    and the lists: example and times."""
    # By parts of the terms, each given up once it is in order, to bound memory.
    found: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(HASH_PARTS)]
    for at, part in _read(texts):
        row, h = term_hashes(part)
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        h, example, n = h[first], (at + row[first]).astype(np.int32), np.diff(np.append(first, len(h))).astype(np.int32)
        share = h // np.uint64(2**64 // HASH_PARTS)
        for i in range(HASH_PARTS):
            own = np.flatnonzero(share == i)
            found[i].append((h[own], example[own], n[own]))
    terms, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    examples, times = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for i in range(HASH_PARTS):
        h, example, n = (np.concatenate([x[j] for x in found[i]] or [np.zeros(0, np.uint64)]) for j in range(3))
        found[i] = []
        order = np.argsort(h, kind="stable")
        each, size = np.unique(h[order], return_counts=True)
        terms.append(each)
        sizes.append(size)
        examples.append(example[order].astype(np.int32))
        times.append(n[order].astype(np.int32))
    return np.concatenate(terms), np.cumsum(np.concatenate(sizes)), np.concatenate(examples), np.concatenate(times)


def _spans(ends: np.ndarray) -> list[tuple[slice, slice]]:
    """(terms, their entries) of about ``PART`` entries: in double precision all of the lists
    would be held several times over."""
    total = int(ends[-1]) if len(ends) else 0
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, total, PART)), len(ends)))
    return [(slice(a, b), slice(int(ends[a - 1]) if a else 0, int(ends[b - 1]))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def evidence_of(ends: np.ndarray, example: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Likelihood ratio of each term's document counts, in which a group of near
    copies counts once, for the terms that go with the toxic label; else 0."""
    if not len(ends):
        return np.zeros(0)
    p = float((weight * toxic).sum() / weight.sum())
    part = lambda x, e: np.where(x > 1e-9, x * np.log(np.maximum(x, 1e-9) / e), 0.0)
    a, n = np.empty(len(ends)), np.empty(len(ends))
    for term, some in _spans(ends):
        starts = np.append(some.start, ends[term][:-1]) - some.start
        for out, each in ((a, weight * toxic), (n, weight)):
            out[term] = np.add.reduceat(each[example[some]], starts)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (part(a, n * p) + part(n - a, n * (1 - p)))
    return np.where(a > n * p, np.maximum(ratio, 0), 0.0)


class Vectors:
    """The examples' unit vectors as posting lists."""

    def __init__(self, ends: np.ndarray, example: np.ndarray, weight: np.ndarray, some: np.ndarray, n: int):
        self.starts, self.ends, self.example, self.weight, self.some, self.n = np.append(0, ends[:-1]), ends, example, weight, some, n

    def sums(self, term: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Products with a query of weights ``w``, of every example."""
        if not len(term):
            return np.zeros(self.n)
        spans = list(zip(self.starts[term].tolist(), self.ends[term].tolist(), strict=True))
        weight = np.concatenate([self.weight[a:b] for a, b in spans]) * np.repeat(w, self.ends[term] - self.starts[term])
        return np.bincount(np.concatenate([self.example[a:b] for a, b in spans]), weight, minlength=self.n)

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        term = np.flatnonzero(w)
        return self.sums(term, w[term])[self.some]


class Index:
    """Posting lists of the examples' unit vectors, those of the commonest terms as a matrix.
    ``idf``: the weight of each term."""

    def __init__(self, ends: np.ndarray, example: np.ndarray, times: np.ndarray, idf: np.ndarray, n: int):
        sizes = np.diff(np.append(0, ends))
        spans = _spans(ends)

        def weights(term: slice, some: slice) -> np.ndarray:
            return (1 + np.log(times[some])) * np.repeat(idf[term], sizes[term])

        square = np.zeros(n)
        for term, some in spans:
            np.add.at(square, example[some], weights(term, some)**2)
        norm = np.sqrt(square)
        self.idf, self.example = idf, np.flatnonzero(norm > 0)
        weight = np.empty(len(example), np.float32)
        for term, some in spans:
            weight[some] = weights(term, some) / norm[example[some]]
        self.vectors = Vectors(ends, example, weight, self.example, n)
        common = np.argsort(-sizes, kind="stable")[:HEAD]
        self.place = np.full(len(idf), -1, np.int16)
        self.place[common] = np.arange(len(common))
        self.order = np.arange(n)
        self.blocks = np.arange(0, n, BLOCK)
        self._head: np.ndarray | None = None
        self.skipped = self.seen = 0
        if n:
            pivots = self.head[:n:max(1, n // 64)]
            self.order = np.lexsort((np.arange(n), (self.head[:n] @ pivots.T).argmax(axis=1)))  # alike ones side by side
            self._head = None
        self.at = np.empty(n, np.int64)
        self.at[self.order] = np.arange(n)
        self.maxima = np.ascontiguousarray(self.head.reshape(len(self.blocks), BLOCK, len(common)).max(axis=1).T)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_head": None}  # each task makes its own

    @property
    def head(self) -> np.ndarray:
        """Weights of the commonest terms in each example, these in the order of the blocks (the last one filled up)."""
        if self._head is None:
            v, common = self.vectors, np.flatnonzero(self.place >= 0)
            at = np.empty(v.n, np.int64)
            at[self.order] = np.arange(v.n)
            self._head = np.zeros((len(self.blocks) * BLOCK, len(common)), np.float32)
            for t in common.tolist():
                some = slice(v.starts[t], v.ends[t])
                self._head[at[v.example[some]], self.place[t]] = v.weight[some]
        return self._head

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int,
               without: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each query (terms, times): examples and cosines of the k nearest, nearest
        first, ties to the earlier example.  ``skipped`` of ``seen`` blocks were not looked at."""
        head, n = self.head, self.vectors.n
        if not n:
            yield from ((np.zeros(0, np.int64), np.zeros(0)) for _ in queries)
            return
        ends = np.append(self.blocks[1:], n)
        first = min(len(self.blocks), -(-k // BLOCK) + 1)
        for begin in range(0, len(queries), QUERIES):
            some = queries[begin:begin + QUERIES]
            dense, parts, rare = np.zeros((len(some), head.shape[1]), np.float32), [], np.zeros((len(some), n))
            for i, (term, times) in enumerate(some):
                w = (1 + np.log(times)) * self.idf[term]
                w = w / np.sqrt(w @ w)
                place = self.place[term]
                common = place >= 0
                dense[i, place[common]] = w[common]
                parts.append((place[common], w[common]))
                rare[i] = self.vectors.sums(term[~common], w[~common])[self.order]
                if without is not None:
                    rare[i, self.at[without[begin + i]]] = -10.0
            bound = dense @ self.maxima + np.maximum.reduceat(rare, self.blocks, axis=1)
            score = np.full(rare.shape, -np.inf)
            tops = np.argpartition(-bound, first - 1, axis=1)[:, :first]
            wanted = np.zeros(bound.shape, bool)
            for i in range(len(some)):
                cols = np.concatenate([np.arange(self.blocks[b], ends[b]) for b in tops[i]])
                for b in tops[i]:
                    own = slice(self.blocks[b], ends[b])
                    score[i, own] = rare[i, own] + head[own] @ dense[i]
                kth = np.partition(score[i, cols], -k)[-k] if len(cols) >= k else 0.0
                wanted[i] = bound[i] >= max(kth, 0.0) - MARGIN
                wanted[i, tops[i]] = False
            for b in np.flatnonzero(wanted.any(axis=0)):
                who, own = np.flatnonzero(wanted[:, b]), slice(self.blocks[b], ends[b])
                score[who, own] = rare[who, own] + dense[who] @ head[own].T
            self.seen += bound.size
            self.skipped += bound.size - int(wanted.sum()) - tops.size
            for i, (place, w) in enumerate(parts):
                least = np.partition(score[i], -k)[-k] if n > k else 0.0
                at = np.flatnonzero((score[i] >= max(least, 0.0) - MARGIN) & (score[i] > 0))
                # Rounded, so that equal texts tie whatever stands beside them in the product.
                exact = np.round(rare[i, at] + np.concatenate(
                    [head[np.ix_(at[a:a + 1000], place)].astype(float) @ w for a in range(0, len(at), 1000)] or [np.zeros(0)]), 12)
                example = self.order[at]
                order = np.lexsort((example, -exact))[:k]
                yield example[order], exact[order]

    def nearest(self, term: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return next(self.search([(term, times)], k))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic regression: thresholds and values of a rising step function."""
    order = np.argsort(x, kind="stable")
    steps: list[list[float]] = []  # start, weight, value
    for a, b, c in zip(x[order], y[order], w[order], strict=True):
        steps.append([a, c, b])
        while len(steps) > 1 and (steps[-2][2] >= steps[-1][2] or steps[-2][0] == steps[-1][0]):
            a2, w2, v2 = steps.pop()
            s = steps[-1]
            s[2] = (s[1] * s[2] + w2 * v2) / (s[1] + w2)
            s[1] += w2
    return np.array([s[0] for s in steps]), np.array([s[2] for s in steps])


class Model:
    """Votes of the nearest examples; ``weight``: how many rows an example of each class stands for."""

    def __init__(self, vocabulary: Vocabulary, index: Index, toxic: np.ndarray, weight: tuple[float, float], ids: list, k: int):
        self.vocabulary, self.index, self.k, self.ids = vocabulary, index, k, ids
        self.toxic, self.mass = toxic, np.where(toxic, weight[1], weight[0])
        has = np.zeros(len(toxic), bool)
        has[index.example] = True
        alone = self.mass[~has]
        self.none = float((alone * toxic[~has]).sum() + 0.5 * min(1.0, float(toxic.any()))) / (alone.sum() + 1.0) if len(toxic) else 0.0
        self.cut: tuple[np.ndarray, np.ndarray] | None = None

    def vote(self, at: np.ndarray, cosine: np.ndarray) -> float:
        square = np.minimum(cosine, 1.0)**2
        power = square / (1 + 1e-6 - square) * self.mass[at]
        return float((power * self.toxic[at]).sum() / power.sum())

    def calibrate(self, row: np.ndarray, term: np.ndarray, times: np.ndarray) -> tuple[list, list, list]:
        """Votes, labels and weights of some of the examples, each without its own vote."""
        x, y, w = [], [], []
        groups = list(_groups(row))
        found = self.index.search([(term[a:b], times[a:b]) for _, a, b in groups], self.k, [r for r, _, _ in groups])
        for (r, _, _), (at, cosine) in zip(groups, found, strict=True):
            if len(at):
                x.append(self.vote(at, cosine))
                y.append(float(self.toxic[r]))
                w.append(self.mass[r])
        return x, y, w

    def score(self, at: np.ndarray, cosine: np.ndarray) -> tuple[float, list]:
        if not len(at):
            return self.none, []
        raw = self.vote(at, cosine)
        if self.cut is not None:
            raw = float(self.cut[1][max(0, int(np.searchsorted(self.cut[0], raw, "right")) - 1)])
        return min(1.0, max(0.0, raw)), [self.ids[i] for i in at]

    def score_texts(self, texts: pa.Array) -> tuple[np.ndarray, list]:
        score, evidence = np.full(len(texts), self.none), [[] for _ in range(len(texts))]
        row, term, times = self.vocabulary.counts(texts)
        same: dict[bytes, list[int]] = {}
        queries = []
        for r, a, b in _groups(row):
            key = term[a:b].tobytes() + times[a:b].tobytes()
            if key not in same:
                queries.append((term[a:b], times[a:b]))
            same.setdefault(key, []).append(r)
        for rows, found in zip(same.values(), self.index.search(queries, self.k), strict=True):
            one = self.score(*found)
            for r in rows:
                score[r], evidence[r] = one
        return score, evidence


def _groups(row: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if not len(row):
        return
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(row)], strict=True):
        yield int(row[a]), a, b


def fit(docs: DataFrame, labels: DataFrame, learn: F.Column, n_toxic: int = N_TOXIC, n_clean: int = N_CLEAN, k: int = K,
        example_bytes: int = EXAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on labelled rows for which ``learn`` (of the id) holds: at most ``n_toxic`` and ``n_clean`` of
    them, whose texts have at most ``example_bytes`` (that bounds the index; documents of any length are scored whole)."""
    spark = docs.sparkSession
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & learn) \
        .select(F.col(id_col).alias("id"), (F.col(label_col) == 1).alias("toxic")).distinct()
    counts = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    key = F.xxhash64("id", F.lit(3))
    picked = [marks.filter((F.col("toxic") == y) & some_of(key, n, counts.get(y, 0))).orderBy(key, "id").limit(n)
              for y, n in ((True, n_toxic), (False, n_clean))]
    chosen = spark.createDataFrame([tuple(r) for p in picked for r in p.collect()], marks.schema)  # bounded by the arguments
    body = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = body.join(F.broadcast(chosen), "id").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= example_bytes)
    rows = sample.orderBy(key, "id", "text").limit(n_toxic + n_clean).toArrow()
    texts = rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string())
    toxic = rows.column("toxic").to_numpy().astype(bool) if rows.num_rows else np.zeros(0, bool)
    ids = rows.column("id").to_pylist() if rows.num_rows else []
    del rows  # the texts are a copy
    terms, ends, example, times = posting_lists(texts)
    vocabulary = Vocabulary(terms)
    del terms
    release_memory()
    n, df = document_frequencies(body, vocabulary)
    evidence = evidence_of(ends, example, toxic, copy_weights(texts))
    release_memory()
    index = Index(ends, example, times, (np.log((1 + n) / (1 + df)) + 1) * (1 + np.sqrt(evidence)), len(texts))
    weight = (counts.get(False, 0) / max(1, int((~toxic).sum())), counts.get(True, 0) / max(1, int(toxic.sum())))
    model = Model(vocabulary, index, toxic, weight, ids, k)
    votes: tuple[list, list, list] = ([], [], [])
    for at, part in _read(texts):
        row, term, uses = vocabulary.counts(part)
        for all_of, some in zip(votes, model.calibrate(row + at, term, uses), strict=True):
            all_of += some
    if votes[0]:
        model.cut = isotonic(*map(np.array, votes))
    return model


def document_frequencies(body: DataFrame, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """Number of all documents, and of those that hold each term."""
    # Sent as a file: as a part of the function it would be held by the driver's Python twice more.
    sent = body.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        df, n = np.zeros(len(vocabulary.hashes), np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                n += part.num_rows
                df += np.bincount(vocabulary.counts(part.column("text"))[1], minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], ["term", "n"])

    # One row for each term of the bounded sample, and the number of documents.
    got = body.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    sent.destroy()
    term, count = got.column("term").to_numpy(), got.column("n").to_numpy()
    df = np.zeros(len(vocabulary.hashes))
    df[term[term >= 0]] = count[term >= 0]
    return int(count[term < 0].sum()), df


def score_documents(docs: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """row (a struct of the columns ``keep``, default all), score and evidence (ids of the voters)."""
    rows = with_row(docs, keep or docs.columns, text_col)
    # Sent as a file: as a part of the function the driver's Python would hold it as long as the result's plan.
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_of(batch, text_col), SCORE_BYTES):
                score, evidence = sent.value.score_texts(text_of(part, text_col))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(score), pa.array([[str(i) for i in e] for e in evidence], pa.list_(pa.string()))],
                    ["row", "score", "evidence"])

    return rows.mapInArrow(run, f"{row_schema(rows)}, score double, evidence array<string>")


def keep_clean(docs: DataFrame, labels: DataFrame, learn: F.Column, threshold: float = 0.5, **options) -> DataFrame:
    """The documents that score below the threshold, with their own columns."""
    scored = score_documents(docs, fit(docs, labels, learn, **options))
    release_memory()
    return scored.filter(F.col("score") < threshold).select("row.*")


def op8_knn_toxicity(spark, sf_dir: str) -> DataFrame:
    from permea.llm.common import table
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score_documents(docs, fit(docs, labels, hash_mod("doc_id") != 0), ["doc_id"]).select("row.doc_id", "score", "evidence")
    release_memory()
    return out.select("doc_id", F.coalesce(hash_mod("doc_id") == 0, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
