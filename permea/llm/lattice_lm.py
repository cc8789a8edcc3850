"""Document probability from a lattice of whole words and existing subword pieces.

The pieces and their first scores come from an existing public vocabulary (its
order gives a Zipf score).  A word's subword probability is the sum over all of
its segmentations, by a forward recursion in log space over the word's lattice;
forward-backward passes over the distinct training words turn the first
scores into learned ones.  Whole training words are further edges of the
lattice, with discounted counts:

    P(word) = max(c - D, 0) / N + (D * V / N) * P_subword(word).

The texts come from ``COMPONENTS`` hidden components (say, languages), whose word
edges back off to that word probability (a share ``KNOWN``) and to the subwords
alone, since a word that is new to a component is mostly new to all:

    P_k(word) = max(c_k - D, 0) / N_k
                + (D * V_k / N_k) * (KNOWN * P(word) + (1 - KNOWN) * P_subword(word)),
    P(text) = sum over k of weight_k * product of (1 - P(end)) * P_k(word), times P(end).

So the score is the marginal over all segmentations and components, a proper
distribution over texts (as sequences of words).  Training texts are put in the
components by the nearest centre of their letter histograms; the centres are
found by k-means over all distinct training texts, in passes over their written histograms.

Counting is exact and spread over the cluster: documents are dealt in chunks,
each chunk sends its distinct words (with training counts) once to hash
buckets, the buckets add up and answer with the corpus counts.  A frequent word
costs one entry per chunk; nothing grows with the corpus on the driver but the
piece scores, whose number is the vocabulary's, and the centres.

Defined cases: NULL or empty text is the end alone; a NULL id is a training
row; repeated rows count as often as they stand; without training rows the
words have only their subword probability and the end has probability 1/2;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permea.llm.common import (LOWER, _power_tables, hash_mod, lean, mix64, slices, space_words, utf8, with_chunk,
                               word_hash)
from permea.session import materialize

CHUNK_BYTES, BUCKET_BYTES = 2 << 20, 8 << 20
DISCOUNT, KNOWN = 0.6, 0.1
#: ``SAMPLE``: histograms that are looked at outside Spark (``_sample_histograms``).
COMPONENTS, SAMPLE = 8, 2000
#: Histograms for each task of a k-means pass, once every core has a task.
POINTS = 50_000
#: Forward-backward passes of a bucket over its words (a random part of all, by hash); the buckets' last counts are summed.
PASSES = 3
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a tiktoken vocabulary file in its order: lower-cased, without the
    space of a word's start; all single bytes."""
    found: dict[bytes, None] = {}
    for line in open(path, "rb"):
        piece = base64.b64decode(line.split()[0]).lower()
        piece = piece[1:] if piece[:1] == b" " else piece
        if piece and not _SPACE[np.frombuffer(piece, np.uint8)].any():
            found[piece] = None
    found.update({bytes([b]): None for b in range(256) if not _SPACE[b]})
    return list(found)


def zipf_scores(n: int) -> np.ndarray:
    """Natural-log scores by rank, with a share for the word end (last)."""
    p = 1.0 / (np.arange(n) + 50.0)
    return np.log(np.append(p / p.sum() * 0.75, 0.25))


@lru_cache(1)
def _piece_tables(pieces: tuple[bytes, ...]) -> list[tuple]:
    """For each piece length that exists: the length, how many pieces a hash slot has, its
    first piece, the pieces' keys and numbers by slot, and the most of a slot."""
    sizes = np.array([len(p) for p in pieces])
    raw, off = utf8(pa.array(pieces, pa.binary()))
    keys = np.array([_key(raw[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)], np.uint64)
    tables = []
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        bits = min(20, len(own).bit_length() + 7)  # long pieces are few
        slot = _slot(keys[own], bits)
        own, slot = own[np.argsort(slot, kind="stable")], np.sort(slot)
        # Most substrings are no piece: this tells most of them.
        count = np.bincount(slot, minlength=1 << bits).astype(np.uint8)
        first = np.zeros(1 << bits, np.min_scalar_type(len(own)))
        first[slot[::-1]] = np.arange(len(slot))[::-1]
        tables.append((size, bits, count, first, keys[own], own, int(count.max())))
    return tables


class Lattice:
    """All segmentations of words into pieces; ``scores`` are natural logs, the
    last is that of the word's end.  Words of like length stand side by side in a
    matrix (byte, word), so a step of the recursion serves all of them at once."""

    def __init__(self, pieces: list[bytes], scores: np.ndarray):
        self.scores, self.n = scores, len(pieces)
        self.tables = _piece_tables(tuple(pieces))
        # The word's end is certain not to come first.
        self.end = float(scores[-1]) - math.log1p(-math.exp(float(scores[-1])))

    def _edges(self, block: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, words, pieces) of the pieces found, by start; ``sizes`` ascend."""
        longest, width = block.shape
        up, down = _power_tables(longest + 1)
        sums = np.zeros((longest + 1, width), np.uint64)
        np.cumsum(_BYTE[block] * up[:longest, None], axis=0, out=sums[1:])
        reach = np.searchsorted(sizes, np.arange(longest + 1))  # the first word of that many bytes
        for start in range(longest):
            for size, bits, count, first, keys, own, most in self.tables:
                end = start + size
                if end > longest:
                    break
                k = int(reach[end])
                key = (sums[end, k:] - sums[start, k:]) * down[start]
                slot = _slot(key, bits)
                hit = np.flatnonzero(count[slot])
                if not len(hit):
                    continue
                key, at = key[hit], first[slot[hit]].astype(np.int64)
                for r in range(most):
                    there = np.minimum(at + r, len(keys) - 1)
                    same = np.flatnonzero((keys[there] == key) & (at + r < len(keys)))
                    if len(same):
                        yield start, end, hit[same] + k, own[there[same]]

    def _forward(self, block: np.ndarray, sizes: np.ndarray, keep: bool = False):
        alpha = np.full((block.shape[0] + 1, len(sizes)), -np.inf)
        alpha[0] = 0.0
        edges = []
        for start, end, word, piece in self._edges(block, sizes):
            alpha[end, word] = np.logaddexp(alpha[end, word], alpha[start, word] + self.scores[piece])
            if keep:
                edges.append((start, end, word, piece))
        return alpha, edges

    def log_probability(self, words: pa.Array) -> np.ndarray:
        """Natural-log subword probability of each word."""
        out = np.empty(len(words))
        for at, block, sizes in _blocks(words):
            alpha, _ = self._forward(block, sizes)
            out[at] = alpha[sizes, np.arange(len(sizes))] + self.end
        return out

    def expected_counts(self, words: pa.Array) -> np.ndarray:
        """Expected number of uses of each piece over the segmentations of each word once."""
        out = np.zeros(self.n)
        for _, block, sizes in _blocks(words):
            alpha, edges = self._forward(block, sizes, True)
            column = np.arange(len(sizes))
            beta = np.full(alpha.shape, -np.inf)
            beta[sizes, column] = 0.0
            whole = alpha[sizes, column]
            for start, end, word, piece in reversed(edges):
                rest = self.scores[piece] + beta[end, word]
                beta[start, word] = np.logaddexp(beta[start, word], rest)
                np.add.at(out, piece, np.exp(alpha[start, word] + rest - whole[word]))
        return out


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))


def _key(piece: np.ndarray) -> np.uint64:
    up, _ = _power_tables(len(piece))
    return (_BYTE[piece] * up[:len(piece)]).sum(dtype=np.uint64)


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int64)


def _blocks(words: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, bytes by (byte, word), sizes) of words of like length, sizes ascending."""
    raw, off = utf8(words)
    sizes = np.diff(off)
    order = np.argsort(sizes, kind="stable")
    start = 0
    while start < len(order):
        # Words up to an eighth longer than the shortest, and about ``limit`` bytes.
        low = int(sizes[order[start]])
        stop = int(np.searchsorted(sizes[order], low + low // 8, "right"))
        stop = min(stop, start + max(1, limit // max(1, low)))
        at = order[start:stop]
        where = off[:-1][at] + np.arange(int(sizes[at[-1]]))[:, None]
        block = raw[np.minimum(where, max(0, len(raw) - 1))] if len(raw) else np.zeros((0, len(at)), np.uint8)
        yield at, block, sizes[at]
        start = stop


def _scores(uses: np.ndarray, words: float) -> np.ndarray:
    """Natural-log scores of pieces used so often in so many words, and of the end."""
    p = np.append(uses, words) + 0.1
    return np.log(p / p.sum())


def _chunk_words(rows: pa.Table, buckets: int):
    """Distinct words of a chunk in the order of (bucket, hash), each token's place
    in them, row offsets of the tokens, and each bucket's range."""
    flat, off = space_words(rows.column("text"))
    coded = flat.dictionary_encode()
    words = coded.dictionary
    h = word_hash(words)
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((h, bucket))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return words.take(pa.array(order)), place[coded.indices.to_numpy()], off, ends


_LETTERS = np.concatenate([np.arange(97, 123), np.arange(128, 256)])


def letter_histograms(texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Square roots of each text's shares of the letters a-z and the bytes from 128."""
    raw, off = utf8(texts)
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    counts = np.bincount(row * 256 + LOWER[raw], minlength=256 * n).reshape(n, 256)[:, _LETTERS]
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))


def centres_of(points: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """k-means: each first centre is the point farthest from those before it."""
    if not len(points):
        return np.zeros((1, len(_LETTERS)))
    centres = points[:1]
    while len(centres) < min(k, len(points)):
        far = ((points[:, None] - centres) ** 2).sum(2).min(1)
        centres = np.concatenate([centres, points[far.argmax()][None]])
    for _ in range(rounds):
        own = _nearest(points, centres)
        centres = np.stack([points[own == i].mean(0) if (own == i).any() else centres[i] for i in range(len(centres))])
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)


def _histograms(rows: DataFrame) -> DataFrame:
    """key, p: the histogram of each distinct training text that isn't empty."""
    taught = rows.filter(F.col("learn") & (F.octet_length("text") > 0)).select("text")
    taught = taught.withColumn("key", F.xxhash64("text", F.lit(5)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                points = letter_histograms(part.column("text")).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array([p.tobytes() for p in points], pa.binary())], ["key", "p"])

    return taught.mapInArrow(run, "key long, p binary").groupBy("key").agg(F.first("p").alias("p"))


def _sample_histograms(rows: DataFrame, sample: int) -> np.ndarray:
    """The first ``sample`` histograms by key, for a look at them outside Spark."""
    got = _histograms(rows).orderBy("key").limit(sample).collect()
    return np.stack([np.frombuffer(r.p, np.float32) for r in got]).astype(float) if got else np.zeros((0, len(_LETTERS)))


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and histograms of some rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            yield (part.column("key").to_numpy(),
                   np.stack([np.frombuffer(p, np.float32) for p in part.column("p").to_pylist()]).astype(float))


def spread_centres(points: DataFrame, k: int, rounds: int = 15) -> np.ndarray:
    """``centres_of`` over a table of histograms (key, p): a centre or a round is one pass, in which
    a task gives one row or the sums of its ``k`` groups.  Ends when a round changes nothing.
    However many files the table came in, a pass has a task for each core or for ``POINTS`` rows: its
    sums are as many for each task, and small tasks would send more of them than they read."""
    n = points.count()
    if not n:
        return np.zeros((1, len(_LETTERS)))
    points = points.coalesce(max(points.sparkSession.sparkContext.defaultParallelism, math.ceil(n / POINTS)))
    start = points.orderBy("key").first()
    centres = np.frombuffer(start.p, np.float32).astype(float)[None]
    for _ in range(min(k, n) - 1):
        far = points.mapInArrow(partial(_farthest, centres), "d double, key long, p binary").orderBy(F.desc("d"), "key").first()
        centres = np.concatenate([centres, np.frombuffer(far.p, np.float32).astype(float)[None]])
    for _ in range(rounds):
        sums = points.mapInArrow(partial(_group_sums, centres), "centre int, letter int, s double") \
            .groupBy("centre", "letter").agg(F.sum("s").alias("s")).collect()  # a row for each centre and letter, and its rows
        total = np.zeros((len(centres), len(_LETTERS) + 1))
        for r in sums:
            total[r.centre, r.letter] = r.s
        rows, before = total[:, -1:], centres
        centres = np.where(rows > 0, total[:, :-1] / np.maximum(rows, 1), centres)
        if np.array_equal(before, centres):
            break
    return centres


def _farthest(centres: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's point that is farthest from all centres (ties: the smallest key)."""
    best = None
    for key, p in _points(batches):
        d = ((p[:, None] - centres) ** 2).sum(2).min(1)
        i = np.lexsort((key, -d))[0]
        if best is None or (-d[i], key[i]) < best[:2]:
            best = -d[i], key[i], p[i]
    if best:
        yield pa.RecordBatch.from_arrays([pa.array([-best[0]]), pa.array([best[1]]), pa.array([best[2].astype(np.float32).tobytes()], pa.binary())],
                                         ["d", "key", "p"])


def _group_sums(centres: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the points nearest to each centre, letter by letter, and (as one more letter) their number."""
    total = np.zeros((len(centres), len(_LETTERS) + 1))
    for _, p in _points(batches):
        own = _nearest(p, centres)
        for i in np.unique(own):
            total[i, :-1] += p[own == i].sum(0)
            total[i, -1] += (own == i).sum()
    centre, letter = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(centre, pa.int32()), pa.array(letter, pa.int32()), pa.array(total[centre, letter])],
                                     ["centre", "letter", "s"])


def _joined(words: pa.Array) -> bytes:
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words.cast(pa.large_binary())),
                          pa.scalar(b"\n", pa.large_binary()))[0].as_py()


def _split(blob: bytes) -> pa.Array:
    return pc.split_pattern(pa.array([blob], pa.large_binary()), b"\n").flatten()


def score_documents(docs: DataFrame, learn: F.Column, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
                    discount: float = DISCOUNT, components: int = COMPONENTS) -> DataFrame:
    """doc_id, learned (whether the row taught), n_tokens, n_known, train_tokens, base_score,
    score, component (the likeliest)."""
    pieces = vocabulary(vocabulary_path)
    first = zipf_scores(len(pieces))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.coalesce(learn, F.lit(True)).alias("learn"))
    dealt, chunks = with_chunk(rows, "doc_id", "text", CHUNK_BYTES)
    buckets = max(1, math.ceil(chunks * CHUNK_BYTES / BUCKET_BYTES))
    centres = spread_centres(materialize(_histograms(rows), "lm-histograms"), components)
    k_all = len(centres)

    def ask(group: pa.Table) -> pa.Table:
        words, place, off, ends = _chunk_words(group, buckets)
        own = np.where(group.column("learn").to_numpy(zero_copy_only=False),
                       _nearest(letter_histograms(group.column("text")), centres), k_all)
        cell = np.repeat(own, np.diff(off)) * len(words) + place
        counts = np.bincount(cell, minlength=(k_all + 1) * len(words)).reshape(k_all + 1, -1)[:k_all].astype("<i4")
        full = [b for b in range(buckets) if ends[b] < ends[b + 1]]
        chunk = group.column("_chunk")[0].as_py()
        return pa.table({"chunk": pa.array([chunk] * len(full), pa.int32()), "bucket": pa.array(full, pa.int32()),
                         "words": pa.array([_joined(words[ends[b]:ends[b + 1]]) for b in full], pa.binary()),
                         "counts": pa.array([counts[:, ends[b]:ends[b + 1]].tobytes() for b in full], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        lists = pa.chunked_array([_split(w.as_py()) for w in group.column("words")]).combine_chunks()
        own = np.concatenate([np.frombuffer(c.as_py(), "<i4").reshape(k_all, -1) for c in group.column("counts")], axis=1)
        coded = lists.dictionary_encode()
        index = coded.indices.to_numpy()
        each = np.stack([np.bincount(index, own[k], minlength=len(coded.dictionary)) for k in range(k_all)]).astype(np.int64)
        total = each.sum(0)
        taught, scores = coded.dictionary.filter(pa.array(total > 0)), first
        for _ in range(PASSES):
            uses = Lattice(pieces, scores).expected_counts(taught)
            scores = _scores(uses, len(taught))
        some = np.flatnonzero(uses > 0)
        sizes = [len(c.as_py()) // (4 * k_all) for c in group.column("counts")]
        cuts = np.cumsum(sizes).tolist()
        answers = [each[:, index[a:b]].astype("<i8").tobytes() for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        n = len(answers)
        # Below 0: all words and types, then those of each component.
        stats = np.concatenate([[total.sum(), (total > 0).sum()], each.sum(1), (each > 0).sum(1), uses[some]])
        names = [-2, -1, *range(-3, -3 - 2 * k_all, -1), *some.tolist()]
        pad = len(stats)
        return pa.table({
            "chunk": pa.array(group.column("chunk").to_pylist() + [-1] * pad, pa.int32()),
            "bucket": pa.array(group.column("bucket").to_pylist() + [-1] * pad, pa.int32()),
            "counts": pa.array(answers + [None] * pad, pa.binary()),
            "stat": pa.array([None] * n + names, pa.int32()),
            "value": pa.array([None] * n + stats.tolist(), pa.float64())})

    asked = dealt.groupBy("_chunk").applyInArrow(lean(ask), "chunk int, bucket int, words binary, counts binary")
    answers = materialize(asked.groupBy("bucket").applyInArrow(
        lean(add), "chunk int, bucket int, counts binary, stat int, value double"), "lm-answers")
    # At most one row for each piece of the vocabulary.
    stats = {r.stat: r.v for r in answers.filter("stat is not null").groupBy("stat").agg(F.sum("value").alias("v")).collect()}
    n_words, n_types = stats.pop(-2, 0.0), stats.pop(-1, 0.0)
    per = np.array([stats.pop(-3 - i, 0.0) for i in range(2 * k_all)]).reshape(2, k_all)
    n_docs = rows.filter("learn").count()
    weight = (per[0] + 1) / (per[0] + 1).sum()  # of the components, by their words
    uses = np.zeros(len(pieces))
    uses[list(stats)] = list(stats.values())
    learned = _scores(uses, n_types) if n_types else first

    n, v = n_words + n_docs, n_types + (n_docs > 0)
    p_end = (n_docs + 0.5) / (n + 1.0)
    spare = discount * n_types / n_words if n_words else 1.0

    def base(count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (n + 0.5 * (v + 1)))

    def finish(group: pa.Table, replies: pa.Table) -> pa.Table:
        if not group.num_rows:
            return empty
        words, place, off, ends = _chunk_words(group, buckets)
        each = np.zeros((k_all, len(words)), np.int64)
        for b, blob in zip(replies.column("bucket").to_pylist(), replies.column("counts").to_pylist(), strict=True):
            each[:, ends[b]:ends[b + 1]] = np.frombuffer(blob, "<i8").reshape(k_all, -1)
        count = each.sum(0)
        sub = Lattice(pieces, learned).log_probability(words)
        whole = np.maximum(count - discount, 0) / max(n_words, 1)
        with np.errstate(divide="ignore"):
            logs = np.logaddexp(np.log(whole), math.log(spare) + sub)
        lower = np.logaddexp(math.log(KNOWN) + logs, math.log(1 - KNOWN) + sub)
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        total = lambda x: np.bincount(row, x[place], minlength=len(off) - 1)
        sums = np.empty((len(off) - 1, k_all))
        for k in range(k_all):
            own = logs
            if per[0, k]:
                with np.errstate(divide="ignore"):
                    own = np.logaddexp(np.log(np.maximum(each[k] - discount, 0) / per[0, k]),
                                       math.log(discount * per[1, k] / per[0, k]) + lower)
            sums[:, k] = total(own) + math.log(weight[k])
        best = sums.max(1)
        marginal = (best + np.log(np.exp(sums - best[:, None]).sum(1)) + math.log(1 - p_end) * np.diff(off)) / math.log(10)
        return pa.table({
            "doc_id": group.column("doc_id"), "learned": group.column("learn"),
            "n_tokens": pa.array(np.diff(off) + 1), "n_known": pa.array(total((count > 0) * 1.0).astype(np.int64) + (n_docs > 0)),
            "train_tokens": pa.array(np.full(len(off) - 1, int(n))),
            "base_score": pa.array(total(base(count)) + float(base(np.array(n_docs)))),
            "score": pa.array(marginal + math.log10(p_end)), "component": pa.array(sums.argmax(1).astype(np.int32))})

    kind = dict(rows.dtypes)["doc_id"]
    schema = (f"doc_id {kind}, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
              "score double, component int")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    empty = to_arrow_schema(_parse_datatype_string(schema)).empty_table()
    replies = answers.filter("chunk >= 0").select("chunk", "bucket", "counts")
    return dealt.groupBy("_chunk").cogroup(replies.groupBy("chunk")).applyInArrow(lean(finish), schema)


def op1_lattice_lm(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from permea.llm.common import table
    rest = hash_mod("doc_id")
    out = score_documents(table(spark, sf_dir, "documents"), rest != 1, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
