"""Benchmark decontamination with suffix arrays of the training texts.

Every shard (a run of documents of bounded size) gets a suffix array of its
words: the words are numbered, suffixes are ordered by three words at a time,
and only suffixes that still tie are ordered again by the ranks three, nine,
... words on.  Every suffix of every test item is then binary-searched in every
shard; this gives its longest verbatim match and all places where one of its
windows occurs.  No match crosses a document's end.

Tests are read in blocks of at most ``TEST_BYTES`` of text; a corpus is matched
with one block after the other and the hits are united, so neither side is
bounded by what one task can hold.

Defined cases: NULL or empty text, and text without a word, has no words and no
hit; an item without words matches nothing; an item without an id hits words
under the id ``null``; repeated rows are separate rows, repeated items count
once per id; empty tables give no hits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permea.llm.common import LOWER, row_schema, slices, span_hash, text_of, utf8, with_row
from permea.session import materialize

#: Words of a window, and the least share of hit words (1 in 20) of a contaminated document.
WINDOW, SHARE = 13, 20
TEST_BYTES = 16 << 20

_IN_WORD = np.zeros(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _IN_WORD[_a:_b] = True


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and row offsets (n + 1)."""
    raw, off = utf8(texts)
    inside = _IN_WORD[raw]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    edge = off[:-1][off[:-1] < off[1:]]
    before[edge] = False
    after[off[1:][off[:-1] < off[1:]] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return span_hash(LOWER[raw], starts, ends), np.searchsorted(starts, off).astype(np.int64)


class SuffixArray:
    """Suffixes of the words of a shard, ordered up to ``depth`` words."""

    def __init__(self, hashes: np.ndarray, off: np.ndarray, depth: int):
        self.alphabet, number = np.unique(hashes, return_inverse=True)
        sizes = np.diff(off)
        # Number 0 ends a document, so no match goes on into the next.
        at = np.arange(len(hashes)) + np.repeat(np.arange(len(sizes)), sizes)
        self.words = np.zeros(len(hashes) + len(sizes) + depth + 1, np.int64)
        self.words[at] = number + 1
        self.starts = off[:-1] + np.arange(len(sizes))  # of the documents, in ``words``
        self.n = len(hashes) + len(sizes)
        bits = max(1, int(self.n + 1).bit_length())
        self.step = 3 if bits <= 21 else 2 if bits <= 31 else 1
        self.bits = bits
        rank = np.zeros(self.n + 3 * depth + 9, np.int64)
        rank[:self.n] = self.words[:self.n]
        self.order = at[self._sort(rank, at)]
        self.key = self._keys(rank, self.order)
        covered = self.step
        new = np.concatenate([[True], self.key[1:] != self.key[:-1]]) if len(at) else np.zeros(0, bool)
        while covered < depth and not new.all():
            first = np.flatnonzero(new)
            group = np.repeat(first, np.diff(np.append(first, len(new)))) + 1  # rank: place of the first of its equals
            rank[:] = 0
            rank[self.order] = group
            tied = np.flatnonzero(~(new & np.append(new[1:], True)))
            some = self.order[tied]
            keys = rank[some] << (self.bits * (self.step - 1))
            for j in range(1, self.step):
                keys |= rank[some + j * covered] << (self.bits * (self.step - 1 - j))
            if self.step == 1:  # very large shards: by rank, then by what follows
                turn = np.lexsort((rank[some + covered], rank[some]))
                split = np.stack([rank[some], rank[some + covered]])[:, turn]
                differ = (split[:, 1:] != split[:, :-1]).any(0)
                covered *= 2
            else:
                turn = np.argsort(keys)
                keys = keys[turn]
                differ = keys[1:] != keys[:-1]
                covered *= self.step
            self.order[tied] = some[turn]
            new[tied[0]] = True
            new[tied[1:]] |= differ

    def _keys(self, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        keys = rank[at] << (self.bits * (self.step - 1))
        for j in range(1, self.step):
            keys |= rank[at + j] << (self.bits * (self.step - 1 - j))
        return keys

    def _sort(self, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.argsort(self._keys(rank, at))

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words; -1 for a word that the shard lacks."""
        if not len(self.alphabet):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.alphabet, hashes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == hashes, at + 1, -1)

    def match(self, patterns: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Words that each pattern shares with the suffix at its place."""
        width = patterns.shape[1]
        other = self.words[self.order[place][:, None] + np.arange(width)]
        differ = (patterns != other) | (np.arange(width) >= sizes[:, None])
        return np.where(differ.any(1), differ.argmax(1), width)

    def search(self, patterns: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
        """First place in [low, high) whose suffix is not below the pattern
        (``after``: is above every suffix that begins with it)."""
        low, high = low.copy(), high.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            p, n = patterns[open_], sizes[open_]
            same = self.match(p, n, mid)
            row = np.arange(len(open_))
            full = same >= n
            theirs = self.words[self.order[mid] + np.minimum(same, p.shape[1] - 1)]
            below = np.where(full, after, theirs < p[row, np.minimum(same, p.shape[1] - 1)])
            low[open_] = np.where(below, mid + 1, low[open_])
            high[open_] = np.where(below, high[open_], mid)
        return low


class Tests:
    """The suffixes of a block of test items, as word hashes."""

    def __init__(self, ids: list[str], hashes: np.ndarray, off: np.ndarray, window: int):
        sizes = np.diff(off)
        self.ids, self.hashes, self.window = ids, hashes, window
        self.item = np.repeat(np.arange(len(sizes)), sizes)
        self.at = np.arange(len(hashes)) - off[:-1][self.item]
        self.rest = sizes[self.item] - self.at  # words of each suffix
        self.depth = int(sizes.max(initial=1))
        need = np.minimum(window, sizes[self.item])
        # Words that a hit of this suffix must share; 0: too short to hold a window.
        self.need = np.where((self.rest >= need) & ((sizes[self.item] >= window) | (self.at == 0)), need, 0)

    def find(self, shard: SuffixArray) -> tuple[list[tuple[int, np.ndarray]], np.ndarray, np.ndarray]:
        """(suffix, places of its window) of those that hit, and for each suffix
        its longest match (words) and one place of it."""
        longest, place = np.zeros(len(self.hashes), np.int64), np.zeros(len(self.hashes), np.int64)
        hits: list[tuple[int, np.ndarray]] = []
        if not len(shard.order) or not len(self.hashes):
            return hits, longest, place
        number = np.concatenate([shard.number(self.hashes), np.zeros(self.depth + 3, np.int64)])
        some = np.flatnonzero(number[:len(self.hashes)] > 0)
        # The first words narrow the search to the suffixes that share them.
        lead = np.minimum(self.rest[some], shard.step)
        key, top = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
        known = np.ones(len(some), bool)
        for j in range(shard.step):
            shift = shard.bits * (shard.step - 1 - j)
            use = j < lead
            word = np.where(use, number[some + j], 0)
            known &= word >= 0
            key |= np.maximum(word, 0) << shift
            top |= np.where(use, np.maximum(word, 0), (1 << shard.bits) - 1) << shift
        low = np.searchsorted(shard.key, key, "left")
        high = np.searchsorted(shard.key, top, "right")
        one = np.flatnonzero(~(known & (low < high)))
        longest[some[one]] = 1  # at least the first word is there
        live = np.flatnonzero(known & (low < high))
        some, low, high = some[live], low[live], high[live]
        for begin in range(0, len(some), 4096):
            s, lo, hi = some[begin:begin + 4096], low[begin:begin + 4096], high[begin:begin + 4096]
            width = int(self.rest[s].max())
            grid = np.minimum(s[:, None] + np.arange(width), len(number) - 1)
            patterns = np.where(np.arange(width) < self.rest[s][:, None], number[grid], -2)
            # The longest match stands next to where the suffix would be.
            at = shard.search(patterns, self.rest[s], lo, hi, False)
            for near in (np.maximum(at - 1, lo), np.minimum(at, hi - 1)):
                n = shard.match(patterns, self.rest[s], near)
                better = n > longest[s]
                longest[s] = np.where(better, n, longest[s])
                place[s] = np.where(better, shard.order[near], place[s])
            hit = np.flatnonzero((self.need[s] > 0) & (longest[s] >= self.need[s]))
            if len(hit):
                need = self.need[s[hit]]
                part = patterns[hit][:, :max(1, int(need.max()))]
                first = shard.search(part, need, lo[hit], hi[hit], False)
                last = shard.search(part, need, lo[hit], hi[hit], True)
                hits += [(int(x), shard.order[a:b]) for x, a, b in zip(s[hit], first, last, strict=True)]
        return hits, longest, place


def shard_hits(tests: Tests, texts: pa.Array) -> tuple[np.ndarray, list, list, list]:
    """Per row: words, runs of hit words, items, longest match (item, word in the
    item, word in the document, words)."""
    hashes, off = words_of(texts)
    n = len(off) - 1
    shard = SuffixArray(hashes, off, max(tests.depth, 1))
    hits, longest, place = tests.find(shard)
    runs: list[list] = [[] for _ in range(n)]
    items: list[set] = [set() for _ in range(n)]
    best: list[tuple | None] = [None] * n
    if hits:
        spot = np.concatenate([p for _, p in hits])
        suffix = np.repeat([x for x, _ in hits], [len(p) for _, p in hits])
        doc = np.searchsorted(shard.starts, spot, "right") - 1
        start = spot - shard.starts[doc]
        end = start + tests.need[suffix]
        order = np.lexsort((end, start, doc))
        doc, start, end, suffix = doc[order], start[order], end[order], suffix[order]
        for d, s, e, x in zip(doc.tolist(), start.tolist(), end.tolist(), suffix.tolist(), strict=True):
            items[d].add(tests.ids[tests.item[x]])
            if runs[d] and s <= runs[d][-1][1]:
                runs[d][-1][1] = max(e, runs[d][-1][1])
            else:
                runs[d].append([s, e])
    for x in np.flatnonzero((tests.need > 0) & (longest >= tests.need)).tolist():
        d = int(np.searchsorted(shard.starts, place[x], "right")) - 1
        if best[d] is None or longest[x] > best[d][3]:
            best[d] = (tests.ids[tests.item[x]], int(tests.at[x]), int(place[x] - shard.starts[d]), int(longest[x]))
    return np.diff(off), runs, [sorted(i) for i in items], best


_RESULT = ("n_words long, runs array<struct<start:int,end:int>>, items array<string>, "
           "longest struct<item:string,item_word:int,doc_word:int,words:int>")


def match_tests(docs: DataFrame, tests: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id",
                item_text: str = "text", keep: list[str] | None = None, block_bytes: int = TEST_BYTES) -> DataFrame:
    """row (a struct of the columns ``keep``, default all), n_words, runs (maximal runs
    of hit words), items (sorted ids of the items with occurring windows) and
    longest (one longest match)."""
    items = tests.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("id"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    blocks = max(1, math.ceil(size / block_bytes))
    rows = with_row(docs, keep or docs.columns, text_col)
    if blocks == 1:
        return _match_block(rows, items, window, text_col)
    # Several blocks of tests: one pass for each, united by row.
    rows = materialize(rows.withColumn("nth", F.monotonically_increasing_id()), "tested-rows")
    text = F.col("text") if "text" in rows.columns else F.col(f"row.`{text_col}`")
    one = rows.select(F.struct("nth").alias("row"), text.alias("text"))
    found = None
    for b in range(blocks):
        part = _match_block(one, items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b), window, "text")
        found = part if found is None else found.unionByName(part)
    found = found.groupBy(F.col("row.nth").alias("nth")).agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max_by("longest", "longest.words").alias("longest"))
    return rows.join(found, "nth").drop("nth", "text")


def _match_block(rows: DataFrame, items: DataFrame, window: int, text_col: str) -> DataFrame:
    known = items.filter(F.octet_length("text") > 0).collect()  # at most a block of text
    hashes, off = words_of(pa.array([r.text for r in known], pa.string()))
    ids = [r.id for r in known]
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    match = pa.struct([("item", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("words", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = Tests(ids, hashes, off, window)
        for batch in batches:
            for part in slices(batch, text_of(batch, text_col)):
                n, runs, its, best = shard_hits(tests, text_of(part, text_col))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(n.astype(np.int64)),
                     pa.array([[{"start": s, "end": e} for s, e in r] for r in runs], spans), pa.array(its, pa.list_(pa.string())),
                     pa.array([b and dict(zip(("item", "item_word", "doc_word", "words"), b, strict=True)) for b in best], match)],
                    ["row", "n_words", "runs", "items", "longest"])

    return rows.mapInArrow(run, f"{row_schema(rows)}, {_RESULT}")


def contamination(docs: DataFrame, tests: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """:func:`match_tests` with n_hit (words that the runs cover; runs may overlap when
    they come from several blocks) and contaminated."""
    hit = F.expr("aggregate(runs, named_struct('n', 0L, 'to', 0), (a, r) -> named_struct("
                 "'n', a.n + greatest(0, r.end - greatest(a.to, r.start)), 'to', greatest(a.to, r.end))).n").cast("long")
    return match_tests(docs, tests, window, **options).withColumn("n_hit", hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))


def remove_contaminated(docs: DataFrame, tests: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    return contamination(docs, tests, window, **options).filter("not contaminated").select("row.*")


def op5_suffix_decontam(spark, sf_dir: str) -> DataFrame:
    from permea.llm.common import table
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
                        F.col("longest.words").alias("longest_match"))
