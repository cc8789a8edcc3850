"""Packing of token pieces into sequences by a configuration linear program.

One pass tokenizes the documents and cuts the long ones into pieces; each piece
gets its rank among the pieces of its length.  Only the length histogram (at
most ``limit`` numbers, whatever the corpus) reaches the driver, which solves

    minimise the number of sequences over configurations (multisets of lengths
    that fit), so that every length is covered,

by multiplicative weights: the price of a length falls as it is covered, and
the best configuration at the current prices is an unbounded knapsack, solved
by dynamic programming over the capacity.  The fractional solution is rounded
down, the rest is solved again, and what is left at the end (bounded by the
number of configurations) is placed best fit.  A piece finds its place by
looking up its rank in the ranges of its length.

Defined cases: NULL or empty text is the single end token; every row is packed,
repeated ids too; an empty table gives an empty result.  A corpus of one piece
length, or of pieces that only fit alone, is packed the same way.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permea.llm.common import slices
from permea.session import materialize

LIMIT = 1024
END_ID = 2
#: Knapsacks of one solution and how often what rounding leaves is solved again.
STEPS, ROUNDS = 400, 6
#: Texts of these characters have the same ids in both libraries; others go through ``tokenizers`` itself.
_COMMON = "\t\n\r -~¡-¬®-ɏ–—‘-”…€"


@lru_cache(1)
def _encoders(path: str):
    """(fast encoder or None, tokenizer): tiktoken reads the vocabulary and merges of the file's own BPE."""
    import json
    import re

    import tiktoken
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    model = json.load(open(path, encoding="utf-8"))
    special = [t["content"] for t in model.get("added_tokens", [])]
    pre = model.get("pre_tokenizer") or {}
    fast = None
    if model["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") \
            and model.get("normalizer") is None:
        import public_tokenizers
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte alphabet of byte-level BPE
        back = {chr(b): b for b in letters}
        back.update({chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(letters))})
        ranks = {bytes(back[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    common = re.compile(f"[{_COMMON}]*")
    return fast, tok, common, special


def token_ids(text: str | None, path: str) -> np.ndarray:
    """Ids of a text, without the end token."""
    if not text:
        return np.zeros(0, np.uint32)
    fast, tok, common, special = _encoders(path)
    if fast is not None and common.fullmatch(text) and not any(s in text for s in special):
        return fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)
    return np.array(tok.encode(text, add_special_tokens=False).ids, np.uint32)


def cut(n: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter."""
    first = n % limit or min(n, limit)
    return [(0, first), *((s, limit) for s in range(first, n, limit))]


def token_pieces(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = END_ID, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's rank (``nth``)
    among those of its length in its partition (``part``)."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, part = [0] * (limit + 1), TaskContext.get().partitionId()
        for batch in batches:
            for some in slices(batch, "text"):
                at, out = [], []
                for k, text in enumerate(some.column("text").to_pylist()):
                    ids = np.append(token_ids(text, path), np.uint32(end_id)).astype("<u4")
                    for piece, (start, length) in enumerate(cut(len(ids), limit)):
                        at.append(k)
                        out.append((piece, start, length, zlib.crc32(ids[start:start + length].tobytes()), part,
                                    counts[length]))
                        counts[length] += 1
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (
                    pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column("doc_id").take(pa.array(at)), *cols], names)

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, piece int, start long, length long, "
                                "ids_crc32 long, part int, nth long")


#: A configuration: ((length, copies), ...), lengths ascending.
Configuration = tuple[tuple[int, int], ...]


def knapsack(prices: np.ndarray, limit: int) -> Configuration:
    """The most valuable configuration."""
    sizes = np.flatnonzero(prices > 0)
    worth, value, choice = prices[sizes], np.zeros(limit + 1), np.zeros(limit + 1, np.int64)
    fit = np.searchsorted(sizes, np.arange(limit + 1), "right")
    for c in range(1, limit + 1):
        n = fit[c]
        if n:
            gain = value[c - sizes[:n]] + worth[:n]
            j = int(gain.argmax())
            value[c], choice[c] = gain[j], sizes[j]
    copies: dict[int, int] = {}
    c = limit
    while c > 0 and choice[c]:
        size = int(choice[c])
        copies[size] = copies.get(size, 0) + 1
        c -= size
    return tuple(sorted(copies.items()))


def solve_lp(demand: np.ndarray, limit: int, steps: int = STEPS) -> dict[Configuration, float]:
    """Configurations and how often each is used, fractionally, so that every
    length is covered; by multiplicative weights."""
    need = demand > 0
    cover, used = np.zeros(limit + 1), {}
    eta = 4 * np.log(max(2, need.sum()))
    sizes = np.arange(limit + 1) / limit
    for _ in range(steps):
        low = cover[need].min()
        best = knapsack(np.where(need, sizes * np.exp(-eta * (cover - low)), 0.0), limit)
        at, copies = np.array(best).T
        amount = float((demand[at] / copies).min()) / 8
        cover[at] += amount * copies / demand[at]
        used[best] = used.get(best, 0.0) + amount
        if cover[need].min() >= 1:
            break
    return used


def best_fit(demand: np.ndarray, limit: int) -> dict[Configuration, int]:
    """Longest first, each into the fullest configuration that has room."""
    free: list[list[list[int]]] = [[] for _ in range(limit + 1)]
    for size in range(limit, 0, -1):
        for _ in range(int(demand[size])):
            room = next((r for r in range(size, limit) if free[r]), limit)
            own = free[room].pop() if room < limit else []
            own.append(size)
            free[room - size].append(own)
    out: dict[Configuration, int] = {}
    for bins in free:
        for own in bins:
            key = tuple((x, own.count(x)) for x in sorted(set(own)))
            out[key] = out.get(key, 0) + 1
    return out


def configurations(demand: np.ndarray, limit: int = LIMIT) -> list[tuple[Configuration, int]]:
    """Configurations and whole numbers of uses that pack exactly ``demand``."""
    rest, out = demand.astype(np.int64).copy(), []
    if rest[limit]:
        out.append((((limit, 1),), int(rest[limit])))
        rest[limit] = 0
    for _ in range(ROUNDS):
        before = rest.sum()
        if before < 2000:
            break
        # The fullest first: what they leave is solved again.
        for best, amount in sorted(solve_lp(rest, limit).items(), key=lambda x: -sum(s * k for s, k in x[0])):
            at, copies = np.array(best).T
            uses = min(int(amount), int((rest[at] // copies).min()))
            if uses > 0:
                rest[at] -= uses * copies
                out.append((best, uses))
        if rest.sum() > 0.98 * before:
            break
    if rest.sum():
        out += best_fit(rest, limit).items()
    return out


class Places:
    """Sequence and offset of the rth piece of each length."""

    def __init__(self, plan: list[tuple[Configuration, int]]):
        all_ends: dict[int, list[int]] = {}
        all_rows: dict[int, list[tuple[int, int, int, int]]] = {}
        base = 0
        for copies, uses in plan:
            offset = 0
            for size, k in reversed(copies):
                ends = all_ends.setdefault(size, [])
                before = ends[-1] if ends else 0
                ends.append(before + k * uses)
                all_rows.setdefault(size, []).append((before, base, k, offset))
                offset += k * size
            base += uses
        self.table = {s: (np.array(all_ends[s]), np.array(all_rows[s])) for s in all_ends}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        sizes, first = np.unique(length[order], return_index=True)
        for size, at in zip(sizes.tolist(), np.split(order, first[1:]), strict=True):
            ends, rows = self.table[size]
            before, base, k, off = rows[np.searchsorted(ends, rank[at], "right")].T
            sequence[at] = base + (rank[at] - before) // k
            offset[at] = off + (rank[at] - before) % k * size
        return sequence, offset


def pack(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = END_ID, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = materialize(token_pieces(docs, path, limit, end_id, id_col, text_col), "pack-pieces")
    # Rows of this table: partitions x lengths; the window runs over the partitions of one length.
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    demand = np.zeros(limit + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``limit`` rows
        demand[r.length] = r.n
    places = Places(configurations(demand, limit))
    ranked = pieces.join(bases, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = places.find(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)],
                                             [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"doc_id {dict(pieces.dtypes)['doc_id']}, piece int, start long, length long, "
                                  "ids_crc32 long, sequence_id long, offset long")


def op6_config_lp_pack(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from permea.llm.common import table
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
