"""Prefix trie of conversations by ROLLUP over positional turn-id columns.

A turn's id is 16 bytes of md5 over (role, text) and 4 of its number of code points.
Each conversation is written in rows of ``WIDTH`` turn ids, ``t1`` to ``t8``, so that
one ``ROLLUP(t1, ..., t8)`` aggregates every prefix at once; ``grouping_id`` tells how
many columns a result row has kept.  A longer conversation goes on in further rows
(column blocks), and these are rolled up under the key of the prior block's node: its
depth and a 128-bit fingerprint of all turns up to it.  The fingerprint is an XOR of
hashes of (position, id), so it comes from a running aggregate and no block waits for
the one before it.

Sums over subtrees need no walk either.  The nodes whose smallest member is a given
conversation are the lower end of its path, so that conversation *owns* them: a first
ROLLUP finds each conversation's first owned depth and whether it owns its leaf, a second
one adds up what the members own.  The distinct code points below a node are then
the members' owned ones, less what its own smallest member owns above it.

Scale: partial aggregation collapses a frequent prefix in every task; a conversation's
turns are placed by prefix counts over range partitions, and its blocks are joined in
segments of ``SEGMENT`` blocks, so a conversation with a third of all turns stays spread.
Parents with over a thousandth of all nodes as children (under 1000 of them)
are broadcast, all others joined by a shuffle.  The members that end at a node are
joined to short runs in order before the runs of one node meet in one task.

Defined cases: a NULL conversation id takes no part; NULL turns come first; equal turns
follow each other by role, then by the md5 of their id; a repeated row is a turn of
its own; a NULL role or text is empty; an empty table has no nodes; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from permea.session import materialize

WIDTH, SEGMENT = 8, 1024
#: Members in one run (about 4 KB of digits).
RUN = 512
SLOTS = [f"t{i}" for i in range(1, WIDTH + 1)]
KEY = ["depth", "fp1", "fp2"]


def turn_id(role: Column, text: Column) -> Column:
    """20 bytes: md5 of the turn, then its code points."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    body = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.unhex(F.md5(body.cast("binary"))), F.unhex(F.lpad(F.hex(F.char_length(text).cast("long")), 8, "0")))


def _chars(tid: Column) -> Column:
    return F.coalesce(F.conv(F.hex(F.substring(tid, 17, 4)), 16, 10).cast("long"), F.lit(0).cast("long"))


def _xor(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseXOR(p)
    return out


def _fingerprint(seed: int, names: list[str] = SLOTS) -> Column:
    """Of a row's turns at their places in the conversation; no turn adds nothing."""
    return _xor([F.when(F.col(t).isNotNull(), F.xxhash64(F.lit(seed), F.col("block") * WIDTH + SLOTS.index(t), F.col(t)))
                 .otherwise(F.lit(0).cast("long")) for t in names])


def place_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Turns dealt to range partitions: rows (conv_id, part, nth, tid), nth counting a
    conversation's turns inside its part, and starts (conv_id, part, before), the turns in earlier parts."""
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
                        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                        turn_id(F.col(role), F.col(text)).alias("tid")).filter(F.col("conv_id").isNotNull())
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("tid")]
    rows = (rows.repartitionByRange(F.asc("conv_id"), *order).withColumn("part", F.spark_partition_id())
            .withColumn("nth", F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order)).cast("long")))
    rows = materialize(rows.select("conv_id", "part", "nth", "tid"), "trie-turns")
    counts = rows.groupBy("part", "conv_id").agg(F.max("nth").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return rows, starts


def sequences(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """(conv_id, pos, tid): each conversation's turns, counted from 1."""
    return rows.join(starts, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("nth")).alias("pos"), "tid")


def graft(rows: DataFrame, starts: DataFrame, base: Column, heads: Column, most: int) -> DataFrame:
    """Sequences in which the first ``heads`` (at most ``most``) turns of every conversation are
    replaced by those of the conversation ``base`` names (fewer if it has fewer, none if
    it is absent).  Every conversation also has a row without a turn (tid NULL)."""
    firsts = (sequences(rows, starts.filter(F.col("conv_id") == base)).filter(F.col("pos") <= most)
              .groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "tid"))),
                                                  lambda x: x["tid"]).alias("head"))
              .withColumnRenamed("conv_id", "base"))
    starts = (starts.withColumn("base", base).join(firsts, "base", "left")
              .withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<binary>")), F.lit(1), heads.cast("int")))
              .withColumn("cut", heads.cast("long")).drop("base"))
    starts = materialize(starts, "trie-starts")
    own = (rows.join(starts, ["conv_id", "part"]).withColumn("pos", F.col("before") + F.col("nth"))
           .filter(F.col("pos") > F.col("cut"))
           .select("conv_id", (F.col("pos") - F.col("cut") + F.size("head")).alias("pos"), "tid"))
    once = starts.filter("before = 0")  # a conversation's first part
    new = once.select("conv_id", F.posexplode("head").alias("pos", "tid"))
    none = once.select("conv_id", F.lit(1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("tid"))
    return own.unionByName(new.withColumn("pos", F.col("pos").cast("long") + 1)).unionByName(none)


def _blocks(seqs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of WIDTH turns with what stands before them, and the segments they are in."""
    at = (F.col("pos") - 1)
    cells = seqs.select("conv_id", F.floor(at / (WIDTH * SEGMENT)).alias("segment"), F.floor(at / WIDTH).alias("block"),
                        (at % WIDTH).cast("int").alias("slot"), "tid")
    wide = cells.repartition("conv_id", "segment").groupBy("conv_id", "segment", "block").agg(
        *[F.max(F.when(F.col("slot") == i, F.col("tid"))).alias(t) for i, t in enumerate(SLOTS)])
    total = lambda cols: sum(cols[1:], cols[0])
    wide = wide.withColumns({"x1": _fingerprint(1), "x2": _fingerprint(2),
                             "chars": total([_chars(F.col(t)) for t in SLOTS]),
                             "turns": total([F.col(t).isNotNull().cast("long") for t in SLOTS])})
    inside = Window.partitionBy("conv_id", "segment").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    wide = materialize(wide.withColumns({
        "b1": F.coalesce(F.bit_xor("x1").over(inside), zero), "b2": F.coalesce(F.bit_xor("x2").over(inside), zero),
        "bc": F.coalesce(F.sum("chars").over(inside), zero)}), "trie-rows")
    segments = wide.groupBy("conv_id", "segment").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"),
                                                     F.sum("chars").alias("chars"), F.sum("turns").alias("turns"))
    order = Window.partitionBy("conv_id").orderBy("segment")
    earlier, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("conv_id")
    segments = materialize(segments.select(
        "conv_id", "segment", F.coalesce(F.bit_xor("x1").over(earlier), zero).alias("s1"),
        F.coalesce(F.bit_xor("x2").over(earlier), zero).alias("s2"), F.coalesce(F.sum("chars").over(earlier), zero).alias("sc"),
        F.sum("chars").over(whole).alias("total_chars"), F.sum("turns").over(whole).alias("total_turns")), "trie-segments")
    rows = wide.join(segments, ["conv_id", "segment"]).select(
        "conv_id", "segment", "block", *SLOTS, F.col("b1").bitwiseXOR(F.col("s1")).alias("prior1"),
        F.col("b2").bitwiseXOR(F.col("s2")).alias("prior2"), (F.col("bc") + F.col("sc")).alias("prior_chars"),
        "total_chars", "total_turns")
    return materialize(rows, "trie-blocks"), segments


def _rollup(blocks: DataFrame, aggregates: str) -> DataFrame:
    """One row per node: key, parent's key, last turn, code points before it, and the aggregates."""
    cols = ", ".join(SLOTS)
    out = blocks.sparkSession.sql(
        f"SELECT block, prior1, prior2, {cols}, {WIDTH} - bit_count(grouping_id()) AS level, "
        f"min(prior_chars) AS prior_chars, {aggregates} "
        f"FROM {{blocks}} GROUP BY block, prior1, prior2, ROLLUP({cols})", blocks=blocks)
    last = F.element_at(F.array(*SLOTS), F.greatest(F.col("level"), F.lit(1)).cast("int"))
    # A level whose last column is empty lies beyond the conversation's end; level 0 is the node of the block before.
    out = out.filter(((F.col("level") > 0) & last.isNotNull()) | ((F.col("level") == 0) & (F.col("block") == 0)))
    out = out.withColumn("tid", F.when(F.col("level") > 0, last)).withColumn("last_chars", _chars(F.col("tid")))
    all_chars = sum([_chars(F.col(t)) for t in SLOTS], F.col("prior_chars"))
    place = F.col("block") * WIDTH + F.col("level") - 1
    hashed = {n: F.when(F.col("level") > 0, F.xxhash64(F.lit(n), place, F.col("tid"))).otherwise(F.lit(0).cast("long")) for n in (1, 2)}
    return (out.withColumns({"fp1": F.col("prior1").bitwiseXOR(_fingerprint(1)), "fp2": F.col("prior2").bitwiseXOR(_fingerprint(2)),
                             "depth": (place + 1).cast("long"), "chars_before": all_chars - F.col("last_chars")})
            .withColumns({f"parent{n}": F.col(f"fp{n}").bitwiseXOR(h) for n, h in hashed.items()})
            .drop(*SLOTS, "block", "prior1", "prior2", "prior_chars", "level"))


def _ends(blocks: DataFrame) -> DataFrame:
    """The key of every node at which members end, and the SHA-256 of their ids."""
    last = F.greatest(F.floor((F.col("total_turns") - 1) / WIDTH), F.lit(0))
    ends = blocks.filter(F.col("block") == last).select(
        F.col("total_turns").alias("depth"), F.col("prior1").bitwiseXOR(_fingerprint(1)).alias("fp1"),
        F.col("prior2").bitwiseXOR(_fingerprint(2)).alias("fp2"), "conv_id")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in KEY), strict=True))
            ids = batch.column("conv_id").to_pylist()
            out, start = [], 0
            for i in range(1, len(ids) + 1):
                if i == len(ids) or keys[i] != keys[start] or i - start == RUN:
                    out.append((*keys[start], ids[start], ",".join(map(str, ids[start:i]))))
                    start = i
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())],
                                             [*KEY, "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                                              [*KEY, "ends_sha256"])
        for batch in batches:
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in [*KEY, "ids"]), strict=True):
                if key == now:
                    state.update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256(ids.encode())
            yield flush()
        if now is not None:
            out.append((*now, state.hexdigest()))
            yield flush()

    key = "depth long, fp1 long, fp2 long"
    order = [*KEY, "conv_id"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(runs, f"{key}, first long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digests, f"{key}, ends_sha256 string")


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """The trie of sequences (conv_id, pos from 1 without gaps, tid; NULL tid: no turn).

    One row per node: ``node`` and ``parent`` keys (depth, two fingerprint halves), ``conv_id``
    (smallest member), parent_conv_id, ``tid`` of the last turn, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    blocks, segments = _blocks(seqs)
    first = _rollup(blocks, "min(conv_id) AS conv_id, max(total_turns) AS deepest")
    owners = first.groupBy("conv_id").agg(F.min("chars_before").alias("before"),
                                          F.max((F.col("deepest") == F.col("depth")).cast("long")).alias("leaf"))
    owned = segments.join(owners, "conv_id", "left").select(
        "conv_id", "segment", "before", F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf"),
        F.coalesce(F.col("total_chars") - F.col("before"), F.lit(0).cast("long")).alias("owned_chars"))
    nodes = materialize(_rollup(
        blocks.join(owned, ["conv_id", "segment"]),
        "count(*) AS n_convs, min(conv_id) AS conv_id, min_by(before, conv_id) AS before, sum(total_chars) AS total_chars, "
        "sum(owned_chars) AS owned_chars, sum(leaf) AS n_leaves"), "trie-nodes")
    children = nodes.filter("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("parent1").alias("fp1"), F.col("parent2").alias("fp2")).agg(F.count("*").alias("n_children"))
    # All members' code points from this node on, less those of its distinct nodes.
    saved = (F.col("total_chars") - F.col("n_convs") * F.col("chars_before")
             - (F.col("owned_chars") + F.col("before") - F.col("chars_before")))
    nodes = materialize(nodes.join(children, KEY, "left").join(_ends(blocks), KEY, "left").select(
        *KEY, "parent1", "parent2", "conv_id", "tid", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        "n_leaves", saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")),
        "trie-counted")
    parents = nodes.filter("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("fp1").alias("parent1"), F.col("fp2").alias("parent2"),
        F.col("conv_id").alias("parent_conv_id"), "n_children")
    above = ["depth", "parent1", "parent2"]
    limit = nodes.count() / 1000  # children sum to less than all nodes, so fewer than 1000 parents pass it
    heavy = F.broadcast(parents.filter(F.col("n_children") > limit).drop("n_children"))
    light = parents.filter(F.col("n_children") <= limit).drop("n_children")
    tried = nodes.join(heavy, above, "left")
    known = tried.filter("parent_conv_id IS NOT NULL OR depth = 0")
    rest = tried.filter("parent_conv_id IS NULL AND depth > 0").drop("parent_conv_id").join(light, above)
    return known.unionByName(rest).select(
        F.struct(*KEY).alias("node"), F.when(F.col("depth") > 0, F.struct(F.col("depth") - 1, "parent1", "parent2")).alias("parent"),
        "conv_id", "depth", "parent_conv_id", "tid", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                      text: str = "text") -> DataFrame:
    """:func:`prefix_trie` of conversations as they stand."""
    return prefix_trie(sequences(*place_turns(turns, conv, turn, role, text)))


def turn_texts(turns: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """tid, role, text of every distinct turn, to be joined to nodes."""
    return turns.select(turn_id(F.col(role), F.col(text)).alias("tid"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                        F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["tid"])


def op11_rollup_trie(spark, sf_dir: str) -> DataFrame:
    """Conversation c gets the first crc32(c) % 6 turns of conversation c - c % 100 in place of its own."""
    from permea.llm.common import table
    rows, starts = place_turns(table(spark, sf_dir, "conversations"))
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    seqs = graft(rows, starts, F.col("conv_id") - F.col("conv_id") % 100, heads, 5)
    return prefix_trie(seqs).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                    "saved_tokens", "ends_sha256")
