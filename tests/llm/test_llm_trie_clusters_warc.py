"""Prefix trie, centroid clusters and WARC archives against brute-force versions and on edge cases."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from permea.llm import centroids, oracles, prefix_trie, warc

TURNS = "conv_id long, turn long, role string, text string, part string, tid int, depth int"


def trie_of(sequences):
    """Brute force: (conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends) of every node."""
    members = collections.defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = collections.defaultdict(list)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    below, out = {}, []
    for n in sorted(members, key=len, reverse=True):
        leaves = sum(below[x][0] for x in children[n]) or 1
        saved = (len(members[n]) - 1) * (len(n[-1][1]) if n else 0) + sum(below[x][1] for x in children[n])
        below[n] = leaves, saved
        ends = ",".join(str(c) for c in sorted(members[n]) if len(sequences[c]) == len(n))
        out.append((min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(children[n]), leaves,
                    saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def in_order(rows):
    out = collections.defaultdict(list)
    for c, t, role, text, *_ in rows:
        role, text = role or "", text or ""
        if c is not None:
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            out[c].append(((t is not None, t or 0, role, key), (role, text)))
    return {c: [x for _, x in sorted(v)] for c, v in out.items()}


COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(df):
    return sorted((tuple(r) for r in df.select(*COLS).collect()), key=repr)


def conversations():
    rows = []
    for c in range(0, 260):
        if c == 100:
            continue  # an absent base
        kind = c % 7
        n = 1 + c % 9 if c != 205 else 61
        for t in range(n):
            text = ["Hi", "é" * (t + 1), None, "", "long " * 40][(t + (kind if t > 2 else 0)) % 5]
            rows.append((c, None if t == 0 and kind == 3 else t, [None, "user", "assistant"][t % 3], text, "x", 1, 2))
    rows += [(7, 2, "user", "tie", "x", 1, 2)] * 2 + [(None, 0, "user", "no id", "x", 1, 2), (-150, 1, "user", "Hi", "x", 1, 2)]
    return rows


def test_trie_of_whole_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SEGMENT", 2)  # 61 turns: 8 blocks in 4 segments
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    rows = conversations()
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS).repartition(5))
    assert nodes(got) == trie_of(in_order(rows))
    texts = got.join(prefix_trie.turn_texts(spark.createDataFrame(rows, TURNS)), "tid").filter("conv_id = 205").collect()
    own = in_order(rows)[205]
    assert all((r.role, r.text) == own[r.depth - 1] for r in texts) and len(texts) >= 50


def test_trie_of_rebuilt_conversations(spark, tmp_path):
    rows = conversations()
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    own = in_order(rows)
    rebuilt = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        rebuilt[c] = own.get(base, [])[:h] + s[h:]
    assert any(not s for s in rebuilt.values())  # a turnless one
    got = nodes(prefix_trie.op11_rollup_trie(spark, str(tmp_path)))
    assert got == trie_of(rebuilt)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    sql = con.execute(f"SELECT {', '.join(COLS)} FROM ({oracles.SQL['op11_rollup_trie']})").fetchall()
    assert sorted(sql, key=repr) == got


def test_trie_of_nothing(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).collect() == []
    only = spark.createDataFrame([(None, 1, "user", "x", "", 1, 1)], TURNS)
    assert prefix_trie.conversation_trie(only).collect() == []


VECTORS = "vec_id long, embedding array<double>, v string, cluster int, distance int"


def brute_clusters(vectors, first, rounds):
    x = np.array([v for _, v in vectors], np.int64)
    c = np.array(first, np.int64)

    def nearest():
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)
    for _ in range(rounds):
        at, _ = nearest()
        c = np.array([x[at == j].sum(axis=0) // (at == j).sum() if (at == j).any() else c[j] for j in range(len(c))])
    return (*nearest(), c)


def test_search_equals_all_distances_and_skips_most():
    rng = np.random.default_rng(3)
    for spread in (1, 40, 3000):
        centers = rng.integers(-spread, spread + 1, (60, 64)) + rng.integers(-2000, 2000, (60, 1))
        centers[7] = centers[3]  # a tie goes to the smaller number
        rows = centers[rng.integers(0, 60, 500)] + rng.integers(-3, 4, (500, 64))
        rows[:5] = centers[3]
        search = centroids.CentroidSearch(centers)
        number, dist = search.nearest(rows)
        every = ((rows[:, None, :] - centers[None]) ** 2).sum(axis=2)
        assert (number == every.argmin(axis=1)).all() and (dist == every.min(axis=1)).all()
        assert search.measured < 500 * 60
        if spread == 1:
            assert search.measured < 500 * 12


def test_search_with_large_components():
    centers = np.array([[centroids.LIMIT] * 64, [-centroids.LIMIT] * 64, [0] * 64])
    rows = np.array([[centroids.LIMIT - 1] * 64, [-centroids.LIMIT] * 63 + [centroids.LIMIT], [1] * 64])
    number, dist = centroids.CentroidSearch(centers).nearest(rows)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c, strict=True)) for c in centers] for r in rows]
    assert dist.tolist() == [min(w) for w in want] and number.tolist() == [w.index(min(w)) for w in want]


def test_clusters_on_edges(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=64) + (i % 5)).tolist(), "x", 1, 1) for i in range(200)]
    rows += [(300 + i, [0.25] * 64, "x", 1, 1) for i in range(40)] + [(300, [0.25] * 64, "x", 1, 1)]  # copies, a repeated row
    good = list(rows)
    rows += [(400, None, "x", 1, 1), (401, [1.0] * 63, "x", 1, 1), (402, [1.0] * 63 + [None], "x", 1, 1),
             (403, [float("nan")] + [1.0] * 63, "x", 1, 1), (404, [float("inf")] * 64, "x", 1, 1), (405, [], "x", 1, 1)]
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    vectors = [(i, np.floor(1024 * np.array(v)).astype(np.int64).tolist()) for i, v, *_ in good]
    start = sorted(vectors, key=lambda r: hashlib.sha256(f"3:{r[0]}".encode()).hexdigest())[:8]
    at, dist, c = brute_clusters(vectors, [v for _, v in start], 10)
    got = centroids.op12_mean_order_clusters(spark, str(tmp_path)).collect()
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c.tolist()]
    per = np.bincount(at, dist, 8)
    assert sorted(tuple(r) for r in got) == sorted(
        (i, int(a), int(d), int(per[a]), int(dist.sum()), sha[a]) for (i, _), a, d in zip(vectors, at, dist, strict=True))


def test_clusters_of_few_vectors(spark):
    few = spark.createDataFrame([(None, [1e300] * 64, "", 1, 1), (2, [0.0] * 64, "", 1, 1)], VECTORS)
    found, c = centroids.kmeans(centroids.integer_vectors(few, 1024, 64), 8, 2, F.col("vec_id"))
    assert len(c) == 2 and c[1].tolist() == [centroids.LIMIT] * 64 and c[0].tolist() == [0] * 64
    assert sorted((r.vec_id or -1, r.distance) for r in found.collect()) == [(-1, 0), (2, 0)]
    none, c = centroids.kmeans(centroids.integer_vectors(few.limit(0), 1024, 64), 8, 2, F.col("vec_id"))
    assert none.count() == 0 and len(c) == 0


PAGES = "page_id long, url string, html string, digest string, file string, offset int"


def pages():
    big, other = "<p>é" + "a" * 120, "b" * 100
    rows = [(i, f"http://x/{i}", big, "", "", 1) for i in range(30, 3, -1)]  # a hot payload
    rows += [(50, "http://y/ a\r\nX: 1", other, "", "", 1), (51, None, other, "", "", 1), (None, "http://z", other, "", "", 1),
             (None, "u", "c" * 300, "", "", 1), (None, "u", "c" * 300, "", "", 1), (60, "u", "s" * 99, "", "", 1),
             (61, "u", "s" * 99, "", "", 1), (62, "u", None, "", "", 1), (63, "u", "", "", "", 1),
             (4, "http://x/4", big, "", "", 1), (70, "long", "z" * 3_000_000 + "\r\n\r\nWARC/1.1\r\n\r\n", "", "", 1)]
    return rows


def wanted(rows):
    first = {}
    for i, _, html, *_ in rows:
        if len((html or "").encode()) >= 100 and i is not None:
            first[html] = min(first.get(html, i), i)
    out = []
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        to = first.get(html) if first.get(html) != i else None
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if to is not None else "response", to))
    return sorted(out, key=repr)


def test_archives_round_trip(spark, tmp_path):
    rows = pages()
    index = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(4), str(tmp_path / "archives"))
    got = warc.read_records(index).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == wanted(rows)
    html = {(i, hashlib.sha256((h or "").encode()).hexdigest()): (h or "").encode() for i, _, h, *_ in rows}
    assert all(r.payload is None if r.record_type == "revisit" else bytes(r.payload) == html[r.page_id, r.payload_digest] for r in got)
    assert {r.url for r in got if r.page_id == 50} == {"http://y/%20a%0D%0AX:%201"}
    assert {r.url for r in index.filter("page_id = 50").collect()} == {"http://y/ a\r\nX: 1"}
    some = warc.read_records(index, F.col("page_id").isin(62, 70)).collect()
    assert sorted(r.page_id for r in some) == [62, 70]
    # Every archive is a whole one: gzip members, one after the other, as the index says.
    for name in {r.file for r in index.collect()}:
        raw = open(name, "rb").read()
        spans = sorted((r.offset, r.length) for r in index.filter(F.col("file") == name).collect())
        assert [s for s, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()] and sum(n for _, n in spans) == len(raw)


def test_archives_of_the_query(spark, tmp_path):
    rows = pages()
    spark.createDataFrame(rows, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op13_indexed_warc(spark, str(tmp_path))
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=repr) == wanted(rows)
    assert warc.write_archives(spark.createDataFrame([], PAGES)).count() == 0


def test_shuffled_and_hot_payloads(spark):
    """Without broadcasts of the light table: heavy payloads are broadcast, no row is lost."""
    rows = [(i, "u", ("h" if i % 3 else f"{i % 1500}") * 100, "", "", 1) for i in range(4000)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = warc.read_records(warc.write_archives(spark.createDataFrame(rows, PAGES)), payloads=False).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == wanted(rows)


def test_ranges_join_over_small_gaps():
    at = [(0, 10), (10, 5), (15 + warc.GAP, 5), (40 + 2 * warc.GAP, 5), (50 + 2 * warc.GAP, warc.READ + 1), (60 + 2 * warc.GAP + warc.READ, 9)]
    rows = [{"offset": o, "length": n} for o, n in at]
    assert [len(held) for _, _, held in warc._ranges(rows)] == [3, 1, 1, 1]


@pytest.mark.parametrize("name", ["op11_rollup_trie", "op12_mean_order_clusters", "op13_indexed_warc"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    from permea.llm import registry
    con = duckdb.connect()
    for t in ("conversations", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = registry.QUERIES[name](spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracles.SQL[name]})").fetchall()
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
