"""Registered queries against brute-force versions on small tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from permea.llm import common, decontaminate, html_text, langid, lattice_lm, minhash, packing, registry, suffix_dedup, topk, toxicity

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEST_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def crc(x, k=5):
    return zlib.crc32(str(x).encode()) % k


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def run(spark, sf_dir, name):
    return registry.QUERIES[name](spark, sf_dir).collect()


def test_lattice_counts(spark, sf_dir, docs):
    words = {i: SPACE_WORD.findall(low(r.text)) + ["\n"] for i, r in docs.items()}
    c = collections.Counter(w for i, x in words.items() if crc(i) != 1 for w in x)
    n, v = sum(c.values()), len(c)
    for r in run(spark, sf_dir, "op1_lattice_lm"):
        own = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id) == 1, len(own), sum(c[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel=1e-9)
        assert -1e9 < r.score < 0


def test_lattice_is_the_sum_over_segmentations():
    pieces = lattice_lm.vocabulary(RANKS)
    lattice = lattice_lm.Lattice(pieces, lattice_lm.zipf_scores(len(pieces)))
    score = dict(zip(pieces, lattice.scores, strict=False))

    def total(word):
        return 1.0 if not word else sum(math.exp(score[word[:k]]) * total(word[k:]) for k in range(1, min(10, len(word)) + 1) if word[:k] in score)

    words = [b"a", b"the", b"thing", b"readings", "éü".encode(), b"zqxj", b"aaaaaa"]
    got = lattice.log_probability(pa.array(words))
    assert got == pytest.approx([math.log(total(w)) + lattice.end for w in words])
    # Expected counts: a piece's count is the derivative of the log probability by its score.
    counts = lattice.expected_counts(pa.array(words))
    for piece in (b"th", b"a", b"ing"):
        k, step = pieces.index(piece), 1e-6
        more = lattice.scores.copy()
        more[k] += step
        assert counts[k] == pytest.approx((lattice_lm.Lattice(pieces, more).log_probability(pa.array(words)) - got).sum() / step, abs=1e-4)


def exact_components(sets):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def shingles(text):
    w = SPACE_WORD.findall(low(text))
    return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset(map(tuple, [w] if w else []))


def test_minhash(spark, sf_dir, docs):
    sets = {i: shingles(r.text) for i, r in docs.items()}
    want = exact_components(sets)
    got = run(spark, sf_dir, "op3_tensored_minhash")
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {
        i: (len(sets[i]), want[i], want[i] == i) for i in docs}


def test_minhash_family_without_a_centre(spark):
    """Copies that are far from the smallest id but near to each other."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(80):
        own = base.copy()
        for k in rng.choice(120, int(rng.integers(1, 9)), replace=False):
            own[k] = f"x{i}_{k}"
        rows.append((i, " ".join(own)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = exact_components({i: shingles(t) for i, t in rows})
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(frame).collect()} == want


def windows(items):
    out = {}
    for i, text in items:
        w = TEST_WORD.findall(low(text))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            out.setdefault((n, tuple(w[k:k + n])), set()).add(str(i))
    return out


def contamination(text, found):
    w, hit, items = TEST_WORD.findall(low(text)), set(), set()
    for n in {n for n, _ in found}:
        for k in range(len(w) - n + 1):
            if own := found.get((n, tuple(w[k:k + n]))):
                items |= own
                hit.update(range(k, k + n))
    return len(w), len(hit), sorted(items)


def test_decontaminate(spark, sf_dir, docs):
    found = windows([(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    for r in run(spark, sf_dir, "op5_suffix_decontam"):
        n, hit, items = contamination(docs[r.doc_id].text, found)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(items), hit > 0 and 20 * hit >= n)
        assert r.items_sha256 == hashlib.sha256(",".join(items).encode()).hexdigest()


def test_word_suffix_array():
    rng = np.random.default_rng(1)
    for depth in (1, 4, 40):
        sizes = rng.integers(0, 30, 12)
        off = np.concatenate([[0], np.cumsum(sizes)])
        words = rng.integers(0, 3, off[-1]).astype(np.uint64)
        shard = decontaminate.SuffixArray(words, off, depth)
        keys = [shard.words[p:p + depth].tolist() for p in shard.order]
        assert keys == sorted(keys) and sorted(shard.order) == sorted(np.flatnonzero(shard.words))


def test_pack(spark, sf_dir, docs):
    tok = Tokenizer.from_file(JSON)
    rows = run(spark, sf_dir, "op6_config_lp_pack")
    by, place = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        place[r.sequence_id].append((r.offset, r.length))
    for i, d in docs.items():
        ids = np.array([*tok.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in pieces] == [(k, s, n) for k, (s, n) in enumerate(packing.cut(len(ids)))]
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in pieces)
        assert all(r.length == 1024 for r in pieces[1:])
    for spots in place.values():
        assert [o for o, _ in sorted(spots)] == [0, *np.cumsum([n for _, n in sorted(spots)])[:-1]]
        assert sum(n for _, n in spots) <= 1024
    assert len(place) <= math.ceil(sum(r.length for r in rows) / 1024) * 1.1 + 1


def test_configurations_near_the_bound():
    rng = np.random.default_rng(3)
    demand = np.bincount(rng.integers(20, 700, 40000), minlength=1025)
    plan = packing.configurations(demand)
    made = np.zeros(1025, int)
    for config, uses in plan:
        assert sum(s * k for s, k in config) <= 1024
        for s, k in config:
            made[s] += k * uses
    assert (made == demand).all()
    assert sum(n for _, n in plan) <= 1.005 * math.ceil((demand * np.arange(1025)).sum() / 1024)


def test_token_ids_agree_with_the_tokenizer():
    tok = Tokenizer.from_file(JSON)
    for text in ["plain text", "a  b\n\n c\t", "it's we'll I'D", "été naïf – “x”…", "日本語 текст", "<|endoftext|> x", "   x\u0085", "x" * 3000, "١٢٣ 123"]:
        assert packing.token_ids(text, JSON).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_language_on_held_out(spark, sf_dir, docs):
    rows = [r for r in run(spark, "/root/testdata/sf0.01", "op7_bigru_langid") if r.held_out]
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) > 0.95


def test_gru_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in langid.init(3, 4, rng).items()}
    x, live = rng.integers(0, 5, (6, 2)), np.ones((6, 2, 1), bool)
    live[4:, 1] = False
    weight = rng.normal(size=(6, 2, 4)) * live

    def loss(q):
        return float((langid.forward(q, "b", x, live)[0] * weight).sum())

    _, kept = langid.forward(p, "b", x, live, True)
    grads = {}
    langid.backward(p, "b", x, live, kept, weight, grads)
    for k in ("bxr", "bun", "buz", "bxn"):
        at = (1, 2) if k[1] == "x" else (0, 1)
        up = {n: v.copy() for n, v in p.items()}
        up[k][at] += 1e-3
        down = {n: v.copy() for n, v in p.items()}
        down[k][at] -= 1e-3
        assert grads[k][at] == pytest.approx((loss(up) - loss(down)) / 2e-3, abs=5e-3)
    small = {k: v.astype(np.float32) for k, v in p.items()}
    assert np.allclose(langid.read(small, "f", x.astype(np.uint8), live), langid.forward(small, "f", x, live)[0], atol=1e-5)


def test_toxic_neighbours_are_exact(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), common.hash_mod("doc_id") != 0)
    index = model.index
    texts = pa.array([r.text for r in docs.limit(400).collect()])
    row, term, times = model.vocabulary.counts(texts)
    seen = 0
    for _, a, b in toxicity._groups(row):
        w = np.zeros(len(index.idf))
        w[term[a:b]] = (1 + np.log(times[a:b])) * index.idf[term[a:b]]
        cosine = index.vectors @ (w / np.linalg.norm(w))
        order = sorted((-round(c, 9), e) for c, e in zip(cosine, index.example, strict=True) if c > 0)[:model.k]
        at, best = index.nearest(term[a:b], times[a:b], model.k)
        assert best == pytest.approx([-c for c, _ in order])
        seen += 1
    assert seen > 10


def test_blocks_are_skipped_and_lose_no_neighbour():
    """Cosines summed in plain Python; examples of several kinds, so that most blocks can't win."""
    rng = np.random.default_rng(4)
    words = [[f"w{kind}x{i}" for i in range(60)] for kind in range(8)]
    texts = [" ".join(rng.choice(words[i % 8] + ["the", "of"], 25)) for i in range(600)]
    terms, ends, example, times = toxicity.posting_lists(pa.array(texts))
    idf = rng.uniform(0.5, 3.0, len(terms))
    index = toxicity.Index(ends, example, times, idf, len(texts))
    vocabulary = toxicity.Vocabulary(terms)
    weight = {int(h): w for h, w in zip(terms, idf, strict=True)}

    def vector(text):
        row, hashes = toxicity.term_hashes(pa.array([text]))
        v = {h: (1 + math.log(n)) * weight[h] for h, n in collections.Counter(hashes.tolist()).items() if h in weight}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {h: x / size for h, x in v.items()}

    vectors = [vector(t) for t in texts]
    queries = texts[:40] + [" ".join(rng.choice(words[3], 10))]
    row, term, uses = vocabulary.counts(pa.array(queries))
    found = list(index.search([(term[a:b], uses[a:b]) for _, a, b in toxicity._groups(row)], 15))
    for text, (at, cosine) in zip(queries, found, strict=True):
        q = vector(text)
        every = [sum(x * v.get(h, 0.0) for h, x in q.items()) for v in vectors]
        best = sorted(range(len(every)), key=lambda e: (-round(every[e], 6), e))[:15]
        assert cosine == pytest.approx([every[e] for e in best], abs=1e-5)
        assert {e for e in at if every[e] > cosine[-1] + 1e-5} == {e for e in best if every[e] > cosine[-1] + 1e-5}
    assert index.skipped > 0.5 * index.seen


def test_suffix_dedup(spark, sf_dir, docs):
    least, want = {}, {}
    body = {i: (docs[i].text or "").encode() for i in sorted(docs)}
    for i, b in body.items():
        for p in range(len(b) - 49):
            least.setdefault(b[p:p + 50], i)
    for i, b in body.items():
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if least[b[p:p + 50]] < i:
                gone[p:p + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        want[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for options in ({}, {"chunk_bytes": 1 << 15}, {"chunk_bytes": 1 << 15, "hot_chunks": 1}):
        got = suffix_dedup.removed_spans(frame, **options).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_two_stage_sorting():
    rng = np.random.default_rng(0)
    for k in range(300):
        text = rng.integers(0, rng.integers(1, 5), rng.integers(0, 60)).astype(np.uint8)
        b = text.tobytes()
        assert suffix_dedup.two_stage_suffix_array(text).tolist() == sorted(range(len(b)), key=lambda i: b[i:]), k


def test_topk_stops_early_and_is_exact():
    rng = np.random.default_rng(2)
    ids, rows = np.arange(500) * 3, rng.integers(-9, 9, (500, 6))
    lists = topk.SortedLists(ids, rows)
    for _ in range(40):
        q = rng.integers(-9, 9, 6).astype(float)
        at, score = lists.search(q, 30, 7)
        want = sorted((-int(v @ q), i) for i, v in zip(ids, rows, strict=True) if i != 30)[:7]
        assert [(-int(s), i) for i, s in zip(at, score, strict=True)] == want


def test_line_blocks_without_an_article():
    page = ("<html><head><title>T</title><style>p{}</style></head><body><div id='nav-menu'><a href='/'>Home</a></div><div><a href='/a'>Some link</a> "
            "<a href='/b'>Other</a></div><h2>A headline of the story</h2><p>" + "A long first paragraph of prose. " * 5 + "</p><p>Short one.</p><p>"
            + "Another long paragraph &amp; more. " * 5 + "</p><div class='comments'><p>" + "I disagree with this. " * 9
            + "</p></div><form>Name <input></form><footer>Imprint</footer></body></html>")
    text = html_text.main_text(page)
    assert text.split("\n") == ["A headline of the story", ("A long first paragraph of prose. " * 5).strip(), "Short one.",
                                ("Another long paragraph & more. " * 5).strip()]


def test_pipeline_stages(spark, docs):
    sf = "/root/testdata/sf0.001"
    now = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in now.collect()}
        now = stage(spark, now, sf).cache()
        after = {r.doc_id: r.text for r in now.collect()}
        if name == "toxicity":
            model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), labels, common.hash_mod("doc_id") != 0)
            score, _ = model.score_texts(pa.array(list(before.values())))
            assert set(after) == {i for i, s in zip(before, score, strict=True) if s < 0.5}
        elif name == "near_dedup":
            assert set(after) == set(exact_components({i: shingles(t) for i, t in before.items()}).values())
        elif name == "decontamination":
            found = windows([(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
            bad = {i for i, t in before.items() for n, hit, _ in [contamination(t, found)] if hit and 20 * hit >= n}
            assert set(after) == set(before) - bad
        else:
            assert set(after) == set(before) and sum(map(len, after.values())) <= sum(map(len, before.values()))


def test_lattice_score_of_the_model(spark, sf_dir, docs):
    """The score from the formula, with the model's own parts recomputed in plain Python."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("learn", common.hash_mod("doc_id") != 1)
    centres = lattice_lm.centres_of(lattice_lm._sample_histograms(rows, lattice_lm.SAMPLE), lattice_lm.COMPONENTS)
    k_all, d = len(centres), lattice_lm.DISCOUNT
    words = {i: SPACE_WORD.findall(low(r.text)) for i, r in docs.items()}
    each = [collections.Counter() for _ in range(k_all)]
    for i, r in docs.items():
        if crc(i) != 1:
            each[int(lattice_lm._nearest(lattice_lm.letter_histograms(pa.array([r.text])), centres)[0])].update(words[i])
    whole = sum(each, collections.Counter())
    n, n_docs = sum(whole.values()), sum(crc(i) != 1 for i in docs)
    pieces, scores = lattice_lm.vocabulary(RANKS), None
    scores = lattice_lm.zipf_scores(len(pieces))
    types = pa.array(sorted(whole))
    for _ in range(lattice_lm.PASSES):
        scores = lattice_lm._scores(lattice_lm.Lattice(pieces, scores).expected_counts(types), len(types))
    lattice = lattice_lm.Lattice(pieces, scores)
    p_end = (n_docs + 0.5) / (n + n_docs + 1)
    weight = np.array([sum(c.values()) + 1 for c in each], float)
    weight /= weight.sum()
    got = {r.doc_id: r.score for r in run(spark, sf_dir, "op1_lattice_lm")}
    for i in sorted(docs)[:40]:
        own = words[i]
        sub = np.exp(lattice.log_probability(pa.array(own, pa.string()))) if own else np.zeros(0)
        p = np.array([max(whole[w] - d, 0) / n for w in own]) + d * len(whole) / n * sub
        total = []
        for k, c in enumerate(each):
            size = sum(c.values())
            q = np.array([max(c[w] - d, 0) / size for w in own]) + d * len(c) / size * (
                lattice_lm.KNOWN * p + (1 - lattice_lm.KNOWN) * sub) if size else p
            total.append(math.log(weight[k]) + (np.log(q).sum() if own else 0))
        want = (np.logaddexp.reduce(total) + len(own) * math.log(1 - p_end) + math.log(p_end)) / math.log(10)
        assert got[i] == pytest.approx(want, rel=1e-9)
