"""Every dealt operator on rows with NULLs, empty and very long texts, ties,
repeated rows, clashing extra columns, and on empty tables."""

import math
import zlib

import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from permea.llm import decontaminate, html_text, langid, lattice_lm, minhash, packing, sharding, suffix_dedup, topk, toxicity
from permea.llm.common import hash_mod

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(40_000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards box and the cat looks on from a warm wall"
ROWS = [
    (1, f"Alpha {PASSAGE} omega", "en", "a", 9), (2, f"Beta {PASSAGE} delta", "en", "a", 9), (3, None, "en", "a", 0),
    (4, "", None, "a", 0), (5, "word", "fr", None, 4), (6, LONG, "fr", "b", 9), (6, LONG, "fr", "b", 9), (7, LONG, None, "b", None),
    (8, "été à la plage, ça va très bien 😀 \U0001f600", "fr", "b", 9), (8, "été à la plage", "fr", "b", 9),
    (None, f"Null id {PASSAGE}", "en", "a", 1), (None, None, None, None, None), (10, " \t\n 12 34 !!", "en", "a", 3),
    (11, "aaaa" * 500, "en", "a", 3), (12, "aaaa" * 400, "en", "a", 3), (13, "x" * 3000, "en", "a", 3)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASH = ("_chunk", "row", "score", "n", "node", "bands", "part", "nth", "tkey", "runs", "items", "bucket", "chunk", "_row",
                               "learn", "v", "q", "size", "id", "evidence", "label", "times")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(c) for c in CLASH})


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("doc_id < -1")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, None), (3, ""), (4, "word"), (None, "plage ça va très bien")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in (1, 2, 3, 4, 5, 6, 6, 8)] + [(None, 1, 1), (10, 1, None)],
                                 "doc_id long, quality int, toxic int")


def pairs(df, *cols):
    return sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))


def test_lattice(docs, none):
    rows = lattice_lm.score_documents(docs, hash_mod("doc_id") != 1, RANKS).collect()
    assert len(rows) == len(ROWS)
    assert all(r.score < 0 and r.base_score <= 0 for r in rows)
    assert sorted(r.n_tokens for r in rows if r.doc_id is None) == [1, 25]
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {1}
    assert lattice_lm.score_documents(none, hash_mod("doc_id") != 1, RANKS).count() == 0
    untaught = lattice_lm.score_documents(docs, F.lit(False), RANKS).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score < 0 for r in untaught)


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, None, "<article><p>One &amp; two<p>three<br>four</article><footer>x</footer>"),
                                   (3, None, "<article><p>One &amp; two<p>three<br>four</article><footer>x</footer>"), (None, "u", "<nav>a</nav><p"),
                                   (5, "u", "<article>" + "<p>Very long line of text.</p>" * 20000 + "</article>")],
                                  "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("x")})
    got = {(r.page_id, r.text[:20]): r.n_chars for r in html_text.extract_main_text(pages).collect()}
    assert got[3, "One & two\nthree four"] == 20 and got[1, ""] == got[2, ""] == got[None, ""] == 0
    assert got[5, "Very long line of te"] == 24 * 20000 - 1
    assert html_text.extract_main_text(pages).count() == 6
    assert html_text.extract_main_text(pages.filter("page_id = 99")).count() == 0


def test_minhash(docs, none):
    got = minhash.near_duplicates(docs)
    by = {(r.doc_id, r.n_shingles): r for r in got.collect()}
    assert got.count() == len(ROWS)
    assert [r.component_id for r in got.filter("doc_id in (6, 7)").collect()] == [6, 6, 6]
    assert by[3, 0].component_id == 3 and by[4, 0].kept and by[5, 1].component_id == 5
    assert not by[None, 0].kept and by[None, 0].component_id is None
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(6) == 1 and 7 not in ids and ids.count(None) == 2 and {3, 4, 5, 10} <= set(ids)


def test_shards(docs, none):
    rows = sharding.shard_by_bytes(docs, 4).collect()
    assert len(rows) == len(ROWS)
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    text = {(r[0], len((r[1] or "").encode()) + 1): zlib.crc32((r[1] or "").encode()) for r in ROWS}
    assert all(text[r.doc_id, r.size] == r.text_crc32 for r in rows)
    assert sharding.shard_by_bytes(none, 4).count() == 0


def test_decontaminate(docs, none, bench):
    got = decontaminate.contamination(docs, bench)
    by = {(r.row.doc_id, r.n_words): r for r in got.collect()}
    assert by[1, 24].n_hit == 22 and by[1, 24].contaminated and by[1, 24]["items"] == ["1"]
    assert by[5, 1].n_hit == 1 and by[8, 10]["items"] == ["null"] and by[3, 0].n_hit == 0
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == len(ROWS) - 5
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.filter("item_id = 99")).filter("n_hit > 0").count() == 0
    # Tests in several blocks give the same rows.
    blocks = decontaminate.contamination(docs, bench, keep=["doc_id"], block_bytes=40)
    assert pairs(blocks, "row.doc_id", "n_words", "n_hit", "items", "contaminated") == \
        pairs(got, "row.doc_id", "n_words", "n_hit", "items", "contaminated")


def test_pack(docs, none):
    rows = packing.pack(docs, JSON).collect()
    place = {}
    for r in rows:
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in place.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024
    assert sum(r.doc_id in (3, 4) and r.length == 1 for r in rows) == 2
    assert packing.pack(none, JSON).count() == 0


def test_language(docs, none):
    got = langid.predict_language(docs, F.lit(True), per_language=5, steps=3)
    by = {(r.doc_id, r.lang_pred): r.score for r in got.collect()}
    assert by[3, "und"] == by[4, "und"] == by[10, "und"] == by[None, "und"] == 0
    assert {p for _, p in by} <= {"und", "en", "fr"} and all(0 <= s <= 1 for s in by.values())
    assert langid.predict_language(none, F.lit(True)).count() == 0
    assert {r.lang_pred for r in langid.predict_language(docs, F.lit(False)).collect()} == {"und"}


def test_digits_and_symbols_are_no_letters():
    assert not any(langid.LETTER.search(t) for t in ("½", "²", "①", "12 _ -", "")) and langid.LETTER.search("1 é")


def test_top_k_among_vectors_of_one_length(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 60)] + [(100 + i, [1.0, 2.0, float(i)]) for i in range(30)] + [(500, [1.0])]
    got = topk.threshold_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 3, 1).collect()
    best = {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in {r.query_id for r in got}}
    assert best == {20: [59, 58, 57], 40: [59, 58, 57], 100: [101, 102, 103], 120: [129, 128, 127]}


def test_toxicity(docs, none, labels):
    model = toxicity.fit(docs, labels, F.lit(True))
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.keep_clean(docs, labels, F.lit(True)).columns == docs.columns
    assert toxicity.score_documents(none, toxicity.fit(none, labels, F.lit(True))).count() == 0
    unlabelled = toxicity.fit(docs, labels.filter("doc_id = 99"), F.lit(True))
    assert {r.score for r in toxicity.score_documents(docs, unlabelled).collect()} == {0.0}


def test_suffix_dedup(docs, none):
    got = {(r.doc_id, r.n_bytes): r for r in suffix_dedup.removed_spans(docs).collect()}
    size = len(LONG.encode())
    assert got[7, size].n_removed == size and got[6, size].n_removed == 0 and got[3, 0].n_removed == 0
    assert got[12, 1600].n_removed == 1600 and got[11, 2000].n_removed == 0 and got[13, 3000].n_removed == 0
    assert got[2, len(ROWS[1][1])].n_removed >= len(PASSAGE)
    assert got[None, len(ROWS[10][1])].n_removed >= len(PASSAGE)
    assert suffix_dedup.removed_spans(none).count() == 0
    cut = suffix_dedup.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(ROWS)
    assert cut.filter("doc_id = 7 and text = ''").count() == 1 and cut.filter("text is null").count() == 2


def test_topk(spark):
    rows = [(i, [0.1 * (i % 7), -0.2 * (i % 3), 0.05 * i]) for i in range(60)] + [
        (60, None), (61, [0.1, None, 0.2]), (62, [float("nan"), 0.0, 0.0]), (63, [float("inf"), 0.0, 0.0]), (20, [9.0, 9.0, 9.0]),
        (None, [5.0, 5.0, 5.0]), (65, [1.0]), (80, [0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit(1), "rank": F.lit(1), "v": F.lit(1)})
    got = topk.threshold_topk(vectors, F.col("vec_id") % 20 == 0, 5)
    zero = [(r["rank"], r.vec_id, r.score) for r in got.filter("query_id = 80").orderBy("rank").collect()]
    assert zero == [(i + 1, i, 0) for i in range(5)]
    assert got.filter("query_id = vec_id or vec_id in (60, 61, 62, 63, 65)").count() == 0
    assert topk.threshold_topk(vectors.filter("vec_id = -5"), F.col("vec_id") % 20 == 0, 5).count() == 0
    assert topk.threshold_topk(vectors.filter("vec_id in (40, 41, 42)"), F.col("vec_id") % 20 == 0, 5).count() == 2


def test_stages(spark, docs, tmp_path, bench, labels):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for source in (docs, docs.filter("doc_id < -1")):
        now = source
        for name, stage in corpus_pipeline.STAGES:
            before, now = now, stage(spark, now, str(tmp_path)).cache()
            if name != "packing":
                assert now.columns == before.columns
                assert now.count() <= before.count()


def test_toxicity_of_a_rare_kind(spark):
    """A text equal to a labelled toxic example is flagged though none of its words is frequent."""
    plain = [(i, f"the river number{i} runs past houses and fields near town{i % 7}") for i in range(40)]
    common = [(100 + i, f"you are an idiot{'' if i % 2 else ' moron'} says voice{i}") for i in range(20)]
    rare = [(200, "qvarx zelgon threpp wumbled skorvane"), (201, "qvarx zelgon threpp wumbled skorvane")]
    docs = spark.createDataFrame([*plain, *common, *rare], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in [*plain, *common, rare[0]]], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, toxicity.fit(docs, labels, F.lit(True)), ["doc_id"])
           .select("row.doc_id", "score", "evidence").collect()}
    assert got[201].evidence[0] == "200" and got[201].score >= 0.5
    assert got[201].score == got[200].score and all(got[i].score < 0.5 for i, _ in plain)


def test_html_windows():
    long = "A long paragraph of prose that goes on for a while and tells a story. " * 2
    wrapped = "".join(f"<div><div><p>{t}</p></div></div>" for t in (long, "Short entry.", "Another short one.", long, "The end."))
    assert html_text.main_text(f"<body>{wrapped}</body>").split("\n") == [
        long.strip(), "Short entry.", "Another short one.", long.strip(), "The end."]
    rows = "".join(f"<tr><td>cell {i}</td></tr>" for i in range(4))
    assert html_text.main_text(f"<body><table>{rows}</table></body>").split("\n") == [f"cell {i}" for i in range(4)]
    # Links in a row are a dive; short text after it is not part of the article.
    links = "<p><a href='/'>More of this</a></p>" * 4
    article = f"<article><p>Lead.</p><p>{long}</p></article><div>{links}</div><article><p>Teaser</p></article>"
    assert html_text.main_text(f"<body>{article}</body>").split("\n") == ["Lead.", long.strip()]
    # Names of paragraphs and wrappers do not hide text; those of whole containers do.
    page = f"<div class='page has-sidebar'><p class='notice'>{long}</p><div class='sidebar'><p>{long}aside</p></div></div>"
    assert html_text.main_text(page) == long.strip()


def test_language_sample_of_copies(spark):
    """Copies of a few texts leave no language without its windows."""
    texts = [f"bonjour le monde numero {i} et tous les autres" for i in range(20)]
    rows = [(texts[0], "fr")] * 3000 + [(t, "fr") for t in texts] + [(f"good morning number {i}", "en") for i in range(30)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    names, windows, labels = langid.sample_windows(docs, F.lit(True), 10, 2, 64, 8)
    assert names == ["en", "fr"] and (labels == 0).sum() == (labels == 1).sum() == 20
    names, _, labels = langid.sample_windows(docs, F.lit(True), 50, 2, 64, 8)
    assert (labels == 0).sum() == 60 and (labels == 1).sum() == 40
    many = spark.createDataFrame([(f"text number {i}", f"l{i % 80:02}") for i in range(160)], "text string, lang string")
    names, _, labels = langid.sample_windows(many, F.lit(True), 10, 2, 64)
    assert len(names) == 80 and set(labels.tolist()) == set(range(80))
    points = lattice_lm._sample_histograms(docs.withColumn("learn", F.lit(True)), 40)
    assert len(points) == 40


def test_lattice_of_long_pieces():
    """The sum over all segmentations has pieces of any length."""
    pieces = lattice_lm.vocabulary(RANKS)
    score = dict(zip(pieces, lattice_lm.zipf_scores(len(pieces)).tolist(), strict=False))
    assert {b"superintendent", b"civilizations"} <= set(pieces)
    lattice = lattice_lm.Lattice(pieces, lattice_lm.zipf_scores(len(pieces)))
    words = [b"superintendent", b"civilizations", b"xcivilizations", "правительства".encode(), b"-" * 40, b"a"]
    for word, got in zip(words, lattice.log_probability(pa.array(words)), strict=True):
        sums = [1.0]
        for end in range(1, len(word) + 1):
            sums.append(sum(sums[k] * math.exp(score[word[k:end]]) for k in range(end) if word[k:end] in score))
        assert got - lattice.end == pytest.approx(math.log(sums[-1]), rel=1e-9)
