"""Shards, token packing, language, pages and archives."""

import gzip
import html as html_lib
import os
import random
import re

import numpy as np
import pytest

EDGE = {1: None, 2: "", 3: " \n", 4: "one", 5: "same text again", 6: "same text again", 7: "y" * 100_000, 8: "word " * 9_000, 9: "<|endoftext|> é Ü. don't 12!"}


def test_ring_shards_of_a_panel(make):
    from pyspark.sql import functions as F

    from accuracast.llm.sharding import ring_shards

    panel = make({f"s{i}": range(13) for i in range(40)})
    got = ring_shards(panel, shards=8, tie=("pos",)).collect()
    assert len(got) == 520 and {r.shard for r in got} == set(range(8))
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(65))
    hot = panel.withColumn("series_id", F.when(F.col("pos") < 5, None).otherwise(F.col("series_id"))).withColumn("slot", F.lit("clash"))
    counts = [r["count"] for r in ring_shards(hot, shards=7, tie=("ts", "y")).groupBy("shard").count().collect()]
    assert sum(counts) == 520 and max(counts) - min(counts) <= 1
    assert ring_shards(panel.limit(0)).count() == 0


def test_ring_moves_little_with_slack(make):
    from accuracast.llm.sharding import ring_shards

    panel = make({f"s{i}": range(2) for i in range(600)}).where("pos = 0")
    a, b = ({r.series_id: r.shard for r in ring_shards(panel, shards=n, slack=0.25).collect()} for n in (8, 9))
    assert max(list(a.values()).count(s) for s in range(8)) <= 94
    assert sum(a[k] != b[k] for k in a) < 0.4 * len(a)


def test_flow_continues_clockwise():
    from accuracast.llm.sharding import capacities, flow

    assert capacities(10, 3) == [4, 3, 3]
    pieces = flow([(5, 0, 9), (9, 1, 1), (20, 2, 0)], capacities(10, 3))
    assert pieces == [(5, 0, 4, 0, 0), (9, 0, 1, 1, 0), (5, 4, 6, 1, 1), (5, 6, 9, 2, 0)]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    from accuracast.llm.tokens import default_tokenizer

    return Tokenizer.from_file(default_tokenizer())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = ["alpha", "Beta,", "gamma.", "déjà", "l'eau", "x=1", "%%%", "日本", "delta\n", "12", "epsilon", "Σας", "ét́"]
    return EDGE | {100 + i: " ".join(rng.choice(words) for _ in range(rng.randint(0, 700))) for i in range(60)}


def _ids(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def test_retrieval_pack_is_lossless(docs, tokenizer, texts):
    from accuracast.llm.packing import retrieval_pack

    rows = retrieval_pack(docs(texts, clash=True)).collect()
    for i, t in texts.items():
        want = _ids(tokenizer, t)
        own = sorted((r for r in rows if r.series_id == i), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == want.tobytes() and {r.doc_tokens for r in own} == {len(want)}
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
    sequences = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) == 2048 and sum(n < 2048 for n in sequences.values()) <= 8  # one per partition
    assert retrieval_pack(docs({})).count() == 0


def test_bm25_scores_match_the_formula():
    from accuracast.llm.packing import B, K1, ShardIndex, fill_windows

    rng = np.random.default_rng(1)
    shard = [rng.integers(0, 50, rng.integers(1, 80)) for _ in range(20)]
    df = np.bincount(np.concatenate([np.unique(x) for x in shard]), minlength=50)
    index = ShardIndex(shard, df, 40, 30.0)
    for q in range(20):
        want = np.zeros(20)
        for t in np.unique(shard[q]):
            idf = max(0.0, np.log((40 - df[t] + 0.5) / (df[t] + 0.5)))
            for d in range(20):
                tf = (shard[d] == t).sum()
                want[d] += idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(shard[d]) / 30.0))
        assert np.allclose(index.scores(q), want)
    windows = fill_windows(index, np.array([len(x) for x in shard]), 100)
    assert all(sum(p[2] for p in w) == 100 for w in windows[:-1])
    first = windows[0]
    order = [d for d in np.argsort(-index.scores(first[0][0]), kind="stable") if d != first[0][0]]
    assert first[1][0] == next((d for d in order if len(shard[d]) <= 100 - first[0][2]), order[0])


def test_retrieval_reaches_beyond_files_and_shards(spark, tokenizer):
    from accuracast.llm.packing import SHARD_DOCS, retrieval_pack

    words = sorted(w for w in tokenizer.get_vocab() if re.fullmatch("[a-z]{4,}", w) and len(_ids(tokenizer, w)) == 2)
    topics = random.Random(5).sample(words, SHARD_DOCS + 88)
    rows = [(i, f"{w} " * (9 + half)) for half in range(2) for i, w in enumerate(topics, half * len(topics))]
    docs = spark.createDataFrame(rows, "series_id bigint, text string").union(spark.createDataFrame([(None, None)] * 3, "series_id bigint, text string"))
    got = retrieval_pack(docs, window=21).collect()
    assert sum(r.length for r in got) == sum(len(_ids(tokenizer, t)) for _, t in rows) + 3
    windows = {}
    for r in got:
        windows.setdefault(r.series_id, set()).add(r.sequence_id)
    # the two of a topic are read 600 rows apart; where a text is cut, the ones after it may pair otherwise
    together = sum(bool(windows[i] & windows[i + len(topics)]) for i in range(len(topics)))
    assert together > len(topics) / 2


def test_packed_matrices_are_lossless(docs, tokenizer, texts):
    from accuracast.llm.token_matrix import packed_matrices

    rows = packed_matrices(docs(texts, clash=True), capacity=512, pad=9).collect()
    back = {i: np.zeros(len(_ids(tokenizer, t)), "<u4") for i, t in texts.items()}
    for r in rows:
        ids, positions = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == 512 and (ids[r.n_ids :] == 9).all() and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_ids
        for k, (key, start) in enumerate(zip(r["keys"], r.starts)):
            a, b = r.cu_seqlens[k : k + 2]
            back[key][start : start + b - a] = ids[a:b]
            assert positions[a:b].tolist() == list(range(b - a))
    assert all((back[i] == _ids(tokenizer, t)).all() for i, t in texts.items())
    assert len({r.sequence_id for r in rows}) == len(rows) and packed_matrices(docs({})).count() == 0


def test_best_fit_decreasing_matches_a_plain_search():
    from accuracast.llm.token_matrix import best_fit_decreasing

    rng = np.random.default_rng(2)
    for _ in range(30):
        sizes = rng.integers(1, 65, 80)
        free = []
        for s in sorted(sizes.tolist(), reverse=True):
            fits = [i for i, f in enumerate(free) if f >= s]
            if fits:
                free[min(fits, key=lambda i: free[i])] -= s
            else:
                free.append(64 - s)
        bins = best_fit_decreasing(sizes, 64)
        assert sorted(64 - sum(sizes[i] for i in b) for b in bins) == sorted(free)
        assert sorted(i for b in bins for i in b) == list(range(80))


def test_language_on_held_out_texts(spark, docs):
    from pyspark.sql import functions as F

    from accuracast.llm.langid import fit_language_model, held_out, predict_language

    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("held", held_out(F.col("doc_id")))
    model = fit_language_model(table.where("not held"), key="doc_id")
    got = predict_language(table, model).where("held").collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    assert (model.weights == 0).mean() > 0.5  # the penalty keeps most weights at zero
    edge = {r.series_id: (r.lang_pred, r.score) for r in predict_language(docs(EDGE | {10: "12 %"}, clash=True), model).collect()}
    assert {k for k, v in edge.items() if v == ("und", 0.0)} == {1, 2, 3, 10} and len(edge) == len(EDGE) + 1
    assert predict_language(docs({}), model).count() == 0
    nothing = fit_language_model(table.where("false"), key="doc_id")
    assert {r.lang_pred for r in predict_language(docs(EDGE), nothing).collect()} == {"und"}


def test_temperature_mends_overconfidence():
    from accuracast.llm.langid import temperature

    rng = np.random.default_rng(0)
    labels = rng.integers(0, 2, 400)
    scores = np.where((np.arange(2) == labels[:, None]) ^ (rng.random((400, 1)) < 0.2), 8.0, 0.0)
    assert abs(temperature(scores, labels) - 8 / np.log(4)) < 1.5


PAGES = {
    "<p>plain &amp; text": "plain & text",
    "": "",
    '<body><nav><a href="/x">menu</a></nav><article><h1>Head</h1><p>One <b>two</b>\n three<br>four<p>Five &lt;b&gt;</article><footer>foot</footer>': "Head One two three four Five <b>",
    '<div class="sidebar"><p>beside</p></div><div><div><p>Intro that is rather long and says much.</p></div><div><p>Main text that is long enough.</p><p>End</p></div></div>': "Intro that is rather long and says much. Main text that is long enough. End",
    "<main><header><h2>T</h2></header><p>x</p><script>if (a<b) {}</script><!-- c --><form>f<input></form><div class='reader-comments'>nice</div></main>": "T x",
    '<article><p title="a>b">quoted</p><style>p{}</style><aside>no</aside></article>': "quoted",
    "<div>" * 2000 + "deep" + "</div>" * 2000: "deep",
}


def test_main_text(spark):
    from accuracast.llm.html_text import extract_main_text

    rows = [(i, f"u{i}", p) for i, p in enumerate(PAGES)] + [(90, "u", None), (91, "u0", list(PAGES)[0])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in extract_main_text(pages).collect()}
    want = dict(enumerate(PAGES.values())) | {90: "", 91: "plain & text"}
    assert {k: r.text for k, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())
    assert extract_main_text(pages.limit(0)).count() == 0
    real = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    texts = {r.page_id: r.text for r in extract_main_text(real).collect()}
    for r in real.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        assert texts[r.page_id] == " ".join(html_lib.unescape(re.sub(r"<[^>]*>", " ", body)).split())


PROSE = "".join(f"<p>Paragraph {i} tells at some length what happened in the town that day, and why people cared.</p>" for i in range(8))
TOLD = " ".join(re.findall("<p>(.*?)</p>", PROSE))
LINKS = "<ul>" + "".join(f"<li><a href='/{i}'>Other story number {i}</a></li>" for i in range(12)) + "</ul>"
WRAPPED = {
    f"<body><div class='layout with-sidebar'><article>{PROSE}</article><div class='sidebar'>{LINKS}</div></div></body>": TOLD,
    f"<body><div class='post has-comments'><div>{PROSE}</div></div><div class='comments'><p>Nice.</p></div></body>": TOLD,
    f"<body><div id='search-content'><div class='text'>{PROSE}</div>{LINKS}</div><footer>Foot</footer></body>": TOLD,
    f"<body><form id='page'><nav>{LINKS}</nav><div><div>{PROSE}</div></div></form></body>": TOLD,
    f"<body><div class='content'><div>{LINKS}</div><div>{PROSE}</div><div>{LINKS}</div></div></body>": TOLD,
    f"<body><article><div>{PROSE}</div><div>{LINKS}</div></article></body>": TOLD,
    f"<body><div><div>{PROSE}</div></div><div class='comments'>{'<p>I liked reading this.</p>' * 12}</div></body>": TOLD,
    f"<body><nav>{LINKS}</nav><article><h1>Short</h1><p>Brief.</article><footer>A line of the publisher that is longer than what the article says.</footer></body>": "Short Brief.",
}


@pytest.mark.parametrize("page", WRAPPED)
def test_names_do_not_cut_the_article(page):
    from accuracast.llm.html_text import main_text

    assert main_text(page) == WRAPPED[page]


def test_warc_round_trip(spark, tmp_path):
    from accuracast.llm import warc

    rows = [(1, "http://a/\r\nX: y", "<html lang=fr><title>T &amp; t</title><body><p>Un<p>deux é <a href='/l'>l</a></html>"), (2, None, None), (3, "http://c", ""), (3, "http://c", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    responses = warc.response_records(pages)
    found = warc.derivative_records(responses)
    got = found.collect()
    assert len(got) == 8 and found.columns == ["page_id", *warc.NAMES]
    source = {r.record_id: r for r in responses.collect()}
    for r in got:
        s = source[r.refers_to]
        assert s.page_id == r.page_id and s.target_uri == r.target_uri and r.block_digest == warc.digest(r.content.encode()) and r.content_length == len(r.content.encode())
        assert f"WARC-Refers-To: {s.record_id}" in r.headers
        if r.record_type == "metadata":
            assert f"source-payload-digest: {s.payload_digest}" in r.content and "source-header: Content-Type: text/html" in r.content
        else:
            assert f"WARC-Source-Payload-Digest: {s.payload_digest}" in r.headers
    first = {r.record_type: r for r in got if r.page_id == 1}
    assert first["conversion"].content == "Un\ndeux é l" and "title: T & t" in first["metadata"].content and "outlink: /l" in first["metadata"].content
    path = str(tmp_path / "warc")
    warc.write_warc(responses.unionByName(found), path)
    back = [x for f in os.listdir(path) if f.endswith(".gz") for x in warc.split_records(gzip.open(os.path.join(path, f)).read())]
    assert sorted(x["fields"]["WARC-Record-ID"] for x in back) == sorted([r.record_id for r in got] + [r.record_id for r in responses.collect()])
    assert all(warc.digest(x["content"].encode()) == x["fields"]["WARC-Block-Digest"] for x in back)
    assert warc.derivative_records(responses.limit(0)).count() == 0


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_pipeline_stages_match_plain_versions(spark):
    import corpus_pipeline as pipeline
    from accuracast.llm.minmax import near_duplicates
    from accuracast.llm.pii import private_spans
    from accuracast.llm.quality import apply_quality_rules
    from accuracast.llm.winnow import benchmark_spans
    from accuracast.session import written

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    kept = written(pipeline.quality(spark, docs, sf), "kept")
    assert ids(kept) == ids(apply_quality_rules(docs).where("kept")) and kept.columns == pipeline.COLUMNS
    once = written(pipeline.dedup(spark, written(kept.union(kept.limit(3)), "again"), sf), "once")
    assert ids(once) == sorted({r.doc_id for r in near_duplicates(kept, key="doc_id", threshold=80).where("kept").collect()})
    clean = written(pipeline.decontaminate(spark, once, sf), "clean")
    hits = {r.doc_id for r in benchmark_spans(once, spark.read.parquet(f"{sf}/benchmark.parquet"), key="doc_id").where("n_hit > 0").collect()}
    assert set(ids(clean)) == set(ids(once)) - hits
    masked = written(pipeline.private(spark, clean, sf), "masked")
    assert ids(masked) == ids(clean) and masked.columns == pipeline.COLUMNS
    assert written(private_spans(masked), "spans").where("exists(private_spans, x -> x.base)").count() == 0
    packed = pipeline.packing(spark, masked, sf)
    assert set(ids(packed)) == set(ids(masked))


def test_stages_tell_rows_apart_by_text(spark):
    import corpus_pipeline as pipeline

    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(n))
    a, b, c = text(60), text(60), text(300)
    near = c.split()
    near[100] = near[200] = "changed"  # 286 of 306 shingles: 0.93
    far = a.split()
    far[30] = "changed"  # 51 of 61: 0.836
    rows = [(3, a), (5, a), (5, b), (7, b), (None, c), (9, " ".join(near)), (11, None), (12, ""), (12, ""), (13, " ".join(far)), (3, a)]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOCS)
    got = sorted((r.doc_id, r.text or "") for r in pipeline.dedup(spark, docs, "").collect())
    assert got == sorted([(3, a), (5, b), (9, " ".join(near)), (11, ""), (12, ""), (12, "")])
    assert pipeline.dedup(spark, docs.limit(0), "").count() == 0


def test_contaminated_rows_go_whatever_their_id(spark, tmp_path):
    import corpus_pipeline as pipeline

    item = "what is the capital of the country that lies north of the great lake"
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"so {item} then"), (None, "clean"), (4, f"{item}!"), (4, "also clean"), (6, None), (6, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOCS)
    got = [(r.doc_id, r.text) for r in pipeline.decontaminate(spark, docs, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(None, "clean"), (4, "also clean"), (6, None), (6, "")], key=str)
    assert pipeline.decontaminate(spark, docs.limit(0), str(tmp_path)).count() == 0
