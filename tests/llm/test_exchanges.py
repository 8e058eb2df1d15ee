"""What is exchanged between tasks: whole texts only where another row may decide about them."""

from __future__ import annotations

import random

import pytest


def _shuffled(spark) -> int:
    """Bytes written by all shuffles of the session so far."""
    context = spark.sparkContext
    gateway = context._gateway
    found = context._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(found.apply(i).shuffleWriteBytes() for i in range(found.size()))


@pytest.fixture
def no_broadcast(spark):
    """Tables here are small; large ones are never broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_dedup_exchanges_only_texts_in_groups(spark, no_broadcast):
    import corpus_pipeline

    rng = random.Random(3)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(3000)) for _ in range(400)]
    rows = [(i, text) for i, text in enumerate(texts)]
    rows += [(1000, texts[3] + " end"), (1001, texts[3]), (3, texts[3]), (None, texts[4]), (5, texts[6]), (None, texts[7]), (None, "begin " + texts[7]), (2000, None), (2001, "")]
    docs = spark.createDataFrame([(i, t, "en", "web", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    before = _shuffled(spark)
    kept = corpus_pipeline.dedup(spark, docs, "").collect()
    size = sum(len(t) for t in texts)
    assert _shuffled(spark) - before < size / 4
    want = [(i, text) for i, text in enumerate(texts) if i != 6] + [(5, texts[6]), (2000, None), (2001, "")]
    order = lambda x: (-1 if x[0] is None else x[0], x[1] or "")
    assert sorted(((r.doc_id, r.text) for r in kept), key=order) == sorted(want, key=order)


def test_collocations_exchange_short_hashes(spark):
    from accuracast.llm.collocations import collocations

    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(1000)) + " new york" for _ in range(200)]
    docs = spark.createDataFrame([(t, "en") for t in texts], "values string, split string")
    before = _shuffled(spark)
    found = collocations(docs).collect()
    assert _shuffled(spark) - before < 10 * 200_000
    assert [(r.phrase, r.a, r.l, r.r, r.n) for r in found] == [("new york", 200, 200, 200, 200_400)]


def test_collocations_exchange_no_rare_triples_as_text(spark):
    from accuracast.llm.collocations import collocations

    rng = random.Random(6)
    texts = [" ".join(f"word{rng.randrange(30)}" for _ in range(1000)) + " new york" for _ in range(200)]
    docs = spark.createDataFrame([(t, "en") for t in texts], "values string, split string")
    before = _shuffled(spark)
    found = collocations(docs).collect()
    assert _shuffled(spark) - before < 15 * 200_000
    assert [(r.phrase, r.a, r.l, r.r, r.n) for r in found][0] == ("new york", 200, 200, 200, 200_400)
