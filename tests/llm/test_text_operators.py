"""Quality rules, near-duplicates, benchmark passages and private data against plain versions."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

EDGE = {1: None, 2: "", 3: " \n\t ", 4: "one", 5: "a b c d e f g h i j k l", 6: "a b c d e f g h i j k l", 7: "x" * 300_000, 8: "A B C D E F G H I J K L", 9: "w " * 40_000}


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _quality(text):
    text, w = text or "", _words(text)
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    counts, covered, seen, dup = Counter(windows), set(), set(), 0
    for k, x in enumerate(windows):
        if counts[x] > 1:
            covered.update(range(k, k + 5))
    for line in text.split("\n"):
        if _words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_measures(docs):
    from accuracast.llm.quality import apply_quality_rules

    rng = random.Random(3)
    rows = EDGE | {100 + i: " ".join(rng.choice("ab cd ef gh\n %% | ij\n kl".split(" ")) for _ in range(rng.randint(1, 90))) for i in range(60)}
    got = apply_quality_rules(docs(rows, clash=True)).collect()
    for r in got:
        want = _quality(rows[r.series_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.series_id
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    assert len(got) == len(rows) and apply_quality_rules(docs({})).count() == 0


def test_quality_filter_and_rules(docs):
    from accuracast.llm.quality import Rule, apply_quality_rules, keep_passing

    prose = "the cat and the dog went to a house on that hill and it was for them as good as is"
    df = docs({1: prose, 2: "%%% ### " * 6 + prose, 3: None, 4: prose})
    assert [r.series_id for r in keep_passing(df).orderBy("series_id").collect()] == [1, 4]
    failed = apply_quality_rules(df, rules=[Rule("symbol_ratio", high=0.1)]).select("series_id", "failed_rules", "kept").orderBy("series_id").collect()
    assert failed[0].kept and failed[1].failed_rules == ["symbol_ratio"] and not failed[2].kept


def _sets(rows):
    out = {}
    for i, t in rows.items():
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def _components(rows, threshold=85):
    sets, comp = _sets(rows), {i: i for i in rows}
    ids = sorted(rows)
    changed = True
    links = [(i, j) for i in ids for j in ids if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(comp[i], comp[j])
            if comp[i] != low or comp[j] != low:
                comp[i] = comp[j] = low
                changed = True
    return comp, {i: len(s) for i, s in sets.items()}


def test_near_duplicates_match_all_pairs(docs):
    from accuracast.llm.minmax import near_duplicates

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, base = dict(EDGE), [rng.choice(vocabulary) for _ in range(150)]
    for i in range(120):  # around the threshold, so that links form chains
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(150)] = rng.choice(vocabulary)
        rows[1000 + i] = " ".join(copy)
    for i in range(40):
        rows[2000 + i] = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60)))
    comp, sizes = _components(rows)
    got = near_duplicates(docs(rows, clash=True)).collect()
    assert len(got) == len(rows)
    assert {r.series_id: r.component_id for r in got} == comp
    assert {r.series_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.series_id == r.component_id) for r in got)


def test_near_duplicates_edges(docs):
    from accuracast.llm.minmax import near_duplicates

    assert near_duplicates(docs({})).count() == 0
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (3, "A B C D E F"), (3, "A B C D E F")]
    got = sorted(((r.series_id, r.component_id, r.kept) for r in near_duplicates(docs(rows)).collect()), key=str)
    assert got == sorted([(None, None, True), (None, None, True), (4, 3, False), (3, 3, True), (3, 3, True)], key=str)


def test_blocks_of_a_large_bucket_lose_no_link():
    import numpy as np

    from accuracast.llm.minmax import link_block

    sets = [np.arange(a, a + 100, dtype=np.uint64) for a in (0, 5, 10, 500, 505, 9000)]
    links = link_block(np.arange(6), np.arange(6), sets, 85)
    assert {frozenset(x) for x in links} == {frozenset((0, 1)), frozenset((1, 2)), frozenset((3, 4))}


def test_components(spark):
    from accuracast.llm.components import components

    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (200, 100)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 100}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def _hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        n = min(10, len(x))
        windows = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_benchmark_spans_match_brute_force(spark, docs):
    from accuracast.llm.winnow import benchmark_spans

    rng = random.Random(11)
    w = [f"t{i}" for i in range(30)] + ["Été", "ß"]
    pick = lambda n: [rng.choice(w) for _ in range(n)]
    items = [(i, " ".join(pick(rng.randint(9, 40)))) for i in range(25)] + [(90, "alpha Beta"), (91, "gamma"), (92, ""), (93, None), (94, "Alpha beta"), (None, "delta epsilon zeta")]
    rows = dict(EDGE)
    for i in range(80):
        t = pick(rng.randint(0, 30))
        part = rng.choice(items)[1] or ""
        cut = part.split()[rng.randint(0, 3) :]
        rows[100 + i] = ", ".join(t + cut + pick(rng.randint(0, 10)))
    rows[300] = "x ALPHA, beta; gamma! delta epsilon-zeta"
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.series_id: (r.n_words, r.n_hit, list(r["items"])) for r in benchmark_spans(docs(rows, clash=True), table).collect()}
    named = [(i, t) for i, t in items if i is not None]
    for i, t in rows.items():
        n, hit, found = _hits(t, items)
        assert got[i] == (n, hit, [x for x in _hits(t, named)[2]]), i
    assert benchmark_spans(docs({}), table).count() == 0
    assert all(r.n_hit == 0 for r in benchmark_spans(docs(rows), table.limit(0)).collect())


def test_winnowing_sees_every_span_of_ten():
    import numpy as np

    from accuracast.llm.textarrays import U
    from accuracast.llm.winnow import winnow

    rng = np.random.default_rng(0)
    for _ in range(200):
        shared = rng.integers(0, 6, 10).astype(U)
        a, b = (np.concatenate((rng.integers(0, 6, rng.integers(0, 9)).astype(U), shared, rng.integers(0, 6, rng.integers(0, 9)).astype(U))) for _ in range(2))
        assert set(winnow(a, np.array([0, len(a)]))[1].tolist()) & set(winnow(b, np.array([0, len(b)]))[1].tolist())


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _valid(kind, s):
    digits = [int(c) for c in s if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and luhn % 10 == 0
    return True


@pytest.fixture(scope="module")
def private_rows():
    rng = random.Random(2)
    pieces = ["a@b.c", "x.y@z-1.org", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (918) 555-3922", "+12", "é😀", ".", "@", "_", " ", "-", "5", 'token = "deadbeef00112233"', "\n", "x"]
    rows = EDGE | {7: "x" * 2000} | {100 + i: "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for i in range(250)}
    rows[900] = " ".join("u%d@h.de" % i for i in range(1200))
    return rows


def test_private_spans_match_plain_patterns(docs, private_rows):
    from accuracast.llm.pii import private_spans, span_list

    found = private_spans(docs(private_rows, clash=True)).select("series_id", span_list(F.filter("private_spans", lambda x: x["base"])).alias("base"), "private_spans").collect()
    assert len(found) == len(private_rows)
    for r in found:
        t = private_rows[r.series_id] or ""
        want = [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, t) if _valid(k, m.group())]
        assert r.base == ",".join(want), (r.series_id, t[:80])
        base = [s for s in r.private_spans if s.base]
        assert not any(s.start < b.end and b.start < s.end for s in r.private_spans if not s.base for b in base)


def test_mask_and_wide_spans(docs):
    from accuracast.llm.pii import fit_span_model, mask_private, with_candidates

    rows = {1: None, 2: "", 3: "nothing here", 4: "Dear Mr. Smith, password=abcdef0123456789ab ip 1.2.3.4.5", 5: "é😀 a@b.de and 4111 1111 1111 1111.", 6: "joe (at) mail (dot) com"}
    df = docs(rows)
    model = fit_span_model(with_candidates(df))
    got = {r.series_id: r.text for r in mask_private(df, model=model).collect()}
    assert got == {1: None, 2: "", 3: "nothing here", 4: "Dear [PERSON], password=[SECRET] ip [IP].5", 5: "é😀 [EMAIL] and [CARD].", 6: "[EMAIL]"}
    assert all(0.5 < v < 1 for v in model.reliability.values())
    assert mask_private(docs({})).count() == 0


def test_sql_twins(spark):
    from oracle import compare, connect

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in ("op5_quality_rules", "op6_minmax_dedup", "op9_winnow_decontamination"):
        assert compare(spark, connect(sf), sf, queries[name], oracles[name]) is None
    assert {n.split("_")[0] for n in queries if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in queries


def test_digest_of_base_spans(spark):
    import __spark_entry__ as entry

    row = entry.queries()["op1_pii"](spark, "/root/testdata/sf0.001").where("n_email + n_ip + n_card + n_phone = 0").first()
    assert row.base_sha256 == hashlib.sha256(b"").hexdigest()
