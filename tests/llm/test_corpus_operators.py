"""Filter audit, shared passages and collocations against plain versions."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest

CLASH = ("p", "m", "n", "f0", "key", "text", "lost", "a", "hash", "phrase", "rank", "kept", "step", "words", "_digest")


def clash(df, keep):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in CLASH if c not in keep})


def plain_audit(rows, names):
    """rows: (part, failed names, flagged)."""
    out = {}
    for part in {p for p, _, _ in rows}:
        mine = [(f, g) for p, f, g in rows if p == part]
        shapley = Counter()
        for order in permutations(names):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[0]]
                left = [r for r in left if x not in r[0]]
                shapley[x] += len(gone)
                out[part, ">".join(order), step] = (x, len(left), len(gone), sum(x in f for f, _ in mine) - len(gone), sum(f == {x} for f, _ in mine), sum(g for _, g in gone))
        for k in [k for k in out if k[0] == part]:
            out[k] = out[k][:6] + (shapley[out[k][0]],)
    return out


@pytest.mark.parametrize("names", [["short"], ["short", "sparse", "copy"], ["A", "B", "C", "D"]])
def test_filter_audit_of_series(spark, names):
    from accuracast.llm.filter_audit import filter_audit

    rng = random.Random(len(names))
    rows = [(rng.choice(["train", "test", None, ""]), {x for x in names if rng.random() < 0.4}, rng.random() < 0.3) for _ in range(90)]
    rows += rows[:7]
    data = [(p, *[True if x in f else rng.choice([False, None]) for x in names], g or None) for p, f, g in rows]
    df = clash(spark.createDataFrame(data, f"split string, {', '.join(f'is_{x} boolean' for x in names)}, good boolean"), ())
    got = filter_audit(df, {x: f"is_{x}" for x in names}, flags={"good": "good"})
    assert got.columns == ["split", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "shapley"]
    want = plain_audit([(p or "", f, g) for p, f, g in rows], names)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == want
    assert filter_audit(df.limit(0), {x: f"is_{x}" for x in names}).count() == 0


def test_filter_audit_wants_one_to_six(spark):
    from accuracast.llm.filter_audit import filter_audit

    df = spark.createDataFrame([("a",)], "split string")
    for n in (0, 7):
        with pytest.raises(ValueError):
            filter_audit(df, {f"f{i}": "true" for i in range(n)})


def test_repeats_smaller(spark, make):
    from pyspark.sql import functions as F

    from accuracast.llm.filter_audit import repeats_smaller

    rows = [(1, "x"), (2, "x"), (2, "x"), (3, None), (4, None), (5, ""), (None, "x"), (6, "y" * 200_000), (7, "y" * 200_000)]
    df = clash(spark.createDataFrame(rows, "series_id bigint, values string"), ()).withColumn("repeated", F.lit(3))
    got = sorted((r.series_id or 0, r.repeated) for r in repeats_smaller(df).collect())
    assert got == [(0, False), (1, False), (2, True), (2, True), (3, False), (4, True), (5, False), (6, False), (7, True)]
    series = make({"a": [1, 2, 3], "b": [1, 2, 3], "c": [1, 2, 4]}).groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("pos", "y"))).alias("values"))
    assert {r.series_id: r.repeated for r in repeats_smaller(series).collect()} == {"a": False, "b": True, "c": False}
    assert repeats_smaller(df.limit(0)).count() == 0


def plain_spans(rows, span):
    tokens = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
    least = {}
    for k, t in rows:
        w = tokens(t)
        for i in range(len(w) - span + 1):
            if k is not None:
                g = tuple(w[i : i + span])
                least[g] = min(k, least.get(g, k))
    out = []
    for k, t in rows:
        w = tokens(t)
        gone = {p for i in range(len(w) - span + 1) if k is not None and least[tuple(w[i : i + span])] < k for p in range(i, i + span)}
        out.append((k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return Counter(out)


@pytest.mark.parametrize("span", [1, 2, 5, 13, 26])
def test_shared_spans_match_plain(spark, span):
    from accuracast.llm.shared_spans import remove_shared_spans

    rng = random.Random(span)
    vocabulary = ["a", "A", "déjà", "日本", "x y", "10", "e.g.", "\x00", "b"]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(span, 3 * span))) for _ in range(6)]
    rows = []
    for k in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 5))]
        rows.append((k * 7 % 61, rng.choice([" ", "\n", " \t\x0b"]).join(parts)))
    rows += [(None, passages[0]), (None, None), (100, None), (101, ""), (102, " \n"), (103, "w " * 20_000), (104, "w " * 40), (5, passages[1]), (5, passages[1]), (3, passages[2] + " " + passages[2])]
    df = clash(spark.createDataFrame(rows, "series_id bigint, values string"), ())
    got = remove_shared_spans(df, span=span)
    assert got.columns == ["series_id", "n_values", "n_removed", "kept_values"]
    assert Counter(map(tuple, got.collect())) == plain_spans(rows, span)


def test_shared_spans_with_a_full_table_of_bits(spark):
    from accuracast.llm.shared_spans import remove_shared_spans

    rng = random.Random(2)
    passage = " ".join(str(rng.random()) for _ in range(40))
    rows = [(i, f"{i} {passage if i % 3 == 0 else ''} {' '.join(str(rng.random()) for _ in range(30))}") for i in range(30)]
    df = spark.createDataFrame(rows, "series_id bigint, values string")
    assert Counter(map(tuple, remove_shared_spans(df, filter_bits=7).collect())) == plain_spans(rows, 13)


def test_shared_spans_of_a_panel(make):
    from accuracast.llm.shared_spans import panel_values, remove_shared_spans

    wave = [i * i % 31 for i in range(40)]
    panel = make({"a": wave, "b": [100, *wave[5:25], None, 7], "c": [None] * 20, "d": [1, 2, 3]})
    got = {r.series_id: r for r in remove_shared_spans(panel_values(panel)).collect()}
    assert (got["a"].n_removed, got["b"].n_removed, got["c"].n_removed, got["d"].n_removed) == (0, 20, 0, 0)
    assert got["b"].kept_values == "100.0 null 7.0" and got["b"].n_values == 23
    assert remove_shared_spans(panel_values(panel.limit(0))).count() == 0


def test_cover_takes_any_two_positions_to_a_common_shift():
    from accuracast.llm.shared_spans import COVERS, cover_for

    for period, cover in COVERS.items():
        assert all(any((i + s) % period in cover and (j + s) % period in cover for s in range(period)) for i in range(period) for j in range(period))
    assert cover_for(13) == (7, (0, 1, 3), 7)


def plain_collocations(rows, longest, least, top):
    count, total = Counter(), Counter()
    for part, text in rows:
        part = "und" if part is None else part
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[part] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    count[part, tuple(w[i : i + n])] += 1
    found = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    dropped = {(p, g[i : i + n]) for (p, g), f in found.items() for n in range(2, len(g)) for i in range(len(g) - n + 1) if 100 * f >= 80 * found.get((p, g[i : i + n]), 10**30)}
    out = []
    for part in total:
        best = []
        for (p, g), a in found.items():
            if p == part and (p, g) not in dropped:
                score, k = min((2_000_000 * a // (count[p, g[:k]] + count[p, g[k:]]), k) for k in range(1, len(g)))
                best.append((-score, -a, " ".join(g).encode(), count[p, g[:k]], count[p, g[k:]]))
        out += [(part, i, x[2].decode(), -x[1], x[3], x[4], total[part], -x[0]) for i, x in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("longest,period,bits", [(4, 32, 26), (4, 1, 26), (3, 5, 7), (2, 4, 26)])
def test_collocations_match_plain(spark, longest, period, bits):
    from accuracast.llm.collocations import collocations

    rng = random.Random(longest * 100 + period)
    vocabulary = ["Tax", "tax", "rate", "of", "été", "日本", "-", "\x00", "x1", "O'Neil"]
    line = "the long Common line, of twenty words; that all of them hold at the end of each and every text here."
    rows = []
    for _ in range(80):
        body = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " \x0b"]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "en", "fr", None]), body + (line if rng.random() < 0.5 else "")))
    rows += rows[:20] + [("en", None), ("fr", ""), ("de", "one two"), ("es", " .;\n"), ("en", "tax " * 30_000), ("en", "long" * 50_000)]
    df = clash(spark.createDataFrame(rows, "split string, values string"), ())
    got = collocations(df, longest=longest, least=8, top=25, period=period, filter_bits=bits)
    assert got.columns == ["split", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, longest, 8, 25)
    assert collocations(df.limit(0)).count() == 0


def test_motifs_of_a_panel(make):
    from pyspark.sql import functions as F

    from accuracast.llm.collocations import collocations, panel_symbols

    panel = make({"a": [0, 1, 2, 1] * 20, "b": [3, 3, None, 4, 5, 4]})
    moves = panel_symbols(panel).withColumn("split", F.lit("test"))
    assert {r.series_id: r["values"] for r in moves.collect()}["b"] == ". e . . u d"
    got = collocations(moves, least=10)
    rows = [("test", r["values"]) for r in moves.collect()]
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 4, 10, 2000) and got.count() > 0


def test_score_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = spark.range(1).select((F.lit(6 * 10**18)).alias("f"), F.lit(5 * 10**18).alias("l"), F.lit(7 * 10**18).alias("r"))
    whole = "cast(f as decimal(20,0)) * cast(2000000 as decimal(10,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"
    assert big.select(F.expr(whole)).first()[0] == 2_000_000 * 6 * 10**18 // (12 * 10**18)


def test_equal_routes_are_dealt_over_their_ranges(spark):
    from accuracast.llm.packing import retrieval_pack

    same = "the same text about the same tax again and again " * 30
    rows = [(i, same if i % 3 else f"text {i} of its own kind k{i % 7}") for i in range(300)]
    out = retrieval_pack(spark.createDataFrame(rows, "series_id bigint, text string").repartition(3))
    got = out.selectExpr("series_id", "length", "doc_tokens", "sequence_id >> 36 as task").collect()
    total, size = Counter(), {}
    for r in got:
        total[r.series_id] += r.length
        size[r.series_id] = r.doc_tokens
    assert len(total) == 300 and total == size
    tasks = Counter(r.task for r in got if r.series_id % 3)
    assert len(tasks) >= 2 and max(tasks.values()) < 0.8 * sum(tasks.values())
