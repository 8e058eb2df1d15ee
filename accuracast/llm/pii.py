"""Personal data by weak supervision: regex, gazetteer and context labelers vote, expectation
maximisation weighs the votes, and a span classifier learns from them. DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accuracast.llm.barrier import settled
from accuracast.session import written

#: Order of kinds in every listing.
KINDS = ["email", "ip", "card", "phone", "secret", "person"]
BASE_KINDS = KINDS[:4]
ROUNDS = 20

# Patterns of the base kinds. Possessive forms and look-behinds find the same matches as
# the plain ones in linear time; \G lets an email begin where the one before ended.
BASE_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# gazetteers
GIVEN_NAMES = (
    "James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen "
    "Hans Peter Klaus Ursula Jürgen Sabine Pierre Jean Marie Sophie Camille Luc José Carmen Javier Lucía Carlos Ana Miguel Elena"
).split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Mme Monsieur Madame Señor Señora".split()
TOP_DOMAINS = "com org net edu gov info io de fr es eu uk it nl ch at be pt".split()
DIAL_CODES = "1 7 20 27 30 31 32 33 34 39 41 43 44 45 46 47 48 49 52 54 55 61 64 81 82 86 90 91 351 352 353 358".split()
# Words before a span that speak for a kind, or against any
HINTS = {
    "email": "mail contact write reply", "ip": "ip addr host server client", "card": "card visa credit karte carte tarjeta",
    "phone": "phone tel call fax mobil", "secret": "token password passwd secret key credential", "person": "name signed dear from by",
}
COUNTER_HINTS = "order invoice isbn version section page chapter figure build release".split()
#: Wider candidates. A text without any of the marks is not searched.
WIDE_PATTERNS = {
    "email": (("(at)", "[at]"), r"[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++"),
    "phone": (("(", "00"), r"(?<![0-9+] ?)(?:\([0-9]{3}\) ?[0-9]{3}[- ][0-9]{4}|00[1-9](?: ?[0-9]){7,12})(?![0-9])"),
    # a key of 16 characters or more, joined by hyphens or underscores or not, with a letter and a digit
    "secret": (("",), r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]{16})(?=[0-9_-]*+[A-Za-z])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9]++(?:[_-]++[A-Za-z0-9]++)*+(?![A-Za-z0-9])"),
    "person": (tuple(TITLES + GIVEN_NAMES), rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{'|'.join(TITLES)})\.? (?:\p{{Lu}}\p{{Ll}}+)(?: \p{{Lu}}\p{{Ll}}+)?|(?:{'|'.join(GIVEN_NAMES)}) \p{{Lu}}\p{{Ll}}+)(?!\p{{L}})"),
}
LABELERS = ["pattern", "check", "gazetteer", "context", "edges"]
SHAPES = ["hinted", "countered", "mostly_digits", "letters_and_digits", "long", "very_long", "quoted", "after_sign", "capital"]


def located(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, s>>``: leftmost matches that do not overlap, in code points.

    Places come from the lengths of what lies between the matches, summed in blocks of 256.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    block = lambda i: F.floor(i / 256).cast("int")

    def place(m: Column) -> Column:
        def steps(between: Column) -> Column:
            return F.transform(m, lambda s, i: F.char_length(F.get(between, i)) + F.when(i > 0, F.char_length(F.get(m, i - 1))).otherwise(0))

        def starts(steps: Column) -> Column:
            sums = F.transform(F.sequence(F.lit(0), block(F.size(steps) - 1)), lambda b: total(F.slice(steps, b * 256 + 1, 256)))

            def span(sums: Column) -> Column:
                return F.transform(m, lambda s, i: F.struct((total(F.slice(sums, 1, block(i))) + total(F.slice(steps, block(i) * 256 + 1, i % 256 + 1))).alias("start"), s.alias("s")))

            return _let(sums, span)

        each = _let(_let(F.split(text, pattern, -1), steps), starts)
        return F.transform(each, lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.char_length(x["s"])).alias("end"), x["s"].alias("s")))

    return _let(found, lambda m: F.when(F.size(m) > 0, place(m)))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = F.translate(digits, "0123456789", "0246813579")
    n = F.char_length(digits)
    at = lambda i: F.when((n - i) % 2 == 0, F.substr(digits, i, F.lit(1))).otherwise(F.substr(doubled, i, F.lit(1)))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + at(i).cast("int")) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: p.cast("double") <= 255)
    n = F.char_length(_digits(s))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(s))).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _vote(plus: Column, minus: Column | None = None) -> Column:
    vote = F.when(plus, F.lit(1))
    return (vote if minus is None else vote.when(minus, F.lit(-1))).otherwise(0)


def _judged(text: Column, kind: str, base: bool, x: Column) -> Column:
    """A candidate with the votes of all labelers (base 3, as one number) and its shape (bits)."""
    s, digits = x["s"], _digits(x["s"])
    left = F.lower(F.substr(text, F.greatest(x["start"] - 23, F.lit(1)), F.least(x["start"], F.lit(24))))
    before, after = F.right(left, F.lit(1)), F.substr(text, x["end"] + 1, F.lit(1))
    hinted = left.rlike("(?:" + "|".join(HINTS[kind].split()) + r")")
    countered = left.rlike("(?:" + "|".join(COUNTER_HINTS) + r")")
    signed = before.isin("=", ":") | left.rlike("[=:] ?[\"'`]?$")
    pattern = F.lit(1) if base else {"email": F.lit(1), "phone": _vote(F.startswith(s, F.lit("("))), "secret": _vote(signed), "person": _vote(s.rlike("^(?:" + "|".join(TITLES) + r")\b"))}[kind]
    check = {
        "email": _vote(s.rlike(r"(?i)[.)\] ][a-z]{2,24}$"), s.rlike(r"\.[0-9-]+$")), "ip": _vote(~s.rlike(r"^0*\."), s.rlike(r"^0*\.")),
        "card": _vote(~digits.rlike(r"^(.)\1+$"), digits.rlike(r"^(.)\1+$")), "phone": _vote(F.char_length(digits).between(9, 13)),
        "secret": _vote(s.rlike("^[0-9a-f]+$"), ~s.rlike("[0-9].*[0-9]")), "person": F.lit(0),
    }[kind]
    gazetteer = {
        "email": _vote(F.lower(F.regexp_extract(s, r"([A-Za-z0-9-]+)$", 1)).isin(TOP_DOMAINS)),
        "ip": _vote(F.lit(False), s.rlike(r"^(?:10|127|0)\.|^192\.168\.")),
        "card": _vote(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"), digits.rlike("^[0179]")),
        "phone": _vote(digits.rlike("^(?:00)?(?:" + "|".join(DIAL_CODES) + ")")), "secret": F.lit(0),
        "person": _vote(F.regexp_extract(s, r"^(\p{L}+)", 1).isin(GIVEN_NAMES)),
    }[kind]
    inner = r"[\p{L}0-9_]"
    votes = [pattern, check, gazetteer, _vote(hinted & ~countered, countered), _vote(~before.rlike(inner) & ~after.rlike(inner), before.rlike(inner) | after.rlike(inner))]
    shape = [
        hinted, countered, F.char_length(digits) * 2 > F.char_length(s), s.rlike("[A-Za-z]") & s.rlike("[0-9]"), F.char_length(s) >= 16, F.char_length(s) >= 32,
        before.isin('"', "'", "`"), signed, s.rlike(r"^\p{Lu}"),
    ]
    code, bits = F.lit(0), F.lit(0)
    for v in votes:
        code = code * 3 + v + 1
    for i, b in enumerate(shape):
        bits = bits + F.when(b, 1 << i).otherwise(0)
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(base).alias("base"), code.cast("int").alias("votes"), bits.cast("int").alias("shape")
    )


def _valid_of(kind: str):
    return lambda x: _valid(kind, x["s"])


def _judge_of(text: Column, kind: str, base: bool):
    return lambda x: _judged(text, kind, base, x)


def with_candidates(df: DataFrame, text: str = "text", out: str = "candidates") -> DataFrame:
    """``df`` with ``array<struct<kind, start, end, base, votes, shape>>`` over the whole of ``text``."""
    t = F.coalesce(F.col(text), F.lit(""))
    # most texts have no digit, and a text that cannot match is not decoded for a pattern
    df = df.withColumn("_digit", settled(t.rlike("[0-9]")))
    digit = F.col("_digit")
    marks = {"email": F.contains(t, F.lit("@")), "phone": digit & F.contains(t, F.lit("+")), "ip": digit & F.contains(t, F.lit(".")), "card": digit}
    none = F.array().cast("array<struct<kind:int,start:int,end:int,base:boolean,votes:int,shape:int>>")
    found = {}
    for kind, pattern in BASE_PATTERNS.items():
        valid = F.filter(located(t, pattern), _valid_of(kind))
        found[f"_{kind}"] = F.when(marks[kind], F.transform(valid, _judge_of(t, kind, True)))
    out_df = df.withColumns({k: F.coalesce(v, none) for k, v in found.items()})
    base = F.concat(*[F.col(k) for k in found])
    out_df = out_df.withColumn("_base", settled(base)).drop(*found)
    wide = {}
    for kind, (signs, pattern) in WIDE_PATTERNS.items():
        sign = t.rlike(r"(?<!\p{L})(?=\p{Lu})(?:" + "|".join(signs) + r")(?!\p{L})") if kind == "person" else F.lit(False)
        if kind == "secret":
            sign = F.lit(True)
        elif kind != "person":
            for x in signs:
                sign = sign | F.contains(t, F.lit(x))
            sign = sign if kind == "email" else digit & sign
        wide[f"_{kind}"] = F.coalesce(F.when(sign, F.transform(located(t, pattern), _judge_of(t, kind, False))), none)
    out_df = out_df.withColumns(wide)
    clear = lambda x: ~F.exists("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    return out_df.withColumn(out, settled(F.concat("_base", F.filter(F.concat(*[F.col(k) for k in wide]), clear)))).drop("_base", "_digit", *wide)


@dataclass(frozen=True)
class SpanModel:
    """Weights of the span classifier, by kind and shape, and what EM found out about the labelers."""

    bias: float
    kinds: tuple[float, ...]
    shapes: tuple[float, ...]
    reliability: dict[str, float]
    priors: tuple[float, ...]

    def margin(self, x: Column) -> Column:
        """Log odds that a candidate is personal data."""
        score = F.lit(self.bias)
        for i, w in enumerate(self.kinds):
            score = score + F.when(x["kind"] == i, F.lit(w)).otherwise(0.0)
        for i, w in enumerate(self.shapes):
            score = score + F.when(x["shape"].bitwiseAND(1 << i) != 0, F.lit(w)).otherwise(0.0)
        return score


def fit_span_model(candidates: DataFrame, column: str = "candidates") -> SpanModel:
    """Learn from the candidates of all rows.

    They are counted by kind, votes and shape; all rounds work on these counts, whose number is bounded
    by the labelers and not by the data. EM alternates between the posterior of each vote pattern, the
    share of true candidates per kind and the reliability of each labeler: how often it is right when it
    votes. An abstention says nothing. A logistic regression then learns kind and shape from the
    posteriors.
    """
    x = candidates.select(F.explode(column).alias("x")).select("x.kind", "x.votes", "x.shape")
    counts = written(x.groupBy("kind", "votes", "shape").agg(F.count(F.lit(1)).cast("double").alias("c")), "votes")
    n = len(LABELERS)
    vote = [(F.floor(F.col("votes") / 3 ** (n - 1 - j)) % 3 - 1).cast("double").alias(f"v{j}") for j in range(n)]
    patterns = written(counts.groupBy("kind", "votes").agg(F.sum("c").alias("c")).select("*", *vote), "patterns").coalesce(1)

    def posterior(priors: list[float], right: list[float]) -> Column:
        odds = F.get(F.array(*[F.lit(math.log(q / (1 - q))) for q in priors]), F.col("kind"))
        for j, a in enumerate(right):
            odds = odds + F.col(f"v{j}") * math.log(a / (1 - a))
        return settled(1 / (1 + F.exp(-odds)))

    priors, right = [0.5] * len(KINDS), [0.75] * n
    p, c = F.col("p"), F.col("c")
    sums = [F.sum(c * p).alias("k"), F.sum(c).alias("n")]
    for j in range(n):
        v = F.col(f"v{j}")
        sums += [F.sum(c * F.abs(v) * F.when(v > 0, p).otherwise(1 - p)).alias(f"r{j}"), F.sum(c * F.abs(v)).alias(f"v{j}")]
    for _ in range(ROUNDS):
        rows = patterns.withColumn("p", posterior(priors, right)).groupBy("kind").agg(*sums).collect()  # a row per kind
        by = {r.kind: r for r in rows}
        before = priors + right
        priors = [(by[k].k + 1) / (by[k].n + 2) if k in by else 0.5 for k in range(len(KINDS))]
        # a labeler is taken to be better than chance, which also fixes which side is the truth
        right = [min(0.99, max(0.55, (sum(r[f"r{j}"] for r in rows) + 3) / (sum(r[f"v{j}"] for r in rows) + 4))) for j in range(n)]
        if max(abs(x - y) for x, y in zip(before, priors + right)) < 1e-4:
            break
    reliability = dict(zip(LABELERS, right))
    if counts.isEmpty():
        return SpanModel(-1.0, (0.0,) * len(KINDS), (0.0,) * len(SHAPES), reliability, tuple(priors))
    soft = written(counts.select("*", *vote).withColumn("p", posterior(priors, right)), "posteriors")
    both = soft.select("*", F.lit(1.0).alias("label"), (F.col("c") * F.col("p") + 1e-6).alias("w")).union(soft.select("*", F.lit(0.0).alias("label"), (F.col("c") * (1 - F.col("p")) + 1e-6).alias("w")))
    names = [f"k{k}" for k in range(len(KINDS))] + [f"s{i}" for i in range(len(SHAPES))]
    both = both.withColumns({f"k{k}": (F.col("kind") == k).cast("double") for k in range(len(KINDS))} | {f"s{i}": (F.col("shape").bitwiseAND(1 << i) != 0).cast("double") for i in range(len(SHAPES))})
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(both.coalesce(1))
    fit = LogisticRegression(weightCol="w", regParam=1e-3, maxIter=50, standardization=False).fit(rows)
    w = [float(v) for v in fit.coefficients]
    return SpanModel(float(fit.intercept), tuple(w[: len(KINDS)]), tuple(w[len(KINDS) :]), reliability, tuple(priors))


def private_spans(df: DataFrame, text: str = "text", model: SpanModel | None = None) -> DataFrame:
    """``df`` with ``private_spans array<struct<kind string, start, end, base>>`` by kind, then start.

    General operator: the project's panels hold no free text. Email, ip, card and phone spans of the
    base patterns always stay; wider candidates (spelled-out addresses, national numbers, secrets, names
    after a title or a known given name) stay if the classifier gives them even odds or more and no base
    span overlaps them. Places are code points, ends exclusive. NULL and empty texts have no span.
    Without a ``model`` one is fitted on all rows of ``df``.

    Scale: candidates are found in a projection. Fitting shuffles counts of vote patterns only.
    """
    found = with_candidates(df, text, "_candidates")
    model = model or fit_span_model(found, "_candidates")
    chosen = F.filter("_candidates", lambda x: x["base"] | (model.margin(x) >= 0))
    ordered = F.array_sort(F.transform(chosen, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(ordered, lambda x: F.struct(F.get(names, x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base")))
    return found.withColumn("private_spans", spans).drop("_candidates")


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def mask_private(df: DataFrame, text: str = "text", model: SpanModel | None = None) -> DataFrame:
    """``df`` with every private span of ``text`` replaced by its kind in capitals and brackets.

    Of overlapping spans the first, then the longer, is named and the rest of the others masked with it.
    NULL stays NULL; texts without a span stay as they are.
    """
    found = private_spans(df, text, model)
    spans = F.array_sort(F.transform("private_spans", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"))))
    piece = lambda a, b: F.substr(F.col(text), a + 1, b - a)

    def step(acc: Column, x: Column) -> Column:
        end = -x["back"]
        new = F.concat(acc["out"], piece(acc["at"], x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        fresh = x["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], end).alias("at"), F.when(fresh, new).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substr(F.col(text), a["at"] + 1, F.char_length(F.col(text)))))
    return found.withColumn(text, F.when(F.size("private_spans") > 0, whole).otherwise(F.col(text))).drop("private_spans")
