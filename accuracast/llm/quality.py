"""Text quality rules: one table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accuracast.llm.barrier import settled

# Frequent function words of the four languages
STOP_WORDS = {
    "en": "the of and to in is that it for as was with be by on not he at this are or from an but have his they a".split(),
    "fr": "de la le et les des en un une du dans est que pour qui au sur par pas plus ne se ce il avec sont".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus".split(),
    "es": "de la que el en y a los del se las por un para con no una su al es lo como más pero sus".split(),
}


@dataclass(frozen=True)
class Rule:
    """A text passes if ``low <= metric <= high``; texts of fewer than ``from_words`` words are not tested."""

    metric: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: Ratios are shares of words, of characters in words, or of lines that hold a word.
RULES = [
    Rule("n_words", low=10),
    Rule("mean_word_chars", low=2, high=40),
    Rule("symbol_ratio", high=0.1),
    Rule("bar_word_ratio", high=0.1),
    Rule("shout_word_ratio", high=0.3, from_words=20),
    Rule("stop_word_ratio", low=0.01, from_words=50),
    Rule("repeat_word_ratio", high=0.2),
    Rule("dup_line_ratio", high=0.5),
    Rule("bullet_line_ratio", high=0.9),
    Rule("ellipsis_line_ratio", high=0.5),
]

#: What ``text_measures`` adds.
MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_word_chars", "symbol_ratio", "bar_word_ratio",
    "shout_word_ratio", "stop_word_ratio", "repeat_word_ratio", "dup_line_ratio", "bullet_line_ratio", "ellipsis_line_ratio",
]
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def _counts(text: Column) -> dict[str, Column]:
    """Columns that later ones refer to by name, level by level."""
    letters = F.translate(text, SPACE, "")
    return {
        "_words": F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""),
        "_lines": F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE, "") != ""),
        "word_chars": F.char_length(letters).cast("bigint"),
        "n_symbols": (F.char_length(letters) - F.char_length(F.translate(letters, SYMBOLS, ""))).cast("bigint"),
    }


def _covered(places: Column) -> Column:
    """Words covered by 5-word windows at the given places, in order."""
    return F.aggregate(F.transform(places, lambda p, i: F.least(F.lit(5), F.coalesce(F.get(places, i + 1) - p, F.lit(5)))), F.lit(0), lambda a, x: a + x)


def text_measures(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``df`` with the measures of ``text``: counts (bigint) and the ratios that rules can name.

    A NULL text has no words: all counts are 0 and the ratios NULL. Word is a run of characters other
    than space, tab, newline, vertical tab, form feed and carriage return. Columns of the input that
    carry a measure's name are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    out = df.withColumns(_counts(t))
    # Windows are compared by 64-bit hashes. Only where two are equal they are sorted with their places:
    # a repeated window then stands beside its equal.
    n = F.size("_words")
    out = out.withColumns({"n_words": n.cast("bigint"), "_hashes": F.when(n >= 5, F.transform("_words", lambda w: F.xxhash64(w)))})
    # without ANSI mode the size of NULL is -1 and the places would run backwards
    starts = F.when(F.col("_hashes").isNotNull(), F.sequence(F.lit(1), F.size("_hashes") - 4))
    out = out.withColumn("_at", F.transform(starts, lambda i: F.xxhash64(F.slice(F.col("_hashes"), i, 5)))).drop("_hashes")
    again = F.size(F.array_distinct("_at")) < F.size("_at")
    out = out.withColumn("_sorted", F.when(again, F.sort_array(F.transform("_at", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_at")
    near = lambda i: F.get(F.col("_sorted"), i)["h"]
    same = F.transform("_sorted", lambda x, i: F.when((x["h"] == near(i - 1)) | (x["h"] == near(i + 1)), x["i"]))
    out = out.withColumn("_places", F.sort_array(F.array_compact(same))).drop("_sorted")
    headed = lambda x, *heads: F.greatest(*[F.startswith(F.ltrim(x), F.lit(h)) for h in heads])
    lines, words = F.size("_lines"), F.size("_words")
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    count = lambda a, f: F.size(F.filter(a, f))
    out = out.withColumns({
        "n_repeat_words": F.coalesce(_covered(F.col("_places")), F.lit(0)).cast("bigint"),
        "n_dup_lines": (lines - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "mean_word_chars": ratio(F.col("word_chars"), words),
        "symbol_ratio": ratio(F.col("n_symbols"), F.col("word_chars")),
        "bar_word_ratio": ratio(count("_words", lambda x: x == "|"), words),
        "shout_word_ratio": ratio(count("_words", lambda x: F.endswith(x, F.lit("!!"))), words),
        "stop_word_ratio": ratio(count("_words", lambda x: F.lower(x).isin(stop)), words),
        "bullet_line_ratio": ratio(count("_lines", lambda x: headed(x, "-", "*", "•", "·")), lines),
        "ellipsis_line_ratio": ratio(count("_lines", lambda x: F.endswith(F.rtrim(x), F.lit("...")) | F.endswith(F.rtrim(x), F.lit("…"))), lines),
    })
    out = out.withColumns({"repeat_word_ratio": ratio(F.col("n_repeat_words"), words), "dup_line_ratio": ratio(F.col("n_dup_lines"), lines)})
    return out.drop("_words", "_lines", "_places")


def failed_rules(rules: list[Rule]) -> Column:
    """Names of the rules a row breaks; a NULL metric (no words, no lines) breaks none."""
    tests = []
    for r in rules:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (F.col(r.metric) < r.low)
        if r.high is not None:
            bad = bad | (F.col(r.metric) > r.high)
        tests.append(F.when(bad & (F.col("n_words") >= r.from_words), F.lit(r.metric)))
    return F.array_compact(F.array(*tests))


def apply_quality_rules(df: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``df`` with all measures, ``failed_rules array<string>``, ``base_failed`` and ``kept``.

    General operator: the project has no records of running text, so any table with a text column will
    do. ``base_failed``: fewer than 10 words, or over 20 % of them inside repeated 5-word windows; such
    a row is never kept. Every other row is kept when it breaks no rule. NULL and empty texts fail for
    want of words, repeated rows are judged alike, and an empty table stays empty.

    Scale: a projection. No shuffle, no Python; the work per row is n log n at most, and only texts with
    a repeated window sort anything. Filters on what is added stay above the projection, so they cost
    nothing more. Columns of ``df`` that carry the name of an added one are replaced (``keep_passing``
    keeps them).
    """
    out = text_measures(df, text)
    out = out.withColumn("failed_rules", failed_rules(RULES if rules is None else rules))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumn("base_failed", base).withColumn("kept", ~base & (F.size("failed_rules") == 0))
    added = ["failed_rules", "base_failed", "kept", *MEASURES]
    return out.withColumns({c: settled(F.col(c)) for c in added})


def keep_passing(df: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The rows of ``df`` that pass, with its own columns."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(text).alias("_text"))
    return apply_quality_rules(rows, "_text", rules).where("kept").select("_row.*")
