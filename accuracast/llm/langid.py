"""Language of a text: sparse multinomial logistic regression on TF-IDF character n-grams, trained with
follow-the-regularised-leader and elastic-net penalties, then calibrated by temperature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accuracast.llm.textarrays import slices, text_buffers
from accuracast.session import written

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Expected labelled texts per language that the classifier is fitted on.
SAMPLE_PER_LANGUAGE = 1500
EPOCHS = 3
#: FTRL: step size, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.05, 0.01
#: Sum of the TF-IDF values of a text, which brings them to the size that step and penalties assume.
SCALE = 30.0
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point, its lower-case form if it is a letter, else 0."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters.append(table)
    return _letters[0]


def gram_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text, letters): hashed 1- to 3-grams of all texts, the text of each, letters per text.

    Runs of anything but letters become one space, and every text has one before and behind it.
    """
    data, offsets = text_buffers(column)
    n = len(offsets) - 1
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before each byte
    table = letter_table()
    low = table[points]
    owner = np.repeat(np.arange(n), np.diff(heads[offsets]))
    letters = np.bincount(owner[low > 0], minlength=n)
    # one space at each text's start, then what is kept of it: letters, and the first of other runs
    first = np.ones(len(low), bool)
    first[1:] = (low[1:] > 0) | (low[:-1] > 0) | (owner[1:] != owner[:-1])
    low, owner = low[first], owner[first]
    begin = np.searchsorted(owner, np.arange(n))
    low, owner = np.insert(low, np.append(begin, len(low)), 0), np.insert(owner, np.append(begin, len(owner)), np.append(np.arange(n), n))
    found, texts = [], []
    hashed = np.full(len(low), 0x9E3779B1, np.uint32)
    for k in ORDERS:
        m = len(low) - k + 1
        hashed = (hashed[:m] ^ low[k - 1 :]) * np.uint32(0x85EBCA6B)
        # a gram may end in the space that begins the next text; one of spaces alone says nothing
        keep = (low[:m] > 0) | (low[k - 1 :] > 0) if k > 1 else low > 0
        keep &= owner[:m] < n
        if k > 2:
            keep &= owner[:m] == owner[k - 2 : len(low) - 1]
        mixed = hashed[:m][keep]
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        found.append((mixed >> np.uint32(16)).astype(np.int64)), texts.append(owner[:m][keep])
    return np.concatenate(found), np.concatenate(texts), letters


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: texts that hold each bucket, and under -1 all texts."""
    seen, docs = np.zeros(BUCKETS, np.int64), 0
    for batch in slices(batches, "text", 1 << 20):
        bucket, text, _ = gram_buckets(batch.column("text"))
        here = np.zeros((batch.num_rows, BUCKETS), bool) if batch.num_rows <= 64 else None
        if here is not None:
            here[text, bucket] = True
            seen += here.sum(0)
        else:
            pairs = np.unique(text * BUCKETS + bucket)
            seen += np.bincount(pairs % BUCKETS, minlength=BUCKETS)
        docs += batch.num_rows
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], docs))], ["bucket", "n"])


def _weights(bucket: np.ndarray, text: np.ndarray, n: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(idf per occurrence, factor per text): a text's TF-IDF values add up to SCALE whatever its length."""
    value = idf[bucket]
    return value, SCALE / np.maximum(np.bincount(text, value, minlength=n), 1e-12)


class Ftrl:
    """Multinomial FTRL-proximal over hashed features; most weights stay exactly zero."""

    def __init__(self, classes: int):
        self.z, self.n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        score = x @ w
        p = np.exp(score - score.max())
        p /= p.sum()
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores with the least log loss, by golden-section search over its logarithm."""

    def loss(t: float) -> float:
        s = scores / np.exp(t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), labels]).mean())

    a, b, r = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(50):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(scores over temperature, letters) per text."""
        n = len(column)
        bucket, text, letters = gram_buckets(column)
        value, scale = _weights(bucket, text, n, self.idf)
        table = self.idf[:, None] * self.weights
        each = [np.bincount(text, table[bucket, k], minlength=n) * scale for k in range(len(self.languages))]
        return np.stack(each, 1) / self.temperature, letters


def _fit(idf: np.ndarray, languages: list[str]):
    """One bounded group: texts in an order that follows their hash; every fifth calibrates."""

    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("turn").to_numpy(), kind="stable")
        labels = np.array([languages.index(x) for x in rows.column("lang").to_pylist()])[order]
        texts = rows.column("text").combine_chunks().take(pa.array(order))
        examples = []
        for i in range(len(texts)):
            bucket, text, _ = gram_buckets(texts.slice(i, 1))
            at, count = np.unique(bucket, return_counts=True)
            value, scale = _weights(bucket, text, 1, idf)
            examples.append((at, idf[at] * count * scale[0]))
        held = np.arange(len(labels)) % 5 == 4
        model = Ftrl(len(languages))
        for _ in range(EPOCHS):
            for i in np.flatnonzero(~held):
                model.learn(*examples[i], labels[i])
        w = model.weights(slice(None))
        scores = np.array([x @ w[at] for at, x in (examples[i] for i in np.flatnonzero(held))]).reshape(-1, len(languages))
        t = temperature(scores, labels[held]) if len(scores) else 1.0
        bucket, lang = np.nonzero(w)
        return pa.table({"bucket": np.append(bucket, -1), "lang": np.append(lang, 0), "w": np.append(w[bucket, lang], t)})

    return run


def fit_language_model(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "series_id", per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learn from the rows of ``df`` with a text and a language.

    Document frequencies cover all of them. The classifier is fitted on a bounded sample: of each
    language the rows whose hash of ``key`` and text is lowest, ``per_language`` of them in expectation,
    in one task. The model has 65,536 buckets times the languages, whatever the data.
    """
    known = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(key, text).alias("turn"))
    counts = known.select("text").mapInArrow(_document_counts, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # buckets + 1 rows
    seen = np.zeros(BUCKETS)
    real = counts[counts["bucket"] >= 0]
    seen[real["bucket"]] = real["n"]
    docs = int(counts.loc[counts["bucket"] < 0, "n"].sum())
    idf = np.where(seen > 0, np.log((1 + docs) / (1 + seen)) + 0.1, 0.0)
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel((), idf, np.zeros((BUCKETS, 0)), 1.0)
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, per_language / n))).otherwise(share)
    sample = known.where((F.col("turn") / 2.0**64 + 0.5) < share).withColumn("group", F.lit(1))
    fitted = sample.groupBy("group").applyInArrow(_fit(idf, languages), "bucket bigint, lang bigint, w double")
    fitted = written(fitted, "weights").toPandas()
    w = np.zeros((BUCKETS, len(languages)))
    real = fitted[fitted["bucket"] >= 0]
    w[real["bucket"], real["lang"]] = real["w"]
    t = fitted.loc[fitted["bucket"] < 0, "w"]
    return LanguageModel(tuple(languages), idf, w, float(t.iloc[0]) if len(t) else 1.0)


def predict_language(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred string`` and ``score double``; nothing but ``text`` is looked at.

    General operator: the project has no running text. A text that is NULL or has no letter is ``und``
    with score 0, and so is every text if nothing was learned. Else the score is the calibrated
    probability. Whole texts are read in batches of bounded size; nothing is shuffled.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in df.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in slices(batches, text, 1 << 20):
            if m.languages:
                s, letters = m.score(batch.column(text))
                best = s.argmax(1)
                p = 1 / np.exp(s - s.max(1, keepdims=True)).sum(1)
            else:
                letters, best, p = np.zeros(batch.num_rows), np.zeros(batch.num_rows, int), np.zeros(batch.num_rows)
            none = letters == 0
            best, p = np.where(none, len(m.languages), best), np.where(none, 0.0, p)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(names[best], pa.string()), pa.array(p)], [*columns, "lang_pred", "score"])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*columns).dtypes)
    return df.select(*columns).mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out(key: Column) -> Column:
    """The fold that is never learned from: a remainder of 2 of the crc32 of the key as text by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
