"""Benchmark passages inside documents: winnowed fingerprints find them, whole windows confirm them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accuracast.llm.textarrays import ALNUM, U, grams, slices, text_buffers, words
from accuracast.session import written

SPAN = 10
GRAM = 5
#: Bits of the filter that documents are tested with first; its size never depends on the data.
FILTER_BITS = 26


def text_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the words of each text, lower-cased runs of letters, digits and non-ASCII."""
    data, offsets = text_buffers(column)
    _, _, hashes, first = words(data, offsets, ALNUM)
    return hashes, first


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """For every word, whether the n words from it on belong to one text."""
    at = np.arange(first[-1])
    return at + n <= np.repeat(first[1:], np.diff(first))


def winnow(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the chosen 5-grams: the least of every six neighbours, all of them on a tie.

    Two texts that share ten words share the six 5-grams in them, hence the least one: no span of ten
    words or more goes unseen.
    """
    whole = inside(first, SPAN)
    rolled = grams(hashes, GRAM)
    n = max(0, len(hashes) - SPAN + 1)
    width = SPAN - GRAM + 1
    least = rolled[:n].copy()
    for k in range(1, width):
        np.minimum(least, rolled[k : k + n], out=least)
    chosen = np.zeros(len(rolled), bool)
    for k in range(width):
        chosen[k : k + n] |= whole[:n] & (rolled[k : k + n] == least)
    at = np.flatnonzero(chosen)
    return at, rolled[at]


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of items (``n`` words) and their fingerprints (``n`` 0)."""
    for batch in slices(batches, "text"):
        hashes, first = text_words(batch.column("text"))
        owner = np.repeat(np.arange(batch.num_rows), np.diff(first))
        rows, values, sizes = [], [], []

        def add(at, found, n):
            rows.append(owner[at]), values.append(found), sizes.append(np.full(len(at), n, np.int32))

        at = np.flatnonzero(inside(first, SPAN))
        add(at, grams(hashes, SPAN)[at], SPAN)
        add(*winnow(hashes, first), 0)
        for n in range(1, SPAN):
            at = first[:-1][np.diff(first) == n]
            add(at, grams(hashes, n)[at], n)
        yield pa.RecordBatch.from_arrays(
            [batch.column("item").take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(values).view(np.int64)), pa.array(np.concatenate(sizes))], ["item", "hash", "n"]
        )


def _place(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (hashes >> U(64 - FILTER_BITS + 6)).astype(np.int64), (hashes >> U(64 - FILTER_BITS)) & U(63)


def _filter(spark: SparkSession, found: DataFrame):
    """Broadcast bit filter of all item hashes: at most 2^20 words of 64 bits, however many items."""
    word, bit = F.shiftrightunsigned("hash", 64 - FILTER_BITS + 6), F.shiftrightunsigned("hash", 64 - FILTER_BITS).bitwiseAND(F.lit(63)).cast("int")
    ones = found.select(word.cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("b"))
    table = ones.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 6), U)
    bits[table["w"].to_numpy()] = table["b"].to_numpy(np.int64).view(U)
    return spark.sparkContext.broadcast(bits)


def _candidates(bits, short: list[int]):
    def known(hashes: np.ndarray) -> np.ndarray:
        word, bit = _place(hashes)
        return (bits.value[word] >> bit) & U(1) == U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, first = text_words(batch.column("text"))
            starts, values, sizes = [], [], []
            at, prints = winnow(hashes, first)
            at = at[known(prints)]
            # the windows that hold a known fingerprint
            near = np.unique((at[:, None] - np.arange(SPAN - GRAM + 1)).ravel())
            for n, places in [(SPAN, near[near >= 0]), *((n, np.arange(len(hashes))) for n in short)]:
                places = places[inside(first, n)[places]]
                rolled = grams(hashes, n)[places]
                hit = known(rolled)
                starts.append(places[hit]), values.append(rolled[hit]), sizes.append(np.full(int(hit.sum()), n, np.int32))
            at = np.concatenate(starts)
            order = np.argsort(at, kind="stable")
            at = at[order]
            owner = np.searchsorted(first, at, side="right") - 1
            each = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(values)[order].view(np.int64)), pa.array((at - first[owner]).astype(np.int32)), pa.array(np.concatenate(sizes)[order])], ["hash", "start", "n"]
            )
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)), pa.int32()), each)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.diff(first).astype(np.int64)), lists], ["key", "n_words", "found"])

    return run


def benchmark_spans(df: DataFrame, items: DataFrame, key: str = "series_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``key``, ``n_words``, ``n_hit``, ``hits array<struct<start, n>>`` and ``items array<string>``, one row per row of ``df``.

    General operator: the project has no running text of its own. Words are lower-cased (A-Z) runs of
    ASCII letters, digits and non-ASCII characters. A window is ten words of an item in a row, or the
    whole item if it is shorter; ``hits`` are the occurrences of windows in the document, ``n_hit`` the
    words inside any of them, ``items`` the identifiers, sorted as strings, of the items they belong to.

    NULL texts have no words and hit nothing; items without words have no window; an item without an
    identifier counts for words but is not named. Repeated rows are reported one by one. Without items,
    or without documents, nothing is hit.

    Method: both sides keep the least 5-gram hash of every six neighbours. A document looks its
    fingerprints up in a bit filter of fixed size; windows around a known one are extended to ten words
    and leave the task only if the filter knows them too, to be joined with the items' windows by hash.
    Texts are read once and never shuffled. Items under ten words are too short for a fingerprint that
    every copy must have; their whole hash is looked up at every place.
    """
    spark = df.sparkSession
    kind, item_kind = dict(df.dtypes)[key], dict(items.dtypes)[item_key]
    named = items.select(F.col(item_key).alias("item"), F.col(item_text).cast("string").alias("text"))
    prints = written(named.mapInArrow(_items, f"item {item_kind}, hash bigint, n int").distinct(), "items")
    short = sorted(r.n for r in prints.where(f"n between 1 and {SPAN - 1}").select("n").distinct().collect())  # nine values at most
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(_candidates(_filter(spark, prints), short), f"key {kind}, n_words bigint, found array<struct<hash:bigint,start:int,n:int>>")
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "candidates")
    windows = prints.where("n > 0").select("hash", "item")
    each = found.select("row", F.explode("found").alias("f")).select("row", "f.*")
    hits = each.join(windows.select("hash").distinct(), "hash", "left_semi").groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("hits"))
    names = each.select("row", "hash").distinct().join(windows, "hash").groupBy("row").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    end = lambda x: x["start"] + x["n"]
    n_hit = F.aggregate(
        "hits", F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("total")),
        lambda a, x: F.struct(F.greatest(a["end"], end(x)).alias("end"), (a["total"] + F.greatest(F.lit(0), end(x) - F.greatest(a["end"], x["start"]))).alias("total")),
        lambda a: a["total"],
    )
    none = F.array().cast
    return found.drop("found").join(hits, "row", "left").join(names, "row", "left").select(
        F.col("key").alias(key), "n_words", F.coalesce(n_hit, F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("hits", none("array<struct<start:int,n:int>>")).alias("hits"), F.coalesce("items", none("array<string>")).alias("items"),
    )
