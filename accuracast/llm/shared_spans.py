"""Passages that a record shares with an earlier one, found by anchors at difference-cover positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accuracast.llm.bitfilter import BITS, bit_filter, filed
from accuracast.llm.textarrays import SPACES, grams, slices, text_buffers, words
from accuracast.session import written

SPAN = 13
# Perfect difference covers, by period
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Runs of anything but ASCII white space as they are; no text holds the byte 255, which stands for 0.
EXACT = np.array([0 if b in SPACES else b or 255 for b in range(256)], dtype=np.uint8)


def panel_values(panel: DataFrame) -> DataFrame:
    """``series_id`` and ``values``: the observations of a panel in order of ``pos``, written one after the
    other as a text (a missing one is ``null``), the form in which series are compared here."""
    each = F.sort_array(F.collect_list(F.struct("pos", F.coalesce(F.col("y").cast("string"), F.lit("null")).alias("y"))))
    return panel.groupBy("series_id").agg(F.array_join(F.transform(each, lambda x: x["y"]), " ").alias("values"))


def cover_for(span: int) -> tuple[int, tuple[int, ...], int]:
    """(period, cover, anchor length): the longest period that leaves an anchor of half the span."""
    period = max(p for p in COVERS if p <= max(1, (span + 1) // 2))
    return period, COVERS[period], span - period + 1


def _tokens(column: pa.Array):
    data, offsets = text_buffers(column)
    start, end, hashes, first = words(data, offsets, EXACT)
    at = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))
    left = np.repeat(np.diff(first), np.diff(first)) - at
    return data, start, end, hashes, first, at, left


def anchor_places(at: np.ndarray, left: np.ndarray, span: int) -> np.ndarray:
    """Places of anchors: positions of the cover whose window lies in a record of at least ``span`` tokens."""
    period, cover, length = cover_for(span)
    return np.flatnonzero(np.isin(at % period, cover) & (left >= length) & (at + left >= span))


def _once(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the first of each hash of each owner."""
    order = np.lexsort((owner, hashes))
    o, h = owner[order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    return order[new]


def _maybe_copies(batch: pa.RecordBatch, copies) -> np.ndarray:
    """Rows whose ``id`` is filed among the copies; rows without one are known to be none."""
    known = batch.column("id")
    return np.asarray(known.is_valid()) & filed(copies.value, known.fill_null(0).to_numpy().view(np.uint64))


def _sifted(batches: Iterator[pa.RecordBatch], copies, flagged: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(_maybe_copies(batch, copies) == flagged))


def _flagged(copies):
    return lambda batches: _sifted(batches, copies, True)


def _anchors(span: int, copies):
    length = cover_for(span)[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(_sifted(batches, copies), "text", 1 << 22):
            _, _, _, hashes, first, at, left = _tokens(batch.column("text"))
            places = anchor_places(at, left, span)
            rolled = grams(hashes, length)[places]
            once = _once(np.searchsorted(first, places, side="right"), rolled)
            found, n = np.unique(rolled[once], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["hash", "n"])

    return run


def _windows(span: int, copies, bits, known=None):
    """Windows around anchors in ``bits``, each once a row; with ``known``, those it may hold."""
    period, _, length = cover_for(span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(_sifted(batches, copies), "text"):
            _, _, _, hashes, first, at, left = _tokens(batch.column("text"))
            places = anchor_places(at, left, span)
            places = places[filed(bits.value, grams(hashes, length)[places])]
            near = np.zeros(len(hashes), bool)
            for k in range(period):
                near[places[at[places] >= k] - k] = True
            near = np.flatnonzero(near & (left >= span))
            found = grams(hashes, span)[near]
            if known is not None:
                hit = filed(known.value, found)
                near, found = near[hit], found[hit]
            owner = np.searchsorted(first, near, side="right") - 1
            once = _once(owner, found)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(owner[once])), pa.array(found[once].view(np.int64))], ["key", "hash"])

    return run


def _kept(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, start, end, hashes, first, _, left = _tokens(batch.column("text"))
            gone = np.zeros(len(hashes) + 1, np.int32)
            rolled = grams(hashes, span).view(np.int64)
            lost = batch.column("lost")
            for i in np.flatnonzero(~np.asarray(lost.is_null())):
                stop = first[i + 1] - span + 1
                hit = first[i] + np.flatnonzero(np.isin(rolled[first[i] : stop], lost[i].values.to_numpy()))
                np.add.at(gone, hit, 1)
                np.add.at(gone, hit + span, -1)
            copies = np.asarray(batch.column("copy")) & (np.diff(first) >= span)
            keep = (np.cumsum(gone[:-1]) == 0) & ~np.repeat(copies, np.diff(first))
            counts = np.concatenate(([0], np.cumsum(keep)))[first]
            # kept tokens, one blank after each
            size = end[keep] - start[keep] + 1
            into = np.cumsum(size) - size
            out = data[np.minimum(np.repeat(start[keep] - into, size) + np.arange(size.sum()), len(data) - 1)] if len(size) else data[:0]
            out = out.copy()
            out[into + size - 1] = 32
            ends = np.concatenate((into, [len(out)]))[counts]
            raw = out.tobytes()
            texts = [raw[x : max(x, y - 1)] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
            n = np.diff(first)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(n.astype(np.int64)), pa.array((n - np.diff(counts)).astype(np.int64)), pa.array(texts, pa.binary()).cast(pa.string())],
                ["key", "n_values", "n_removed", "kept_values"],
            )

    return run


def remove_shared_spans(df: DataFrame, key: str = "series_id", values: str = "values", span: int = SPAN, filter_bits: int = BITS) -> DataFrame:
    """``key``, ``n_values bigint``, ``n_removed bigint`` and ``kept_values``, one row per row of ``df``.

    ``values`` is a sequence as text, tokens separated by ASCII white space: a series written by
    ``panel_values``, or running text. A window is ``span`` tokens of one row in a row, compared as they
    are. Tokens inside a window that also starts in a row with a smaller ``key`` are removed; windows are
    judged on the input, not on what is left. ``kept_values`` joins the other tokens by one blank.

    NULL, empty and blank values have no tokens and keep ''. A row with a NULL key keeps all its tokens
    and takes none from others. Rows that share a key are judged by keys smaller than theirs, so neither
    loses to the other; repeated rows come out repeated. Rows under ``span`` tokens lose nothing. An empty
    table gives an empty one. Other columns of ``df``, whatever their names, are not looked at.

    Method: anchors. Of every seven positions three are in the cover {0, 1, 3}, and any two positions
    have a common shift below seven that takes both into it. Two equal windows of 13 tokens therefore
    share an anchor of seven tokens that both rows hash. (Other spans take the period that leaves anchors
    of half their length.) Anchors of two rows are filed in a bit table of fixed size; only windows around
    them, extended to the whole span, leave the task to find their least key, and those that have one in
    another row meet it by a join. No pair of rows is formed. Rows whose whole text stands under a smaller
    key lose every window and are not looked into, so groups of copies cost a digest each (a bit table
    tells which rows may be copies; only those are joined with them); windows of
    other hot passages are combined before they are shuffled, and the join with their least key is one
    that Spark splits. Tokens and windows are told apart by 64-bit hashes, texts by SHA-256.

    Scale: one shuffle of 3/7 of the positions as hashes with counts, one each for the extended windows
    to find and to meet their least key, one of the texts by key. Texts are read and hashed once per pass.
    Beyond some ten million shared anchors the bit tables (``filter_bits``) spare less and less, at worst
    nothing: every window is then extended, still at a cost in proportion to the input, and the result is
    the same.
    """
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(values).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    named = rows.where("key is not null").withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    named = named.withColumn("id", F.xxhash64("key", "digest"))
    # a copy of a smaller key's text loses every window, so it need not be looked into
    digests = named.groupBy("digest").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi")
    copies = written(named.select("key", "digest", "id").join(written(digests, "digests"), "digest").where("key > lo").select("key", "digest", "id").distinct(), "copies")
    flags = bit_filter(copies.select(F.col("id").alias("hash")), filter_bits)
    # rows that the flags take for copies and are none: few, or all when the table of bits is full
    doubtful = named.select("key", "text", "digest", "id").mapInArrow(_flagged(flags), f"key {kind}, text string, digest binary, id bigint")
    cleared = written(doubtful.join(copies.select("key", "digest"), ["key", "digest"], "left_anti").select("key", "text", F.lit(None).cast("bigint").alias("id")), "cleared")
    live = named.select("key", "text", "id").union(cleared)

    shared = live.mapInArrow(_anchors(span, flags), "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1")
    bits = bit_filter(shared, filter_bits)
    windows = lambda known: live.mapInArrow(_windows(span, flags, bits, known), f"key {kind}, hash bigint")
    least = written(windows(None).groupBy("hash").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("hash", "lo"), "least")
    lost = windows(bit_filter(least, filter_bits)).join(least, "hash").where("key > lo").select("key", "hash", F.lit(None).cast("binary").alias("digest"))
    lost = lost.union(copies.select("key", F.lit(None).cast("bigint"), "digest"))
    lost = written(lost.groupBy("key").agg(F.collect_set("hash").alias("lost"), F.collect_set("digest").alias("copies")), "lost")

    judged = named.join(lost, "key", "left").select("key", "text", "lost", F.coalesce(F.array_contains("copies", F.col("digest")), F.lit(False)).alias("copy"))
    unnamed = rows.where("key is null").select("key", "text", F.lit(None).cast("array<bigint>"), F.lit(False))
    out = judged.union(unnamed).mapInArrow(_kept(span), f"key {kind}, n_values bigint, n_removed bigint, kept_values string")
    return out.withColumnRenamed("key", key)
