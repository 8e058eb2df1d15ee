"""Near-duplicate texts by min-max hashing: every permutation gives its minimum and its maximum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accuracast.llm.bitfilter import bit_filter, may_be_filed
from accuracast.llm.components import components
from accuracast.llm.textarrays import SPACED, U, grams, mix, released, slices, text_buffers, words
from accuracast.session import written

SHINGLE = 5
BANDS = 45
#: Permutations in a band; each gives two of its values.
PER_BAND = 3
#: Shingles in a block of a bucket whose members are still apart.
BLOCK_SHINGLES = 400_000
_RANDOM = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, (BANDS * PER_BAND, 2), dtype=np.uint32)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets): the sorted distinct 5-word shingles of each text as 64-bit hashes.

    A text of one to four words is one shingle; one without words has none.
    """
    data, offsets = text_buffers(column)
    _, _, hashes, first = words(data, offsets, SPACED)
    rolled = grams(hashes, SHINGLE)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= SHINGLE:
            s = np.sort(rolled[a : b - SHINGLE + 1])
            sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        else:
            sets.append(grams(hashes[a:b], b - a) if b > a else hashes[a:a])
    return np.concatenate(sets) if sets else np.zeros(0, U), np.cumsum([0, *map(len, sets)])


def min_max_bands(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One key per set and band, from the minima and maxima of the band's permutations."""
    x = (values >> U(32)).astype(np.uint32)
    keys = np.empty((len(starts), BANDS), U)
    for band in range(BANDS):
        key = np.full(len(starts), band, U)
        for a, b in _RANDOM[band * PER_BAND : (band + 1) * PER_BAND]:
            h = x * (a | np.uint32(1)) + b
            both = (np.minimum.reduceat(h, starts).astype(U) << U(32)) | np.maximum.reduceat(h, starts).astype(U)
            key = mix(key * U(0x9E3779B97F4A7C17) + both)
        keys[:, band] = key
    return keys


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        values, offsets = shingle_sets(batch.column("text"))
        sizes = np.diff(offsets)
        full = np.flatnonzero(sizes)
        a, b, bands = np.zeros(len(sizes), U), np.zeros(len(sizes), U), np.zeros((len(sizes), BANDS), U)
        if len(full):
            starts = offsets[full]
            a[full] = np.add.reduceat(mix(values), starts)
            b[full] = np.bitwise_xor.reduceat(mix(values + U(0x9E3779B97F4A7C17)), starts)
            bands[full] = min_max_bands(values, starts)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(([0], np.where(sizes > 0, BANDS, 0)))), pa.int32()), _long(bands[full].ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes.astype(np.int64)), _long(a), _long(b), lists], ["key", "n_shingles", "a", "b", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the texts whose digest is the one looked for."""
    for batch in slices(batches, "text"):
        values, offsets = shingle_sets(batch.column("text"))
        sums = np.array([mix(values[i:j]).sum(dtype=U) for i, j in zip(offsets[:-1], offsets[1:])], U).view(np.int64)
        hit = np.flatnonzero(sums == batch.column("a").to_numpy())
        out = [values[offsets[i] : offsets[i + 1]].tobytes() for i in hit]
        yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(hit)), pa.array(out, pa.binary())], ["node", "shingles"])


def _verify(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            hit = []
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = np.concatenate((x, y))
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * shared >= threshold * (len(x) + len(y) - shared):
                    hit.append(i)
            at = pa.array(hit, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("u").take(at), batch.column("v").take(at)], ["u", "v"])

    return run


def link_block(nodes: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """Links that join components of one block: an inverted index of shingles counts what members share.

    Members of the largest component only answer. Of the links found, those that join two groups remain.
    """
    sizes = np.array([len(s) for s in sets])
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    member = np.repeat(np.arange(len(sets)), sizes)
    posted = member[np.argsort(term, kind="stable")]
    df = np.bincount(term)
    begin = np.concatenate(([0], np.cumsum(df)))
    ends = np.cumsum(sizes)
    values, counts = np.unique(comps, return_counts=True)
    parent = {int(c): int(c) for c in values}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    links = []
    for i in np.flatnonzero(comps != values[np.argmax(counts)]):
        terms = term[ends[i] - sizes[i] : ends[i]]
        lens = df[terms]
        at = np.repeat(begin[terms] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
        shared = np.bincount(posted[at], minlength=len(sets))
        for j in np.flatnonzero(100 * shared >= threshold * (sizes[i] + sizes - shared)):
            p, q = root(int(comps[i])), root(int(comps[j]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                links.append((int(nodes[i]), int(nodes[j])))
    return links


def _link_sorted(threshold: int):
    """Blocks arrive one after the other; the last block of a batch may go on in the next."""

    def block(rows: pa.Table) -> pa.RecordBatch:
        sets = [np.frombuffer(x.as_buffer(), U) for x in rows.column("shingles").combine_chunks()]
        links = link_block(rows.column("node").to_numpy(), rows.column("comp").to_numpy(), sets, threshold)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in released(batches):
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            key = np.stack([rows.column(c).to_numpy() for c in ("bucket", "i", "j")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist()]
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield block(rows.slice(a, b - a))
            rest = rows.slice(cuts[-1])
        if rest is not None:
            yield block(rest)

    return run


def near_duplicates(df: DataFrame, key: str = "series_id", text: str = "text", threshold: int = 85) -> DataFrame:
    """``key``, ``n_shingles bigint``, ``component_id`` and ``kept``, one row per row of ``df``.

    General operator: the project's records carry no running text, so any table with an identifier and
    a text column will do, for example notes on series. Texts are lower-cased (A-Z) and cut at ASCII
    white space; their sets of 5-word shingles are linked where 100 * intersection >= threshold * union.
    ``component_id`` is the smallest key reachable over links, ``kept`` marks the row that carries it.

    NULL, empty and blank texts have no shingles and are linked with nothing. A row with a NULL key is
    linked with nothing either and kept. Rows that repeat a key and text share a component and are kept
    or not together. An empty table gives an empty table.

    Method: 135 permutations give 270 values (minimum and maximum each), cut into 45 bands of three
    permutations. A pair at similarity 0.85 shares a band with probability 1 - (1 - 0.85^6)^45, short
    of 1 by 6e-10. Then, by steps that never pair up a bucket:

    1. equal sets become one class (digest of 128 bits), so copies cost one shuffled row per task;
    2. each class is compared, on full sets, with the smallest class of its buckets;
    3. buckets whose other members are still in different components go through an inverted index in
       blocks of bounded size, a large bucket as pairs of blocks; only joining links leave a block.

    Every pair that shares a band and is not yet joined is thus confirmed or refused on full sets.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    base = written(rows.mapInArrow(_sign, f"key {kind}, n_shingles bigint, a bigint, b bigint, bands array<bigint>"), "minmax")
    known = base.where("n_shingles > 0 and key is not null")
    classes = known.groupBy("a", "b").agg(F.min("key").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    member = classes.select(F.explode("bands").alias("bucket"), F.struct("node", "n").alias("m"))
    centers = member.groupBy("bucket").agg(F.min("m").alias("c"), F.max("m.node").alias("last")).where("c.node != last").select("bucket", "c")
    near = (F.col("m.n") * 100 >= F.col("c.n") * threshold) & (F.col("c.n") * 100 >= F.col("m.n") * threshold)
    shared = written(member.join(centers, "bucket").select("bucket", F.col("m.node").alias("u"), F.col("c.node").alias("v"), F.col("m.n").alias("n"), near.alias("near")), "buckets")
    pairs = shared.where("u != v and near").select("u", "v").distinct()
    wanted = written(classes.join(shared.select(F.col("u").alias("node")).distinct(), "node", "left_semi").select(F.col("id").alias("key"), "node", "a"), "wanted")
    # texts that are surely not wanted stay where they are
    likely = rows.where(may_be_filed(bit_filter(wanted.select(F.xxhash64("key").alias("hash"))), F.col("key")))
    sets = likely.join(wanted, "key").select("node", "a", "text").mapInArrow(_sets, "node bigint, shingles binary")
    sets = written(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "shingles")
    side = lambda name, col: sets.select(F.col("node").alias(name), F.col("shingles").alias(col))
    links = written(pairs.join(side("u", "x"), "u").join(side("v", "y"), "v").mapInArrow(_verify(threshold), "u bigint, v bigint"), "links")

    comp = components(links)
    apart = shared.where("u != v").join(comp.withColumnRenamed("node", "u"), "u", "left").select("bucket", "u", "n", F.coalesce("comp", "u").alias("comp"))
    open_ = apart.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks")).where("lo != hi")
    rest = apart.join(open_.select("bucket", "blocks"), "bucket").withColumn("own", F.pmod(F.hash("u"), F.col("blocks")))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("u").alias("node"), "comp")
    blocks = rest.join(sets, "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    more = written(blocks.mapInArrow(_link_sorted(threshold), "u bigint, v bigint"), "links")

    comp = components(links.union(more))
    named = classes.select("node", "a", "b", "id").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    named = named.join(least, "comp").select("a", "b", "component_id")
    out = known.select("key", "n_shingles", "a", "b").join(named, ["a", "b"]).select("key", "n_shingles", "component_id")
    alone = base.where("n_shingles = 0 or key is null").select("key", "n_shingles", F.col("key").alias("component_id"))
    return out.union(alone).select(F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
