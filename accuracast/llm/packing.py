"""Training windows filled by lexical neighbours: BM25 retrieval over token ids, sharded by content."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accuracast.llm.textarrays import released
from accuracast.llm.tokens import id_width, sorted_terms, token_ids
from accuracast.session import written

WINDOW = 2048
#: Documents of a shard of the index, taken in order of content, and ids after which a shard is closed early.
SHARD_DOCS = 512
SHARD_IDS = 4_000_000
K1, B = 1.2, 0.75
#: Terms of a text by which its place in the order of the corpus is set.
ROUTE_TERMS = 8
#: Sampled routes per range from which the bounds of the ranges are taken.
SAMPLES = 60


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of tasks, one row per id; documents and ids stand under -1 and -2."""
    for batch in batches:
        for x in batch.column("counts"):
            pairs = np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in (0, 1)], ["id", "n"])


def route(ids: np.ndarray, idf: np.ndarray) -> bytes:
    """The terms that say most about a text, heaviest first, as bytes that sort like the terms."""
    term, n = sorted_terms(ids)
    weight = idf[term] * np.log1p(n)
    top = np.argsort(-weight, kind="stable")[:ROUTE_TERMS]
    return term[top[weight[top] > 0]].astype(">u4").tobytes()


def _routes(df, n_docs: int, width: np.dtype, bounds: list[bytes] | None = None):
    """Per task: rows with their route, their place in reading order and the range they fall into; without
    ``bounds`` the routes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a term of one document leads to no other
        idf = np.where(df.value > 1, np.log(np.maximum(1.0, (n_docs - df.value + 0.5) / (df.value + 0.5))), 0.0)
        at = TaskContext.get().partitionId() << 36
        for batch in released(batches):
            # sent on in parts of a few megabytes
            parts = np.cumsum(pc.binary_length(batch.column("ids")).to_numpy()) >> 22
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]
            for part in (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:])):
                routes = [route(np.frombuffer(x.as_buffer(), width), idf) for x in part.column("ids")]
                if bounds is None:
                    yield pa.RecordBatch.from_arrays([pa.array(routes, pa.binary())], ["route"])
                    continue
                # a route that fills several ranges is dealt out over them
                ends = [(bisect_left(bounds, x), bisect_right(bounds, x)) for x in routes]
                ranges = pa.array([a + (at + i) % (b - a + 1) for i, (a, b) in enumerate(ends)], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("ids"), pa.array(routes, pa.binary()), pa.array(np.arange(at, at + len(routes))), ranges], ["key", "ids", "route", "row", "range"])
                at += len(routes)

    return run


class ShardIndex:
    """Inverted index of one shard: per term the documents that hold it and their BM25 weights."""

    def __init__(self, docs: list[np.ndarray], df: np.ndarray, n_docs: int, mean_ids: float):
        found = [sorted_terms(x) for x in docs]
        # a term in more than half of all documents has no positive weight and no list
        idf = np.log(np.maximum(1.0, (n_docs - df + 0.5) / (df + 0.5)))
        self.terms = [t[idf[t] > 0] for t, _ in found]
        tf = np.concatenate([c[idf[t] > 0] for t, c in found]).astype(float)
        n = np.array([len(t) for t in self.terms])
        norm = K1 * (1 - B + B * np.array([len(x) for x in docs]) / mean_ids)
        term = np.concatenate(self.terms)
        weight = idf[term] * tf * (K1 + 1) / (tf + np.repeat(norm, n))
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = np.repeat(np.arange(len(docs)), n)[order], weight[order]
        self.begin = np.searchsorted(term[order], np.arange(len(df) + 1))

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of every document of the shard for the terms of one of them."""
        terms = self.terms[doc]
        first = self.begin[terms]
        lens = self.begin[terms + 1] - first
        at = np.repeat(first - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        return np.bincount(self.docs[at], self.weights[at], minlength=len(self.terms))


def fill_windows(index: ShardIndex, sizes: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start, length).

    Whole windows of a long document come first, each its own. What is left of the documents is packed:
    the first unused one seeds a window, its unused neighbours follow by score, each if it fits. When
    none fits, the best one is cut to fill the window and its rest seeds the next.
    """
    windows = [[(i, a, window)] for i, n in enumerate(sizes.tolist()) for a in range(0, n - window + 1, window)]
    start = sizes // window * window
    left = sizes - start
    seed, at = -1, 0
    while True:
        if seed < 0 or not left[seed]:
            while at < len(left) and not left[at]:
                at += 1
            if at == len(left):
                return windows
            seed = at
        out = [(seed, int(start[seed]), int(left[seed]))]
        gap = window - int(left[seed])
        left[seed] = 0
        order = None
        while gap:
            if order is None:
                order = np.argsort(-index.scores(seed), kind="stable")
            order = order[left[order] > 0]
            if not len(order):
                break
            fits = order[left[order] <= gap]
            take = int(fits[0] if len(fits) else order[0])
            n = min(gap, int(left[take]))
            out.append((take, int(start[take]), n))
            start[take] += n
            left[take] -= n
            gap -= n
            if left[take]:
                seed = take
        windows.append(out)


def _pack(df, n_docs: int, mean_ids: float, width: np.dtype, window: int):
    def shard(keys: pa.Array, ids: list[np.ndarray], first: int) -> tuple[pa.RecordBatch, int]:
        sizes = np.array([len(x) for x in ids], np.int64)
        windows = fill_windows(ShardIndex(ids, df.value, n_docs, mean_ids), sizes, window)
        doc, start, length = (np.array([p[k] for w in windows for p in w], np.int64) for k in range(3))
        each = np.array([len(w) for w in windows])
        total = np.cumsum(length) - length
        offset = total - np.repeat(total[np.cumsum(each) - each], each)
        cells = [ids[d][a : a + n].astype("<u4").tobytes() for d, a, n in zip(doc.tolist(), start.tolist(), length.tolist())]
        return pa.RecordBatch.from_arrays(
            [keys.take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(cells, pa.binary()), pa.array(sizes[doc]), pa.array(first + np.repeat(np.arange(len(windows)), each)), pa.array(offset)],
            ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        ), len(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        keys, ids, held = [], [], 0
        for batch in released(batches):
            for at, x in enumerate(batch.column("ids")):
                keys.append(batch.column("key").slice(at, 1))
                ids.append(np.frombuffer(x.as_buffer(), width))
                held += len(ids[-1])
                if len(ids) == SHARD_DOCS or held >= SHARD_IDS:
                    out, n = shard(pa.concat_arrays(keys), ids, first)
                    yield out
                    keys, ids, held, first = [], [], 0, first + n
        if ids:
            yield shard(pa.concat_arrays(keys), ids, first)[0]

    return run


def retrieval_pack(df: DataFrame, key: str = "series_id", text: str = "text", window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """Pieces of texts packed into windows of ``window`` ids with their lexical neighbours.

    One row per piece: ``key``, ``start`` (ids of its text before it), ``length``, ``ids binary`` (32-bit
    little-endian), ``doc_tokens`` (ids of its text, the end id included), ``sequence_id`` and ``offset``
    in the sequence. General operator: the project has no running text.

    Every id lies in exactly one piece. NULL and empty texts are their end id alone; repeated rows are
    packed one by one; texts without a weighty term come first, in order of reading; an empty table gives
    no piece. All windows are full but the last of a shard.

    Method: texts are encoded once and written. Document frequencies, the number of documents and their
    mean length are counted over the whole table; the frequencies have one entry per id of the
    vocabulary, so they are small enough to send to every task at any scale. The whole corpus is then
    put in order of the heaviest terms of each text (idf times log of the count; terms of one document
    do not count), by ranges whose bounds come from a sample (60 routes a range; all rows are placed):
    documents about the same thing stand side by side whatever file they came from. Documents of a common
    term are split by the terms after it; a route that fills several ranges is dealt out over them by
    place in reading order, so no key has to fit one task. A shard is 512 documents in this order with an
    inverted index of its own. A seed's terms (all of them, over its whole text) give the BM25 score of
    every unused document of the shard, and these fill the window in that order.
    """
    spark = df.sparkSession
    from tokenizers import Tokenizer

    from accuracast.llm.tokens import default_tokenizer

    entries = max(Tokenizer.from_file(tokenizer or default_tokenizer()).get_vocab_size(), 1)
    width = np.dtype(id_width(tokenizer))
    found = written(token_ids(df, key, text, tokenizer, counts=True), "tokens")
    rows = found.where("counts is null")
    counts = found.where("counts is not null").select("counts").mapInArrow(_frequencies, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # vocabulary + 2 rows
    counts = dict(zip(counts["id"].tolist(), counts["n"].tolist()))
    n_docs, total = counts.pop(-1, 0), counts.pop(-2, 0)
    table = np.zeros(entries, np.int64)
    table[np.array(list(counts), np.int64)] = list(counts.values())
    table = spark.sparkContext.broadcast(table)
    kind = rows.schema["key"].dataType.simpleString()
    # bounds from a sample of the documents: a range shuffle of Spark's would compute every route twice
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, SAMPLES * parts / max(1, n_docs))
    sample = sorted(bytes(r.route) for r in rows.select("ids").sample(share, 7).mapInArrow(_routes(table, n_docs, width), "route binary").collect())
    bounds = [sample[i * len(sample) // parts] for i in range(1, parts)] if sample else []
    routed = rows.select("key", "ids").mapInArrow(_routes(table, n_docs, width, bounds), f"key {kind}, ids binary, route binary, row bigint, range int")
    rows = routed.repartitionById(parts, F.col("range")).sortWithinPartitions("route", "row")
    pack = _pack(table, n_docs, max(1.0, total / max(1, n_docs)), width, window)
    out = rows.select("key", "ids").mapInArrow(pack, f"key {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("key", key)
