"""Phrases whose words keep together, counted over a prefix-free parse of the texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accuracast.llm.bitfilter import BITS, bit_filter, filed
from accuracast.llm.textarrays import U, byte_classes, grams, mix, slices, text_buffers, words
from accuracast.session import written

LONGEST, LEAST, TOP = 4, 30, 2000
#: A chunk begins, on average, every so many words.
PERIOD = 32
SCORE = 2_000_000
#: Leading bits of a hash that are exchanged to be counted; what falls together only spares less.
CHUNK_BITS, PHRASE_BITS = 40, 32
_BREAKS = {*range(0x0A, 0x0E), *b".,;:!?"}
_SPOKEN = byte_classes(lambda b: b not in _BREAKS and b not in (0x20, 0x09))
_IS_BREAK = np.array([b in _BREAKS for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def panel_symbols(panel: DataFrame) -> DataFrame:
    """``series_id`` and ``values``: a panel's moves in order of ``pos`` as a text of the words u (up), d
    (down) and e (equal); a missing observation ends a piece. Phrases of them are motifs of the series."""
    from pyspark.sql import Window as W

    before = F.lag("y").over(W.partitionBy("series_id").orderBy("pos"))
    move = F.when(F.col("y").isNull() | before.isNull(), ".").when(F.col("y") > before, "u").when(F.col("y") < before, "d").otherwise("e")
    each = F.sort_array(F.collect_list(F.struct("pos", F.col("move"))))
    return panel.withColumn("move", move).groupBy("series_id").agg(F.array_join(F.transform(each, lambda x: x["move"]), " ").alias("values"))


class Parsed:
    """Words of a batch: hashes, owners, and where a piece ends."""

    def __init__(self, column: pa.Array):
        self.data, offsets = text_buffers(column)
        self.start, self.end, self.hashes, self.first = words(self.data, offsets, _SPOKEN)
        each = np.diff(self.first)
        self.at = np.arange(len(self.hashes)) - np.repeat(self.first[:-1], each)
        self.left = np.repeat(each, each) - self.at
        seen = np.zeros(len(self.data) + 1, np.int32)
        np.cumsum(_IS_BREAK[self.data], out=seen[1:])
        #: whether a piece ends after the word
        self.last = self.left == 1
        self.last[:-1] |= seen[self.start[1:]] > seen[self.end[:-1]]

    def plain(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(bytes, begin, end): lower-cased words, a blank after each or a new line where a piece ends."""
        size = self.end - self.start + 1
        begin = np.cumsum(size) - size
        total = int(size.sum())
        if not total:
            return b"", begin, begin
        out = _LOWER[self.data[np.minimum(np.repeat(self.start - begin, size) + np.arange(total), len(self.data) - 1)]]
        out[begin + size - 1] = np.where(self.last, 10, 32)
        return out.tobytes(), begin, begin + size - 1


def chunks(p: Parsed, longest: int = LONGEST, period: int = PERIOD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end of own words, end) of each chunk.

    A chunk begins with its text and wherever the hash of the next ``longest - 1`` words (of one, for
    single words) is 0 modulo ``period``; it reaches over the words that triggered the next one, so every
    phrase lies whole in the chunk that owns its first word. What triggers is content, not place: the same
    passage gives the same chunks wherever it stands, but for its ends.
    """
    width = max(1, longest - 1)
    begins = p.at == 0
    rolled = grams(p.hashes, width)
    begins[: len(rolled)] |= (rolled % U(period) == 0) & (p.left[: len(rolled)] >= width)
    a = np.flatnonzero(begins)
    own = np.append(a[1:], len(p.hashes))[: len(a)]
    return a, own, np.minimum(own + longest - 1, (np.arange(len(p.hashes)) + p.left)[a])


def chunk_hashes(p: Parsed, seeds: np.ndarray, cut: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """A hash of each chunk's words, piece ends, number of own words and the seed of its row."""
    a, own, b = cut
    if not len(a):
        return np.zeros(0, U)
    place = lambda at: (at - np.repeat(a, own - a) + 1).astype(U) * U(0xD1342543DE82EF95)
    word = p.hashes + np.where(p.last, U(0x9E3779B97F4A7C15), U(0))
    total = np.add.reduceat(mix(word + place(np.arange(len(word)))), a)
    for j in range(int((b - own).max())):
        there = own + j < b
        total[there] += mix(word[own[there] + j] + ((own - a)[there] + j + 1).astype(U) * U(0xD1342543DE82EF95))
    return mix(total ^ seeds[np.searchsorted(p.first, a, side="right") - 1] ^ (own - a).astype(U))


def _seeds(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("seed").to_numpy().view(U)


def _chunk_counts(longest: int, period: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 21):
            p = Parsed(batch.column("text"))
            found, n = np.unique(chunk_hashes(p, _seeds(batch), chunks(p, longest, period)) >> U(64 - CHUNK_BITS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["lead", "n"])

    return run


def _parse(longest: int, period: int, repeated):
    """Chunks in ``repeated``, and per row without text how many words the others own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            p = Parsed(batch.column("text"))
            a, own, b = cut = chunks(p, longest, period)
            again = filed(repeated.value, chunk_hashes(p, _seeds(batch), cut))
            owner = np.searchsorted(p.first, a, side="right") - 1
            single = np.bincount(owner, np.where(again, 0, own - a), minlength=batch.num_rows).astype(np.int64)
            raw, begin, end = p.plain()
            a, own, b, owner = a[again], own[again], b[again], owner[again]
            texts = [raw[x:y] for x, y in zip(begin[a].tolist(), end[b - 1].tolist())]
            rest = np.flatnonzero(single)
            yield pa.RecordBatch.from_arrays(
                [batch.column("part").take(pa.array(np.concatenate((owner, rest)))), pa.array(texts + [None] * len(rest), pa.binary()).cast(pa.string()), pa.array(np.concatenate((own - a, single[rest])))],
                ["part", "text", "own"],
            )

    return run


def _weights(batch: pa.RecordBatch, p: Parsed, longest: int, period: int, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: seed of the part, copies of its chunk, whether phrases that begin there are counted here.

    A row with ``own`` is an entry of the dictionary; one without is a text, of which the chunks that are
    in the dictionary count there.
    """
    each = np.diff(p.first)
    own = batch.column("own").fill_null(-1).to_numpy()
    here = p.at < np.repeat(own, each)
    if (own < 0).any():
        a, end, b = cut = chunks(p, longest, period)
        single = ~filed(repeated, chunk_hashes(p, _seeds(batch), cut))
        here = np.where(np.repeat(own < 0, each), np.repeat(single, end - a), here)
    return np.repeat(_seeds(batch), each), np.repeat(batch.column("n").to_numpy(), each), here


def _phrase_hashes(p: Parsed, seed: np.ndarray, n: int) -> np.ndarray:
    rolled = grams(p.hashes, n)
    return mix(rolled ^ seed[: len(rolled)])


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, sums of n, a place of each)."""
    code, distinct = pd.factorize(keys)
    order = np.argsort(code, kind="stable")
    begin = np.searchsorted(code[order], np.arange(len(distinct)))
    return distinct, np.add.reduceat(n[order], begin) if len(distinct) else n[:0], order[begin]


def _counted(leads: DataFrame, bits: int) -> DataFrame:
    """``hash`` and the sum of ``n``, from the leading bits of the hashes."""
    return leads.groupBy("lead").agg(F.sum("n").alias("n")).select(F.shiftleft("lead", 64 - bits).alias("hash"), "n")


def _hash_counts(n: int, filters: list, longest: int, period: int, repeated):
    """Counts of phrases of ``n`` words by hash; ``filters`` tell the frequent phrases one word shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 21):
            p = Parsed(batch.column("text"))
            seed, copies, own = _weights(batch, p, longest, period, repeated.value)
            there = _frequent(p, seed, n, [f.value for f in filters]) & own
            at = np.flatnonzero(there)
            found, total, _ = _sums(_phrase_hashes(p, seed, n)[at] >> U(64 - PHRASE_BITS), copies[at])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(total)], ["lead", "n"])

    return run


def _frequent(p: Parsed, seed: np.ndarray, n: int, tables: list[np.ndarray]) -> np.ndarray:
    """Places of phrases of ``n`` words inside a piece whose parts can all be frequent."""
    ok = np.ones(len(p.hashes), bool)
    for k in range(1, n + 1):
        if k > 1:
            # the first k - 1 words and the last k - 1 words are candidates, and no piece ends between
            ok = np.concatenate((ok[:-1] & ok[1:] & ~p.last[:-1], [False])) if len(ok) else ok
        if k <= len(tables):
            rolled = _phrase_hashes(p, seed, k)
            ok[: len(rolled)] &= filed(tables[k - 1], rolled)
    return ok


def _phrase_counts(longest: int, filters: list, period: int, repeated):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 21):
            p = Parsed(batch.column("text"))
            seed, copies, own = _weights(batch, p, longest, period, repeated.value)
            raw, begin, end = p.plain()
            tables = [f.value for f in filters]
            places, totals, size = [], [], []
            for n in range(1, longest + 1):
                at = np.flatnonzero(_frequent(p, seed, n, tables) & own)
                _, total, where = _sums(_phrase_hashes(p, seed, n)[at], copies[at])
                places.append(at[where]), totals.append(total), size.append(np.full(len(total), n))
            at, n = np.concatenate(places), np.concatenate(size)
            texts = [raw[x:y] for x, y in zip(begin[at].tolist(), end[at + n - 1].tolist())]
            owner = np.searchsorted(p.first, at, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("part").take(pa.array(owner)), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(np.concatenate(totals))], ["part", "phrase", "f"]
            )

    return run


def collocations(
    df: DataFrame, values: str = "values", part: str = "split", longest: int = LONGEST, least: int = LEAST, top: int = TOP, inside_percent: int = 80, period: int = PERIOD, filter_bits: int = BITS
) -> DataFrame:
    """The ``top`` phrases of every ``part`` whose words keep together best.

    ``values`` is text: running text, or the moves of series as ``panel_symbols`` writes them, when the
    phrases are motifs. A-Z are lower-cased; pieces end at ``. , ; : ! ?`` and at line ends, words inside
    them at blanks and tabs. Candidates are phrases of 2 to ``longest`` words inside a piece that occur
    ``least`` times or more in the part, overlaps counted. Cut after k words, a candidate of a occurrences
    whose two parts occur l and r times scores floor(2000000 a / (l + r)); the lowest cut counts, the
    shortest first part on a tie. A candidate that stands inside a longer one with at least
    ``inside_percent`` % of its occurrences is dropped.

    Columns: ``part``, ``rank`` (from 1; by score and a, descending, then by phrase in byte order),
    ``phrase``, ``a``, ``l``, ``r``, ``n`` (words of the part) and ``score``. A NULL part is ``und``; NULL
    and empty values have no words; repeated rows count each; very long texts are parsed like any other;
    parts without a candidate and empty tables give no row. Other columns of ``df`` are not looked at.

    Method: texts are cut into overlapping chunks where their content says so (``chunks``). Chunks that
    occur again, told by a count of hashes, become entries of a dictionary with their number; the others
    are entries of number 1 and stay where they are. Phrases are counted in the distinct chunks, weighted
    by that number, each by the chunk that owns its first word, so what chunks share is counted once.
    Phrases as frequent as candidates consist of words, pairs and triples as frequent: these are first
    counted by hash, and bit tables of fixed size tell which phrases are worth counting as text. The
    tables only spare work; counts are exact, by text. Arithmetic is in integers and decimals.

    Scale: shuffles hold leading bits of hashes of chunks, repeated chunks, hashes of words and of pairs and triples of frequent parts,
    and phrases that passed, each combined per batch and on the map side, so a chunk or phrase of a third
    of all rows sends one row per batch. Texts are read once per count and not shuffled. Candidates (at
    most one in ``least`` words) are joined with their parts by key.
    """
    rows = df.select(F.coalesce(F.col(part).cast("string"), F.lit("und")).alias("part"), F.col(values).cast("string").alias("text")).withColumn("seed", F.xxhash64("part"))
    again = _counted(rows.mapInArrow(_chunk_counts(longest, period), "lead bigint, n bigint"), CHUNK_BITS).where("n > 1")
    repeated = bit_filter(again, filter_bits)
    parsed = rows.mapInArrow(_parse(longest, period, repeated), "part string, text string, own bigint")
    parse = written(parsed.groupBy("part", "text", "own").agg(F.count(F.lit(1)).alias("n")), "chunks")
    entries = parse.where("text is not null").select("part", "text", F.xxhash64("part").alias("seed"), "own", "n")
    units = rows.select("part", "text", "seed", F.lit(None).cast("bigint").alias("own"), F.lit(1).cast("bigint").alias("n")).union(entries)

    filters: list = []
    for n in range(1, min(3, longest - 1) + 1):
        counts = _counted(units.mapInArrow(_hash_counts(n, list(filters), longest, period, repeated), "lead bigint, n bigint"), PHRASE_BITS)
        filters.append(bit_filter(counts.where(F.col("n") >= least), filter_bits))
    counted = units.mapInArrow(_phrase_counts(longest, filters, period, repeated), "part string, phrase string, f bigint")
    frequent = counted.groupBy("part", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    phrases = written(frequent.select("part", "phrase", F.size(F.split("phrase", " ")).alias("words"), "f"), "phrases")

    cut = F.split("phrase", " ")
    piece = lambda a, n: F.array_join(F.slice(cut, a, n), " ")
    cuts = phrases.where("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("part", "phrase", "words", "f", "k", piece(F.lit(1), F.col("k")).alias("head"), piece(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    side = lambda name, f: phrases.select("part", F.col("phrase").alias(name), F.col("f").alias(f))
    scored = cuts.join(side("head", "l"), ["part", "head"]).join(side("rest", "r"), ["part", "rest"])
    whole = f"cast(f as decimal(20,0)) * cast({SCORE} as decimal(10,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"
    best = scored.groupBy("part", "phrase").agg(F.first("f").alias("a"), F.min(F.struct(F.expr(whole).alias("score"), "k", "l", "r")).alias("s"))

    spans = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")) for n in range(2, longest) for i in range(1, longest - n + 2)] or [F.struct(F.lit(1).alias("i"), F.lit(longest + 1).alias("n"))])
    inner = phrases.where("words > 2").withColumn("s", F.explode(spans)).where("s.n < words and s.i + s.n - 1 <= words")
    inner = inner.select("part", piece(F.col("s.i"), F.col("s.n")).alias("phrase"), "f").groupBy("part", "phrase").agg(F.max("f").alias("longer"))
    alone = best.join(inner, ["part", "phrase"], "left").where(f"longer is null or cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {inside_percent}")

    order = Window.partitionBy("part").orderBy(F.desc("s.score"), F.desc("a"), "phrase")
    ranked = alone.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = parse.groupBy("part").agg(F.sum(F.col("own") * F.col("n")).alias("total"))
    return ranked.join(total, "part").select(
        F.col("part").alias(part), F.col("rank").cast("bigint").alias("rank"), "phrase", "a", F.col("s.l").alias("l"), F.col("s.r").alias("r"), F.col("total").cast("bigint").alias("n"), F.col("s.score").cast("bigint").alias("score")
    )
