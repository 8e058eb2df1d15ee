"""Token ids of texts by a public tokenizer, one encoding per distinct word of a worker."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accuracast.llm.textarrays import SPACED, U, slices, text_buffers, words

#: Distinct words a worker remembers; beyond that it starts anew.
KEPT_WORDS = 3_000_000
END_ID = 1
#: A control character that stands between words while they are encoded.
MARK = "\x1f"

#: Words that the pre-tokenizer ``LETTERS_SPLIT`` leaves whole and composition unchanged.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
LETTERS_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes as the characters a byte-level vocabulary spells them with; the blank stays, it stands between words.
_PRINTED = np.array([0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b for b in range(256)])
_SPELLED = np.where(_PRINTED, np.arange(256), 255 + np.cumsum(~_PRINTED)).astype("<u2")
_SPELLED[0x20] = 0x20

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and b != ord("'")]] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _cut(m: np.ndarray, breaks: np.ndarray) -> None:
    """Places inside a run where the pre-tokenizer splits whatever stands around: beside a digit, and
    between a letter and punctuation. Letters are a-z and the two-byte letters of Latin-1; the
    apostrophe is left alone because contractions begin with it."""
    latin = np.zeros(len(m), bool)
    latin[1:] = (m[:-1] == 0xC3) & (m[1:] != 0x97) & (m[1:] != 0xB7)
    ends = _LETTER[m] | latin
    begins = _LETTER[m]
    begins[:-1] |= latin[1:]
    digit, mark = _DIGIT[m], _MARK[m]
    breaks[1:-1] |= digit[1:] | digit[:-1] | (ends[:-1] & mark[1:]) | (mark[:-1] & begins[1:])


def letter_coder(tokenizer):
    """(tokenizer of words of letters, which ids end a word), or None where the given one is of another kind.

    A word of a-z and letters of Latin-1 passes its pre-tokenizer and, lower-cased, its normalizer as it
    is, so its ids are those of the model alone: most of the time of an encoding goes into the pattern.
    """
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import Split

    spec = json.loads(tokenizer.to_str())
    model, normal, pre = spec["model"], spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
    if model.get("type") != "BPE" or not model["end_of_word_suffix"] or model["continuing_subword_prefix"] or model["dropout"] or model["unk_token"]:
        return None
    if [x["type"] for x in normal.get("normalizers", [])] != ["NFC", "Replace", "Lowercase"] or normal["normalizers"][1]["pattern"] != {"Regex": r"\s+"}:
        return None
    steps = pre.get("pretokenizers", [])
    if [x["type"] for x in steps] != ["Split", "ByteLevel"] or steps[1]["add_prefix_space"] or steps[1]["use_regex"]:
        return None
    if (steps[0]["pattern"], steps[0]["behavior"], steps[0]["invert"]) != ({"Regex": LETTERS_SPLIT}, "Removed", True):
        return None
    if any(_LETTERS.fullmatch(x["content"]) for x in spec["added_tokens"]):
        return None
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    ends[[i for x, i in model["vocab"].items() if x.endswith(model["end_of_word_suffix"])]] = True
    coder = Tokenizer(tokenizer.model)
    coder.pre_tokenizer = Split(" ", "removed")
    return coder, ends


class WordTokens:
    """Ids of texts as if each had been encoded alone, without special tokens added.

    The tokenizer works on words, so a word is encoded once and found again by its 64-bit hash. A text
    that may spell a special token is encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        alone = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        fast = hasattr(self.tokenizer, "encode_batch_fast")
        self.mark = alone[0] if len(alone) == 1 and fast else None
        self.letters = letter_coder(self.tokenizer) if fast else None
        self.forget()

    def forget(self) -> None:
        self.known, self.begin, self.count, self.ids = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def learn(self, hashes: np.ndarray, spelled: list[str]) -> None:
        """Encode words, many in one call, and file their ids by hash."""
        kinds = [(np.arange(len(spelled)), self._any)]
        if self.letters is not None:
            plain = np.fromiter((_LETTERS.fullmatch(w) is not None for w in spelled), bool, len(spelled))
            kinds = [(np.flatnonzero(plain), self._of_letters), (np.flatnonzero(~plain), self._any)]
        counts, ids = [], []
        for at, coded in kinds:
            each, texts = coded([spelled[i] for i in at.tolist()])
            counts.append(each)
            ids += texts
        hashes, counts = hashes[np.concatenate([at for at, _ in kinds])], np.concatenate(counts)
        begins = len(self.ids) + np.cumsum(counts) - counts
        order = np.argsort(hashes)
        at = np.searchsorted(self.known, hashes[order])
        self.known, self.begin, self.count = (np.insert(x, at, y[order]) for x, y in ((self.known, hashes), (self.begin, begins), (self.count, counts)))
        self.ids = np.concatenate([self.ids, *ids])

    def _of_letters(self, spelled: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        coder, last = self.letters
        counts, ids = np.zeros(len(spelled), np.int64), []
        for a in range(0, len(spelled), 300):
            part = spelled[a : a + 300]
            raw = np.frombuffer(" ".join(part).lower().encode(), np.uint8)
            found = np.array(coder.encode_batch_fast([_SPELLED[raw].tobytes().decode("utf-16-le")], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(last[found])
            if len(ends) != len(part):
                # a letter the vocabulary lacks
                each, texts = self._any(part)
                counts[a : a + len(part)] = each
                ids += texts
                continue
            counts[a : a + len(part)] = np.diff(ends, prepend=-1)
            ids.append(found)
        return counts, ids

    def _any(self, spelled: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        counts, ids = np.zeros(len(spelled), np.int64), []
        for a in range(0, len(spelled), 2000):
            part = spelled[a : a + 2000]
            if self.mark is not None and not any(MARK in w for w in part):
                # a mark after each word tells where it ends, and no offsets are kept
                found = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join(part) + f" {MARK}"], add_special_tokens=False)[0].ids, self.dtype)
                ends = np.flatnonzero(found == self.mark)
                if len(ends) == len(part):
                    counts[a : a + len(part)] = np.diff(ends, prepend=-1) - 1
                    ids.append(found[found != self.mark])
                    continue
            begins = np.cumsum([0, *(len(w) + 1 for w in part)])
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            at = np.fromiter((x[0] for x in found.offsets), np.int64, len(found.ids))
            counts[a : a + len(part)] = np.bincount(np.searchsorted(begins, at, side="right") - 1, minlength=len(part))
            ids.append(np.array(found.ids, self.dtype))
        return counts, ids

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of all texts, END_ID after each."""
        data, offsets = text_buffers(column)
        start, end, hashes, first = words(data, offsets, SPACED, _cut)
        if len(self.known) > KEPT_WORDS:
            self.forget()
        code, distinct = pd.factorize(hashes, sort=True)
        at = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        new = self.known[at] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if new.any():
            sample = np.empty(len(distinct), np.int64)
            sample[code[::-1]] = np.arange(len(code))[::-1]
            raw = memoryview(data)
            self.learn(distinct[new], [bytes(raw[a:b]).lower().decode() for a, b in zip(start[sample[new]].tolist(), end[sample[new]].tolist())])
            at = np.searchsorted(self.known, distinct)
        counts = self.count[at][code]
        into = np.repeat(self.begin[at][code] - (np.cumsum(counts) - counts), counts)
        ids = self.ids[into + np.arange(len(into))]
        total = np.concatenate(([0], np.cumsum(counts)))[first]
        texts = len(first) - 1
        out = np.full(len(ids) + texts, END_ID, self.dtype)
        out[np.arange(len(ids)) + np.repeat(np.arange(texts), np.diff(total))] = ids
        total = total + np.arange(texts + 1)
        marks = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        odd = np.unique(np.searchsorted(offsets, marks, side="right") - 1)
        if len(odd):
            parts = [out[a:b] for a, b in zip(total[:-1], total[1:])]
            for i in odd.tolist():
                parts[i] = np.append(self.whole(data[offsets[i] : offsets[i + 1]].tobytes().decode()), np.array(END_ID, self.dtype))
            out, total = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return out, total


_loaded: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]


def id_lists(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary cells with the ids of each text, little-endian."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * ids.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])


def sorted_terms(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids, how often each occurs); 16-bit ids are sorted by radix."""
    x = np.sort(ids, kind="stable")
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    return x[at], np.diff(at, append=len(x))


def token_ids(df: DataFrame, key: str, text: str, path: str | None = None, counts: bool = False) -> DataFrame:
    """``key``, ``n_tokens bigint`` and ``ids binary``: the ids of each text and the end id.

    With ``counts`` there is a further column ``counts binary`` and, as its last, one row per task that has
    nothing else: in how many of its texts each id occurs, as pairs of 64-bit numbers, after the pairs
    (-1, texts) and (-2, ids).

    Ids are little-endian, of 16 bits where the vocabulary has at most 65,536 entries and of 32 bits
    else. A NULL text is empty and has the end id alone. No shuffle; batches are cut by bytes.
    """
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_tokens(path)
        seen, texts, total, key_type = np.zeros(1, np.int64), 0, 0, None
        for batch in slices(batches, "text", 1 << 21):
            ids, offsets = coder.encode(batch.column("text"))
            columns = [batch.column("key"), pa.array(np.diff(offsets)), id_lists(ids, offsets)]
            if counts:
                here = np.bincount(np.concatenate([sorted_terms(ids[a:b])[0] for a, b in zip(offsets[:-1], offsets[1:])]))
                here[: len(seen)] += seen[: len(here)]
                seen = np.concatenate((here, seen[len(here) :]))
                texts, total, key_type = texts + batch.num_rows, total + len(ids), batch.column("key").type
                columns.append(pa.nulls(batch.num_rows, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)
        if key_type is not None:
            at = np.flatnonzero(seen)
            pairs = np.stack((np.concatenate(([-1, -2], at)), np.concatenate(([texts, total], seen[at]))), 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, key_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([pairs.tobytes()], pa.binary())], names)

    names = ["key", "n_tokens", "ids", *(["counts"] if counts else [])]
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n_tokens bigint, ids binary{', counts binary' if counts else ''}")


def id_width(path: str | None = None) -> str:
    """numpy name of the id type that ``token_ids`` writes."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path or default_tokenizer()).get_vocab_size() <= 1 << 16 else "<u4"
