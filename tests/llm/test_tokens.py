"""Token ids of words equal those of the tokenizer, whichever way a word is encoded."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

ODD = ["Kelvin", "Ångström", "İstanbul", "Straße", "ªºµ", "ét", "l'eau", "don't", "x1y", "×÷", "naïve", "ÉCOLE", "à ­á", "ſ", "ﬁn", "日本", "'s", "ÐÞÿ"]


def _texts(n: int) -> list[str]:
    rng = random.Random(8)
    letters = [*map(chr, range(97, 123)), *map(chr, range(65, 91)), *map(chr, range(0xC0, 0x100))]
    words = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(n)]
    return [" ".join(rng.choice(words) for _ in range(60)) for _ in range(n)]


def _equal(path: str, texts: list[str]) -> None:
    from tokenizers import Tokenizer

    from accuracast.llm.tokens import WordTokens

    plain = Tokenizer.from_file(path)
    ids, offsets = WordTokens(path).encode(pa.array(texts))
    for text, a, b in zip(texts, offsets[:-1], offsets[1:]):
        assert ids[a:b].tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1]


def test_words_of_letters_leave_the_pattern_out(monkeypatch):
    from accuracast.llm.tokens import WordTokens, default_tokenizer

    _equal(default_tokenizer(), _texts(400))
    coder, seen = WordTokens(default_tokenizer()), []
    both = coder._any
    monkeypatch.setattr(coder, "_any", lambda words: seen.extend(words) or both(words))
    coder.encode(pa.array(["plain words naïve ÉCOLE Straße l'eau 日本"]))
    assert sorted(seen) == ["l'eau", "日本"]


def test_tokenizers_of_another_kind_keep_their_pattern(tmp_path):
    import json

    from accuracast.llm.tokens import WordTokens, default_tokenizer

    spec = json.load(open(default_tokenizer()))
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[a-m]+|[^\sa-m]+"
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    assert WordTokens(str(path)).letters is None
    coder = WordTokens(str(path))
    coder.learn(np.array([5, 3], np.uint64), ["amnz", "Straße"])
    got = {int(h): coder.ids[b : b + n].tolist() for h, b, n in zip(coder.known, coder.begin, coder.count)}
    assert got == {h: coder.tokenizer.encode(w, add_special_tokens=False).ids for h, w in ((5, "amnz"), (3, "Straße"))}
