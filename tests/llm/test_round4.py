"""Token files: what a worker keeps of the parts it has met."""

from __future__ import annotations

import numpy as np

from sessionforge.llm import token_files
from sessionforge.llm.queries import vocabulary


def test_encoder_keeps_each_word_once_and_few_of_them(monkeypatch):
    """Words with and without a comma share what is kept; frequent parts outlive a full cache; ids stay the library's."""
    enc = token_files.Encoder(vocabulary("byte_bpe_50k.json"))
    texts = ["Harbor lights, harbor lights. a1-b2 ünd Ünd, naïve. x", "lights", ",", " . ,", "it's don't, 3.5, 日本 語, tab\tand\nline", "a,b, c.,d", "Ⅷ ² x², ǅ"]
    monkeypatch.setattr(token_files, "CACHE_ENTRIES", 8)
    for _ in range(3):
        for t in [*texts, " ".join(f"word{i} w{'abcdefghij'[i % 10]}x, the" for i in range(40))]:
            assert np.frombuffer(enc(t), enc.kind).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, t
            assert len(enc.first) <= 8 and len(enc.later) <= 8 and len(enc.words) <= 8
    fresh, asked = token_files.Encoder(vocabulary("byte_bpe_50k.json")), []
    word = fresh.word
    fresh.word = lambda shown: (asked.append(shown), word(shown))[1]
    fresh("x lights lights, lights.")
    assert sum("lights" in shown for shown in asked) == 1 and not any("lights" in shown for shown in fresh.words)
