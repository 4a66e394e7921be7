"""The cache of word pieces forgets rare ones and keeps what is met often."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest

from starloom.llm import bpe as bpe_module
from starloom.llm import token_file
from starloom.llm.bpe import END_ID, CachedBpe


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_full_cache_keeps_frequent_pieces(name, monkeypatch):
    often = "the quick brown fox, the lazy dog. "
    texts = [often * 8 + " ".join(f"w{i}x{j} café{j}z{i}" for j in range(20)) + "\n  end" for i in range(12)]
    bpe = CachedBpe(public_tokenizers.path(name), cached=60)
    new: list[str] = []
    encode = CachedBpe._encode
    monkeypatch.setattr(CachedBpe, "_encode", lambda self, pieces, *a: new.extend(pieces) or encode(self, pieces, *a))
    for text in texts:
        ids, sizes = bpe.encode([text, None, ""])
        want = bpe.tokenizer.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == [*want, END_ID, END_ID, END_ID] and sizes.tolist() == [len(want) + 1, 1, 1]
    assert new.count("quick") == 1  # once after each overflow before
    assert bpe.count < 60 + 100


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_plain_words_need_no_pattern(name, monkeypatch):
    asked: list[str] = []
    word = bpe_module._WORD
    monkeypatch.setattr(bpe_module, "_WORD", lambda p: asked.append(p) or word(p))  # every piece was matched before
    other = [chr(c) for c in range(0xC0, 0x100)]
    text = "Plain words, more of them!? x9 ;; a.b " + " ".join(f"É{c}a{c}ÃÃ{c}..." for c in other) + "\nÃ end* ñ漢 ٣"
    bpe = CachedBpe(public_tokenizers.path(name), None)
    assert bpe.encode([text])[0].tolist() == bpe.tokenizer.encode(text, add_special_tokens=False).ids
    assert asked and not any(p.isascii() for p in asked)


@pytest.mark.parametrize("most", [1, 200, 300, 70_000, 1 << 25])
def test_ranks_come_back(most):
    ranks = np.random.default_rng(most).integers(0, most, 1001).astype(np.uint32)
    control, data = token_file.encode_ranks(ranks)
    assert token_file.decode_ranks(control, data, len(ranks)).tolist() == ranks.tolist()
    assert len(data) == sum(1 + (r > 255) + (r > 65535) + (r > 0xFFFFFF) for r in ranks.tolist())
