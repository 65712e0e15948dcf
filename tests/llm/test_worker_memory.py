"""What a reused Python worker keeps between tasks."""

import sys

import public_tokenizers

from inkstone.llm import shared
from inkstone.llm.token_cache import WordCache, word_cache


def test_word_cache_grows_with_its_units():
    cache = WordCache(public_tokenizers.path("word_bpe_49k.json"), "word", limit=90_000)
    arrays = lambda: sum(x.nbytes for x in vars(cache).values() if hasattr(x, "nbytes"))
    assert arrays() < 4e6
    for lot in range(6):  # grows several times, then is emptied
        words = [f"lot{lot}word{k}" for k in range(20_000)]
        got = list(cache.encode([" ".join(words), "", words[7]]))
        assert got[0] == cache._encoded([" ".join(words)])[0] and got[1] == b"" and got[2] == cache._encoded([words[7]])[0]
    assert cache.n <= 90_000 and 2 * cache.n <= len(cache.slot_unit)


def test_kept_things_can_be_dropped():
    path = public_tokenizers.path("word_bpe_49k.json")
    first = word_cache(path, "word")
    assert word_cache(path, "word") is first
    shared.drop_kept()
    assert "_inkstone_kept" not in sys.modules and word_cache(path, "word") is not first
