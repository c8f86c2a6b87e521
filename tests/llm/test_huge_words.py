import random

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from penforge.llm import bpe


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@pytest.mark.parametrize("size", [40, 67, 1000])
def test_rounds_in_slices_equal_the_library(codec, monkeypatch, size):
    monkeypatch.setattr(bpe, "HUGE", 40)
    monkeypatch.setattr(bpe, "SLICE", size)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(size)
    words = ["a" * 211, "=" * 164, "aab" * 60, *("".join(rng.choices("etaoinshr"[: 2 + i], k=130)) for i in range(6))]
    for store in (codec.words, codec.chunks):
        store._clear()
    assert codec.encode(pa.array(words)).to_pylist() == [library.encode_ordinary(w) for w in words]


@pytest.mark.parametrize("letter, n", [("a", 2_000_000), ("=", 5_000_000), ("a", 20_000_000)])
def test_words_of_many_megabytes(codec, letter, n):
    ids = codec.encode(pa.array([letter * n]))
    assert codec.decode(ids) == [letter.encode() * n]
    per = {len(w): i for w, i in codec.ranks.items() if set(w) == {ord(letter)}}
    assert len(set(ids[0].as_py()[: n // max(per) - 1])) == 1  # a run of one letter is its longest token over and over
