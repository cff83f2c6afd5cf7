"""Runs without white space, however long, are encoded and counted as the public libraries do, in bounded time."""

import base64
import random
import string
import time

import numpy as np
import pytest
import tiktoken
from tokenizers import Tokenizer

from waypost.llm.bpe_files import PATTERN, read_file, read_ranks, tokenizer_path
from waypost.llm.byte_bpe import Encoder, encode_block
from waypost.llm.token_counts import MergeTable, count_block

RNG = random.Random(7)
HAN = "的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年得就那要下以生会自着去之过家学"
LONG = {
    "letters": "".join(RNG.choices(string.ascii_letters, k=1_000_000)),
    "base64": base64.b64encode(RNG.randbytes(750_000)).decode(),
    "lower": "".join(RNG.choices(string.ascii_lowercase, k=100_000)),
    "repeated": "a" * 100_000,
    "pairs": "ab" * 30_000,
    "han": "".join(RNG.choices(HAN, k=20_000)),
    "glued": "thequickbrownfoxjumpsoverthelazydogandnobodyknowswhy" * 300,
}


@pytest.fixture(scope="module")
def ranks():
    return read_file(tokenizer_path("byte_bpe_multi_50k.tiktoken"))


@pytest.mark.parametrize("name", LONG)
def test_long_words_encode_like_the_library(ranks, name):
    text = f"one {LONG[name]} two"
    library = tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=read_ranks(ranks), special_tokens={})
    encoder = Encoder(ranks)
    start = time.perf_counter()
    n, ids, decoded = encode_block([text, "one"], encoder)
    assert time.perf_counter() - start < 40
    assert ids[0] == ",".join(map(str, library.encode_ordinary(text))) and decoded[0] == text.encode()
    assert n[0] == ids[0].count(",") + 1 and ids[1] == ",".join(map(str, library.encode_ordinary("one")))


@pytest.mark.parametrize("name", LONG)
def test_long_words_count_like_the_library(name):
    path = tokenizer_path("word_bpe_49k.json")
    text = f"one {LONG[name]} two"
    start = time.perf_counter()
    found = count_block([text], MergeTable(read_file(path)))
    assert time.perf_counter() - start < 40
    assert found[0] == len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)


def test_words_are_cut_only_where_no_merge_spans(ranks):
    encoder = Encoder(ranks)
    library = tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=read_ranks(ranks), special_tokens={})
    for word in ("".join(RNG.choices(string.ascii_letters, k=60)).encode() for _ in range(200)):
        pieces = encoder.pieces(word)
        assert b"".join(pieces) == word
        assert np.concatenate([library.encode_ordinary(p.decode()) for p in pieces]).tolist() == library.encode_ordinary(word.decode())
