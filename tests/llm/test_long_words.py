"""Long words take few steps and encode like the library."""

import base64
import random
import time

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from scorelake.llm import bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(RANKS, P.PATTERN)


ALPHABETS = ["ab", "a", "etaoin", "abcdefghijklmnopqrstuvwxyz", "éèaß", "中文的一是不了人", "0123456789", " ", "the ing tion er und".split()]


def test_contraction_in_few_steps_is_the_contraction(codec, encoding):
    rng = random.Random(4)
    for _ in range(300):
        letters = rng.choice(ALPHABETS)
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(2, rng.choice([6, 40, 500])))).encode()
        assert codec._contract_long(word).tolist() == encoding._encode_single_piece(word)


def test_small_merge_tables(tmp_path):
    """Random vocabularies over two or three letters, where merges undercut each other often."""
    rng = random.Random(8)
    for round_ in range(25):
        tokens = [bytes([b]) for b in range(256)]
        letters = "abc"[:rng.randrange(2, 4)]
        while len(tokens) < 256 + 12:
            a, b = (rng.choice([x for x in tokens if set(x) <= set(letters.encode())]) for _ in range(2))
            if a + b not in tokens:
                tokens.append(a + b)
        made = tokens[256:]
        rng.shuffle(made)                   # ranks that no training would give
        ranks = {token: k for k, token in enumerate(tokens[:256] + made)}
        path = tmp_path / f"r{round_}"
        path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % k for t, k in ranks.items()))
        codec = bpe.DuckCodec(str(path), P.PATTERN)
        library = tiktoken.Encoding(f"r{round_}", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for _ in range(20):
            word = "".join(rng.choice(letters) for _ in range(rng.randrange(2, 60))).encode()
            assert codec._contract_long(word).tolist() == library._encode_single_piece(word), (ranks, word)
            assert np.concatenate(codec._contract([word])).tolist() == library._encode_single_piece(word)


@pytest.mark.parametrize("make", [lambda rng: "a" * 1_000_000, lambda rng: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)),
                                  lambda rng: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(333_000)),
                                  lambda rng: "".join(rng.choices(["the", "ing", "tion", "er", "und"], k=60_000))])
def test_a_megabyte_without_a_space(codec, encoding, make):
    word = make(random.Random(2))
    start = time.time()
    ids, counts = codec.tokens(pa.array([word]))
    assert time.time() - start < 120 and counts[0] == len(ids)
    assert b"".join(encoding.decode_single_token_bytes(x) for x in ids.tolist()) == word.encode()
    head = word[:3000]
    got, _ = codec.tokens(pa.array([head]))
    assert got.tolist() == encoding.encode_ordinary(head)
