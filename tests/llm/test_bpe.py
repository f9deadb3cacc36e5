import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from docmill.llm.bpe import Codec, encode, read_ranks, serialise_model  # noqa: E402

TOKENS = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def codec():
    return Codec(serialise_model(TOKENS), TOKENS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={})


def same(codec, reference, text):
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text), text[:80]
    assert codec.decode(ids) == text.encode()


def test_random_texts(codec, reference):
    r = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "\t", "　", "é", "中", "👍", "1", "٣", "'s", "'LL", "!", "\x1c", "\x85", "\u200b", "<|endoftext|>", "▁", "aaaaaaaa", "\x00", "tion"]
    for _ in range(2000):
        same(codec, reference, "".join(r.choice(parts) for _ in range(r.randrange(40))))


def test_code_points(codec, reference):
    for at in range(0, 0x30000, 7):
        if not 0xD800 <= at < 0xE000:
            c = chr(at)
            same(codec, reference, f"a{c}b {c}{c}1{c} x  {c}")


@pytest.mark.parametrize("text", ["a" * 100_000, " " * 30_000, "\n" * 20_000 + "x", "ab" * 30_000])
def test_long_pretokens(codec, reference, text):
    same(codec, reference, text)


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "héllo wörld", "k"), (3, "héllo wörld", "k"), (None, "x" * 50_000, "k")], "doc_id long, text string, n_tokens string")
    rows = encode(spark, docs, vocabulary=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN, decoded="decoded").collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows[:2]] == [(0, empty, empty)] * 2
    assert rows[2] == rows[3] and rows[2].decoded == "héllo wörld" and len(rows[2].ids) == rows[2].n_tokens
    assert rows[4].decoded == "x" * 50_000
    assert encode(spark, docs.limit(0), vocabulary=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN).count() == 0
