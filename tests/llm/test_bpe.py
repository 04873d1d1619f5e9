import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from conftest_llm import as_multiset, texts_of
from scorelattice.llm import bpe

RANKS = bpe.read_ranks(public_tokenizers.path(bpe.RANKS))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def want(rows, library):
    out = []
    for i, text in rows:
        ids = library.encode_ordinary(text)
        shown = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        out.append((i, len(ids), shown, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(docs, **settings):
    return as_multiset(bpe.encode_digests(docs, **settings), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def test_against_the_library(small, library):
    docs = small("documents")
    assert got(docs) == want(texts_of(docs), library)


@pytest.mark.parametrize("block_tokens", [1, 50, 4_000_000])
def test_odd_rows_and_blocks(odd, none, library, block_tokens):
    assert got(odd, block_tokens=block_tokens) == want(texts_of(odd), library)
    assert got(none) == []


def test_long_and_short_merges_agree(library):
    r = random.Random(3)
    for size in (1, 2, 7, 63, 64, 65, 200, 1000):
        for alphabet in ("ab", "etaoin shr", "日本語é"):
            word = "".join(r.choice(alphabet) for _ in range(size)).replace(" ", "x").encode()
            assert bpe.merge(word, RANKS) == bpe._merge_long(word, RANKS) == library._core_bpe.encode_single_piece(word)


def test_round_trip_of_ids(odd, spark):
    ids = bpe.encode(odd)
    back = sorted(((r["doc_id"], bytes(r["data"])) for r in bpe.decode(ids).collect()), key=repr)
    assert back == sorted(((i, t.encode()) for i, t in texts_of(odd)), key=repr)


def test_another_vocabulary(small):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    other = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    docs = small("documents", "/root/testdata/sf0.001")
    assert got(docs, ranks_path=path) == want(texts_of(docs), other)


def test_equal_blocks(spark, library):
    """Two parts with the same rows are blocks of one name; both come back."""
    rows = [(1, "the same words here"), (2, "and here")]
    twice = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert got(twice.unionAll(twice)) == sorted(want(rows, library) * 2, key=repr)
