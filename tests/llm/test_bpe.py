"""Encoding against the public library, decoding as an exact round trip."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from cutline.llm import bpe

LONG = "ab" * 30_000


@pytest.fixture(scope="module")
def library():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_documents_and_edge_cases(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    odd = ["", None, LONG, " " * 5000, "\n\n\t x", "<|endoftext|> it's 12345", "日本語 déjà 🙂🙂", "aaaaaaaaaa" * 50]
    rows += [(-1 - i, t) for i, t in enumerate(odd)] + [(None, "null id"), (0, rows[0][1])]
    frame = spark.createDataFrame([(a, b, "x", [1]) for a, b in rows], "doc_id long, text string, n_tokens string, ids array<int>")
    encoded = bpe.encode(frame)
    got = sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=str)
    want = sorted(((i, library.encode_ordinary(t or "")) for i, t in rows), key=str)
    assert got == want
    back = sorted(((r.doc_id, r.text) for r in bpe.decode(encoded).collect()), key=str)
    assert back == sorted(((i, t or "") for i, t in rows), key=str)
    lists = spark.createDataFrame([(1, None), (2, []), (None, [0, 1])], "doc_id long, ids array<int>")
    assert {r.doc_id: len(r.text) for r in bpe.decode(lists).collect()} == {1: 0, 2: 0, None: 2}
    for r in bpe.round_trip(frame).where("doc_id = -3").collect():
        ids = np.array(library.encode_ordinary(LONG), "<u4")
        assert r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()


def test_random_words(library):
    rng = random.Random(5)
    coder = bpe.Encoder(bpe.default_ranks(), bpe.default_pattern())
    docs = ["".join(rng.choice("abcdeinorst éß\n") for _ in range(rng.randrange(300))) for _ in range(200)]
    ids, lens = coder.encode(docs)
    want = [library.encode_ordinary(d) for d in docs]
    assert lens.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(none)).collect() == []
