"""Counts against the public library."""

import random

import pytest
import sentencepiece

from cutline.llm import token_counts as tc


@pytest.fixture(scope="module")
def library():
    sp = sentencepiece.SentencePieceProcessor(model_file=tc.default_model())
    return lambda t: len(sp.encode(t, num_threads=1)) if t else 0


ODD = ["", None, "ab" * 3000, " " * 3001, " a  b   c    d", "\n\n\t x\n y", "<s> </s> <unk> <0x41>",
       "日本語 déjà 🙂🙂 ▁x▁▁y", "a" * 1001, "é​", "0" * 77]


def test_documents_and_edge_cases(spark, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(-1 - i, t) for i, t in enumerate(ODD)] + [(None, "null id"), rows[0]]
    frame = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, n_tokens string")
    got = sorted((tuple(r) for r in tc.token_counts(frame, limit=50).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), n := library(t), n > 50) for i, t in rows), key=str)
    assert got == want


def test_random_texts(library):
    rng = random.Random(3)
    counter = tc.Counter(tc.default_model())
    docs = ["".join(rng.choice("aaeinorst  é.\n漢") for _ in range(rng.randrange(200))) for _ in range(400)]
    assert counter.count_texts(docs).tolist() == [library(d) for d in docs]
    assert [counter._queue(tc.MARK + d.replace(" ", tc.MARK)) for d in docs if d] == [library(d) for d in docs if d]


def test_empty_table(spark):
    assert tc.token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
