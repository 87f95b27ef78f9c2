"""Every stage of the pipeline on its own input, against plain readings."""

import base64

import public_tokenizers as P
import tiktoken

import corpus_pipeline as cp
from cutline.llm import pii
from tests_llm_plain import decontam_plain, divergence_plain, near_plain

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_stages(spark):
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(90_001, None, None, None, None), (90_002, "", "en", "s", 0), (None, "no id " * 60, "en", "s", 3)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).union(docs.limit(5))
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    names = docs.columns
    seen = []
    for name, step in cp.STAGES[:-1]:
        before = rows_of(docs)
        out = step(spark, docs, SF)
        assert out.columns == names, name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}-{len(seen)}-{id(docs)}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after = rows_of(docs)
        if name == "quality_rules":
            want = [r for r in before if divergence_plain(r, before)]
        elif name == "near_dedup":
            want = near_plain(before)
        elif name == "decontaminate":
            leaked = decontam_plain([(r[0], r[1]) for r in before], items)
            want = [r for r in before if r[0] not in leaked]
        else:
            assert [r[0] for r in after] == [r[0] for r in before]
            text = {r[0]: r[1] for r in after}
            for r in before:
                assert not pii.base_spans(text[r[0]]) and (bool(pii.base_spans(r[1])) <= (text[r[0]] != r[1]))
            seen.append(name)
            continue
        assert after == sorted(want, key=str), name
        assert len(after) < len(before), name
        seen.append(name)
    assert seen == [n for n, _ in cp.STAGES[:-1]]
    encoded = cp.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id: r.ids for r in encoded.collect()} == {
        r.doc_id: coder.encode_ordinary(r.text) for r in docs.collect()}


def test_run_is_the_stages_in_order(spark):
    out = cp.run(spark, SF)
    assert out.columns == ["doc_id", "ids"] and 0 < out.count() < 200


def test_stages_on_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, step in cp.STAGES:
        assert step(spark, docs, SF).count() == 0
