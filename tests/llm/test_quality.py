"""Held-out accuracy, and scores against a slow reading of the same model."""

import math
import zlib

import numpy as np
import xxhash

from cutline.llm import quality as ql

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    out = ql.op4_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    held = out[out.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    bad, good = held[held.quality == 0].score, held[held.quality == 1].score
    auc = (good.to_numpy()[:, None] > bad.to_numpy()).mean()
    assert auc > 0.97


def slow(text, model, buckets):
    vectors, weights, bias = model
    words = text.encode().split()
    feats = []
    for w in words:
        f = b"<" + w + b">"
        feats.append(xxhash.xxh3_64_intdigest(f) % buckets)
        feats += [xxhash.xxh3_64_intdigest(f[k:k + n]) % buckets for n in (3, 4) for k in range(len(f) - n + 1) if n < len(f)]
    for a, b in zip(words, words[1:]):
        x = (xxhash.xxh3_64_intdigest(a, 7) * int(ql.PAIR) + xxhash.xxh3_64_intdigest(b, 7)) % (1 << 64)
        feats.append((int(ql.SAME) if a == b else int(ql.mix(np.array([x], np.uint64))[0])) % buckets)
    hidden = vectors[feats].mean(axis=0) if feats else np.zeros(vectors.shape[1])
    z = hidden @ weights + bias
    return 1 / (1 + math.exp(z[0] - z[1]))


def test_edge_cases(spark):
    rows = [(1, "good words here"), (2, "good words there"), (3, "!!! ### $$$"), (4, "### !!!"), (6, ""), (7, None),
            (None, "good"), (8, "x x x y " * 50), (9, "good words " * 9000), (1, "good words here"), (11, "é à\x85ü")]
    docs = spark.createDataFrame([(*r, 1, "a") for r in rows], "doc_id long, text string, score int, label string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0), (4, None), (None, 1), (99, 1)], "doc_id long, quality int")
    args = dict(buckets=64, dim=4, epochs=40)
    sample = ql.sample_rows(ql.texts(docs), labels, 100, 20_000, 5, "quality")
    assert {r for r in sample} <= {(b"good words here", 1), (b"good words there", 1), (b"!!! ### $$$", 0), (b"### !!!", 0)}
    model = ql.train(sample, 64, 4, 40, 2.0)
    got = ql.score(docs, labels, **args).collect()
    assert len(got) == len(rows)
    want = {i: slow(t or "", model, 64) for i, t in rows}
    for r in got:
        assert abs(r.score - want[r.doc_id]) < 1e-5 and r.predicted == (r.score >= 0.3)
    none = ql.score(docs, labels.limit(0), **args).collect()
    assert {r.score for r in none} == {0.5}
    assert ql.score(docs.limit(0), labels, **args).collect() == []
