"""The chunked scan against a plain Python loop, with chunks forced small."""

import random

from pyspark.sql import functions as F

from cutline.plans import scan as S


def test_scan_matches_loop(spark, tiny_chunks):
    rng = random.Random(3)
    rows = []
    for key in range(4):
        for i in range(0 if key == 3 else 60 * (key + 1)):
            rows.append((key, rng.randrange(40), i, rng.choice([None, rng.randrange(100)])))
    df = spark.createDataFrame(rows, "k long, t long, i long, v long")
    got = (
        S.Scan(df, ["k"], ["t", "i"])
        .run(
            mx=S.running_max(F.col("v")),
            sm=S.running_sum(F.col("v"), inclusive=True),
            ix=S.row_index(),
            la=S.last_value(F.col("v")),
            nx=S.next_value(F.col("v")),
            pv=S.previous_row(F.col("v")),
        )
        .run(pv2=S.previous_row(F.col("pv")))
        .df.collect()
    )
    assert len(got) == len(rows)
    assert S.with_chunks(df, ["k"], ["t", "i"]).select(S.CHUNK).distinct().count() > 5
    by_key = {}
    for r in got:
        by_key.setdefault(r.k, []).append(r)
    for rs in by_key.values():
        rs.sort(key=lambda r: (r.t, r.i))
        mx = la = None
        total = 0
        for n, r in enumerate(rs):
            assert r.mx == mx and r.ix == n
            total += r.v or 0
            assert (r.sm or 0) == total
            if r.v is not None:
                la, mx = r.v, r.v if mx is None else max(mx, r.v)
            assert r.la == la
            assert r.nx == next((x.v for x in rs[n + 1:] if x.v is not None), None)
            assert r.pv == (rs[n - 1].v if n else None)
            assert r.pv2 == (rs[n - 2].v if n > 1 else None)


def test_chunks_follow_the_order(spark, tiny_chunks, monkeypatch):
    """All three levels of split points, with ties on the leading column."""
    monkeypatch.setattr(S, "_FANOUT", 4)
    df = spark.range(3000).selectExpr("id % 2 as k", "id div 20 as t", "id as i")
    rows = S.with_chunks(df, ["k"], ["t", "i"]).collect()
    assert len(rows) == 3000
    for key in (0, 1):
        own = sorted((r.t, r.i, r[S.CHUNK]) for r in rows if r.k == key)
        chunks = [c for _, _, c in own]
        assert chunks == sorted(chunks) and 150 < len(set(chunks)) < 600
        assert max(chunks) >> 40 > 1 and max(c >> 20 & 0xFFFFF for c in chunks) > 1


def test_more_points_than_one_list_could_hold(spark):
    """Over 65 536 split points of one key; chunks stay small."""
    spark.conf.set(S.CONF_ROWS, "3")
    try:
        df = spark.range(260_000).selectExpr("1 as k", "id as t")
        out = S.with_chunks(df, ["k"], ["t"]).groupBy(S.CHUNK).count().agg(F.count("*"), F.max("count")).first()
        assert out[0] > 65_536 and out[1] < 80
    finally:
        spark.conf.unset(S.CONF_ROWS)
