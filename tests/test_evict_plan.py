"""Eviction sends no side of its join to the driver, however small it looks."""

from cutline.operators import planning as G


def test_no_side_is_broadcast(spark):
    items = spark.range(200).selectExpr("id % 3 as doc_id", "id as item_id", "id * 7 % 50 as last_seen", "id % 10 = 0 as visible")
    out = G.evict_cold(items)
    rows = out.collect()
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    seen = {}
    for k in range(200):
        seen.setdefault(k % 3, []).append((k * 7 % 50, k, k % 10 == 0))
    want = {(d, k, t) for d, all_ in seen.items() for t, k, _ in sorted(r for r in all_ if not r[2])[:len(all_) - 24]}
    assert {tuple(r) for r in rows} == want
