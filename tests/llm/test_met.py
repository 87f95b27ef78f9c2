"""The near-copy stage hands on only the prefix shingles that more than one text has."""

import random
from collections import Counter

from cutline.llm import resemblance
from cutline.llm.common import texts


def test_met_prefixes_lose_none_and_hand_on_few(spark, monkeypatch):
    """As rows travel the met ones alone, of many texts that mostly share nothing."""
    rng = random.Random(5)
    own = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(60)) for _ in range(300)]
    near = [own[k].rsplit(" ", 1)[0] + f" e{k}" for k in range(20)]
    rows = list(enumerate(own + near + own[:5] + ["", "one two"]))
    made, prefixes = [], resemblance.prefixes

    def counted(*args, **named):
        made.append(prefixes(*args, **named))
        return made[-1]

    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = resemblance.shingle_sets(texts(docs), 5).dropDuplicates(["key"]).cache()
    table = spark.sparkContext.broadcast(resemblance.heavy_shingles(sets, 2, 100))
    whole = [tuple(r) for r in prefixes(sets, (4, 5), table).collect()]
    table.unpersist()
    times = Counter(r[0] for r in whole)
    want = {r for r in whole if times[r[0]] > 1}
    assert want and len(whole) > 3000

    monkeypatch.setattr(resemblance, "prefixes", counted)
    got = [tuple(r) for r in resemblance.met_prefixes(sets, (4, 5), 2, 100).collect()]
    assert want <= set(got) and len(got) < len(want) + 50
    assert sum(df.count() for df in made) < len(whole) / 2


def test_met_cells_of_nothing_and_of_one_hash_many_times(spark):
    table = spark.sparkContext.broadcast(resemblance.heavy_shingles(spark.createDataFrame([], "key long, hashes array<long>"), 2, 100))
    sets = spark.createDataFrame([(k, [-1]) for k in range(2000)] + [(5000, [7])], "key long, hashes array<long>")
    assert not resemblance.met_cells(sets.limit(0), (4, 5), table).any()
    bits = resemblance.met_cells(sets, (4, 5), table)
    assert bits[-1] == 128 and bits.sum() == 128
