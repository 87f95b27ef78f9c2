"""Containers are walked a few megabytes at a time, whatever the size of the Arrow batch."""

import pyarrow as pa

from cutline.sources import containers as A
from cutline.suite.containers import _png


def test_slices_are_bounded_and_whole():
    sizes = [10, 0, 700_000, 1_500_000, 5_000_000, 3, 2_000_000]
    batch = pa.RecordBatch.from_arrays([pa.array([bytes(n) for n in sizes] + [None], pa.binary())], names=["content"])
    parts = list(A.slices([batch, batch.slice(0, 0)], "content"))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert all(len(p) == 1 or p.nbytes <= A.SLICE_BYTES + 100 for p in parts) and len(parts) == 4


def test_files_of_several_slices(spark):
    """Empty, cut and large files beside each other: each keeps its own chunks."""
    rows = [("a", _png([b"x" * 1_500_000, b"y"], False)), ("b", b""), ("c", _png([b"z" * 1_500_000], True)), ("d", b"\x89PNG\r\n\x1a\n")]
    files = spark.createDataFrame(rows, "path string, content binary").coalesce(1)
    got = {(r.path, r.ok): r.n for r in A.chunk_crc_audit(files).groupBy("path", "ok").count().withColumnRenamed("count", "n").collect()}
    assert got == {("a", True): 7, ("c", True): 4, ("c", False): 1}
    assert A.container_chunks(files, "png").count() == 12
