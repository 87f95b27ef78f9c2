"""File sources and damaged input."""

import os
import tempfile
import zlib
from struct import pack

from cutline.sources import containers as A
from cutline.sources import posts, projects, sink


def png(*chunks):
    out = b"\x89PNG\r\n\x1a\n"
    for kind, data in chunks:
        out += pack(">I", len(data)) + kind + data + pack(">I", zlib.crc32(kind + data))
    return out


def test_files_on_disk(spark):
    folder = tempfile.mkdtemp(prefix="cutline-files-")
    good = png((b"IHDR", bytes(13)), (b"IDAT", b"abc"), (b"IEND", b""), (b"late", b"x"))
    spoiled = bytearray(good)
    spoiled[8 + 25 + 9] ^= 1
    for name, data in [("a.png", good), ("b.png", bytes(spoiled)), ("c.png", good[:40])]:
        with open(os.path.join(folder, name), "wb") as f:
            f.write(data)
    files = A.read_files(spark, folder, "*.png")
    seen = {}
    for r in A.container_chunks(files, "png").collect():
        seen.setdefault(os.path.basename(r.path), []).append((r.pos, r.type, r["size"]))
    assert seen["a.png"] == [(8, "IHDR", 13), (33, "IDAT", 3), (48, "IEND", 0)]
    audit = {(os.path.basename(r.path), r.type): r.ok for r in A.chunk_crc_audit(files).collect()}
    assert audit["a.png", "IDAT"] and not audit["b.png", "IDAT"]
    assert ("c.png", "IDAT") not in audit and audit["c.png", "IHDR"]


def test_walkers_stop_on_damage():
    assert [r[1] for r in A.walk_mp4(pack(">I", 0) + b"mdat" + bytes(4))] == ["mdat"]
    assert list(A.walk_mp4(pack(">I", 1) + b"mdat")) == []
    assert [r[2] for r in A.walk_mp4(pack(">I", 1) + b"mdat" + pack(">Q", 16))] == [16]
    assert [r[1] for r in A.walk_riff(b"RIFF" + bytes(8) + b"VP8 " + pack("<I", 2**31))] == ["VP8 "]
    assert [r[1] for r in A.walk_gif(b"GIF89a" + bytes(7) + b"\x99")] == ["error"]
    assert list(A.walk_gif(b"GIF89a")) == []
    assert [r[1] for r in A.walk_gif(b"GIF89a" + bytes(7) + b"\x21\xfe\x03abc")] == ["extension"]


def test_posts_from_files(spark):
    folder = tempfile.mkdtemp(prefix="cutline-posts-")
    texts = {
        "2016-02-16-a.md": "---\ntitle: One: two\ntitle: Last\n\n---\nBody\n\nMore",
        "2016-02-17-b.md": "No front matter\n---\n",
        "2016-02-18-c.md": "---\n---\nOnly body",
    }
    for name, text in texts.items():
        with open(os.path.join(folder, name), "w") as f:
            f.write(text)
    rows = {
        os.path.basename(r.path): (r.front, r.body)
        for r in posts.front_matter(posts.read_posts(spark, folder)).collect()
    }
    assert rows["2016-02-16-a.md"] == ({"title": "Last"}, "Body\n\nMore")
    assert rows["2016-02-17-b.md"] == ({}, texts["2016-02-17-b.md"])
    assert rows["2016-02-18-c.md"] == ({}, "Only body")


def test_projects_tolerate_junk(spark):
    good = '{"v":1,"general":{"fps":9},"video":{"cuts":[{"start":1,"end":5},{"start":2},{"start":"NaN","end":3},null]}}'
    rows = [(1, good), (2, "{oops"), (3, "null"), (4, '{"v":1}')]
    settings, cuts = projects.explode_projects(spark.createDataFrame(rows, "asset_id long, json string"))
    assert [(r.asset_id, r.fps) for r in settings.collect()] == [(1, 9)]
    assert [(r.asset_id, r.st_us, r.en_us) for r in cuts.collect()] == [(1, 1, 5)]


def test_partitioned_sink(spark):
    folder = tempfile.mkdtemp(prefix="cutline-sink-") + "/out"
    df = spark.range(100).selectExpr("id", "id % 3 as part")
    sink.write_partitioned(df, folder, ["part"], rows_per_file=10)
    assert sorted(d for d in os.listdir(folder) if d.startswith("part=")) == ["part=0", "part=1", "part=2"]
    assert spark.read.parquet(folder).count() == 100
