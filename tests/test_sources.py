import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameweave.operators import joining
from frameweave.sources import annotations as A
from frameweave.sources import shards as H
from frameweave.sources import sinks as K


def test_json_layouts(spark, tmp_path):
    rows = [{"id": 1, "text": "a"}, {"id": 2, "text": "b"}]
    (tmp_path / "a.json").write_text("\n  " + json.dumps(rows))
    (tmp_path / "b.json").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    schema = T.StructType.fromDDL("id int, text string, _corrupt string")
    a = A.read_annotations(spark, str(tmp_path / "a.json"), schema)
    b = A.read_annotations(spark, str(tmp_path / "b.json"), schema).cache()
    assert sorted(r.id for r in a.collect()) == [1, 2]
    assert [r._corrupt for r in b.where("id is null").collect()] == ["not json"]


def test_delimited_null_tokens(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("i\ta\n1\tnan\n2\tNone\n3\tred\n")
    df = A.read_delimited(spark, str(tmp_path / "q.tsv"), T.StructType.fromDDL("i int, a string"))
    assert [r.a for r in df.orderBy("i").collect()] == [None, None, "red"]


def test_breakpoints_and_nested_names(spark):
    df = spark.createDataFrame(
        [(("v", "c"), [(5, "q1"), (9, "q2")])],
        "info struct<video: string, cls: string>, breakpoint array<struct<time: int, question: string>>",
    )
    got = A.flatten_breakpoints(df).orderBy("end").collect()
    assert [(r.start, r.end, r.question) for r in got] == [(0, 5, "q1"), (5, 9, "q2")]
    assert A.flatten_nested(df).columns == ["info/video", "info/cls", "breakpoint"]
    with pytest.raises(ValueError):
        A.flatten_nested(df.select(F.struct(F.lit(1).alias("a/b")).alias("s")))


def _tar(path, members):
    with tarfile.open(path, "w") as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


def test_shards(spark, tmp_path):
    for s in range(2):
        _tar(tmp_path / f"s{s}.tar", [(f"d/{i}.{e}", f"{s}{i}{e}".encode()) for i in range(4) for e in ("txt", "json")])
    _tar(tmp_path / "s2.tar", [("nodot", b"x"), ("a.seg.txt", b"y")])
    whole = (tmp_path / "s0.tar").read_bytes()
    (tmp_path / "s3.tar").write_bytes(whole[:700])
    urls = H.list_shards(spark, str(tmp_path))
    assert [u.rsplit("/", 1)[1] for u in urls] == ["s0.tar", "s1.tar", "s2.tar", "s3.tar"]
    samples = {(r.shard[-6:], r.key): r.members for r in H.read_samples(spark, urls[:3]).collect()}
    assert len(samples) == 9 and samples[("s1.tar", "d/3")]["txt"] == b"13txt"
    assert samples[("s2.tar", "a")] == {"seg.txt": b"y"}
    assert H.read_members(spark, urls[:3]).rdd.getNumPartitions() == 3
    catalog = {r.url[-6:]: r for r in H.shard_catalog(spark, urls).collect()}
    assert catalog["s0.tar"].nsamples == 4 and catalog["s0.tar"].filesize == len(whole)
    assert catalog["s3.tar"].nsamples is None and catalog["s3.tar"].error


def test_unreadable_shards_are_not_lost(spark, tmp_path):
    _tar(tmp_path / "good.tar", [(f"{i}.txt", b"x" * 600) for i in range(3)])
    (tmp_path / "cut.tar").write_bytes((tmp_path / "good.tar").read_bytes()[:2500])
    urls = [str(tmp_path / f"{n}.tar") for n in ("good", "cut", "absent")]
    for read, ok in ((H.read_samples, 4), (H.read_members, 4)):
        for bad in urls[1:]:
            with pytest.raises(Exception):
                read(spark, [urls[0], bad]).collect()
        rows = read(spark, urls, errors="report").collect()
        assert sum(r.error is None for r in rows) == ok
        assert {r.shard for r in rows if r.error} == set(urls[1:])


def test_listed_shards(spark, tmp_path):
    """Samples by position: an archive read by several tasks, members apart, compressed and broken archives."""
    import gzip

    for s in range(3):
        _tar(tmp_path / f"s{s}.tar", [(f"d/{i}.{e}", f"{s}{i}{e}".encode() * 50) for e in ("txt", "json") for i in range(40)])
    _tar(tmp_path / "odd.tar", [("nodot", b"x"), ("a.seg.txt", b"y"), ("b.txt", b"")])
    (tmp_path / "packed.tar").write_bytes(gzip.compress((tmp_path / "odd.tar").read_bytes()))
    listing = H.shard_listing(spark, str(tmp_path))
    urls = H.list_shards(spark, str(tmp_path))
    assert sorted(r.url for r in listing.collect()) == urls and len(urls) == 5
    want = {(r.shard, r.key): r.members for r in H.read_samples(spark, urls).collect()}
    for split in (1 << 30, 4000):
        got = H.read_listed(listing, split_bytes=split)
        assert {(r.shard, r.key): {k: bytes(v) for k, v in r.members.items()} for r in got.collect()} == {
            k: {e: bytes(v) for e, v in m.items()} for k, m in want.items()
        }
        # One archive of about 10 kB of content is read by several tasks.
        tasks = {(r.shard, r.p) for r in got.select("shard", F.spark_partition_id().alias("p")).collect()}
        assert (len({p for u, p in tasks if u.endswith("s1.tar")}) > 1) == (split == 4000)
    (tmp_path / "cut.tar").write_bytes((tmp_path / "s0.tar").read_bytes()[:9000])
    (tmp_path / "junk.tar").write_bytes(b"junk" * 300)
    listing = H.shard_listing(spark, str(tmp_path)).unionByName(spark.createDataFrame([(str(tmp_path / "none.tar"), 9)], "url string, length long"))
    with pytest.raises(Exception):
        H.read_listed(listing).collect()
    rows = H.read_listed(listing, errors="report").collect()
    assert {r.shard.rsplit("/", 1)[1] for r in rows if r.error} == {"cut.tar", "junk.tar", "none.tar"}
    assert sum(r.error is None for r in rows) > len(want)
    a = {r.url: (r.nsamples, r.md5sum) for r in H.catalog_listed(listing).collect()}
    assert a == {r.url: (r.nsamples, r.md5sum) for r in H.shard_catalog(spark, [r.url for r in listing.collect()]).collect()}


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(f"s{i % 3}", i, f"text {i}") for i in range(30)], "s string, k long, t string")
    made = H.write_shards(df, str(tmp_path / "out"), "s", "k", {"txt": "t"}).collect()
    assert sorted(r.nsamples for r in made) == [10, 10, 10]
    assert H.read_samples(spark, H.list_shards(spark, str(tmp_path / "out"))).count() == 30
    assert not list((tmp_path / "out").glob("*.part"))


def test_segments_across_pages(spark, monkeypatch):
    from types import SimpleNamespace

    from frameweave.suite import tables

    monkeypatch.setattr(tables, "PAGE", 2)
    turns = spark.createDataFrame([(1, i, "user", "q") for i in range(5)], "conv_id long, turn long, role string, text string")
    rows = tables.flatten_breakpoints(SimpleNamespace(conversations=turns)).orderBy("end").collect()
    assert [r.start for r in rows] == [0, 10, 20, 30, 40]


def test_catalog_of_catalogs(spark):
    shard = "array<struct<url: string, nsamples: bigint>>"
    df = spark.createDataFrame(
        [("top", "/data", [("a.tar", 1)], [("part", 2.0, [("b.tar", 2), ("/x/c.tar", -1)]), (None, None, [("s3://d.tar", 3), ("b.tar", 9)])])],
        f"name string, base string, shardlist {shard}, datasets array<struct<name: string, weight: double, shardlist: {shard}>>",
    )
    got = H.resolve_catalog(df)
    rows = sorted((r.url, r.name, r.weight, r.nsamples) for r in got.collect())
    assert rows == [
        ("/data/a.tar", "top", 1.0, 1),
        ("/data/b.tar", "part", 2.0, 2),
        ("/data/b.tar", "top", 1.0, 9),
        ("/x/c.tar", "part", 2.0, -1),
        ("s3://d.tar", "top", 1.0, 3),
    ]
    problems = {(r.url, r.problem) for r in H.catalog_problems(got).collect()}
    assert problems == {("/data/b.tar", "duplicate url"), ("/x/c.tar", "no sample count")}


def test_resumable_sink(spark, tmp_path):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    two = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    K.write_keep_saved(one, ["k"], str(tmp_path / "1"), None)
    K.write_keep_saved(two, ["k"], str(tmp_path / "2"), str(tmp_path / "1"))
    got = spark.read.parquet(str(tmp_path / "2")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "a"), (2, "b"), (3, "c")]
    merged = K.merge_chunks([one, two], ["k"], "v").orderBy("k").collect()
    assert [(r.k, r.v, r.chunk) for r in merged] == [(1, "a", 0), (2, "B", 1), (3, "c", 1)]


def test_spans_are_strict_and_first_wins(spark):
    points = spark.createDataFrame([("s", i, t) for i, t in enumerate([0, 5, 10, 15, 40])], "s string, p int, t long")
    spans = spark.createDataFrame(
        [("s", 2, 0, 12, "late"), ("s", 1, 4, 6, "early"), ("s", 0, 9, 20, " "), ("s", 3, 10, 16, "x")],
        "s string, o int, a long, b long, w string",
    )
    got = joining.active_spans(points, spans, "s", "p", "t", "a", "b", "o", "w", 7).collect()
    assert {r.p: r.w for r in got} == {1: "early", 2: "late", 3: "x"}
