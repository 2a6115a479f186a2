import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.sources import readers, writers
from millrace.streaming import rollouts


def test_braces_and_missing_files(spark, tmp_path):
    assert readers.braces("a/{b,c}/{d,e}") == ["a/b/d", "a/b/e", "a/c/d", "a/c/e"]
    with pytest.raises(FileNotFoundError):
        readers.files(spark, f"{tmp_path}/*.parquet")
    assert readers.files(spark, f"{tmp_path}/*.parquet", empty_ok=True) == []


@pytest.mark.parametrize("extension", ["jsonl", "jsonl.gz", "jsonl.zst", "jsonl.xz"])
def test_load_by_extension(spark, tmp_path, extension):
    import gzip
    import lzma

    import zstandard

    data = b'{"id": 1, "text": "a"}\n\n{"id": 2, "text": "b"}\n'
    packed = {"jsonl": bytes, "jsonl.gz": gzip.compress, "jsonl.zst": zstandard.ZstdCompressor().compress, "jsonl.xz": lzma.compress}[extension](data)
    (tmp_path / f"x.{extension}").write_bytes(packed)
    assert sorted(r.id for r in readers.load(spark, f"{tmp_path}/*", ["id"]).collect()) == [1, 2]


def test_unknown_extension(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a")
    with pytest.raises(ValueError):
        readers.load(spark, f"{tmp_path}/*")


def test_zip_members_and_row_range(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("a.txt", "one")
        z.writestr("b.md", "two")
    assert [(r.filename, bytes(r.content)) for r in readers.zip_members(spark, f"{tmp_path}/*.zip", "*.txt").collect()] == [("a.txt", b"one")]
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/p")
    assert sorted(r.id for r in readers.row_range(spark.read.parquet(f"{tmp_path}/p"), 3, 6).collect()) == [3, 4, 5]


def test_writers(spark, tmp_path):
    with pytest.raises(ValueError):
        writers.formatted("out.jsonl", 0, 2)
    assert writers.formatted("s3://b//{shard:03d}-of-{total}", 1, 2) == "s3://b/001-of-2"
    path = f"{tmp_path}/o"
    writers.write_jsonl(spark.range(3), path, "gz", skip_existing=True)
    writers.write_jsonl(spark.range(5), path, "gz", skip_existing=True)
    assert spark.read.json(path).count() == 3
    writers.append(spark.range(2), f"{tmp_path}/a")
    writers.append(spark.range(2), f"{tmp_path}/a")
    assert spark.read.parquet(f"{tmp_path}/a").count() == 4
    tokens = spark.createDataFrame([(1, [1, 2]), (2, [3])], "doc_id long, ids array<int>").coalesce(1)
    ledger = writers.write_token_cache(tokens, f"{tmp_path}/c", metadata={"v": 1})
    assert [(r.rows, r.tokens, r.token_offset) for r in ledger.collect()] == [(2, 3, 0)]
    frame = spark.createDataFrame([(bytearray(b"\x00\xff"),), (bytearray(b"ab"),)], "b binary").coalesce(1)
    (name,) = writers.write_binary(frame, f"{tmp_path}/b", "b")
    assert open(name, "rb").read() == b"\x00\xffab"


def test_streams_read_each_file_once(spark, tmp_path):
    rows = spark.range(20).select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"), (F.col("id") % 2).alias("user_id"), F.lit(1.0).alias("value"), F.col("id").alias("event_id"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = lambda: rollouts.file_stream(spark, f"{tmp_path}/in", rows.schema)
    rollouts.run_once(rollouts.fresh(stream(), "ts", "1 hour", "event_id"), f"{tmp_path}/out", f"{tmp_path}/ck")
    rollouts.run_once(rollouts.fresh(stream(), "ts", "1 hour", "event_id"), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20
    rollouts.run_once(rollouts.windowed(stream(), "ts", "1 minute", "5 minutes", "user_id", "value"), f"{tmp_path}/w", f"{tmp_path}/wck")
    assert 0 < spark.read.parquet(f"{tmp_path}/w").count() <= 8


def test_paths_and_subsets(spark, tmp_path):
    assert readers.normal_path("s3://b//x///y") == "s3://b/x/y" and readers.normal_path("//a//b/") == "/a/b/" and readers.normal_path("a//b") == "a/b"
    assert writers.rebased("/in//x/y.jsonl.gz", "/in/", "/out", "parquet") == "/out/x/y.parquet" and writers.rebased("/in/x.json", "/in", "s3://o") == "s3://o/x.json"
    with pytest.raises(ValueError):
        writers.rebased("/else/x", "/in", "/out")
    for i in range(6):
        (tmp_path / f"f{i}.txt").write_text(f"line {i}\n")
    paths = readers.files(spark, f"{tmp_path}/f*.txt")
    drawn = readers.file_subset(paths, 3)
    assert len(drawn) == 3 and drawn == readers.file_subset(reversed(paths), 3) and set(drawn) <= set(paths)
    copied = readers.copy_files(spark, drawn, f"file://{tmp_path}/copies")
    assert [p.rsplit("/", 1)[-1] for p in copied] == sorted(p.rsplit("/", 1)[-1] for p in drawn)
    assert sorted(r.text for r in readers.load_text(spark, f"{tmp_path}/copies/*.txt").collect()) == sorted(f"line {p[-5]}" for p in drawn)


def test_archives(spark, tmp_path):
    import gzip
    import io
    import tarfile

    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as archive:
        for name, data in (("x/one.txt", b"1"), ("x/two.bin", b"2")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    got = readers.tar_members(spark, f"{tmp_path}/*.tar.gz", "*.txt").select("filename", "content", readers.member_group(F.col("filename")).alias("g")).collect()
    assert [(r.filename, bytes(r.content), r.g) for r in got] == [("x/one.txt", b"1", "x")]
    record = lambda kind, url, body: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()
    data = record("warcinfo", "", "isPartOf: CC-MAIN-2024-10") + record("response", "http://x.y/", "HTTP/1.1 200 OK\r\n\r\nWARC/ hi")
    (tmp_path / "w.warc.gz").write_bytes(gzip.compress(data))
    (tmp_path / "v.warc").write_bytes(data)
    got = readers.warc_records(spark, f"{tmp_path}/*.warc*")
    assert sorted((r.type, r.url) for r in got.collect()) == [("response", "http://x.y/")] * 2 + [("warcinfo", "")] * 2
    assert {r[0] for r in got.where("type = 'warcinfo'").select(readers.crawl_split(F.col("content").cast("string"))).collect()} == {"CC-MAIN-2024-10"}
    assert all(bytes(r.content).endswith(b"WARC/ hi") for r in got.where("type = 'response'").collect())


def test_json_of_both_kinds_and_packed_lines(spark, tmp_path):
    import lzma

    import zstandard

    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2, "b": "x"}]')
    (tmp_path / "b.json").write_text('{"a": 3}\n{"a": 4}\n')
    assert sorted((r.a, r.b) for r in readers.load_json(spark, f"{tmp_path}/*.json").collect()) == [(1, None), (2, "x"), (3, None), (4, None)]
    lines = "".join(f'{{"id": {i}, "s": {i / 2}, "t": {{"u": "v{i}"}}}}\n\n' for i in range(5000))
    (tmp_path / "c.jsonl.xz").write_bytes(lzma.compress(lines.encode()))
    (tmp_path / "d.jsonl.zst").write_bytes(zstandard.compress(lines.encode()))
    got = readers.load(spark, f"{tmp_path}/*.jsonl.*", ["id", "s", "t", "absent"])
    assert got.count() == 10_000 and got.columns == ["id", "s", "t", "absent"]
    row = got.where("id = 7").first()
    assert (row.s, row.t.u, row.absent) == (3.5, "v7", None)
    made = readers.ingested(got.drop("absent"), "id", "s", "nc_", "here").first()
    assert made.metadata.asDict().keys() == {"nc_t"} and readers.pruned(got, ["t", "zz"]).columns == ["t"]


def test_named_shards_and_sidecars(spark, tmp_path):
    frame = spark.range(10).repartition(3)
    for kind in ("parquet", "jsonl.gz", "jsonl.zst", "jsonl"):
        names = writers.write_named(frame, f"file://{tmp_path}/{kind}//out-{{shard:02d}}-of-{{total}}.{kind}")
        assert [n.rsplit("/", 1)[-1] for n in names] == [f"out-{i:02d}-of-3.{kind}" for i in range(3)]
        assert sorted(r.id for r in readers.load(spark, f"{tmp_path}/{kind}/*").collect()) == list(range(10))
    failing = spark.range(10).repartition(3).select(F.raise_error(F.lit("computed")).cast("long").alias("id"))
    assert len(writers.write_named(failing, f"file://{tmp_path}/parquet/out-{{shard:02d}}-of-{{total}}.parquet", skip_existing=True)) == 3
    with pytest.raises(ValueError):
        writers.write_named(frame, f"file://{tmp_path}/one.parquet")
    writers.write_sidecar(spark, f"{tmp_path}/meta.json", {"b": 1, "a": [2]})
    assert writers.read_sidecar(spark, f"{tmp_path}/meta.json") == {"a": [2], "b": 1}


def test_caches_are_merged(spark, tmp_path):
    ids = spark.createDataFrame([(i, [1] * (i + 1)) for i in range(6)], "doc_id int, ids array<int>")
    for k in range(2):
        writers.write_token_cache(ids.where(F.col("doc_id") % 2 == k).repartition(2), f"{tmp_path}/c{k}")
    merged = writers.merge_token_caches(spark, [f"{tmp_path}/c0", f"{tmp_path}/c1"], f"{tmp_path}/all").orderBy("cache", "file").collect()
    total = 0
    for r in merged:
        assert r.token_offset == total
        total += r.tokens
    assert total == 21 and sum(r.rows for r in merged) == 6


def test_rollout_files_and_names(spark, tmp_path):
    import os

    for i in range(5):
        rollouts.write_rollouts(spark.range(i, i + 1), f"{tmp_path}/r", keep=3)
    kept = [f for f in os.listdir(tmp_path / "r") if f.startswith("part-")]
    assert len(kept) == 3 and sorted(r.id for r in spark.read.parquet(f"{tmp_path}/r").collect()) == [2, 3, 4]
    assert readers.with_name_parts(["/x/a.b.json", "/x.y/a.json", "a.b.c.d"]) == ["/x/a.b.json"]


def test_small_tables_are_spread(spark, tmp_path, monkeypatch):
    from millrace.operators import durable

    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    frame = spark.read.parquet(f"{tmp_path}/one")
    cores = spark.sparkContext.defaultParallelism
    assert durable.spread(frame).rdd.getNumPartitions() == cores
    monkeypatch.setattr(durable, "BYTES_A_CORE", 1)
    assert durable.spread(frame) is frame
    held = durable.stored(frame)
    assert held.count() == 100 and held.schema == frame.schema
