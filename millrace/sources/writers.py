"""Writing collections, resumably."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .readers import normal_path

_CODECS = {"gz": "gzip", "zst": "zstd", "zstd": "zstd", "bz2": "bzip2"}


def formatted(pattern: str, shard: int, total: int, basename: str = "") -> str:
    """An output name; several shards need ``{shard}`` in the pattern."""
    if total > 1 and "{shard" not in pattern:
        raise ValueError("several shards need {shard} in the pattern")
    return normal_path(pattern.format(shard=shard, total=total, basename=basename))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished output is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _write(frame: DataFrame, path: str, skip_existing: bool, write) -> str:
    # A finished output is not computed again: nothing of the plan runs.
    if not (skip_existing and exists(frame.sparkSession, path)):
        write(frame.write.mode("overwrite" if skip_existing else "error"))
    return path


def write_jsonl(frame: DataFrame, path: str, compression: str | None = None, skip_existing: bool = False) -> str:
    """JSON lines; ``compression`` is a codec or a file extension."""
    codec = _CODECS.get(compression, compression) or "none"
    return _write(frame, path, skip_existing, lambda w: w.option("compression", codec).json(path))


def write_parquet(frame: DataFrame, path: str, skip_existing: bool = False) -> str:
    """Parquet with zstd."""
    return _write(frame, path, skip_existing, lambda w: w.option("compression", "zstd").parquet(path))


def write_orc(frame: DataFrame, path: str, skip_existing: bool = False) -> str:
    """ORC with zstd: columns, statistics and row groups, the closest to a columnar file that the engine has no source for."""
    return _write(frame, path, skip_existing, lambda w: w.option("compression", "zstd").orc(path))


def append(frame: DataFrame, path: str, kind: str = "parquet") -> None:
    """Adds rows to a collection."""
    frame.write.mode("append").format(kind).save(path)


def write_token_cache(
    tokens: DataFrame, path: str, ids: str = "ids", metadata: dict | None = None, skip_existing: bool = False,
) -> DataFrame:
    """Token arrays as Parquet, and a ledger of rows and tokens by file with running offsets, which is returned."""
    spark = tokens.sparkSession
    write_parquet(tokens, f"{path}/data", skip_existing)
    counts = spark.read.parquet(f"{path}/data").select(F.input_file_name().alias("file"), F.size(ids).alias("n")).groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").alias("tokens")
    )
    from ..operators.relational import prefix_sums

    ledger = prefix_sums(prefix_sums(counts, "rows", [F.col("file")], out="row_offset"), "tokens", [F.col("file")], out="token_offset")
    write_parquet(ledger.withColumn("metadata", F.lit(json.dumps(metadata or {}, sort_keys=True))), f"{path}/ledger", skip_existing)
    return spark.read.parquet(f"{path}/ledger")


def write_binary(frame: DataFrame, path: str, column: str) -> list[str]:
    """The values of a binary column one after the other without framing, a file a partition; returns the names.

    The engine has no writer of bare bytes, so tasks write through Arrow's file systems. Each
    writes beside its final name and then moves, so a repeated attempt replaces whole files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        system, base = fs.FileSystem.from_uri(path)
        system.create_dir(base, recursive=True)
        name = f"{base}/part-{task.partitionId():05d}"
        held = f"{name}.{task.attemptNumber()}.tmp"
        with system.open_output_stream(held) as out:
            for batch in batches:
                for value in batch.column(0):
                    if value.is_valid:
                        out.write(value.as_py())
        system.move(held, name)
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    return sorted(r[0] for r in frame.select(column).mapInArrow(run, "name string").collect())


def _is_file(name: str) -> bool:
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(name)
    return system.get_file_info(at).type == fs.FileType.File


def write_named(frame: DataFrame, pattern: str, skip_existing: bool = False) -> list[str]:
    """Each partition into a file of its own, named by ``{shard}`` and ``{total}`` in the pattern; returns the names.

    The kind follows the extension: Parquet, or JSON lines with gzip or zstd. With
    ``skip_existing`` nothing runs when all files are there, and after a run that was cut short
    those that are there are not written again. A file is written beside its name and then moved.
    """
    total = frame.rdd.getNumPartitions()
    names = [formatted(pattern, shard, total) for shard in range(total)]
    kind = next((k for k in (".parquet", ".jsonl", ".jsonl.gz", ".jsonl.zst") if names[0].endswith(k)), None) if names else None
    if names and kind is None:
        raise ValueError(f"no writer for {names[0]}")
    if skip_existing and all(_is_file(name) for name in names):
        return names
    schema = to_arrow_schema(frame.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        name = names[task.partitionId()]
        system, at = fs.FileSystem.from_uri(name)
        if not (skip_existing and _is_file(name)):
            system.create_dir(at.rsplit("/", 1)[0], recursive=True)
            held = f"{at}.{task.attemptNumber()}.tmp"
            if kind == ".parquet":
                import pyarrow.parquet as pq

                with system.open_output_stream(held, compression=None) as out, pq.ParquetWriter(out, schema, compression="zstd") as writer:
                    for batch in batches:
                        writer.write_batch(batch.cast(schema))
            else:
                codec = {".jsonl.gz": "gzip", ".jsonl.zst": "zstd"}.get(kind)
                with system.open_output_stream(held, compression=codec) as out:
                    for batch in batches:
                        out.write("".join(json.dumps(row, ensure_ascii=False, default=str) + "\n" for row in batch.to_pylist()).encode())
            system.move(held, at)
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    return sorted(r[0] for r in frame.mapInArrow(run, "name string").collect())


def rebased(path: str, base: str, target: str, extension: str | None = None) -> str:
    """The same relative path under another base, with another extension if one is given."""
    base = normal_path(base).rstrip("/")
    if not normal_path(path).startswith(f"{base}/"):
        raise ValueError(f"{path} is not under {base}")
    moved = f"{normal_path(target).rstrip('/')}{normal_path(path)[len(base) :]}"
    if extension is None:
        return moved
    folder, _, name = moved.rpartition("/")
    return f"{folder}/{name.split('.', 1)[0]}.{extension.lstrip('.')}"


def write_sidecar(spark: SparkSession, path: str, content: dict) -> None:
    """A JSON file beside a collection: provenance, settings, counts."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = files.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(json.dumps(content, sort_keys=True, indent=1).encode()))
    out.close()


def read_sidecar(spark: SparkSession, path: str) -> dict:
    """What ``write_sidecar`` wrote."""
    return json.loads("\n".join(r[0] for r in spark.read.option("wholetext", "true").text(path).collect()))


def merge_token_caches(spark: SparkSession, paths: Sequence[str], path: str) -> DataFrame:
    """One cache of several, in their order: rows and tokens by file with offsets over all of them; the data stay where they are."""
    ledger = None
    for number, one in enumerate(paths):
        own = spark.read.parquet(f"{one}/ledger").withColumn("cache", F.lit(number).cast("long"))
        ledger = own if ledger is None else ledger.unionByName(own)
    for size, offset in (("rows", "row_offset"), ("tokens", "token_offset")):
        # A row a file: ledgers are small.
        before = Window.orderBy("cache", "file").rowsBetween(Window.unboundedPreceding, 0)
        ledger = ledger.withColumn(offset, F.sum(size).over(before) - F.col(size))
    write_parquet(ledger, f"{path}/ledger")
    return spark.read.parquet(f"{path}/ledger")


def to_jsonl_with_ids(spark: SparkSession, pattern: str, path: str, prefix: str) -> str:
    """Parquet files as packed JSON lines whose ids are made of a prefix, the file's name and the row's number."""
    from .readers import files

    rows = spark.read.parquet(*files(spark, pattern))
    name = F.regexp_replace("_metadata.file_name", r"\.parquet$", "")
    made = F.concat_ws("-", F.lit(prefix), name, F.col("_metadata.row_index").cast("string")).alias("id")
    return write_jsonl(rows.select(made, *(c for c in rows.columns if c != "id")), path, "gz")
