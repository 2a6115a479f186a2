"""Reading collections by pattern and extension."""

from __future__ import annotations

import fnmatch
import gzip
import io
import random
import re
import tarfile
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KNOWN = re.compile(r"\.(?:jsonl?(?:\.(?:gz|zst|zstd|xz))?|parquet|orc)$")


def braces(pattern: str) -> list[str]:
    """A pattern's alternatives in braces, expanded."""
    match = re.search(r"\{([^{}]*)\}", pattern)
    if not match or "," not in match[1]:
        return [pattern]
    return [x for part in match[1].split(",") for x in braces(pattern[: match.start()] + part + pattern[match.end() :])]


def normal_path(path: str) -> str:
    """A path whose slashes in a row are one; a scheme keeps its two."""
    scheme, mark, rest = path.partition("://")
    if not mark:
        scheme, rest = "", path
    lead = "/" if rest.startswith("/") else ""
    return scheme + mark + lead + "/".join(part for part in rest.split("/") if part) + ("/" if len(rest) > 1 and rest.endswith("/") else "")


def files(spark: SparkSession, pattern: str, empty_ok: bool = False) -> list[str]:
    """The paths that a pattern matches, sorted, on any file system that the session reads."""
    jvm, found = spark.sparkContext._jvm, []
    for one in braces(normal_path(pattern)):
        path = jvm.org.apache.hadoop.fs.Path(one)
        listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        found += [s.getPath().toString() for s in listed or []]
    if not found and not empty_ok:
        raise FileNotFoundError(pattern)
    return sorted(set(found))


def with_name_parts(paths: Sequence[str], parts: int = 3) -> list[str]:
    """The paths whose file names have as many parts between dots."""
    return [p for p in paths if p.rsplit("/", 1)[-1].count(".") == parts - 1]


def file_subset(paths: Sequence[str], k: int, seed: int = 42) -> list[str]:
    """``k`` of some files, drawn with a seed."""
    drawn = sorted(paths)
    random.Random(seed).shuffle(drawn)
    return drawn[:k]


def copy_files(spark: SparkSession, paths: Sequence[str], folder: str) -> list[str]:
    """Copies files into a folder, on the executors; returns the new paths."""
    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        target, base = fs.FileSystem.from_uri(folder)
        target.create_dir(base, recursive=True)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                source, at = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
                name = f"{base}/{at.rsplit('/', 1)[-1]}"
                fs.copy_files(at, f"{name}.tmp", source_filesystem=source, destination_filesystem=target)
                target.move(f"{name}.tmp", name)
                yield pa.RecordBatch.from_arrays([pa.array([name])], names=["path"])

    return sorted(r[0] for r in rows.mapInArrow(run, "path string").collect())


def load(
    spark: SparkSession, pattern: str, columns: Sequence[str] | None = None, schema: T.StructType | None = None,
    empty_ok: bool = False,
) -> DataFrame:
    """All files of a pattern, by extension; columns that a file lacks are null."""
    paths = files(spark, pattern, empty_ok)
    kinds: dict[str, list[str]] = {}
    for path in paths:
        match = _KNOWN.search(path)
        if not match:
            raise ValueError(f"no reader for {path}")
        name = match[0]
        kinds.setdefault(
            "parquet" if name == ".parquet" else "orc" if name == ".orc" else "xz" if name.endswith(".xz") else "zst" if name.endswith((".zst", ".zstd")) else "json",
            []
        ).append(path)
    out = None
    for kind, own in kinds.items():
        if kind in ("parquet", "orc"):
            frame = getattr(spark.read, kind)(*own)
        elif kind == "json":
            frame = (spark.read.schema(schema) if schema is not None else spark.read).json(own)
        else:
            frame = parsed_lines(unpacked_lines(spark, own, kind), schema)
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    if out is None:
        out = spark.createDataFrame([], schema or T.StructType([]))
    return out if columns is None else out.select(*(F.col(c) if c in out.columns else F.lit(None).alias(c) for c in columns))


def parsed_lines(lines: DataFrame, schema: T.StructType | None = None, line: str = "value") -> DataFrame:
    """JSON lines as columns, parsed in the plan; without a schema one is gathered over all lines first."""
    if schema is None:
        found = lines.agg(F.schema_of_variant_agg(F.try_parse_json(line))).first()[0]
        # The engine's names of what variants hold, as those of columns.
        found = re.sub(r"DECIMAL\(\d+,\d+\)", "DOUBLE", found.replace("OBJECT<", "STRUCT<")).replace("VOID", "STRING")
        parsed = T._parse_datatype_string(found)
        schema = parsed if isinstance(parsed, T.StructType) else T.StructType([])
    return lines.select(F.from_json(line, schema).alias("row")).select("row.*") if len(schema) else lines.select()


def unpacked_lines(spark: SparkSession, paths: Sequence[str], kind: str) -> DataFrame:
    """The lines of files whose compression the session's readers lack; a file is one task's work, read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                packed = io.BytesIO(content.as_py())
                if kind == "xz":
                    import lzma

                    stream = lzma.open(packed)
                else:
                    import zstandard

                    stream = zstandard.ZstdDecompressor().stream_reader(packed, read_across_frames=True)
                held: list[str] = []
                for line in io.TextIOWrapper(stream, encoding="utf-8"):
                    if line.strip():
                        held.append(line)
                    if len(held) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])

    return spark.read.format("binaryFile").load(list(paths)).select("content").mapInArrow(run, "value string")


#: Members of archives are read in pieces of this size.
PIECE = 1 << 20


def zip_members(spark: SparkSession, pattern: str, member: str = "*") -> DataFrame:
    """``archive, filename, content`` of the members of zip files whose names match."""
    wanted = re.compile(fnmatch.translate(member))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, packed in zip(batch.column("path"), batch.column("content")):
                archive = zipfile.ZipFile(pa.BufferReader(packed.as_buffer()))
                for entry in archive.infolist():
                    if entry.is_dir() or not wanted.match(entry.filename):
                        continue
                    with archive.open(entry) as opened:
                        content = b"".join(iter(lambda: opened.read(PIECE), b""))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path.as_py()]), pa.array([entry.filename]), pa.array([content], pa.binary())],
                        names=["archive", "filename", "content"]
                    )

    return spark.read.format("binaryFile").load(files(spark, pattern)).select("path", "content").mapInArrow(
        run, "archive string, filename string, content binary"
    )


def tar_members(spark: SparkSession, pattern: str, member: str = "*") -> DataFrame:
    """``archive, filename, content`` of the files in tar archives, packed or not, whose names match."""
    wanted = re.compile(fnmatch.translate(member))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, packed in zip(batch.column("path"), batch.column("content")):
                with tarfile.open(fileobj=io.BytesIO(packed.as_py())) as archive:
                    for entry in archive:
                        if entry.isfile() and wanted.match(entry.name):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([path.as_py()]), pa.array([entry.name]), pa.array([archive.extractfile(entry).read()], pa.binary())],
                                names=["archive", "filename", "content"]
                            )

    return spark.read.format("binaryFile").load(files(spark, pattern)).select("path", "content").mapInArrow(
        run, "archive string, filename string, content binary"
    )


def member_group(filename: Column) -> Column:
    """The second last folder of a member's name."""
    parts = F.split(filename, "/")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise("")


def warc_records(spark: SparkSession, pattern: str) -> DataFrame:
    """``archive, type, id, url, date, content`` of the records of WARC files, packed by gzip or not."""
    names = {"warc-type": "type", "warc-record-id": "id", "warc-target-uri": "url", "warc-date": "date"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, packed in zip(batch.column("path").to_pylist(), batch.column("content")):
                raw = io.BytesIO(packed.as_py())
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if raw.getbuffer()[:2] == b"\x1f\x8b" else raw
                while line := stream.readline():
                    if not line.startswith(b"WARC/"):
                        continue
                    row, size = dict.fromkeys(names.values()), 0
                    while (line := stream.readline().strip()) != b"":
                        key, _, value = line.decode("utf-8", "replace").partition(":")
                        if key.lower() == "content-length":
                            size = int(value)
                        elif key.lower() in names:
                            row[names[key.lower()]] = value.strip()
                    content = stream.read(size)
                    columns = [pa.array([path]), *(pa.array([v], pa.string()) for v in row.values()), pa.array([content], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["archive", *row, "content"])

    return spark.read.format("binaryFile").load(files(spark, pattern)).select("path", "content").mapInArrow(
        run, "archive string, type string, id string, url string, date string, content binary"
    )


def load_json(spark: SparkSession, pattern: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON files, each either lines or one array: told apart by the first character that is no white space."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    lines, arrays = [], []
    for path in files(spark, pattern):
        # One short read a file; the rest is read by the tasks.
        head = spark.read.format("text").option("wholetext", "false").load(path).limit(1).collect()
        (arrays if head and head[0][0].lstrip()[:1] == "[" else lines).append(path)
    out = reader.json(lines) if lines else None
    if arrays:
        frame = reader.option("multiLine", "true").json(arrays)
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out


def load_text(spark: SparkSession, pattern: str, column: str = "text") -> DataFrame:
    """The lines of text files."""
    return spark.read.text(files(spark, pattern)).select(F.col("value").alias(column))


def pruned(frame: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Those of the listed columns that there are."""
    return frame.select(*(c for c in keep if c in frame.columns))


def ingested(frame: DataFrame, identifier: str, text: str, prefix: str, source: str) -> DataFrame:
    """``id, text, source, metadata``: the other columns go into ``metadata`` with a prefix to their names."""
    others = [F.col(c).alias(f"{prefix}{c}") for c in frame.columns if c not in (identifier, text)]
    return frame.select(F.col(identifier).alias("id"), F.col(text).alias("text"), F.lit(source).alias("source"), F.struct(*others).alias("metadata"))


def row_range(frame: DataFrame, begin: int, end: int) -> DataFrame:
    """Rows ``begin`` to ``end`` of each Parquet file, chosen before any later filter."""
    return frame.where((F.col("_metadata.row_index") >= begin) & (F.col("_metadata.row_index") < end))


def crawl_split(warcinfo: Column) -> Column:
    """The crawl that an archive's header belongs to."""
    return F.regexp_extract(warcinfo, r"isPartOf:\s*(CC-MAIN-\d{4}-\d{2})", 1)
