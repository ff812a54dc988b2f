"""Files by their paths, on whatever file system the session reads."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telar.plans.lineage import Scratch


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether any file or folder fits a pattern."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def state(spark: SparkSession, folder: str) -> str:
    """Names, sizes and times of the files of a folder or of one file: another text if any has changed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return "|".join(sorted(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in found))


def write_folders(df: DataFrame, root: str, folder: Column, files: dict[str, Column]) -> DataFrame:
    """A folder per row with the given text files, as the scraped sites keep their pages; null contents make no file.

    Returns ``folder, n_files`` and writes when that is computed.  The rows must have different folders; a task that runs again writes the
    same files again.  Parents are made where the file system has folders.
    """
    named = df.select(folder.alias("folder"), *[c.alias(f"f{i}") for i, c in enumerate(files.values())]).where("folder is not null")
    names = list(files)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{os.path.abspath(root)}")
        for batch in batches:
            counts = []
            for row in batch.itertuples(index=False):
                system.create_dir(f"{base}/{row[0]}", recursive=True)
                told = [(n, t) for n, t in zip(names, row[1:], strict=True) if t is not None]
                for n, t in told:
                    with system.open_output_stream(f"{base}/{row[0]}/{n}") as out:
                        out.write(t.encode("utf-8"))
                counts.append(len(told))
            yield pd.DataFrame({"folder": batch["folder"], "n_files": counts})

    return named.mapInPandas(write, "folder string, n_files int")


def write_files(df: DataFrame, root: str, name: Column, content: Column) -> DataFrame:
    """A file per row directly below ``root``; returns ``name`` and writes when that is computed.  Names must differ; null contents make no file."""
    rows = df.select(name.alias("name"), content.alias("content")).where("name is not null and content is not null")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{os.path.abspath(root)}")
        system.create_dir(base, recursive=True)
        for batch in batches:
            for n, t in zip(batch["name"], batch["content"], strict=True):
                with system.open_output_stream(f"{base}/{n}") as out:
                    out.write(t.encode("utf-8"))
            yield batch[["name"]]

    return rows.mapInPandas(write, "name string")


TASK_BYTES, FILE_COST, RANGE = 64 << 20, 32 << 10, 16 << 20  # bytes read by a task, what opening a file counts as, and part of a file of lines
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def system_of(uri: str) -> tuple[fs.FileSystem, str, str]:
    """File system of a path, the path in it, and what stands before that in Spark's names of files."""
    local = os.path.abspath(uri) if "://" not in uri and not uri.startswith("file:") else "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else None
    if local is not None:
        return fs.LocalFileSystem(), local, "file:"
    system, path = fs.FileSystem.from_uri(uri)
    return system, path, uri[: uri.index(path.strip("/"))].rstrip("/") + "/" * (not path.startswith("/"))


def _entries(uri: str) -> Iterator[tuple[str, int | None]]:
    """Names in a folder with their sizes, none for a folder; a local one is never held whole."""
    system, path, _ = system_of(uri)
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(path) as found:
            for x in found:
                yield x.name, None if x.is_dir() else x.stat().st_size
    else:
        for x in system.get_file_info(fs.FileSelector(path)):
            yield x.base_name, None if x.type == fs.FileType.Directory else x.size


def listed(spark: SparkSession, root: str) -> DataFrame:
    """``path, size``: all files below a folder, hidden ones left out, as a written table.

    Folders are listed in tasks, level by level: neither files nor folders go to the driver.
    """
    scratch = Scratch(spark, "listed")
    system, path, before = system_of(root)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, sizes = [], []
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for name, n in _entries(folder):
                    if name[0] == "." or name[0] == "_" and "=" not in name or name.endswith("._COPYING_"):
                        continue  # as Spark does
                    paths.append(f"{folder}/{name}")
                    sizes.append(n)
                    if len(paths) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "size"])
                        paths, sizes = [], []
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "size"])

    folders, out = spark.createDataFrame([(f"{before}{path}".rstrip("/"),)], "path string"), None
    while n := folders.count():
        level = scratch.cut(folders.repartition(-(-n // 2000), "path").mapInArrow(look, "path string, size bigint"), "level")
        files = level.where("size is not null")
        out = files if out is None else out.unionByName(files)
        folders = level.where("size is null").select("path")
    return out


def _spread(files: DataFrame, *columns: str) -> DataFrame:
    cost = files.agg(F.sum(F.least(F.col("size"), F.lit(RANGE)) + FILE_COST)).first()[0] or 0
    return files.select(*columns).repartition(max(1, -(-cost // TASK_BYTES)), *columns)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def whole(files: DataFrame) -> DataFrame:
    """``path, value``: a row per file of ``listed``."""
    schema = pa.schema([("path", pa.string()), ("value", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for uri in batch.column(0).to_pylist():
                    system, path, _ = system_of(uri)
                    with system.open_input_stream(path, compression=None) as f:
                        yield uri, f.read().decode("utf-8", "replace")

        return _batches(rows(), schema)

    return _spread(files, "path").mapInArrow(read, "path string, value string")


def _lines_of(uri: str, start: int, size: int) -> Iterator[bytes]:
    """The lines that begin in a part of a file, ended by line feed, carriage return or both."""
    system, path, _ = system_of(uri)
    with system.open_input_file(path) as f:
        end = min(start + RANGE, size)
        f.seek(max(0, start - 1))
        data = f.read(end - f.tell())
        at = 0
        if start:  # a line begins behind a line's end, which may be the last byte before the part
            ends = [k for k in (data.find(b"\n"), data.find(b"\r")) if k >= 0]
            if not ends:
                return
            at = min(ends)
            at += 2 if data[at : at + 2] == b"\r\n" else 1
        if at >= len(data):
            return
        while data[-1:] not in (b"\n", b"\r") and (more := f.read(1 << 16)):  # the last line ends beyond
            ends = [k for k in (more.find(b"\n"), more.find(b"\r")) if k >= 0]
            data += more[: min(ends) + 1] if ends else more
        data = data[at:].removeprefix(b"\xef\xbb\xbf" if not start else b"")
        yield from data.replace(b"\r\n", b"\n").replace(b"\r", b"\n").removesuffix(b"\n").split(b"\n") if data else ()


def lines(files: DataFrame) -> DataFrame:
    """``path, line, value``: the lines of the files of ``listed``, numbered from 1 in each.

    Long files are read in parts; their lines are counted first, so neither a file nor a line's number needs one task, and no text is shuffled.
    """
    parts = files.select("path", "size", F.explode(F.sequence(F.lit(0), F.greatest("size", F.lit(1)) - 1, F.lit(RANGE))).alias("start"))
    schema = pa.schema([("path", pa.string()), ("line", pa.int64()), ("value", pa.string())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [sum(1 for _ in _lines_of(*x)) for x in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "size")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("start"), pa.array(n, pa.int64())], names=["path", "start", "n"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for uri, start, size, before in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "size", "before")), strict=True):
                    for k, line in enumerate(_lines_of(uri, start, size), before + 1):
                        yield uri, k, line.decode("utf-8", "replace")

        return _batches(rows(), schema)

    cost = files.agg(F.sum("size")).first()[0] or 0
    long = parts.where(F.col("size") > RANGE).repartition(max(1, -(-cost // TASK_BYTES)), "path", "start")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one row per part of a long file
    counted = long.mapInArrow(count, "path string, start bigint, n bigint").withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    short = _spread(parts.where(F.col("size") <= RANGE), "path", "start", "size").withColumn("before", F.lit(0).cast("bigint"))
    told = short.unionByName(_spread(parts.where(F.col("size") > RANGE), "path", "start", "size").join(counted, ["path", "start"]).select("path", "start", "size", "before"))
    return told.mapInArrow(read, "path string, line bigint, value string")
