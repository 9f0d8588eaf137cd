"""Files of folders as rows, with the formats that can be read, the rest as rejects."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.engine import cut, ship
from paperloom.functions import paths

LISTED = "path string, length bigint, modificationTime timestamp"


def listing(spark: SparkSession, inputs: Sequence[str], recursive: bool = False) -> DataFrame:
    """path, length, modificationTime of all files of files, wildcards and folders, each file once; no content is read.

    A folder among the inputs gives its files, with those below it if recursive. Names that begin with _ or . are listed
    too when they are named by themselves or matched by a wildcard on a local file system; Spark's reader skips them.
    Folders that are listed with those below them on a file system that Arrow knows are listed by the executors (see below()).
    """
    plain = [p for p in inputs if not _hidden(p)]
    frames = []
    if recursive:
        roots = {p: root for p in plain if (root := _root(_uri(p)))}
        plain = [p for p in plain if p not in roots]
        if own := sorted(set(roots.values())):
            frames.append(below(spark, own))
            if len(own) == 1 and len(roots) == len({*inputs}):  # one folder gives each file once
                return frames[0]
    if plain:
        r = spark.read.format("binaryFile")
        if recursive:
            r = r.option("recursiveFileLookup", "true")
        frames.append(r.load([_uri(p) for p in plain]).select("path", "length", "modificationTime"))
    hidden = [p for p in inputs if _hidden(p)]
    if hidden:
        rows = [(f"file:{os.path.abspath(p)}", os.path.getsize(p), int(os.path.getmtime(p))) for p in hidden if os.path.isfile(p)]
        frames.append(spark.createDataFrame(rows, "path string, length bigint, t bigint").select("path", "length", F.timestamp_seconds("t").alias("modificationTime")))
    out = reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], LISTED)
    return out.dropDuplicates(["path"])


def below(spark: SparkSession, roots: Sequence[tuple[str, str]]) -> DataFrame:
    """path, length, modificationTime of the files of folders (prefix, path) and of all folders below them.

    Level by level: each folder of a level is listed by one task, and what it has goes to the shared folder, so neither names
    nor tasks meet at the driver, whatever the number of files.
    """
    ship(spark)
    most = 4 * spark.sparkContext.defaultParallelism
    todo = spark.createDataFrame(list(roots), "prefix string, path string")
    levels = []
    while not levels or not todo.isEmpty():
        level = cut(todo.repartition(most, "path").mapInArrow(_children, "prefix string, path string, folder boolean, length bigint, t bigint"))
        levels.append(level.where("not folder").select(F.concat("prefix", "path").alias("path"), "length", F.timestamp_millis("t").alias("modificationTime")))
        todo = level.where("folder").select("prefix", "path")
    return reduce(DataFrame.unionByName, levels)


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """prefix, path, folder, length, t (milliseconds) of what lies in each folder (prefix, path) and has a name that Spark's reader lists."""
    kinds = {"prefix": pa.string(), "path": pa.string(), "folder": pa.bool_(), "length": pa.int64(), "t": pa.int64()}
    systems: dict[str, fs.FileSystem] = {}
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds.values())], list(kinds))
        rows.clear()
        return out

    for b in batches:
        for prefix, path in zip(*(c.to_pylist() for c in b.columns)):
            if prefix not in systems:
                systems[prefix] = _system(prefix, path)[0]
            for i in systems[prefix].get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if i.type != fs.FileType.NotFound and not _skipped(i.base_name):
                    rows.append((prefix, i.path, i.type == fs.FileType.Directory, i.size or 0, (i.mtime_ns or 0) // 1_000_000))
                    if len(rows) == 8192:
                        yield batch()
    if rows:
        yield batch()


def _skipped(name: str) -> bool:
    """Names that Spark's reader leaves out of a folder."""
    out = name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")
    return out and not name.startswith(("_common_metadata", "_metadata"))


def _system(prefix: str, path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Arrow knows it, and the path in it."""
    return fs.FileSystem.from_uri(f"{'file://' if prefix == 'file:' else prefix}{quote(path)}")


def _root(uri: str) -> tuple[str, str] | None:
    """(prefix, path) of a folder without wildcards on a file system that Arrow knows, else None; prefix + path is its name as Spark gives it."""
    m = re.match(r"([a-z][\w+.-]*:)(//[^/]*)?(/.*)$", uri, re.I | re.S)
    if not m or re.search(r"[*?\[\]{}\\]", uri):
        return None
    scheme, host, path = m.groups()
    prefix, path = scheme + (host or "" if scheme != "file:" else ""), re.sub("/+", "/", path).rstrip("/") or "/"
    try:
        system, own = _system(prefix, path)
        return (prefix, path) if own == path and system.get_file_info(own).type == fs.FileType.Directory else None
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None


def _hidden(p: str) -> bool:
    return os.path.basename(p.rstrip("/"))[:1] in ("_", ".") and "://" not in p


def _uri(p: str) -> str:
    return p if "://" in p or p.startswith("file:") else f"file:{os.path.abspath(p)}"


def accepted(files: DataFrame) -> DataFrame:
    """Files of a supported format that aren't temporary, in any letter case of the extension."""
    return files.where(paths.is_supported(F.col("path")))


def rejected(files: DataFrame) -> DataFrame:
    """path, reason (temporary, legacy, unsupported) of the others."""
    p = F.col("path")
    reason = F.when(paths.is_temporary(p), "temporary").when(paths.extension(p).isin(*paths.LEGACY), "legacy").when(~paths.is_supported(p), "unsupported")
    return files.select("path", reason.alias("reason")).where("reason is not null")


#: Names of supported formats in any letter case, as a glob, so that no other file is opened.
GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in f) for f in paths.SUPPORTED) + "}"


def contents(spark: SparkSession, inputs: Sequence[str], recursive: bool = False) -> DataFrame:
    """path, length, modificationTime, content of the accepted files of listing(); each is read where it is parsed, no name passes the driver's Python."""
    frames = []
    plain = [_uri(p) for p in inputs if not _hidden(p)]
    if plain:
        r = spark.read.format("binaryFile").option("pathGlobFilter", GLOB)
        if recursive:
            r = r.option("recursiveFileLookup", "true")
        frames.append(r.load(plain).select("path", "length", "modificationTime", "content"))
    hidden = [p for p in inputs if _hidden(p)]
    if hidden:
        frames.append(listing(spark, hidden).mapInPandas(_read, LISTED + ", content binary"))
    out = frames[0] if frames else spark.createDataFrame([], LISTED + ", content binary")
    for f in frames[1:]:
        out = out.unionByName(f)
    return accepted(out)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        data = []
        for p in b["path"]:
            with open(p.removeprefix("file:"), "rb") as f:
                data.append(f.read())
        yield b.assign(content=data)
