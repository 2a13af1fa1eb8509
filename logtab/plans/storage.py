"""Filesystem helpers that go through Hadoop's FileSystem API, so the same
code works for local paths, HDFS and object stores."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_path(spark, path)
    return bool(fs.exists(p))


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs_path(spark, path)
    fs.delete(p, True)


def size_of(spark: SparkSession, path: str) -> int:
    """Total bytes under ``path`` (metadata only)."""
    fs, p = _fs_path(spark, path)
    return int(fs.getContentSummary(p).getLength())


def list_names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs_path(spark, path)
    return sorted(str(s.getPath().getName()) for s in fs.listStatus(p))


def scratch_dir(spark: SparkSession, label: str = "logtab") -> str:
    """A fresh directory under the cluster's shared checkpoint folder.

    The folder comes from the session (``spark.checkpoint.dir`` or a
    checkpoint directory already set on the context).  Where neither is set,
    a local run gets a temporary folder, installed as the checkpoint
    directory; on a cluster that would be a folder of the driver's own, so
    it is an error there.  ``release`` deletes what this session was given.
    """
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="logtab-ckpt-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir() or root
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _given.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


_given: dict[str, list[str]] = {}


def release(spark: SparkSession) -> None:
    """Delete every scratch directory handed out in this application.  Call
    it once no DataFrame that reads them is needed any more."""
    for path in _given.pop(spark.sparkContext.applicationId, []):
        if exists(spark, path):
            delete(spark, path)


def mkdirs(spark: SparkSession, path: str) -> None:
    fs, p = _fs_path(spark, path)
    fs.mkdirs(p)


def rename(spark: SparkSession, src: str, dst: str) -> None:
    fs, s = _fs_path(spark, src)
    _, d = _fs_path(spark, dst)
    if not fs.rename(s, d):
        raise OSError(f"could not rename {src} to {dst}")


def list_files(spark: SparkSession, path: str) -> list[str]:
    """All files below ``path``."""
    fs, p = _fs_path(spark, path)
    found, out = fs.listFiles(p, True), []
    while found.hasNext():
        out.append(str(found.next().getPath().toString()))
    return out


def sizes(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, int]]:
    out = []
    for path in paths:
        fs, p = _fs_path(spark, path)
        out.append((path, int(fs.getFileStatus(p).getLen())))
    return out


def file_stats(spark: SparkSession, paths: Sequence[str]) -> tuple[int, int]:
    """Number of files and bytes under paths or globs (metadata only)."""
    files = size = 0
    for path in paths:
        fs, p = _fs_path(spark, path)
        for status in fs.globStatus(p) or []:
            summary = fs.getContentSummary(status.getPath())
            files += int(summary.getFileCount())
            size += int(summary.getLength())
    return files, size


def largest_file(spark: SparkSession, paths: str | Sequence[str]) -> int:
    """Bytes of the largest file below paths or globs (metadata only)."""
    most = 0
    for path in [paths] if isinstance(paths, str) else paths:
        fs, p = _fs_path(spark, path)
        for status in fs.globStatus(p) or []:
            found = fs.listFiles(status.getPath(), True)
            while found.hasNext():
                most = max(most, int(found.next().getLen()))
    return most


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, written by the driver."""
    fs, p = _fs_path(spark, path)
    out = fs.create(p)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path in the machine's own file system, if it lies in one."""
    fs, p = _fs_path(spark, path)
    uri = fs.makeQualified(p).toUri()
    return str(uri.getPath()) if uri.getScheme() == "file" else None


COPY_BYTES = 1 << 23


def join_files(spark: SparkSession, parts: Sequence[str], target: str, start: bytes = b"") -> None:
    """Join part files to one file behind ``start``.

    HDFS joins the files' blocks (``FileSystem.concat``), no byte is copied.
    In a shared mounted folder each task copies its part to its place in the
    target; a task that runs twice writes the same bytes again.  In a store
    that has neither, one task after the other would have to append, so
    that is an error: keep the parts there.
    """
    if local_path(spark, target) is None:
        fs, t = _fs_path(spark, target)
        write_bytes(spark, target, start)
        array = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, len(parts))
        for i, part in enumerate(parts):
            array[i] = _fs_path(spark, part)[1]
        try:
            fs.concat(t, array)
        except Exception as e:
            raise OSError(f"{fs.getScheme()} cannot join files; write the output as parts (single_file=False)") from e
        return
    out, at, rows = local_path(spark, target), len(start), []
    for part, size in sizes(spark, parts):
        for offset in range(0, size, COPY_BYTES * 8):
            rows.append((local_path(spark, part), offset, min(COPY_BYTES * 8, size - offset), at + offset))
        at += size
    with open(out, "wb") as f:
        f.write(start)
        f.truncate(at)

    def copy(batches):
        for b in batches:
            for source, offset, left, to in zip(*[c.to_pylist() for c in b.columns]):
                with open(source, "rb") as src, open(out, "r+b") as dst:
                    src.seek(offset)
                    dst.seek(to)
                    while left:
                        data = src.read(min(COPY_BYTES, left))
                        if not data:
                            raise OSError(f"{source} ends early")
                        dst.write(data)
                        left -= len(data)
            yield b

    pieces = spark.createDataFrame(rows, "source string, offset long, size long, place long")
    pieces = pieces.repartition(max(1, min(len(rows), spark.sparkContext.defaultParallelism * 4)))
    pieces.mapInArrow(copy, pieces.schema).agg(F.count("*")).collect()
    for part in parts:
        delete(spark, part)
