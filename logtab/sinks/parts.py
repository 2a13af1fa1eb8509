"""Text parts in source order, without moving rows.

Every row of the staged records knows the split of the source file it came
from.  Where a task reads one split only, its rows are in order already; so
each task writes a part of its own, named after its split, and the parts get
their numbers when the job has ended, from names alone.  Nothing is sampled,
shuffled or sorted across tasks.

``one_split_per_task`` makes Spark plan such tasks while it is in force.
``write_parts`` does not rely on it: where parts start with a header, a task of
two splits is found by counting, and the caller then sorts instead.  Parts
that are joined to one file have no headers, so their tasks may take several
splits (``few_tasks``).
"""

from __future__ import annotations

import contextlib
import posixpath
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from logtab.plans import storage
from logtab.sinks.tsv import byte_count
from logtab.sources.lines import ORDER_COLS

PART_BYTES = "spark.sql.files.maxPartitionBytes"
OPEN_COST = "spark.sql.files.openCostInBytes"
# A part per split would make too many small parts of more files than this
# that hold less than SMALL_FILE bytes on average; those are sorted instead.
MANY_FILES, SMALL_FILE = 1000, 1 << 20

SPLIT = "__logtab_split"
RUN, PLACE = "__logtab_run", "__logtab_place"
ROW = f"__logtab{ORDER_COLS[-1]}"
IN_TASK = (1 << 33) - 1  # monotonically_increasing_id: the low 33 bits count within a task


def has_many_small_files(spark: SparkSession, paths: Sequence[str]) -> bool:
    files, size = storage.file_stats(spark, paths)
    return files > MANY_FILES and size < files * SMALL_FILE


@contextlib.contextmanager
def one_split_per_task(spark: SparkSession, paths: Sequence[str]):
    """Plan file scans with one split in each task, splits having the size
    that Spark would have given them."""
    files, size = storage.file_stats(spark, paths)
    cost, most = (byte_count(spark.conf.get(k)) for k in (OPEN_COST, PART_BYTES))
    share = -(-(size + files * cost) // max(1, spark.sparkContext.defaultParallelism))
    # a file that costs as much to open as a task may read fills its task
    with settings(spark, {k: f"{max(1, min(most, max(cost, share)))}b" for k in (PART_BYTES, OPEN_COST)}):
        yield


# A job without part files for their own sake (``single_file``) takes many
# small splits in a task: as many tasks for each core, or as many bytes a task.
TASKS_PER_CORE, TASK_BYTES = 8, 128 << 20


def few_tasks(spark: SparkSession, rows: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Rows read from ``paths`` with many small splits in one task, each whole
    and in order.  A task costs more than a small split's work; without small
    splits nothing changes."""
    _, size = storage.file_stats(spark, paths)
    return rows.coalesce(max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))


@contextlib.contextmanager
def large_splits(spark: SparkSession):
    """Read scratch files by the splits that Spark has by default or larger
    ones, however small the source's splits are."""
    with settings(spark, {PART_BYTES: f"{max(byte_count(spark.conf.get(PART_BYTES)), TASK_BYTES)}b"}):
        yield


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def with_split(staged: DataFrame) -> DataFrame:
    """Staged records with the name of the split they came from (and of the
    staged file's own split) and their order in it."""
    seq, file, block, row = (F.col(c) for c in ORDER_COLS)
    name = F.format_string("%020d.%s.%020d.%020d", seq, F.lower(F.hex(F.xxhash64(file))), block, F.col("_metadata.file_block_start"))
    return staged.withColumn(SPLIT, name).withColumn(ROW, row)


def split_order(staged: DataFrame) -> dict[str, str] | None:
    """File path by the name it has in ``SPLIT``; None if two share one."""
    files = staged.select(F.lower(F.hex(F.xxhash64("_src_file"))).alias("h"), "_src_file").distinct().collect()
    names = {r.h: r._src_file for r in files}
    return names if len(names) == len(files) else None


def with_runs(staged: DataFrame, files: dict[str, str]) -> DataFrame:
    """``with_split`` and, for parts that are joined to one file, the run of
    each split (splits that follow one another in the source and lie in one
    staged file) and its place among all splits."""
    placed = with_split(staged.withColumn("__own", F.col("_metadata.file_path")))
    found = sorted((_place(r[0], files), r[1], r[0]) for r in placed.select(SPLIT, "__own").distinct().collect())
    rows, run, before = [], -1, None
    for place, (at, own, split) in enumerate(found):
        if (own, at[-1]) != before:  # another staged file, or another split of it
            run, before = run + 1, (own, at[-1])
        rows.append((split, run, place))
    runs = staged.sparkSession.createDataFrame(rows, f"{SPLIT} string, {RUN} int, {PLACE} int")
    return placed.drop("__own").join(F.broadcast(runs), SPLIT)


def _place(split: str, files: dict[str, str]) -> tuple:
    seq, file, block, own = split.split(".")
    return int(seq), files[file], int(block), int(own)


def write_parts(lines: DataFrame, path: str, head: str | None, files: dict[str, str] | None, heads: bool = True
                ) -> list[str] | None:
    """Write ``value`` lines below ``path`` and return the part files in
    order.

    With ``files`` (see ``split_order``), ``lines`` carry the columns of
    ``with_runs``, a part for each run, or ``SPLIT`` and
    ``ROW`` and each split becomes a part; None is returned if some task had
    more than one split (with ``heads``: only a task's first row knows that it
    starts a part).  Without, Spark's partitions are the parts.  Each
    part starts with ``head`` where there is one and ``heads`` asks for it.
    """
    spark = lines.sparkSession
    name = RUN if RUN in lines.columns else SPLIT
    if files is not None:
        lines = lines.sortWithinPartitions(name, *[c for c in (PLACE,) if name == RUN], ROW)  # in order already, which Spark cannot know
    first = (F.monotonically_increasing_id().bitwiseAND(F.lit(IN_TASK)) == 0).alias("first")
    counted = Observation()
    lines = lines.select(*[c for c in (name,) if files is not None], "value", first)
    lines = lines.observe(counted, F.count(F.lit(1)).alias("rows"), F.count_if("first").alias("tasks"))
    if head is not None and heads:
        lines = lines.withColumn("value", F.when(F.col("first"), F.concat(F.lit(head + "\n"), F.col("value"))).otherwise(F.col("value")))
    writer = lines.drop("first").write.option("maxRecordsPerFile", 0)
    (writer.partitionBy(name) if files is not None else writer).text(path)
    found = [f for f in storage.list_files(spark, path) if posixpath.basename(f).startswith("part-")]
    rows, tasks = counted.get["rows"], counted.get["tasks"]
    if not rows:
        return []
    if files is None:
        # a partition without rows leaves no part, but for the first one
        return sorted((f for f, size in storage.sizes(spark, found) if size or head is None), key=posixpath.basename)

    def place(part: str) -> tuple:
        value = unquote(posixpath.basename(posixpath.dirname(part))).partition("=")[2]
        return (int(value),) if name == RUN else _place(value, files)

    if (heads and len(found) != tasks) or len({place(f) for f in found}) != len(found):
        return None
    return sorted(found, key=place)


def publish(spark: SparkSession, parts: Sequence[str], path: str, head: str | None, suffix: str, single: bool) -> None:
    """Move the parts to ``path`` under numbered names, or join them to one
    file there.  Without parts a file of the head alone is made."""
    storage.mkdirs(spark, path)
    name = posixpath.join(path, "part-{:05d}" + suffix)
    start = b"" if head is None else (head + "\n").encode()
    if not parts:
        storage.write_bytes(spark, name.format(0), start)
    elif single:
        storage.join_files(spark, parts, name.format(0), start)
    else:
        for i, part in enumerate(parts):
            storage.rename(spark, part, name.format(i))
