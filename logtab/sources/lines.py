"""Line sources: text files (or an existing column) → one row per line.

Spark's text source breaks lines at ``\\n``, ``\\r\\n`` and a lone ``\\r``
and keeps blank lines, the same universal-newline rule as Python text mode.
Files are split into byte ranges by ``spark.sql.files.maxPartitionBytes``, so
one large log is read by many tasks; there is no separate chunking step.

Every row carries a source-order key so outputs can be written in input
order without a driver-side merge:

* ``_src_file``  - the file path (dictionary-encoded once staged);
* ``_src_seq``   - the file's position in natural order of its name's
  trailing number, when ``natural_order`` is set (``chunk_2`` before
  ``chunk_10``); otherwise 0;
* ``_src_block`` - start byte of the split the line came from;
* ``_src_row``   - ``monotonically_increasing_id()``: increasing within a
  split, and stable when a lost task is recomputed because file splits are
  deterministic.
"""

from __future__ import annotations

import codecs
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER_COLS = ["_src_seq", "_src_file", "_src_block", "_src_row"]

# A file name ends in an integer id, optionally followed by extensions.
NUMBERED_NAME = r"^.*?(\d+)(?:\..*)?$"


def natural_key(name: Column) -> Column:
    """Integer id at the end of a file name (before its extensions); fails the job on a name without one, since such a
    name has no place in the order."""
    digits = F.regexp_extract(name, NUMBERED_NAME, 1)
    return F.when(digits != "", digits.cast("bigint")).otherwise(
        F.raise_error(F.concat(F.lit("file name has no numeric id: "), name)).cast("bigint"))


BAD_BYTES = ("replace", "fail", "mark")
BAD = "_src_bad"


def charset_table(encoding: str) -> tuple[str, str, str]:
    """How a one-byte charset differs from ISO 8859-1 above 0x7F: characters,
    what they stand for, and those that stand for nothing (by Python's codec,
    which must agree with ASCII below)."""
    low, high = bytes(range(0x80)), bytes(range(0x80, 0x100))
    text = high.decode(encoding, "replace")
    if low.decode(encoding, "replace") != low.decode("ascii") or len(text) != len(high):
        raise ValueError(f"{encoding}: lines can be read in UTF-8 and in one-byte charsets that hold ASCII")
    plain = high.decode("latin-1")
    pairs = [(a, b) for a, b in zip(plain, text) if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs), "".join(a for a, b in pairs if b == "\ufffd")


def decoded(raw: Column, encoding: str = "UTF-8", on_bad_bytes: str = "replace") -> tuple[Column, Column]:
    """Text of a line whose bytes are in ``encoding``, and whether it had
    bytes that stand for nothing there (they become U+FFFD, or fail the job
    with ``on_bad_bytes="fail"``)."""
    if on_bad_bytes not in BAD_BYTES:
        raise ValueError(f"on_bad_bytes must be one of {BAD_BYTES}")
    if codecs.lookup(encoding).name == "utf-8":
        bad, text = ~F.is_valid_utf8(raw), F.make_valid_utf8(raw)
    else:
        chars, meant, none = charset_table(encoding)
        plain = F.decode(raw.cast("binary"), "ISO-8859-1")
        text = F.translate(plain, chars, meant) if chars else plain
        bad = F.length(F.translate(plain, none, "")) != F.length(plain) if none else F.lit(False)
    if on_bad_bytes == "fail":
        shown = F.concat(F.lit(f"bytes that are not {encoding} in line: "), F.hex(raw.cast("binary")))
        text = F.when(bad, F.raise_error(shown).cast("string")).otherwise(text)
    return text, bad


def read_lines(spark: SparkSession, paths: str | Sequence[str], natural_order: bool = False,
               with_order: bool = True, encoding: str = "UTF-8", on_bad_bytes: str = "replace") -> DataFrame:
    """Read text files as ``value`` lines plus the order key (see module doc).

    A missing path raises Spark's ``PATH_NOT_FOUND`` error before any job runs.

    ``encoding`` is UTF-8 or a one-byte charset that holds ASCII (Latin-1,
    Windows code pages...); their line ends are the same bytes, so files are
    split as ever.  Bytes that stand for nothing there become U+FFFD
    (``on_bad_bytes="replace"``), fail the job (``"fail"``), or also set the
    column ``_src_bad``, for ``parse(bad="_src_bad")`` to reject the line
    (``"mark"``).
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.text(paths)
    seq = natural_key(F.col("_metadata.file_name")) if natural_order else F.lit(0).cast("bigint")
    text, bad = decoded(F.col("value"), encoding, on_bad_bytes)
    plain = codecs.lookup(encoding).name == "utf-8" and on_bad_bytes == "replace"
    cols = [F.col("value") if plain else text.alias("value")]  # Spark itself shows bad UTF-8 as U+FFFD
    if with_order:
        cols += [seq.alias("_src_seq"),
                 F.col("_metadata.file_path").alias("_src_file"),
                 F.col("_metadata.file_block_start").alias("_src_block"),
                 F.monotonically_increasing_id().alias("_src_row")]
    if on_bad_bytes == "mark":
        cols.append(bad.alias(BAD))
    return df.select(*cols)


def lines(df: DataFrame, col: str, order_by: Sequence[str] = ()) -> DataFrame:
    """Use an existing string column as log lines (renamed ``value``).

    ``order_by`` names columns that already give the line order; they are
    kept as-is and can be passed to the sinks as the order key.
    """
    return df.select(F.col(col).alias("value"), *[c for c in order_by if c != col])


def in_order(df: DataFrame, order: Sequence[str] = ORDER_COLS, partitions: int | None = None) -> DataFrame:
    """Sort by the order key (a range-partitioned shuffle: part files come out
    in key order, each sorted) and drop the key columns.

    ``partitions`` sets the number of sort partitions (default
    ``spark.sql.shuffle.partitions``); size it to the data, since adaptive
    execution can merge range partitions but not split them.
    """
    order = [c for c in order if c in df.columns]
    if not order:
        return df
    if partitions:
        return df.repartitionByRange(partitions, *order).sortWithinPartitions(*order).drop(*order)
    return df.orderBy(*order).drop(*order)


def number_lines(df: DataFrame, order: Sequence[str] = ORDER_COLS, out: str = "line_no") -> DataFrame:
    """Add a dense 1-based ``line_no`` in order-key order, without moving all
    rows through one task.

    The rows are range-sorted and checkpointed (reliably, to the session's
    checkpoint directory), which fixes both their partitions and the order
    inside each.  One small job counts rows per partition - one number per
    partition reaches the driver, like ``RDD.zipWithIndex`` - and each row's
    number is its partition's offset plus its index inside the partition.
    The order-key columns are dropped.  The sorted copy stays under the
    checkpoint directory while the result is in use (Spark removes it with
    ``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    from logtab.plans.storage import scratch_dir

    spark = df.sparkSession
    order = [c for c in order if c in df.columns]
    scratch_dir(spark)  # makes sure a checkpoint directory is set
    fixed = df.orderBy(*order).drop(*order).checkpoint(eager=True)
    counts = dict(fixed.groupBy(F.spark_partition_id().alias("p")).count().collect())
    offsets, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        offsets.append((p, total))
        total += counts.get(p, 0)
    table = spark.createDataFrame(offsets or [(0, 0)], "__pid int, __base bigint")
    pid = F.spark_partition_id()
    tagged = fixed.select("*", pid.alias("__pid"),
                          (F.monotonically_increasing_id() - pid.cast("bigint") * (1 << 33)).alias("__idx"))
    # each row's index is fixed before the join, so any join strategy gives
    # the same numbers
    return (tagged.join(table, "__pid")
            .withColumn(out, F.col("__base") + F.col("__idx") + 1)
            .drop("__pid", "__idx", "__base"))
