"""Records that may hold line breaks, read by many tasks from one file.

A line break inside quotes belongs to its record, so whether a line begins a
record depends on all quotes before it in the file.  Each task numbers the
record starts of its own split twice: as if the split began outside quotes,
and as if it began inside.  One row per split, with the parity of its quotes,
then tells which of the two holds.  Lines that are whole records go on as
they are; only the pieces of broken ones are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logtab.plans.storage import scratch_dir

PLACE = ("__file", "__block", "__row")
STATE = "__odd boolean, __inside boolean, __out int, __in int"


def _numbered(quote: str):
    """Per line, counted from the start of its split: whether its quotes are
    odd, whether the quotes before it are, and how many records have begun by
    its end if the split begins outside and inside quotes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parity, out, inside = None, 0, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            odd = np.asarray(pc.count_substring(b.column(0), quote)).astype(np.int64) & 1
            files, blocks = b.column(1).to_pylist(), np.asarray(b.column(2))
            new = np.concatenate(([(files[0], blocks[0]) != key], blocks[1:] != blocks[:-1]))
            new[1:] |= np.array([x != y for x, y in zip(files[1:], files)], bool)
            cuts = np.union1d(np.flatnonzero(new), [0, b.num_rows]).tolist()
            before, outs, ins = (np.empty(b.num_rows, np.int64) for _ in range(3))
            for lo, hi in zip(cuts, cuts[1:]):  # a split, or what the batch has of it
                if new[lo]:
                    parity = out = inside = 0
                before[lo:hi] = (np.cumsum(odd[lo:hi]) - odd[lo:hi] + parity) & 1
                outs[lo:hi] = out + np.cumsum(before[lo:hi] == 0)
                ins[lo:hi] = inside + np.cumsum(before[lo:hi] == 1)
                parity, out, inside = (int(before[hi - 1]) + int(odd[hi - 1])) & 1, int(outs[hi - 1]), int(ins[hi - 1])
            key = (files[-1], blocks[-1])
            made = [pa.array(odd == 1), pa.array(before == 1), pa.array(outs, pa.int32()), pa.array(ins, pa.int32())]
            yield pa.record_batch([*b.columns, *made], names=[*b.schema.names, "__odd", "__inside", "__out", "__in"])

    return run


def quoted_records(spark: SparkSession, paths: str | Sequence[str], quote: str = '"') -> DataFrame:
    """``(value, is_first, partition columns...)``: each record of text files
    whose quoted values may hold line breaks, as one string; ``is_first``
    marks each file's first record.  A doubled quote inside quotes counts as
    two, so it changes nothing.  Blank records are left out, as CSV readers
    do, and a carriage return before a record's line feed belongs to it.

    The numbered lines are written once to the scratch folder, so every later
    step sees the same splits.  Rows come in no particular order.
    """
    raw = spark.read.option("lineSep", "\n").text(paths)
    own = raw.columns[1:]
    placed = raw.select("value", F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.file_block_start").alias(PLACE[1]),
                        F.monotonically_increasing_id().alias(PLACE[2]), *own)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)
    path = scratch_dir(spark, "logtab-lines")
    placed.mapInArrow(_numbered(quote), f"{kinds}, {STATE}").write.parquet(path)
    lines = spark.read.parquet(path)

    by_block = Window.partitionBy("__file").orderBy("__block")
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("__file", "__block").agg(
        (F.sum(F.col("__odd").cast("int")) % 2).alias("odd"), F.max("__out").alias("out"), F.max("__in").alias("in"))
    blocks = blocks.withColumn("__starts_inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    count = F.when(F.col("__starts_inside"), F.col("in")).otherwise(F.col("out"))
    blocks = blocks.withColumn("last", F.when(count > 0, F.struct(F.col("__block").alias("block"), count.alias("n"))))
    blocks = blocks.withColumn("__open", F.last("last", ignorenulls=True).over(before)).drop("odd", "out", "in", "last")

    number = F.when(F.col("__starts_inside"), F.col("__in")).otherwise(F.col("__out"))
    known = (lines.join(blocks, ["__file", "__block"])
             .withColumn("__begins", F.col("__inside") == F.col("__starts_inside"))
             .withColumn("__record", F.when(number > 0, F.struct(F.col("__block").alias("block"), number.alias("n"))).otherwise(F.col("__open"))))
    # two scans of the stored lines: most records are one line and stay where they are
    whole = known.where("__begins and not __odd").select("value", "__record", *own)
    pieces = known.where("__odd or not __begins")
    joined = (pieces.groupBy("__file", "__record", *own)
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__block", "__row", "value"))), lambda p: p["value"]), "\n")
                   .alias("value")).select("value", "__record", *own))
    first = (F.col("__record")["block"] == 0) & (F.col("__record")["n"] == 1)
    return (whole.unionByName(joined).select(F.regexp_replace("value", "\r$", "").alias("value"), first.alias("is_first"), *own)
            .where("value <> ''"))
