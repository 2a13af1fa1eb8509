"""Log lines as a stream: the same routing and parsing, incrementally.

Routing, header projection and parameter extraction are stateless per
line, so ``parse`` runs unchanged on ``readStream.text``.  Two things need
the whole dataset and are handled differently on a stream:

* **the wide header** is data-dependent.  ``start_records_sink`` appends the
  narrow records (a struct per grammar with a params map - no fixed column
  list needed) to a Parquet store; ``tabulate_records`` later turns the
  store into wide tables in one batch job.  When the header is known up
  front, ``start_table_sink`` writes wide TSV per micro-batch with it;
  keys outside the header stop the query or go to a column of their own.
* **source order** relies on ``monotonically_increasing_id``, which streams
  refuse; the records store adds it per micro-batch, where it still rises
  along each split.

Both sinks are exactly-once through the checkpoint location, which defaults
to a folder under the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import itertools
import posixpath
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logtab.operators.parsers import DEFAULT_PARSERS, LogParser
from logtab.operators.route import REJECT, parse, rejects
from logtab.operators.tabularize import KEYS, grammar_columns, param_keys, tabularize
from logtab.plans import storage
from logtab.sinks.tsv import TSV_WRITE_OPTIONS

_ids = itertools.count()


def stream_lines(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """New text files under ``path`` as a stream of ``value`` lines with
    ``_src_file`` and ``_src_block``."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path).select(
        "value",
        F.col("_metadata.file_path").alias("_src_file"),
        F.col("_metadata.file_block_start").alias("_src_block"),
    )


def parse_stream(spark: SparkSession, path: str, parsers: Sequence[LogParser] = DEFAULT_PARSERS,
                 year: int = 2020, on_bad_date: str = "fail", max_files_per_trigger: int | None = None
                 ) -> DataFrame:
    """Streaming narrow records (same columns as ``parse``); per-route line
    counts appear in the query progress under ``observedMetrics``."""
    return parse(stream_lines(spark, path, max_files_per_trigger), parsers=parsers, year=year,
                 on_bad_date=on_bad_date)


def _checkpoint(spark: SparkSession, given: str | None, label: str) -> str:
    return given or storage.scratch_dir(spark, f"logtab-{label}")


def start_records_sink(narrow: DataFrame, path: str, checkpoint: str | None = None,
                       trigger: dict | None = None) -> StreamingQuery:
    """Append narrow records to a Parquet store at ``path``, with each row's
    key list (for a cheap key discovery by ``tabulate_records``) and its
    order within its split (``_src_row``).

    Each micro-batch is written to a folder of its own (``batch=<id>``), so
    a batch replayed after a failure replaces its output.
    """
    spark = narrow.sparkSession
    if grammar_columns(narrow):
        narrow = narrow.withColumn(KEYS, param_keys(narrow))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # nothing between the scan and here moves rows, so ids rise with the lines of a split
        (batch.withColumn("_src_row", F.monotonically_increasing_id())
         .write.mode("overwrite").parquet(posixpath.join(path, f"batch={batch_id}")))

    w = (narrow.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", _checkpoint(spark, checkpoint, "records-ckpt"))
         .queryName(f"logtab_records_{next(_ids)}"))
    if trigger:
        w = w.trigger(**trigger)
    return w.start()


def start_table_sink(narrow: DataFrame, out: str, headers: dict[str, list[str]], base: str = "stream",
                     parsers: Sequence[LogParser] = DEFAULT_PARSERS, checkpoint: str | None = None,
                     trigger: dict | None = None, new_keys: str = "fail") -> StreamingQuery:
    """Write each micro-batch as wide TSV with fixed ``headers`` (one
    dataset per grammar under ``out``) plus the rejects as text.

    A key outside the headers stops the query (``new_keys="fail"``) or goes
    to a last column ``_extra``, a JSON object (``"keep"``).

    Each batch's files are written to a folder named after the batch id
    (``batch=<id>``), so a batch replayed after a failure replaces its own
    output instead of duplicating it.  Reading a table back with
    ``read_tsv`` therefore adds a ``batch`` partition column.
    """
    spark = narrow.sparkSession
    if new_keys not in ("fail", "keep"):
        raise ValueError("new_keys must be 'fail' or 'keep'")
    opts = dict(TSV_WRITE_OPTIONS)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # three outputs read the batch: parse it once (bounded by the trigger
        # size; a lost block is recomputed from the batch's source files)
        batch.persist()
        try:
            for p in parsers:
                wide = tabularize(batch, p, headers[p.name], new_keys=new_keys)
                (wide.write.mode("overwrite").options(**opts)
                 .csv(posixpath.join(out, f"{base}.{p.name}.tsv", f"batch={batch_id}")))
            (rejects(batch).select("value").write.mode("overwrite")
             .text(posixpath.join(out, f"{base}.{REJECT}", f"batch={batch_id}")))
        finally:
            batch.unpersist()

    w = (narrow.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", _checkpoint(spark, checkpoint, "tables-ckpt"))
         .queryName(f"logtab_tables_{next(_ids)}"))
    if trigger:
        w = w.trigger(**trigger)
    return w.start()
