"""End-to-end job: log file(s) → one wide table per grammar + reject file.

Stages (each a Spark job; only key names ever reach the driver):

1. **parse** - read lines with their source-order key, route and parse
   them (one projection chain), and write the narrow records once as
   Parquet to a staging folder under the shared checkpoint directory.  This
   cuts lineage: later stages, and tasks recomputed after an executor loss,
   re-read Parquet instead of re-running the regexes.
2. **keys** - distinct parameter keys per grammar from the staged records
   (map-side partial aggregate; reads only ``parser`` and the params maps).
3. **tables** - per grammar, each staged record rendered as its TSV line
   from its own entries.  A parse task reads one split of one source file, so
   the staged files keep the lines' order and every table task writes one
   part; parts are numbered in source order when the job has ended
   (``logtab.sinks.parts``).  No row is moved.  Records that have lost their
   splits (dealt lines, very many tiny files, streams), and other ``writer``
   functions, get the narrow records range-sorted instead.
4. **rejects** - unrecognised lines, stripped, in source order, as text.

Output layout: ``<out>/<base>.<parser>.tsv/`` per grammar (always, even when
empty) and ``<out>/<base>.na<ext>/`` for the rejects; ``<out>`` defaults to
``<source dir>/<base>_<YYYYmmdd_HHMMSS>`` and must not exist yet.  A run
writes to a folder beside it that is renamed last, so a failed run leaves
nothing there and can be repeated.
"""

from __future__ import annotations

import contextlib
import datetime
import os
import posixpath
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from logtab.operators.parsers import DEFAULT_PARSERS, LogParser
from logtab.operators.route import REJECT, check_parsers, parse, rejects
from logtab.operators.tabularize import KEYS, TooManyColumns, grammar_columns, headers, param_keys, tabularize
from logtab.plans import storage
from logtab.sinks.parts import (PLACE, ROW, RUN, SPLIT, few_tasks, has_many_small_files, large_splits, one_split_per_task, publish,
                                split_order, with_runs, with_split, write_parts)
from logtab.sinks.sparse import header_line, render
from logtab.sinks.tsv import Writer, write_tsv
from logtab.sources.lines import BAD, ORDER_COLS, in_order, read_lines


@dataclass
class ParseResult:
    out_dir: str
    tables: dict[str, str]
    rejects: str
    headers: dict[str, list[str]]
    counts: dict[str, int] = field(default_factory=dict)
    records: str | None = None


# Suffixes Spark's text source decompresses transparently; they are not part
# of the name the outputs are named after (``app.log.gz`` → ``app``, ``.log``).
COMPRESSION_SUFFIXES = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")


def split_path(path: str) -> tuple[str, str, str]:
    """``dir/base.ext`` → ``(dir, base, ext)`` (F7), ignoring a compression
    suffix."""
    d, name = posixpath.split(path.rstrip("/"))
    for suffix in COMPRESSION_SUFFIXES:
        if name.endswith(suffix) and len(name) > len(suffix):
            name = name[: -len(suffix)]
            break
    base, ext = os.path.splitext(name)
    return d, base, ext


GLOB_CHARS = "*?[]{}"


def output_names(srcs: Sequence[str]) -> tuple[str, str, str]:
    """``(dir, base, ext)`` the outputs are named after: the source file's,
    or a neutral ``logs`` for several sources or a glob."""
    d, base, ext = split_path(srcs[0])
    if len(srcs) > 1 or any(c in base for c in GLOB_CHARS):
        base = "logs"
    if any(c in ext for c in GLOB_CHARS):
        ext = ".log"
    return d, base, ext


def default_out_dir(srcs: Sequence[str], now: datetime.datetime | None = None) -> str:
    """``<source dir>/<base>_<YYYYmmdd_HHMMSS>``."""
    d, base, _ = output_names(srcs)
    stamp = (now or datetime.datetime.now()).strftime("%Y%m%d_%H%M%S")
    return posixpath.join(d, f"{base}_{stamp}")


def parse_logs(spark: SparkSession, src: str | Sequence[str], out: str | None = None,
               parsers: Sequence[LogParser] = DEFAULT_PARSERS, year: int = 2020,
               on_bad_date: str = "fail", writer: Writer = write_tsv, keep_records: bool = False,
               preserve_order: bool = True, single_file: bool = False, natural_order: bool = False,
               max_columns: int | None = None, min_partitions: int | None = None,
               sort_partitions: int | None = None, encoding: str = "UTF-8", on_bad_bytes: str = "replace") -> ParseResult:
    """Run the whole job (see module doc) and return where everything went.

    ``src`` may be one file, a glob, or several files (rotated logs: set
    ``natural_order`` to order them by the number in their names).
    ``keep_records`` keeps the staged narrow records (Parquet, with the
    discovered keys beside them) under ``<out>/.records``.

    ``max_columns`` stops a job whose tables would get more columns
    (``TooManyColumns``); the parsed records are kept then, and the error
    says where.  ``min_partitions`` deals the lines over that many tasks
    before parsing (for gzip logs and other inputs in few splits);
    ``sort_partitions`` sets the range partitions of the ordered outputs
    (default: ``spark.sql.shuffle.partitions``).  ``encoding`` and
    ``on_bad_bytes`` are those of ``read_lines``, with ``"reject"`` for lines
    of bad bytes to go to the rejects.
    """
    parsers = check_parsers(parsers)
    srcs = [src] if isinstance(src, str) else list(src)
    if not srcs:
        raise ValueError("no source given")
    _, base, ext = output_names(srcs)
    out = (out or default_out_dir(srcs)).rstrip("/")
    if storage.exists(spark, out):
        raise FileExistsError(f"output directory already exists: {out}")

    with codegen_method_limit(spark):
        return _run(spark, srcs, out, base, ext, parsers, year, on_bad_date, writer, keep_records,
                    preserve_order, single_file, natural_order, max_columns, min_partitions, sort_partitions, encoding, on_bad_bytes)


# HotSpot does not JIT-compile methods over 8000 bytes of bytecode; the
# parse stage fuses enough expressions to pass that, and would then run in
# the bytecode interpreter (~2.5x slower).  Spark's documented remedy is to
# cap whole-stage codegen methods at that size.
HUGE_METHOD_LIMIT = "8000"


def configure(spark: SparkSession) -> None:
    """Apply the session settings this library's plans want, where the
    session has not chosen otherwise: currently the HotSpot-friendly
    whole-stage codegen method limit (see ``HUGE_METHOD_LIMIT``).
    ``parse_logs`` does this for its own jobs; call it once when using
    ``parse`` directly."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key, None) in (None, "65535"):
        spark.conf.set(key, HUGE_METHOD_LIMIT)


@contextlib.contextmanager
def codegen_method_limit(spark: SparkSession):
    """Set ``spark.sql.codegen.hugeMethodLimit`` to 8000 for the duration,
    unless the session already sets it."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key, None) not in (None, "65535"):
        yield
        return
    before = spark.conf.get(key, None)
    spark.conf.set(key, HUGE_METHOD_LIMIT)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _run(spark, srcs, out, base, ext, parsers, year, on_bad_date, writer, keep_records,
         preserve_order, single_file, natural_order, max_columns, min_partitions, sort_partitions, encoding,
         on_bad_bytes) -> ParseResult:
    # everything goes to a folder of this run, which gets its name last: a
    # failed run leaves no output, and the next one can have the same name
    running = f"{out}.running-{uuid.uuid4().hex}"
    staging = posixpath.join(running, ".records") if keep_records else storage.scratch_dir(spark, "logtab-stage")
    # dealt lines have left their splits; very many small files are better sorted
    by_split = preserve_order and not min_partitions and not has_many_small_files(spark, srcs)
    marked = on_bad_bytes == "reject"
    lines = read_lines(spark, srcs, natural_order=natural_order, encoding=encoding, on_bad_bytes="mark" if marked else on_bad_bytes)
    obs = Observation("logtab_parse")
    narrow = parse(lines, parsers=parsers, year=year, on_bad_date=on_bad_date, observation=obs, min_partitions=min_partitions,
                   bad=BAD if marked else None)
    kept: set[str] = set()
    try:
        # the raw line is not staged (rejects carry their stripped text); the
        # key list is, for a cheap key discovery
        with one_split_per_task(spark, srcs) if by_split else contextlib.nullcontext():
            rows = narrow.drop("value", BAD).withColumn(KEYS, param_keys(narrow))
            if by_split and single_file:  # its parts are joined: a task may hold several splits
                rows = few_tasks(spark, rows, srcs)
            rows.write.mode("errorifexists").options(**without_bounds(narrow)).option("maxRecordsPerFile", 0).parquet(staging)
        counts = {k: int(v) for k, v in obs.get.items()}
        with large_splits(spark) if single_file else contextlib.nullcontext():
            res = tabulate_records(spark, spark.read.parquet(staging), running, base, ext, parsers, writer,
                                   keep_keys=keep_records, preserve_order=preserve_order, single_file=single_file,
                                   max_columns=max_columns, sort_partitions=sort_partitions,
                                   staged_by_split=staging if by_split else None)
        storage.mkdirs(spark, posixpath.dirname(out) or ".")
        if storage.exists(spark, out):
            raise FileExistsError(f"output directory already exists: {out}")
        storage.rename(spark, running, out)
    except TooManyColumns as e:
        kept = {staging, running} if keep_records else {staging}
        raise TooManyColumns(f"{e}; the parsed records are kept at {staging} (see tabulate_records)") from e
    finally:
        for path in {staging, running} - kept:  # nothing else outlives the job
            if storage.exists(spark, path):
                storage.delete(spark, path)

    def final(path: str) -> str:
        return out + path[len(running):]

    return ParseResult(out, {n: final(p) for n, p in res.tables.items()}, final(res.rejects), res.headers, counts,
                       final(staging) if keep_records else None)


def tabulate_records(spark: SparkSession, staged: DataFrame, out: str, base: str, ext: str = ".log",
                     parsers: Sequence[LogParser] = DEFAULT_PARSERS, writer: Writer = write_tsv,
                     keep_keys: bool = False, preserve_order: bool = True, single_file: bool = False,
                     max_columns: int | None = None, sort_partitions: int | None = None,
                     staged_by_split: str | None = None) -> ParseResult:
    """Stages 2-4 over narrow records already stored (by ``parse_logs`` or a
    streaming sink): discover headers, write one table per grammar and the
    rejects under ``out``.  ``preserve_order`` needs the rows' whole order
    key, which both stores have.

    ``staged_by_split`` is the path of records whose files hold one source
    split each; their outputs need no sort.  Tables of the default writer are
    rendered straight from the records (``logtab.sinks.sparse``); any other
    ``writer`` gets the wide table, sorted."""
    if preserve_order and "_src_row" not in staged.columns:
        raise ValueError("the records have no order within a split (_src_row): pass preserve_order=False")
    hdrs = headers(staged, parsers, max_columns)
    if keep_keys:
        keys = [(p, i, k) for p, ks in hdrs.items() for i, k in enumerate(ks, start=1)]
        (spark.createDataFrame(keys, "parser string, position int, key string")
         .coalesce(1).write.parquet(posixpath.join(out, ".keys")))

    files = split_order(staged) if preserve_order and staged_by_split else None
    order = []
    placed = None if files is None else with_runs(staged, files) if single_file else with_split(staged)
    place = [RUN, PLACE, ROW] if single_file else [SPLIT, ROW]
    if preserve_order:
        # reserved names, so a log key such as ``_src_row`` cannot collide
        # with the order key in the wide table
        present = [c for c in ORDER_COLS if c in staged.columns]
        order = [f"__logtab{c}" for c in present]
        for c, o in zip(present, order):
            staged = staged.withColumnRenamed(c, o)
    tables = {}
    for p in parsers:
        path = posixpath.join(out, f"{base}.{p.name}.tsv")
        tables[p.name] = path
        if writer is not write_tsv:
            # sorted while narrow: the wide projection stands above the shuffle
            table = tabularize(_sorted(staged, p, order, sort_partitions), p, hdrs[p.name])
            writer(table.coalesce(1) if single_file else table, path)
            continue

        def lines(rows: DataFrame, keep: Sequence[str] = (), p: LogParser = p) -> DataFrame:
            return render(rows, p, hdrs[p.name], keep)

        ours = None if placed is None else lines(placed.where(F.col("parser") == p.name).select(*place, p.name), place)
        _write_lines(spark, ours, lines(_sorted(staged, p, order, sort_partitions)), path, header_line(hdrs[p.name]), files,
                     staged_by_split, ".csv", single_file)

    na_path = posixpath.join(out, f"{base}.{REJECT}{ext}")
    ours = None if placed is None else rejects(placed, keep=place)
    _write_lines(spark, ours, in_order(rejects(staged, keep=order), order, sort_partitions), na_path, None, files,
                 staged_by_split, ".txt", single_file)
    return ParseResult(out, tables, na_path, hdrs)


def _sorted(staged: DataFrame, parser: LogParser, order: Sequence[str], partitions: int | None) -> DataFrame:
    return in_order(staged.where(F.col("parser") == parser.name).select(*order, "parser", parser.name), order, partitions)


def _write_lines(spark: SparkSession, by_split: DataFrame | None, in_sorted_order: DataFrame, path: str, head: str | None,
                 files: dict[str, str] | None, staged: str | None, suffix: str, single: bool) -> None:
    """Write one output: a part per split where the records have kept them,
    else a part per sorted range.  Parts are made beside ``path`` first."""
    parts, making = None, f"{path}.making"
    if by_split is not None:
        with contextlib.nullcontext() if single else one_split_per_task(spark, [staged]):
            parts = write_parts(by_split, making, head, files, heads=not single)
        if parts is None:
            storage.delete(spark, making)
    if parts is None:
        parts = write_parts(in_sorted_order, making, head, None, heads=not single)
    publish(spark, parts, path, head, suffix, single)
    storage.delete(spark, making)


def without_bounds(narrow: DataFrame) -> dict[str, str]:
    """Writer options: no least and greatest parameter key and value, which
    nothing reads and which would cost two comparisons for each."""
    paths = [f"{KEYS}.list.element", *[f"{g}.params.key_value.{n}" for g in grammar_columns(narrow) for n in ("key", "value")]]
    return {f"parquet.column.statistics.enabled#{path}": "false" for path in paths}


def stage(narrow: DataFrame, path: str | None = None) -> DataFrame:
    """Write narrow records once as Parquet (default: a new folder under the
    session's checkpoint directory) and return them read back.

    Use before running several jobs over the same records (header discovery,
    then wide tables): each then reads Parquet instead of re-parsing, and a
    lost executor costs a re-read rather than a re-parse.  The raw line is
    not staged (rejects keep their stripped text); a ``_param_keys`` column
    with each row's parameter keys is added, which ``headers`` reads instead
    of the maps.  The copy stays until ``storage.release``.
    """
    spark = narrow.sparkSession
    path = path or storage.scratch_dir(spark, "logtab-stage")
    if grammar_columns(narrow):
        narrow = narrow.withColumn(KEYS, param_keys(narrow))
    narrow.drop("value").write.mode("errorifexists").options(**without_bounds(narrow)).parquet(path)
    return spark.read.parquet(path)


def narrow_records(spark: SparkSession, src: str | Sequence[str], **kw) -> DataFrame:
    """The narrow form straight from files, for ad-hoc analysis without writing."""
    natural = kw.pop("natural_order", False)
    return parse(read_lines(spark, src, natural_order=natural), **kw)
