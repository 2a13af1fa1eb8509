"""Registered queries: each exercises operators of the library over lines
rendered from the whole ``events`` table (and ``documents`` as noise).

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame whose
columns are aliased to match the SQL in ``logtab.plans.oracle``.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtab.operators.parsers import CP, HW, PythonLogParser, RegexParser, UnparsableLogError
from logtab.operators.route import candidate_parsers, parse, parse_column, records, rejects
from logtab.operators.tabularize import discover_headers, headers, tabularize
from logtab.plans import storage
from logtab.plans.fixtures import (document_lines, render_devices, render_empty_keys, render_hostile_keys, render_lines, render_many_keys,
                                   render_mixed_pairs, table)
from logtab.plans.tabulate import stage
from logtab.sinks.parts import settings
from logtab.sinks.sparse import render
from logtab.sinks.tsv import PANDAS_NA_VALUES, read_tsv, write_lines, write_parquet, write_tsv
from logtab.sources.lines import number_lines, read_lines

Query = Callable[[SparkSession, str], DataFrame]


def _narrow(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    bad = kw.pop("bad_dates", False)
    return parse(render_lines(_events(spark, sf_dir), bad_dates=bad), **kw)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, dealt over all cores: the table is one small file, and
    rendering and parsing are work for each row."""
    return table(spark, sf_dir, "events").repartition(spark.sparkContext.defaultParallelism)


def _staged(spark: SparkSession, sf_dir: str, parser, lines: DataFrame | None = None) -> DataFrame:
    """One grammar's records, parsed once and stored."""
    lines = render_lines(_events(spark, sf_dir)) if lines is None else lines
    return stage(parse(lines, params=[parser]).where(F.col("parser") == parser.name))


def route_counts(spark, sf_dir):
    return _narrow(spark, sf_dir, params=False).groupBy("parser").agg(F.count(F.lit(1)).alias("n"))


def cp_header(spark, sf_dir):
    return records(_narrow(spark, sf_dir, params=False), CP, ["eid"]).select(
        "eid", F.col("_a_timestamp").alias("a_timestamp"), F.col("_b_datetime").alias("b_datetime"),
        F.col("_c_interface_1").alias("if1"), F.col("_d_interface_2").alias("if2"))


def hw_header(spark, sf_dir):
    return records(_narrow(spark, sf_dir, params=False), HW, ["eid"]).select(
        "eid", F.col("_a_timestamp").alias("a_timestamp"), F.col("_b_datetime").alias("b_datetime"),
        F.col("_c_interface_1").alias("if1"), F.col("_d_interface_2").alias("if2"),
        F.col("_e_event_name").alias("name"), F.col("_f_event_brace_round").alias("round"),
        F.col("_g_event_brace_square").alias("square"))


def _params(df: DataFrame, **cols: str) -> DataFrame:
    return df.select("eid", *[F.col("params")[F.lit(k)].alias(a) for a, k in cols.items()])


def hw_params_eq(spark, sf_dir):
    hw = records(_narrow(spark, sf_dir, params=[HW]), HW, ["eid"]).where(F.map_contains_key("params", F.lit("vsys")))
    return _params(hw, vsys="vsys", user="user", value="value", evt="evt")


def hw_params_colon(spark, sf_dir):
    hw = records(_narrow(spark, sf_dir, params=[HW]), HW, ["eid"]).where(F.map_contains_key("params", F.lit("Policy")))
    return _params(hw, policy="Policy", src_user="Src User", kind="Kind")


def cp_params_lastwins(spark, sf_dir):
    return _params(records(_narrow(spark, sf_dir, params=[CP]), CP, ["eid"]), action="Action", userid="UserId", note="Note")


def params_long(spark, sf_dir):
    """Every (key, value) of every parsed line, one pass over the input."""
    n = _narrow(spark, sf_dir).where(F.col("parser") != "na")
    params = F.coalesce(F.col("hw.params"), F.col("cp.params"))
    return n.select("parser", "eid", F.explode(params).alias("key", "val"))


def header_keys(spark, sf_dir):
    return discover_headers(_narrow(spark, sf_dir), [HW, CP])


def hw_wide(spark, sf_dir):
    """Parse once into staged records, discover the header, project wide."""
    return tabularize(_staged(spark, sf_dir, HW), HW, keep=["eid"])


def cp_wide(spark, sf_dir):
    return tabularize(_staged(spark, sf_dir, CP), CP, keep=["eid"])


def rejected_lines(spark, sf_dir):
    return rejects(_narrow(spark, sf_dir, params=False), ["eid"])


def bad_date_null(spark, sf_dir):
    n = _narrow(spark, sf_dir, bad_dates=True, on_bad_date="null", params=False)
    return records(n, CP, ["eid"]).select("eid", F.col("_b_datetime").alias("b_datetime"))


def bad_date_reject(spark, sf_dir):
    n = _narrow(spark, sf_dir, bad_dates=True, on_bad_date="reject", params=False)
    return n.groupBy("parser").agg(F.count(F.lit(1)).alias("n"))


def year_override(spark, sf_dir):
    n = _narrow(spark, sf_dir, year=2024, params=False)
    return records(n, HW, ["eid"]).select("eid", F.col("_b_datetime").alias("b_datetime"))


def tsv_roundtrip(spark, sf_dir):
    path = posixpath.join(storage.scratch_dir(spark, "logtab-q"), "cp.tsv")
    write_tsv(tabularize(_staged(spark, sf_dir, CP), CP, keep=["eid"]), path)
    return read_tsv(spark, path)


def _rendered_file(spark, sf_dir, sort_cols):
    """Write the rendered lines, sorted, as a text dataset; return its path."""
    path = posixpath.join(storage.scratch_dir(spark, "logtab-q"), "lines")
    df = render_lines(table(spark, sf_dir, "events")).orderBy(*sort_cols)
    write_lines(df, path)
    return path


def line_order(spark, sf_dir):
    path = _rendered_file(spark, sf_dir, ["eid"])
    return number_lines(read_lines(spark, path)).select(F.col("line_no").alias("pos"), "value")


def _task_and_number(path: str) -> tuple[int, int]:
    """Task and number in ``part-<task>-<run>-c<number>.txt``."""
    words = posixpath.basename(path).split(".")[0].split("-")
    return int(words[1]), int(words[-1][1:])


def natural_order(spark, sf_dir):
    """Lines read back from numbered files (``...-c000.txt`` and on, over a
    thousand of them but in the smallest table), in the natural order of the
    numbers, which puts ``c999`` before ``c1000``."""
    path = posixpath.join(storage.scratch_dir(spark, "logtab-q"), "lines")
    lines = render_lines(table(spark, sf_dir, "events"))
    per_file = max(1, lines.count() // 1100)
    order = [F.col("eid") % 997, F.col("eid")]
    (lines.repartitionByRange(max(2, spark.sparkContext.defaultParallelism), *order).sortWithinPartitions(*order)
     .select("value").write.option("maxRecordsPerFile", per_file).text(f"{path}.making"))
    storage.mkdirs(spark, path)
    # each task has numbered the files of its own range: number them all
    made = [f for f in storage.list_files(spark, f"{path}.making") if posixpath.basename(f).startswith("part-")]
    for i, made_file in enumerate(sorted(made, key=_task_and_number)):
        storage.rename(spark, made_file, posixpath.join(path, f"lines-c{i:03d}.txt"))
    storage.delete(spark, f"{path}.making")
    return number_lines(read_lines(spark, path, natural_order=True)).select(F.col("line_no").alias("pos"), "value")


def _junk(line: str) -> dict:
    words = line.split()
    if len(words) != 3 or words[0] != "junk":
        raise UnparsableLogError(line)
    return {"id": words[1], "type": words[2]}


def python_parser(spark, sf_dir):
    n = _narrow(spark, sf_dir, parsers=[HW, CP, PythonLogParser("junk", _junk)], params=False)
    return n.groupBy("parser").agg(F.count(F.lit(1)).alias("n"))


def python_parser_records(spark, sf_dir):
    n = _narrow(spark, sf_dir, parsers=[HW, CP, PythonLogParser("junk", _junk)], params=["junk"])
    return records(n, "junk", ["eid"]).select(
        "eid", F.col("params")["id"].alias("id"), F.col("params")["type"].alias("type"))


def union_sources(spark, sf_dir):
    """Two sources with different key sets, tabulated separately and united
    with null fill: ``=``-pair lines in one, ``:``-pair lines in the other."""
    lines = render_lines(_events(spark, sf_dir))
    # complementary halves: together they are the whole table
    a = _staged(spark, sf_dir, HW, lines.where(F.col("eid") % 10 < 5))
    b = _staged(spark, sf_dir, HW, lines.where(F.col("eid") % 10 >= 5))
    return (tabularize(a, HW, keep=["eid"])
            .unionByName(tabularize(b, HW, keep=["eid"]), allowMissingColumns=True))


FWB = RegexParser(
    "fwb",
    header=r"(?d)^(\S+ [ ]?\S+ \S+) FW-B %%([^:]+):(.*)$\n?",
    fields=["stamp", "event"],
    pair_pattern=r'(?d)(?:(?<=; )|(?<=;))([^:;]+):"?(.*?)"?;',
    pair_prefix=";",
    prefilter="FW-B",
)


def multi_parser_precedence(spark, sf_dir):
    n = _narrow(spark, sf_dir, parsers=[FWB, HW, CP], params=False)
    return n.groupBy("parser").agg(F.count(F.lit(1)).alias("n"))


def mixed_route_counts(spark, sf_dir):
    """Log lines mixed with the ``documents`` prose split into lines."""
    events = render_lines(table(spark, sf_dir, "events")).select("value")
    docs = document_lines(table(spark, sf_dir, "documents")).select("value")
    return parse(events.unionByName(docs), params=False).groupBy("parser").agg(F.count(F.lit(1)).alias("n"))


def _stream_source(spark, sf_dir) -> tuple[str, str]:
    """Rendered lines written as several text files for a file stream."""
    root = storage.scratch_dir(spark, "logtab-stream")
    src = posixpath.join(root, "src")
    write_lines(render_lines(table(spark, sf_dir, "events")).repartition(4), src)
    return root, src


def stream_route_counts(spark, sf_dir):
    """Parse a file stream into a narrow records store, then count routes."""
    from logtab.streaming.stream import parse_stream, start_records_sink

    root, src = _stream_source(spark, sf_dir)
    store = posixpath.join(root, "records")
    q = start_records_sink(parse_stream(spark, src), store, checkpoint=posixpath.join(root, "ckpt"),
                           trigger={"availableNow": True})
    q.awaitTermination()
    return spark.read.parquet(store).groupBy("parser").agg(F.count(F.lit(1)).alias("n"))


def stream_cp_table(spark, sf_dir):
    """Wide cp rows written per micro-batch with a header discovered up front."""
    from logtab.operators.tabularize import headers
    from logtab.streaming.stream import parse_stream, start_table_sink

    root, src = _stream_source(spark, sf_dir)
    # the header of an earlier run's store (here: this table's own lines)
    hdrs = {"hw": list(HW.base_names), "cp": headers(_staged(spark, sf_dir, CP), [CP])["cp"]}
    out = posixpath.join(root, "tables")
    q = start_table_sink(parse_stream(spark, src), out, hdrs, base="s", parsers=[CP], checkpoint=posixpath.join(root, "ckpt"),
                         trigger={"availableNow": True})
    q.awaitTermination()
    return read_tsv(spark, posixpath.join(out, "s.cp.tsv")).drop("batch")


def stream_new_keys(spark, sf_dir):
    """Streamed cp rows under a header that lacks a key: it is kept apart."""
    from logtab.streaming.stream import parse_stream, start_table_sink

    root, src = _stream_source(spark, sf_dir)
    out = posixpath.join(root, "tables")
    header = [*CP.base_names, "Action", "UserId"]
    start_table_sink(parse_stream(spark, src), out, {"cp": header}, base="s", parsers=[CP], new_keys="keep",
                     checkpoint=posixpath.join(root, "ckpt"), trigger={"availableNow": True}).awaitTermination()
    return read_tsv(spark, posixpath.join(out, "s.cp.tsv")).drop("batch")


def stream_ordered_rejects(spark, sf_dir):
    """Rejects of a stream's records store, in source order with positions."""
    from logtab.plans.tabulate import tabulate_records
    from logtab.streaming.stream import parse_stream, start_records_sink

    root = storage.scratch_dir(spark, "logtab-stream")
    src, store = _rendered_file(spark, sf_dir, ["eid"]), posixpath.join(root, "records")
    start_records_sink(parse_stream(spark, src), store, checkpoint=posixpath.join(root, "ckpt"),
                       trigger={"availableNow": True}).awaitTermination()
    res = tabulate_records(spark, spark.read.parquet(store), posixpath.join(root, "out"), "s")
    return _positions(spark, res.rejects)


def _positions(spark, path):
    return number_lines(read_lines(spark, path)).select(F.col("line_no").alias("pos"), "value")


def _job_output(spark, sf_dir, **options):
    """Run the whole file job on the rendered lines (one text log under the
    scratch folder) and return its result."""
    from logtab.plans.tabulate import parse_logs

    path = _rendered_file(spark, sf_dir, ["eid"])
    return parse_logs(spark, path, out=posixpath.join(storage.scratch_dir(spark, "logtab-q"), "out"), **options)


def job_rejects_in_order(spark, sf_dir):
    """The reject file's lines with their positions."""
    return _positions(spark, _job_output(spark, sf_dir).rejects)


def kept_records(spark, sf_dir):
    """Narrow records kept by a job, read back."""
    kept = spark.read.parquet(_job_output(spark, sf_dir, keep_records=True).records)
    return kept.where("parser = 'cp'").select(
        F.col("cp.params")["UserId"].alias("userid"), F.col("cp.params")["Note"].alias("note"))


def kept_keys(spark, sf_dir):
    """Key lists kept by a job, read back."""
    return spark.read.parquet(posixpath.join(_job_output(spark, sf_dir, keep_records=True).out_dir, ".keys"))


def parquet_tables(spark, sf_dir):
    """The cp table of a job with another writer."""
    return spark.read.parquet(_job_output(spark, sf_dir, writer=write_parquet).tables["cp"])


def cli_table(spark, sf_dir):
    """The cp table written by the command-line entry point."""
    from logtab.plans.cli import main

    out = posixpath.join(storage.scratch_dir(spark, "logtab-q"), "out")
    src = _rendered_file(spark, sf_dir, ["eid"])
    main([src, "-o", out, "--max-columns", "100"])
    return read_tsv(spark, posixpath.join(out, f"{posixpath.basename(src)}.cp.tsv"))


def pair_kinds_merge(spark, sf_dir):
    """Both pair kinds on one line: the later kind wins a shared key."""
    n = parse(render_mixed_pairs(_events(spark, sf_dir)), params=[HW])
    return _params(records(n, HW, ["eid"]), user="user", mix="mix", end="end")


def param_overrides_base(spark, sf_dir):
    """A parameter named like a base field takes its column."""
    wide = tabularize(_staged(spark, sf_dir, HW, render_mixed_pairs(_events(spark, sf_dir))), HW, keep=["eid"])
    return wide.select("eid", "_d_interface_2", "_e_event_name", "mix")


def empty_keys(spark, sf_dir):
    """A nameless parameter stays in the map, without a column; keys that
    differ only in case stay apart."""
    staged = _staged(spark, sf_dir, CP, render_empty_keys(_events(spark, sf_dir)))
    wide = tabularize(staged, CP, keep=["eid"])
    named = wide.toDF(*[f"{i}_{c}" for i, c in enumerate(wide.columns)])
    nameless = records(staged, CP, ["eid"]).select("eid", F.col("params")[""].alias("nameless"))
    return named.join(nameless, named["0_eid"] == nameless["eid"]).drop("0_eid")


MANY_KEYS = 10_500
LONG_KEY = 60_000


def wide_many_columns(spark, sf_dir):
    """A header without a limit: how many columns, and two of them."""
    staged = _staged(spark, sf_dir, CP, render_many_keys(_events(spark, sf_dir), MANY_KEYS))
    wide = tabularize(staged, CP, keep=["eid"])
    return wide.select("eid", F.lit(len(wide.columns)).alias("n_columns"), F.col("key0").alias("first"), F.col("alt999").alias("other"))


def wide_hostile_keys(spark, sf_dir):
    """A key of 60,000 characters, and one that JSON readers use themselves."""
    staged = _staged(spark, sf_dir, CP, render_hostile_keys(_events(spark, sf_dir), LONG_KEY))
    return tabularize(staged, CP, keep=["eid"]).select("eid", "a", "_corrupt_record", F.col("k" * LONG_KEY).alias("long_key"))


def _padded(line: str) -> dict:
    words = line.split()
    if len(words) != 3 or words[0] != "junk":
        raise UnparsableLogError(line)
    return {" id": words[1], "id": words[2], " both ": None}


def python_parser_raw_keys(spark, sf_dir):
    """A Python grammar's keys stay as returned, blanks included."""
    n = _narrow(spark, sf_dir, parsers=[HW, CP, PythonLogParser("junk", _padded)], params=["junk"])
    return records(n, "junk", ["eid"]).select("eid", F.explode("params").alias("key", "val"))


def _tsv_of(spark, df):
    path = posixpath.join(storage.scratch_dir(spark, "logtab-q"), "t.tsv")
    write_tsv(df, path)
    return path


def tsv_linebreaks(spark, sf_dir):
    """Values with line breaks, quotes and tabs come back whole."""
    e = _events(spark, sf_dir)
    kind = F.col("event_type")
    return read_tsv(spark, _tsv_of(spark, e.select(
        F.col("event_id").cast("string").alias("eid"), F.concat(kind, F.lit('\n"x"\t'), kind).alias("lf"),
        F.concat(kind, F.lit("\r\ny\r")).alias("cr"))))


def tsv_infer_na(spark, sf_dir):
    """Missing-value tokens do not change a column's type."""
    e = _events(spark, sf_dir)
    eid = F.col("event_id")
    return read_tsv(spark, _tsv_of(spark, e.select(
        eid.alias("eid"), F.when(eid % 3 == 0, "NA").otherwise(eid.cast("string")).alias("whole"),
        F.when(eid % 5 == 0, "n/a").otherwise((eid / 2).cast("string")).alias("half"),
        F.when(eid % 7 == 0, "null").otherwise(F.col("event_type")).alias("kind"))), infer_schema=True, na_values=PANDAS_NA_VALUES)


def tsv_case_twins(spark, sf_dir):
    """Columns that differ only in case keep their names and places."""
    e = _events(spark, sf_dir)
    back = read_tsv(spark, _tsv_of(spark, e.select(F.col("event_id").cast("string").alias("Src"), F.col("event_type").alias("src"))))
    return back.toDF(*[f"c{i}_{c}" for i, c in enumerate(back.columns)])


def _in_one_file(spark, path):
    """The single part of an output, line by line."""
    parts = [f for f in storage.list_files(spark, path) if posixpath.basename(f).startswith("part-")]
    if len(parts) != 1:
        raise AssertionError(f"{len(parts)} parts in {path}")
    return _positions(spark, parts[0])


def single_file_rejects(spark, sf_dir):
    """The rejects as one file, joined from the parts of many tasks."""
    with settings(spark, {"spark.sql.files.maxPartitionBytes": "64k"}):
        return _in_one_file(spark, _job_output(spark, sf_dir, single_file=True).rejects)


def single_file_table(spark, sf_dir):
    """The cp table as one file: its header, then its lines in source order."""
    with settings(spark, {"spark.sql.files.maxPartitionBytes": "64k"}):
        return _in_one_file(spark, _job_output(spark, sf_dir, single_file=True).tables["cp"])


def wide_many_columns_tsv(spark, sf_dir):
    """TSV lines of a table of thousands of columns, rendered from each
    record's own entries."""
    staged = _staged(spark, sf_dir, CP, render_many_keys(_events(spark, sf_dir), MANY_KEYS))
    return render(staged, CP, headers(staged, [CP])["cp"], ["eid"]).select("eid", F.md5("value").alias("line_md5"))


def rerun_after_failure(spark, sf_dir):
    """A run that fails on a bad date, then the same output made again."""
    from logtab.plans.tabulate import parse_logs

    root = storage.scratch_dir(spark, "logtab-q")
    src, out = posixpath.join(root, "lines"), posixpath.join(root, "out")
    write_lines(render_lines(_events(spark, sf_dir), bad_dates=True), src)
    try:
        parse_logs(spark, src, out=out, keep_records=True)
        failed = False
    except Exception as e:
        failed = "impossible date" in str(e)
    left = len(storage.list_names(spark, root)) - 1  # beside the lines
    res = parse_logs(spark, src, out=out, keep_records=True, on_bad_date="reject")
    return (spark.read.parquet(res.records).groupBy("parser").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("failed", F.lit(failed)).withColumn("left_behind", F.lit(left)))


def refusals(spark, sf_dir):
    """What the job refuses, next to what it has done: a source that is not
    there, an output that is, two grammars of one name."""
    from logtab.plans.tabulate import parse_logs

    root = storage.scratch_dir(spark, "logtab-q")
    src, out = posixpath.join(root, "lines"), posixpath.join(root, "out")
    write_lines(render_lines(_events(spark, sf_dir)), src)
    parse_logs(spark, src, out=out)
    cases = {"missing source": lambda: read_lines(spark, posixpath.join(root, "absent")).count(),
             "existing output": lambda: parse_logs(spark, src, out=out),
             "duplicate names": lambda: parse(read_lines(spark, src), parsers=[HW, CP, HW])}
    found = []
    for name, attempt in cases.items():
        try:
            attempt()
        except Exception as e:
            found.append((name, type(e).__name__))
    lines = read_lines(spark, src).groupBy().agg(F.count(F.lit(1)).alias("n_lines"))
    return spark.createDataFrame(found, "what string, error string").join(lines)


def tsv_linebreaks_split(spark, sf_dir):
    """One file whose values hold line breaks, read by several tasks."""
    e = _events(spark, sf_dir)
    kind = F.col("event_type")
    path = _tsv_of(spark, e.select(
        F.col("event_id").cast("string").alias("eid"), F.concat(kind, F.lit('\n"x"\t'), kind).alias("lf"),
        F.concat(kind, F.lit("\r\ny\r")).alias("cr")).coalesce(1))
    with settings(spark, {"spark.sql.files.maxPartitionBytes": "32k"}):
        return read_tsv(spark, path, split_files=True)


DEVICES, DEVICE_GRAMMARS = 120, 100


def many_grammars(spark, sf_dir):
    """A hundred grammars over one table: lines per grammar, and how many
    headers were tried on them."""
    grammars = [RegexParser(f"g{i}", header=rf"(?d)^(\S+) dev{i} n=(\d+)$\n?", fields=["user", "n"], token=f"dev{i}")
                for i in range(DEVICE_GRAMMARS)]
    lines = render_devices(_events(spark, sf_dir), DEVICES)
    lines = lines.withColumn("tried", F.size(candidate_parsers(F.col("value"), grammars)))
    return parse(lines, parsers=grammars, params=False).groupBy("parser").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tried").alias("tried"))


def latin1_lines(spark, sf_dir):
    """Lines in ISO 8859-1 with letters beyond ASCII, read back as text."""
    path = posixpath.join(storage.scratch_dir(spark, "logtab-q"), "latin1")
    text = F.concat(F.col("event_type"), F.lit(" é ß ÿ "), F.col("event_id").cast("string"))
    write_lines(table(spark, sf_dir, "events").select(F.encode(text, "ISO-8859-1").cast("string").alias("value")), path)
    return read_lines(spark, path, encoding="ISO-8859-1", on_bad_bytes="fail").select("value")


def bad_bytes_rejected(spark, sf_dir):
    """Lines with a byte that is not UTF-8 go to the rejects, whatever they
    hold."""
    path = posixpath.join(storage.scratch_dir(spark, "logtab-q"), "bytes")
    odd = F.concat(F.encode(F.col("value"), "UTF-8"), F.unhex(F.lit("E9"))).cast("string")
    write_lines(render_lines(_events(spark, sf_dir)).select(F.when(F.col("eid") % 7 == 0, odd).otherwise(F.col("value")).alias("value")), path)
    marked = parse(read_lines(spark, path, on_bad_bytes="mark"), params=False, bad="_src_bad")
    return marked.groupBy("parser", F.col("_src_bad").alias("bad")).agg(F.count(F.lit(1)).alias("n"))


def parse_expression(spark, sf_dir):
    """The whole parse as one expression in a ``select``."""
    p = F.col("p")
    return render_lines(_events(spark, sf_dir)).select("eid", parse_column("value").alias("p")).select(
        "eid", p["parser"].alias("parser"), F.coalesce(p["hw"]["_b_datetime"], p["cp"]["_b_datetime"]).alias("b_datetime"),
        F.coalesce(p["hw"]["params"]["user"], p["hw"]["params"]["Src User"], p["cp"]["params"]["UserId"]).alias("user"),
        p["reject"].alias("reject"))


def job_hw_table(spark, sf_dir):
    """The hw TSV written by ``parse_logs``, read back (all strings)."""
    return read_tsv(spark, _job_output(spark, sf_dir).tables["hw"])


def job_rejects(spark, sf_dir):
    """The reject file written by ``parse_logs``, read back."""
    return spark.read.text(_job_output(spark, sf_dir).rejects)


QUERIES: dict[str, Query] = {
    "route_counts": route_counts,
    "cp_header": cp_header,
    "hw_header": hw_header,
    "hw_params_eq": hw_params_eq,
    "hw_params_colon": hw_params_colon,
    "cp_params_lastwins": cp_params_lastwins,
    "params_long": params_long,
    "header_keys": header_keys,
    "hw_wide": hw_wide,
    "cp_wide": cp_wide,
    "rejects": rejected_lines,
    "bad_date_null": bad_date_null,
    "bad_date_reject": bad_date_reject,
    "year_override": year_override,
    "tsv_roundtrip": tsv_roundtrip,
    "line_order": line_order,
    "natural_order": natural_order,
    "python_parser": python_parser,
    "python_parser_records": python_parser_records,
    "union_sources": union_sources,
    "multi_parser_precedence": multi_parser_precedence,
    "mixed_route_counts": mixed_route_counts,
    "stream_route_counts": stream_route_counts,
    "stream_cp_table": stream_cp_table,
    "job_hw_table": job_hw_table,
    "job_rejects": job_rejects,
} | {f.__name__: f for f in (
    job_rejects_in_order, kept_records, kept_keys, parquet_tables, cli_table, pair_kinds_merge, param_overrides_base,
    empty_keys, wide_many_columns, wide_hostile_keys, python_parser_raw_keys, tsv_linebreaks, tsv_infer_na, tsv_case_twins,
    stream_new_keys, stream_ordered_rejects, single_file_rejects, single_file_table, wide_many_columns_tsv,
    rerun_after_failure, refusals, tsv_linebreaks_split, many_grammars, latin1_lines, bad_bytes_rejected, parse_expression)}
