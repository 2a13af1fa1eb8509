"""Library surface: custom grammars, header discovery, sinks, streaming."""

import os

import pytest
from pyspark.sql import functions as F

from base_helpers import SF

CP_LINE = 'Nov 28 11:39:51 10.0.0.1 +01:00 10.0.0.2 '


def _df(spark, lines):
    return spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "id int, value string")


def test_python_parser_declines_and_accepts(spark):
    from logtab import CP, HW, PythonLogParser, UnparsableLogError, parse

    def kv(line):
        if not line.startswith("kv "):
            raise UnparsableLogError(line)
        return dict(p.split("=", 1) for p in line[3:].split())

    n = parse(_df(spark, ["kv a=1 b=2", "nothing", CP_LINE + 'x="1"']), parsers=[HW, CP, PythonLogParser("kv", kv)])
    got = {r.id: (r.parser, r.kv and r.kv.params) for r in n.collect()}
    assert got[0] == ("kv", {"a": "1", "b": "2"})
    assert got[1] == ("na", None)
    assert got[2][0] == "cp"


def test_regex_parser_with_date(spark):
    from logtab import RegexParser, parse, records

    p = RegexParser("app", r"(?dU)^(\w+) (\d+) (\d\d):(\d\d):(\d\d) app\[(\d+)\]: (.*)$\n?", ["pid"],
                    pair_pattern=r"(?dU)(\w+)=(\S*)", date_groups=(1, 2, 3, 4, 5))
    r = records(parse(_df(spark, ["Mar 3 01:02:03 app[42]: user=bob ip=1.2.3.4"]), parsers=[p]), p).collect()[0]
    assert (r._a_timestamp, r._b_datetime, r.pid) == ("20200303010203", "2020-03-03 01:02:03", "42")
    assert r.params == {"user": "bob", "ip": "1.2.3.4"}


def test_duplicate_parser_names_rejected(spark):
    from logtab import HW, parse

    with pytest.raises(ValueError, match="duplicate"):
        parse(_df(spark, ["x"]), parsers=[HW, HW])
    from logtab import PythonLogParser
    with pytest.raises(ValueError, match="identifiers"):
        parse(_df(spark, ["x"]), parsers=[PythonLogParser("a.b", lambda s: {})])


def test_headers_exclude_empty_key_and_sort(spark):
    from logtab import CP, headers, parse

    n = parse(_df(spark, [CP_LINE + '="x" b="1" _z="2" A="3" a="4"']), parsers=[CP])
    assert headers(n, [CP])["cp"] == ["_a_timestamp", "_b_datetime", "_c_interface_1", "_d_interface_2", "_z",
                                       "A", "a", "b"]


def test_max_columns(spark):
    from logtab import CP, TooManyColumns, headers, parse

    line = CP_LINE + " ".join(f'k{i}="{i}"' for i in range(20))
    with pytest.raises(TooManyColumns):
        headers(parse(_df(spark, [line]), parsers=[CP]), [CP], max_columns=10)


def test_parquet_sink_dedupes_case(spark, tmp_dir):
    from logtab import CP, parse, tabularize, write_parquet

    wide = tabularize(parse(_df(spark, [CP_LINE + 'Src="1" src="2"']), parsers=[CP]), CP)
    path = os.path.join(tmp_dir, "p")
    write_parquet(wide, path)
    cols = spark.read.parquet(path).columns
    assert "Src" in cols and "src__2" in cols


def test_observation_counts(spark):
    from pyspark.sql import Observation

    from logtab import parse

    obs = Observation("t")
    parse(_df(spark, [CP_LINE + 'a="1"', "junk", ""]), observation=obs).write.format("noop").mode("overwrite").save()
    assert obs.get == {"hw": 0, "cp": 1, "na": 2}


def test_parse_starts_no_job(spark):
    from logtab import parse

    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("quiet", "")
    lines = _df(spark, ["x"]).repartition(3).orderBy("value")
    parse(lines)
    assert not tracker.getJobIdsForGroup("quiet")
    assert parse(_df(spark, ["x"]).coalesce(1), min_partitions=4).rdd.getNumPartitions() == 4
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_params_of_named_grammars(spark):
    from logtab import CP, HW, parse

    lines = _df(spark, [CP_LINE + 'a="1"'])
    plan = parse(lines, params=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
    assert parse(lines, params=[CP]).first().cp.params == {"a": "1"}
    assert parse(lines, params=["hw"]).first().cp.params is None
    with pytest.raises(ValueError):
        parse(lines, parsers=[CP], params=[HW])


def test_wide_fill_loses_nothing(spark):
    from logtab import CP, parse, tabularize

    long_key, long_value = "k" * 60_000, "v" * 21_000_000
    line = CP_LINE + f'{long_key}="1" _corrupt_record="2" a="3" A="4" big="{long_value}"'
    n = parse(_df(spark, [line]), parsers=[CP])
    row = tabularize(n, CP, header=[*CP.base_names, long_key, "_corrupt_record", "a", "A", "big"]).first()
    assert row[long_key] == "1" and row["_corrupt_record"] == "2" and row["a"] == "3" and row["A"] == "4"
    assert row["big"] == long_value


def test_shared_slots_are_looked_up(spark):
    from logtab import CP, parse
    from logtab.operators import tabularize as tb

    n = parse(_df(spark, [CP_LINE + 'a="1" b="2" c="3"']), parsers=[CP])
    cols, filled = tb.wide_columns(CP, ["a", "b", "c"], ["x", "x", *tb.slot_names(spark, ["c"])], record="cp")
    assert list(n.withColumn(tb.WIDE, filled).selectExpr(*cols).first()) == ["1", "2", "3"]


def test_new_keys(spark):
    from logtab import CP, parse, tabularize

    n = parse(_df(spark, [CP_LINE + 'a="1" n="2"', CP_LINE + 'a="3"']), parsers=[CP])
    header = [*CP.base_names, "a"]
    with pytest.raises(Exception, match="keys outside the header: n"):
        tabularize(n, CP, header, new_keys="fail").collect()
    rows = tabularize(n, CP, header, new_keys="keep").collect()
    assert sorted((r.a, r._extra) for r in rows) == [("1", '{"n":"2"}'), ("3", None)]
    assert "_extra" not in tabularize(n, CP, header).columns


def test_python_keys_stay_as_returned(spark):
    from logtab import PythonLogParser, parse

    raw = PythonLogParser("raw", lambda line: {" a": "1", "a": "2", " b ": "3"})
    assert parse(_df(spark, ["x"]), parsers=[raw]).first().raw.params == {" a": "1", "a": "2", " b ": "3"}


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    from logtab.plans import storage

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.scratch_dir(Session())


def test_order_of_records_without_rows_is_refused(spark, tmp_dir):
    from logtab import parse
    from logtab.plans.tabulate import tabulate_records

    n = parse(_df(spark, ["junk"])).withColumn("_src_file", F.lit("f"))
    with pytest.raises(ValueError, match="preserve_order"):
        tabulate_records(spark, n, os.path.join(tmp_dir, "o"), "s")


def test_natural_key(spark):
    from logtab.sources.lines import natural_key

    names = ["chunk_3.hw.log", "chunk_12", "a7.log.gz", "x_2.tar.gz"]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(natural_key(F.col("n"))).collect()] == [3, 12, 7, 2]


def test_filter_on_parser_not_pushed_into_regexes(spark):
    from logtab import parse, records

    n = parse(_df(spark, ["x"]))
    for df in (records(n, "hw"), records(n, "hw").where(F.map_contains_key("params", F.lit("a")))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        # filters stay above the parse: each grammar's regexes appear once
        assert plan.count("regexp_extract_all") <= 6 and plan.count("regexp_replace") <= 4


def test_stream_records_and_tables(spark, tmp_dir):
    from logtab import headers, parse
    from logtab.plans.fixtures import render_lines, table
    from logtab.sinks.tsv import read_tsv, write_lines
    from logtab.streaming.stream import parse_stream, start_records_sink, start_table_sink

    lines = render_lines(table(spark, SF, "events"))
    src = os.path.join(tmp_dir, "src")
    write_lines(lines.repartition(3), src)
    store = os.path.join(tmp_dir, "store")
    q = start_records_sink(parse_stream(spark, src), store, trigger={"availableNow": True})
    q.awaitTermination()
    counts = dict(spark.read.parquet(store).groupBy("parser").count().collect())
    assert counts == {"hw": 700, "cp": 200, "na": 100}

    hdrs = headers(parse(lines))
    out = os.path.join(tmp_dir, "tables")
    q = start_table_sink(parse_stream(spark, src), out, hdrs, base="s", trigger={"availableNow": True})
    q.awaitTermination()
    cp = read_tsv(spark, os.path.join(out, "s.cp.tsv"))
    assert cp.count() == 200 and cp.columns[:2] == ["_a_timestamp", "_b_datetime"]


def test_tabulate_records_from_store(spark, tmp_dir):
    from logtab.plans.fixtures import render_lines, table
    from logtab.plans.tabulate import tabulate_records
    from logtab.sinks.tsv import write_lines
    from logtab.streaming.stream import parse_stream, start_records_sink

    src = os.path.join(tmp_dir, "src")
    write_lines(render_lines(table(spark, SF, "events")).repartition(2), src)
    store = os.path.join(tmp_dir, "store")
    start_records_sink(parse_stream(spark, src), store, trigger={"availableNow": True}).awaitTermination()
    res = tabulate_records(spark, spark.read.parquet(store), os.path.join(tmp_dir, "out"), "s")
    assert res.headers["cp"][-3:] == ["Action", "Note", "UserId"]
    assert spark.read.text(res.rejects).count() == 100


def test_parse_one(spark):
    from logtab import parse_one

    p, rec = parse_one(spark, CP_LINE + 'a="1"')
    assert p == "cp" and rec["params"] == {"a": "1"} and rec["_c_interface_1"] == "10.0.0.1"
    assert parse_one(spark, "  nope ") == ("na", {"value": "nope"})


def test_read_tsv_pandas_na_tokens(spark, tmp_dir):
    from logtab import PANDAS_NA_VALUES, read_tsv, write_tsv

    df = spark.createDataFrame([("NA", "x"), ("null", "n/a"), ("ok", "")], "a string, b string")
    path = os.path.join(tmp_dir, "na.tsv")
    write_tsv(df, path)
    got = {tuple(r) for r in read_tsv(spark, path, na_values=PANDAS_NA_VALUES).collect()}
    assert got == {(None, "x"), (None, None), ("ok", None)}


def test_cli_accepts_process_flags(spark, tmp_dir):
    from logtab.plans.cli import main

    src = os.path.join(tmp_dir, "a.log")
    with open(src, "w") as f:
        f.write('Nov 28 11:39:51 10.0.0.1 +01:00 10.0.0.2 a="1"\n')
    out = os.path.join(tmp_dir, "o")
    assert main([src, "-o", out, "-p", "2", "-t", "1", "-c", "1048576", "--no-order"]) == 0
    assert sorted(os.listdir(out)) == ["a.cp.tsv", "a.hw.tsv", "a.na.log"]


def test_wide_table_exact_keys_and_values(spark):
    from logtab import CP, headers, parse, tabularize

    pairs = ['Src="1"', 'src="2"', 'a.b="dot"', 'q\\"k="3"', 'sp ace="4"', 'ü="ß"', 'bs\\x="back\\slash"',
             'uni=" x\u0001"', '="empty"']
    line = CP_LINE + " ".join(pairs)
    n = parse(_df(spark, [line, CP_LINE + 'Src="only"']), parsers=[CP])
    h = headers(n, [CP])["cp"]
    assert "" not in h and {"Src", "src", "a.b", 'q\\"k', "sp ace", "ü", "bs\\x", "uni"} <= set(h)
    rows = {r.id: r for r in tabularize(n, CP, h, keep=["id"]).collect()}
    r0, r1 = rows[0].asDict(), rows[1].asDict()
    assert (r0["Src"], r0["src"], r0["a.b"], r0['q\\"k'], r0["sp ace"]) == ("1", "2", "dot", "3", "4")
    assert (r0["ü"], r0["bs\\x"], r0["uni"]) == ("ß", "back\\slash", " x\u0001")
    assert r1["Src"] == "only" and r1["src"] is None and r1["a.b"] is None


def test_configure_respects_user_setting(spark):
    from logtab import configure

    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, "12345")
        configure(spark)
        assert spark.conf.get(key) == "12345"
        spark.conf.unset(key)
        configure(spark)
        assert spark.conf.get(key) == "8000"
    finally:
        spark.conf.unset(key)
        if before is not None:
            spark.conf.set(key, before)


def test_parse_without_params(spark):
    from logtab import CP, parse, records

    n = parse(_df(spark, [CP_LINE + 'a="1"', "junk"]), params=False)
    plan = records(n, CP)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
    r = records(n, CP).collect()[0]
    assert r._c_interface_1 == "10.0.0.1" and r.params is None
    assert [x.parser for x in n.orderBy("id").collect()] == ["cp", "na"]


def test_read_tsv_na_tokens_odd_names(spark, tmp_dir):
    from logtab import PANDAS_NA_VALUES, read_tsv, write_tsv

    df = spark.createDataFrame([("NA", "x")], "`we``ird` string, `a.b` string")
    path = os.path.join(tmp_dir, "odd.tsv")
    write_tsv(df, path)
    back = read_tsv(spark, path, na_values=PANDAS_NA_VALUES)
    assert back.columns == ["we`ird", "a.b"] and [tuple(r) for r in back.collect()] == [(None, "x")]


def test_staged_keys_cover_custom_grammars(spark):
    from logtab import CP, HW, PythonLogParser, headers, parse, stage

    def kv(line):
        return dict(p.split("=", 1) for p in line[3:].split()) if line.startswith("kv ") else None

    junk = PythonLogParser("kv", kv)
    n = parse(_df(spark, ["kv z=1 y=2", CP_LINE + 'a="1"']), parsers=[HW, CP, junk])
    staged = stage(n)
    assert "_param_keys" in staged.columns
    h = headers(staged, [HW, CP, junk])
    assert h["kv"] == ["y", "z"] and h["cp"][-1] == "a"
    plan = staged.select("parser", "_param_keys")._jdf.queryExecution().optimizedPlan().toString()
    assert "params" not in plan
