"""Outputs in source order without a sort, sparse lines, whole runs."""

import os
import random

import pytest
from pyspark.sql import functions as F

CP_LINE = "Nov 28 11:39:51 10.0.0.1 +01:00 10.0.0.2 "


def _narrow(spark, lines, **kw):
    from logtab import parse

    return parse(spark.createDataFrame([(x,) for x in lines], "value string"), **kw)


def _text(path):
    return "".join(open(os.path.join(path, p), newline="", encoding="utf-8").read()
                   for p in sorted(os.listdir(path)) if p.startswith("part-"))


def _hostile_lines(rng):
    keys = ["a", "B", "b", "_x", "_c_interface_1", "k\"q", "é", "中 文", "tab\tkey", "long" * 50, *[f"k{i}" for i in range(60)]]
    values = ["", "v", " padded ", "tab\tin", "back\\slash", "é 中", "x" * 5000, "#c", "''"]
    out = []
    for _ in range(120):
        pairs = [f'{rng.choice(keys)}="{rng.choice(values)}"' for _ in range(rng.choice([0, 1, 3, 30]))]
        out.append(CP_LINE + " ".join(pairs))
    return out


def test_sparse_lines_are_what_the_wide_table_writes(spark, tmp_dir):
    from logtab import CP, HW, headers, tabularize, write_tsv
    from logtab.sinks.sparse import header_line, render

    lines = _hostile_lines(random.Random(5)) + [
        "Nov 28 11:39:51 FW %%01X:k=v, w=, _b_datetime=over.", 'Nov 28 11:39:51 FW %%01X(l)[7]:A:"b";  C:d e; ']
    n = _narrow(spark, lines).cache()
    for p in (CP, HW):
        header = headers(n, [p])[p.name]
        rows = n.where(F.col("parser") == p.name).coalesce(1)
        write_tsv(tabularize(rows, p, header), os.path.join(tmp_dir, p.name))
        got = [r.value for r in render(rows, p, header).collect()]
        assert _text(os.path.join(tmp_dir, p.name)) == "\n".join([header_line(header), *got, ""])


def test_sparse_lines_of_a_python_grammar(spark, tmp_dir):
    from logtab import PythonLogParser, headers, tabularize, write_tsv
    from logtab.sinks.sparse import header_line, render

    p = PythonLogParser("own", lambda line: {"a": line, "nul": None, 'q"': 'x"y"\tz', "": "nameless"})
    n = _narrow(spark, ["one", "two"], parsers=[p]).coalesce(1)
    header = headers(n, [p])["own"]
    write_tsv(tabularize(n, p, header), os.path.join(tmp_dir, "t"))
    got = [r.value for r in render(n, p, header).collect()]
    assert _text(os.path.join(tmp_dir, "t")) == "\n".join([header_line(header), *got, ""])


def _log(path, lines):
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(x + "\n" for x in lines)
    return path


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _many_files(tmp_dir, rng):
    """Files of very different sizes; Spark packs and orders their splits by
    size, not by name."""
    at, paths, lines = 0, [], []
    for f, n in enumerate([400, 1, 90, 3, 700, 0, 30]):
        mine = []
        for _ in range(n):
            mine.append(CP_LINE + f'n="{at}"' if rng.random() < 0.6 else f"junk {at}")
            at += 1
        paths.append(_log(os.path.join(tmp_dir, f"log_{f}.log"), mine))
        lines += mine
    return paths, lines


def test_order_without_a_shuffle(spark, tmp_dir, small_splits, monkeypatch):
    from logtab import parse_logs
    from logtab.plans import tabulate

    paths, lines = _many_files(tmp_dir, random.Random(1))
    plans = []

    def spy(rows, *args, **kw):
        plans.append(rows.sortWithinPartitions(*rows.columns[:1])._jdf.queryExecution().executedPlan().toString())
        return write(rows, *args, **kw)

    write = tabulate.write_parts
    monkeypatch.setattr(tabulate, "write_parts", spy)
    res = parse_logs(spark, paths, out=os.path.join(tmp_dir, "o"))
    assert len(plans) == 3 and not any("Exchange" in p for p in plans)  # no output was sorted again
    parts = [p for p in sorted(os.listdir(res.tables["cp"])) if p.startswith("part-")]
    assert len(parts) > 20
    rows = []
    for p in parts:
        head, *body = open(os.path.join(res.tables["cp"], p)).read().splitlines()
        assert head.endswith('\t"n"') and body
        rows += [int(r.split("\t")[-1].strip('"')) for r in body]
    assert rows == [int(x.split('"')[1]) for x in lines if "n=" in x]
    assert _text(res.rejects).splitlines() == [x for x in lines if x.startswith("junk")]


@pytest.mark.parametrize("options", [{"preserve_order": True}, {"min_partitions": 6}])
def test_single_file_is_joined_in_order(spark, tmp_dir, small_splits, options):
    from logtab import parse_logs

    paths, lines = _many_files(tmp_dir, random.Random(2))
    res = parse_logs(spark, paths, out=os.path.join(tmp_dir, "o"), single_file=True, **options)
    assert os.listdir(res.tables["cp"]) == ["part-00000.csv"] and os.listdir(res.rejects) == ["part-00000.txt"]
    head, *body = _text(res.tables["cp"]).splitlines()
    assert head.endswith('\t"n"')
    got, want = [int(r.split("\t")[-1].strip('"')) for r in body], [int(x.split('"')[1]) for x in lines if "n=" in x]
    rejected, junk = _text(res.rejects).splitlines(), [x for x in lines if x.startswith("junk")]
    if "min_partitions" in options:  # dealt lines are numbered per task: only the content is whole
        got, want, rejected, junk = sorted(got), sorted(want), sorted(rejected), sorted(junk)
    assert got == want and rejected == junk


def test_single_file_takes_few_tasks_and_parts_for_many_splits(spark, tmp_dir, small_splits, monkeypatch):
    from logtab import parse_logs
    from logtab.plans import tabulate
    from logtab.sinks import parts

    monkeypatch.setattr(parts, "TASKS_PER_CORE", 1)
    joined, staged = [], []
    publish, tabulated = tabulate.publish, tabulate.tabulate_records
    monkeypatch.setattr(tabulate, "publish", lambda s, found, *a: (joined.append(len(found)), publish(s, found, *a)))
    monkeypatch.setattr(tabulate, "tabulate_records", lambda s, df, *a, **k: (staged.append(len(df.inputFiles())), tabulated(s, df, *a, **k))[1])
    lines = [CP_LINE + f'n="{i}"' if i % 3 else f"junk {i}" for i in range(30_000)]
    res = parse_logs(spark, _log(os.path.join(tmp_dir, "a.log"), lines), out=os.path.join(tmp_dir, "o"), single_file=True)
    cores = spark.sparkContext.defaultParallelism
    assert staged[0] <= cores and max(joined) <= 2 * cores
    body = _text(res.tables["cp"]).splitlines()[1:]
    assert [int(r.split("\t")[-1].strip('"')) for r in body] == [i for i in range(30_000) if i % 3]
    assert _text(res.rejects).splitlines() == [x for x in lines if x.startswith("junk")]


def test_tasks_with_several_splits_are_sorted_instead(spark, tmp_dir, small_splits, monkeypatch):
    """Should Spark put two splits in a task, no part may hold both."""
    import contextlib

    from logtab import parse_logs
    from logtab.plans import tabulate

    monkeypatch.setattr(tabulate, "one_split_per_task", lambda *_: contextlib.nullcontext())
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        paths, lines = _many_files(tmp_dir, random.Random(3))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
        res = parse_logs(spark, paths, out=os.path.join(tmp_dir, "o"))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert _text(res.rejects).splitlines() == [x for x in lines if x.startswith("junk")]
    for p in os.listdir(res.tables["cp"]):
        if p.startswith("part-"):
            heads = [x for x in open(os.path.join(res.tables["cp"], p)).read().splitlines() if x.startswith('"_a_timestamp"')]
            assert len(heads) <= 1


def test_settings_come_back(spark, tmp_dir, small_splits):
    from logtab import parse_logs

    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    parse_logs(spark, _log(os.path.join(tmp_dir, "a.log"), ["x"]), out=os.path.join(tmp_dir, "o"))
    assert [spark.conf.get(k) for k in keys] == before


def test_failed_run_leaves_nothing_and_can_be_repeated(spark, tmp_dir):
    from logtab import parse_logs

    src = _log(os.path.join(tmp_dir, "bad.log"), [CP_LINE + 'a="1"', 'Feb 30 00:00:00 10.0.0.1 +01:00 10.0.0.2 a="2"'])
    out = os.path.join(tmp_dir, "sub", "o")
    for _ in range(2):
        with pytest.raises(Exception, match="impossible date"):
            parse_logs(spark, src, out=out, keep_records=True)
    assert sorted(os.listdir(tmp_dir)) == ["bad.log"] or os.listdir(os.path.join(tmp_dir, "sub")) == []
    res = parse_logs(spark, src, out=out, keep_records=True, on_bad_date="null")
    assert res.counts["cp"] == 2 and spark.read.parquet(res.records).count() == 2
    assert sorted(x for x in os.listdir(out) if not x.startswith(".")) == ["bad.cp.tsv", "bad.hw.tsv", "bad.na.log"]


def test_failing_writer_leaves_nothing(spark, tmp_dir):
    from logtab import parse_logs

    def writer(df, path):
        df.write.parquet(path)
        raise RuntimeError("disk full")

    src = _log(os.path.join(tmp_dir, "a.log"), [CP_LINE + 'a="1"'])
    with pytest.raises(RuntimeError, match="disk full"):
        parse_logs(spark, src, out=os.path.join(tmp_dir, "o"), writer=writer)
    assert os.listdir(tmp_dir) == ["a.log"]


def test_byte_counts():
    from logtab.sinks.parts import byte_count

    assert [byte_count(x) for x in ("134217728b", "4194304", "16m", "64KB", "1g", " 2k ")] == [
        134217728, 4194304, 16 << 20, 64 << 10, 1 << 30, 2 << 10]


def test_last_value_wins_on_long_lines(spark):
    import time

    from logtab import CP, parse

    def seconds(pairs):
        line = CP_LINE + " ".join(f'k{i % (pairs - 1)}="{i}"' for i in range(pairs))
        df = spark.createDataFrame([(line,)] * 4, "value string")
        start = time.time()
        params = F.col("cp.params")
        rows = parse(df, parsers=[CP]).select(params["k0"].alias("v"), F.map_keys(params).alias("k")).collect()
        assert rows[0].v == str(pairs - 1) and rows[0].k == [f"k{i}" for i in range(pairs - 1)]
        return time.time() - start

    seconds(500)
    assert seconds(12_000) < 10  # a search per key took 17 s for eight such lines


def test_random_last_wins_matches_a_dict(spark):
    from logtab.functions.kv import record_map, with_record_maps

    rng = random.Random(7)
    rows = []
    for i in range(200):
        keys = [rng.choice(["a", " a", "a ", "b", "_a", " b ", "c", "", " "]) for _ in range(rng.randrange(9))]
        rows.append((i, keys, [rng.choice(["1", "2", ""]) for _ in keys]))
    df = spark.createDataFrame(rows, "i int, k array<string>, v array<string>")
    base = ["_a", "_b"]
    both = with_record_maps(df, {"m": (F.col("k"), F.col("v"), base)}).select(
        "i", F.map_entries("m").alias("m"), F.map_entries(record_map(F.col("k"), F.col("v"), base)).alias("x"))
    got = {r.i: r for r in both.collect()}
    for i, keys, values in rows:
        want = dict.fromkeys(base)
        for k, v in zip(keys, values):
            want[k] = v
        stripped = {}
        for k, v in want.items():
            stripped[k.strip()] = v
        expect = [(k, v) for k, v in stripped.items() if v is not None]
        assert [tuple(e) for e in got[i].x] == expect, (keys, values)
        assert dict(tuple(e) for e in got[i].m) == dict(expect)
