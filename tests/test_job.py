"""End-to-end job and file-level invariants."""

import csv
import glob
import os

import pytest
from pyspark.sql import functions as F

from base_helpers import SF


def _log_file(spark, tmp_dir, name="central.log", newline="\n"):
    from logtab.plans.fixtures import render_lines, table

    rows = render_lines(table(spark, SF, "events")).orderBy("eid").collect()
    path = os.path.join(tmp_dir, name)
    with open(path, "w", newline="") as f:
        for r in rows:
            f.write(r.value + newline)
    return path, rows


def _read_parts(path, pattern="part-*"):
    out = []
    for p in sorted(glob.glob(os.path.join(path, pattern))):
        with open(p, newline="", encoding="utf-8") as f:
            out.append(f.read())
    return out


def _tsv_rows(path):
    header, rows = None, []
    for text in _read_parts(path, "part-*.csv"):
        recs = list(csv.reader(text.splitlines(), delimiter="\t", quotechar='"'))
        if recs:
            header = header or recs[0]
            assert recs[0] == header
            rows.extend(recs[1:])
    return header, rows


def test_parse_logs_layout_and_contents(spark, tmp_dir):
    from logtab import parse_logs

    src, rows = _log_file(spark, tmp_dir)
    out = os.path.join(tmp_dir, "out")
    res = parse_logs(spark, src, out=out, single_file=True)
    assert sorted(os.listdir(out)) == ["central.cp.tsv", "central.hw.tsv", "central.na.log"]
    n_hw = sum(1 for r in rows if r.eid % 10 < 7)
    n_cp = sum(1 for r in rows if r.eid % 10 in (7, 8))
    assert res.counts == {"hw": n_hw, "cp": n_cp, "na": len(rows) - n_hw - n_cp}

    header, hw = _tsv_rows(res.tables["hw"])
    assert header == ["_a_timestamp", "_b_datetime", "_c_interface_1", "_d_interface_2", "_e_event_name",
                      "_f_event_brace_round", "_g_event_brace_square",
                      "evt", "Kind", "Policy", "Src User", "user", "value", "vsys"]
    assert len(hw) == n_hw
    # source order: the square brace carries the event id on '=' lines
    ids = [int(r[6]) for r in hw if r[6]]
    assert ids == sorted(ids)
    raw = _read_parts(res.tables["hw"], "part-*.csv")[0].splitlines()
    assert raw[0].startswith('"_a_timestamp"\t"_b_datetime"')  # header quoted too
    assert '\t""\t' in raw[1] or '\t""\t' in raw[-1]  # nulls written as ""

    header, cp = _tsv_rows(res.tables["cp"])
    assert header == ["_a_timestamp", "_b_datetime", "_c_interface_1", "_d_interface_2", "Action", "Note", "UserId"]
    assert len(cp) == n_cp

    na = "".join(_read_parts(res.rejects)).splitlines()
    assert na == [r.value.strip() for r in rows if r.eid % 10 == 9]


def test_refuses_existing_output(spark, tmp_dir):
    from logtab import parse_logs

    src, _ = _log_file(spark, tmp_dir)
    with pytest.raises(FileExistsError):
        parse_logs(spark, src, out=tmp_dir)


def test_missing_source(spark, tmp_dir):
    from logtab import parse_logs

    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        parse_logs(spark, os.path.join(tmp_dir, "nope.log"), out=os.path.join(tmp_dir, "o"))


def test_empty_grammar_still_gets_header(spark, tmp_dir):
    from logtab import parse_logs

    src = os.path.join(tmp_dir, "only_cp.log")
    with open(src, "w") as f:
        f.write('Nov 28 11:39:51 10.0.0.1 +01:00 10.0.0.2 a="1"\n\n')
    res = parse_logs(spark, src, out=os.path.join(tmp_dir, "o"), single_file=True)
    header, rows = _tsv_rows(res.tables["hw"])
    assert header[:2] == ["_a_timestamp", "_b_datetime"] and rows == []
    assert "".join(_read_parts(res.rejects)).splitlines() == [""]


def test_many_splits_keep_order(spark, tmp_dir):
    from logtab import parse_logs

    src, rows = _log_file(spark, tmp_dir)
    prev = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        res = parse_logs(spark, src, out=os.path.join(tmp_dir, "o"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", prev)
    na = "".join(_read_parts(res.rejects)).splitlines()
    assert na == [r.value.strip() for r in rows if r.eid % 10 == 9]
    _, cp = _tsv_rows(res.tables["cp"])
    assert [r[3] for r in cp] == [f"192.168.0.{r.eid % 256}" for r in rows if r.eid % 10 in (7, 8)]


def test_mixed_line_endings(spark, tmp_dir):
    from logtab import read_lines

    path = os.path.join(tmp_dir, "crlf.log")
    with open(path, "wb") as f:
        f.write(b"a\rb\r\nc\n\nd")
    got = [r.value for r in read_lines(spark, path).orderBy("_src_block", "_src_row").collect()]
    assert got == ["a", "b", "c", "", "d"]


def test_natural_order_of_files(spark, tmp_dir):
    from logtab import number_lines, read_lines

    d = os.path.join(tmp_dir, "chunks")
    os.makedirs(d)
    for n in (1, 2, 10, 11):
        with open(os.path.join(d, f"chunk_{n}.log"), "w") as f:
            f.write(f"line {n}a\nline {n}b\n")
    df = number_lines(read_lines(spark, os.path.join(d, "*.log"), natural_order=True))
    got = [r.value for r in df.orderBy("line_no").collect()]
    assert got == ["line 1a", "line 1b", "line 2a", "line 2b", "line 10a", "line 10b", "line 11a", "line 11b"]


def test_natural_order_query_writes_by_many_tasks(spark, tmp_dir, monkeypatch):
    from logtab.plans import queries
    from logtab.plans.fixtures import render_lines

    events = spark.range(2500).select(
        F.col("id").alias("event_id"), F.lit("2020-03-01 10:00:00").cast("timestamp").alias("ts"), F.col("id").alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(1.5).alias("value"), F.lit('{"k": 3}').alias("props"))
    events.write.parquet(os.path.join(tmp_dir, "events.parquet"))
    read, made = queries.read_lines, []
    monkeypatch.setattr(queries, "read_lines", lambda s, path, **kw: (made.extend(queries.storage.list_files(s, path)), read(s, path, **kw))[1])
    ranged = []
    monkeypatch.setattr(queries, "_task_and_number", lambda path, was=queries._task_and_number: (ranged.append(was(path)[0]), was(path))[1])
    got = [(r.pos, r.value) for r in queries.natural_order(spark, tmp_dir).orderBy("pos").collect()]
    want = render_lines(events).orderBy(F.col("eid") % 997, "eid").collect()
    assert got == list(enumerate((r.value for r in want), start=1))
    names = sorted(int(os.path.basename(f)[len("lines-c"):-len(".txt")]) for f in made)
    assert len(set(ranged)) > 1 and names == list(range(len(names))) and len(names) > 1000


def test_natural_order_requires_numbered_names(spark, tmp_dir):
    from logtab import read_lines

    p = os.path.join(tmp_dir, "plain.log")
    with open(p, "w") as f:
        f.write("x\n")
    with pytest.raises(Exception, match="no numeric id"):
        read_lines(spark, p, natural_order=True).collect()


def test_tsv_roundtrip_hostile_values(spark, tmp_dir):
    from logtab import read_tsv, write_tsv

    vals = ["  padded  ", 'quote " inside', "back\\slash", '\\"', "#hash", "tab\tin", "", None, "nl\u0085x"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, `a b.c=` string")
    path = os.path.join(tmp_dir, "t.tsv")
    write_tsv(df, path)
    back = {int(r["i"]): r["a b.c="] for r in read_tsv(spark, path).collect()}
    expect = {i: (v if v != "" else None) for i, v in enumerate(vals)}
    assert back == expect


def test_keep_records(spark, tmp_dir):
    from logtab import parse_logs

    src, rows = _log_file(spark, tmp_dir)
    out = os.path.join(tmp_dir, "o")
    res = parse_logs(spark, src, out=out, keep_records=True)
    staged = spark.read.parquet(res.records)
    assert staged.count() == len(rows)
    keys = spark.read.parquet(os.path.join(out, ".keys"))
    assert keys.where("parser = 'cp'").orderBy("position").select("key").collect()[-1].key == "UserId"


def test_cli(spark, tmp_dir):
    from logtab.plans.cli import main

    src, _ = _log_file(spark, tmp_dir)
    out = os.path.join(tmp_dir, "cli_out")
    assert main([src, "-o", out, "--single-file"]) == 0
    assert sorted(os.listdir(out)) == ["central.cp.tsv", "central.hw.tsv", "central.na.log"]


def test_number_lines_many_partitions(spark, tmp_dir):
    from logtab import number_lines, read_lines

    path = os.path.join(tmp_dir, "n.log")
    with open(path, "w") as f:
        for i in range(5000):
            f.write(f"line {i} " + "x" * (i % 37) + "\n")
    prev = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = number_lines(read_lines(spark, path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", prev)
    got = sorted((r.line_no, r.value) for r in rows)
    assert [n for n, _ in got] == list(range(1, 5001))
    assert all(v.startswith(f"line {n - 1} ") for n, v in got)


def test_unicode_separators_stay_inside_a_line(spark, tmp_dir):
    from logtab import parse, read_lines

    path = os.path.join(tmp_dir, "u.log")
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write('Nov 28 11:39:51 10.0.0.1 +01:00 10.0.0.2 a="x y" b="\u0085"\n')
        f.write("Nov 28 11:39:51 FW %%01X:k=v w.\n")
    rows = parse(read_lines(spark, path)).orderBy("_src_row").collect()
    assert [r.parser for r in rows] == ["cp", "hw"]
    assert rows[0].cp.params == {"a": "x y", "b": "\u0085"}
    assert rows[1].hw.params == {"k": "v w"}


def test_stage_then_tabulate(spark, tmp_dir):
    from logtab import CP, headers, parse, read_lines, stage, tabularize

    src, rows = _log_file(spark, tmp_dir)
    staged = stage(parse(read_lines(spark, src)))
    assert "value" not in staged.columns
    h = headers(staged)
    assert tabularize(staged, CP, h["cp"]).count() == sum(1 for r in rows if r.eid % 10 in (7, 8))


def test_gzip_source(spark, tmp_dir):
    import gzip

    from logtab import parse_logs

    _, rows = _log_file(spark, tmp_dir)
    src = os.path.join(tmp_dir, "central.log.gz")
    with gzip.open(src, "wt", newline="") as f:
        for r in rows:
            f.write(r.value + "\n")
    res = parse_logs(spark, src, out=os.path.join(tmp_dir, "gz"))
    assert sorted(os.listdir(res.out_dir)) == ["central.cp.tsv", "central.hw.tsv", "central.na.log"]
    assert res.counts["cp"] == sum(1 for r in rows if r.eid % 10 in (7, 8))
    na = "".join(_read_parts(res.rejects)).splitlines()
    assert na == [r.value.strip() for r in rows if r.eid % 10 == 9]


def test_empty_grammar_header_multi_part(spark, tmp_dir):
    from logtab import parse_logs

    src = os.path.join(tmp_dir, "only_na.log")
    with open(src, "w") as f:
        f.write("nothing to see\n")
    res = parse_logs(spark, src, out=os.path.join(tmp_dir, "o"))
    for name in ("hw", "cp"):
        header, rows = _tsv_rows(res.tables[name])
        assert header[:2] == ["_a_timestamp", "_b_datetime"] and rows == []


def test_case_twin_keys_written_to_tsv(spark, tmp_dir):
    from logtab import parse_logs

    src = os.path.join(tmp_dir, "twins.log")
    with open(src, "w") as f:
        f.write('Nov 28 11:39:51 10.0.0.1 +01:00 10.0.0.2 Src="1" src="2"\n')
    res = parse_logs(spark, src, out=os.path.join(tmp_dir, "o"))
    header, rows = _tsv_rows(res.tables["cp"])
    assert header[-2:] == ["Src", "src"] and rows[0][-2:] == ["1", "2"]


def test_sorted_narrow_then_widened(spark, tmp_dir):
    from logtab import parse_logs

    src = os.path.join(tmp_dir, "w.log")
    with open(src, "w") as f:
        for i in range(50):
            f.write(f'Nov 28 11:39:51 10.0.0.1 +01:00 10.0.0.2 k{i}="{i}"\n')
    plans = []

    def writer(df, path):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        df.write.parquet(path)

    parse_logs(spark, src, out=os.path.join(tmp_dir, "o"), writer=writer)
    wide = plans[-1]
    assert wide.index("from_json") < wide.index("Sort [")  # the fill stands above the sort


def test_column_limit_keeps_the_records(spark, tmp_dir):
    from logtab import TooManyColumns, parse_logs

    src = os.path.join(tmp_dir, "w.log")
    with open(src, "w") as f:
        f.write("Nov 28 11:39:51 10.0.0.1 +01:00 10.0.0.2 " + " ".join(f'k{i}="{i}"' for i in range(20)) + "\n")
    with pytest.raises(TooManyColumns) as e:
        parse_logs(spark, src, out=os.path.join(tmp_dir, "o"), max_columns=10)
    kept = str(e.value).split("kept at ")[1].split(" (")[0]
    assert spark.read.parquet(kept).count() == 1


def test_glob_source_gets_neutral_names(spark, tmp_dir):
    from logtab import parse_logs

    d = os.path.join(tmp_dir, "many")
    os.makedirs(d)
    for n in (1, 2):
        with open(os.path.join(d, f"fw{n}.log"), "w") as f:
            f.write(f'Nov 28 11:39:5{n} 10.0.0.1 +01:00 10.0.0.2 a="{n}"\n')
    res = parse_logs(spark, os.path.join(d, "*.log"))
    assert os.path.basename(res.out_dir).startswith("logs_") and os.path.dirname(res.out_dir) == d
    assert sorted(os.listdir(res.out_dir)) == ["logs.cp.tsv", "logs.hw.tsv", "logs.na.log"]
    assert res.counts["cp"] == 2


def test_bad_date_fails_the_job(spark, tmp_dir):
    from logtab import parse_logs

    src = os.path.join(tmp_dir, "bad.log")
    with open(src, "w") as f:
        f.write('Nov 28 11:39:51 10.0.0.1 +01:00 10.0.0.2 a="1"\n')
        f.write('Feb 30 00:00:00 10.0.0.1 +01:00 10.0.0.2 a="2"\n')
    out = os.path.join(tmp_dir, "o")
    with pytest.raises(Exception, match="impossible date"):
        parse_logs(spark, src, out=out)
    assert not os.path.exists(os.path.join(out, "bad.cp.tsv"))
    res = parse_logs(spark, src, out=os.path.join(tmp_dir, "o2"), on_bad_date="reject")
    assert res.counts == {"hw": 0, "cp": 1, "na": 1}


def test_utf8_bom_is_skipped(spark, tmp_dir):
    from logtab import parse, read_lines

    path = os.path.join(tmp_dir, "bom.log")
    with open(path, "wb") as f:
        f.write(b'\xef\xbb\xbfNov 28 11:39:51 10.0.0.1 +01:00 10.0.0.2 a="1"\nx\n')
    rows = parse(read_lines(spark, path)).orderBy("_src_row").collect()
    assert [r.parser for r in rows] == ["cp", "na"]


def test_log_key_named_like_order_column(spark, tmp_dir):
    from logtab import parse_logs

    src = os.path.join(tmp_dir, "k.log")
    with open(src, "w") as f:
        f.write('Nov 28 11:39:51 10.0.0.1 +01:00 10.0.0.2 _src_row="7" _src_file="x"\n')
    res = parse_logs(spark, src, out=os.path.join(tmp_dir, "o"))
    header, rows = _tsv_rows(res.tables["cp"])
    assert "_src_row" in header and rows[0][header.index("_src_row")] == "7"


def test_natural_key_with_compression_suffix(spark):
    from pyspark.sql import functions as F

    from logtab import natural_key

    names = ["chunk_1.log", "chunk_12.log.gz", "app.log.3.bz2", "x7", "fw_10.log.zst"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.k for r in df.select(natural_key(F.col("n")).alias("k")).collect()]
    assert got == [1, 12, 3, 7, 10]
