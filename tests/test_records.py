"""Records with line breaks read by many tasks, charsets, the routing index,
and a parse as one expression."""

import csv
import os
import random
import time

import pytest
from pyspark.sql import functions as F

CP_LINE = "Nov 28 11:39:51 10.0.0.1 +01:00 10.0.0.2 "


@pytest.fixture
def tiny_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _write(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, delimiter="\t", quotechar='"', quoting=csv.QUOTE_ALL, lineterminator=end)
        w.writerows(rows)
    return path


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_line_breaks_over_many_splits(spark, tmp_dir, tiny_splits, end):
    from logtab import read_tsv

    rng = random.Random(4)
    pieces = ["a", "\n", '"', "\r\n", "\r", "\t", " ", "é", "\n\n", '""', "x" * 150, "\n" * 220, ",", "#", "\\"]
    rows = [[str(i), "".join(rng.choices(pieces, k=rng.randrange(6))), "".join(rng.choices(pieces, k=2))] for i in range(300)]
    files = [_write(os.path.join(tmp_dir, f"f{k}.csv"), [["n", "one", "two"], *rows[k::3]], end) for k in range(3)]
    df = read_tsv(spark, files, split_files=True)
    assert df.columns == ["n", "one", "two"]
    got = {r.n: (r.one, r.two) for r in df.collect()}
    assert got == {n: (a or None, b or None) for n, a, b in rows}
    whole = {tuple(r) for r in read_tsv(spark, files, split_files=False).collect()} if end == "\n" else None
    assert whole is None or whole == {(n, *v) for n, v in got.items()}


def test_lines_are_read_by_many_tasks(spark, tmp_dir, tiny_splits):
    from logtab.sources.records import quoted_records

    path = _write(os.path.join(tmp_dir, "f.csv"), [["n"], *[[f"{i}\n{i}"] for i in range(400)]])
    assert spark.read.text(path).rdd.getNumPartitions() > 10
    records = quoted_records(spark, path)
    got = sorted(r.value for r in records.where("not is_first").collect())
    assert got == sorted(f'"{i}\n{i}"' for i in range(400))
    assert [r.value for r in records.where("is_first").collect()] == ['"n"']


def test_large_files_are_split_by_default(spark, tmp_dir, tiny_splits):
    from logtab import read_tsv

    path = _write(os.path.join(tmp_dir, "f.csv"), [["n", "v"], *[[str(i), "a\nb"] for i in range(100)]])
    df = read_tsv(spark, path, infer_schema=True)
    assert df.schema["n"].dataType.simpleString() == "bigint" and df.where("v = 'a\nb'").count() == 100
    assert "logtab-lines" in str(df.inputFiles())


def test_empty_and_header_only_files(spark, tmp_dir):
    from logtab import read_tsv

    path = _write(os.path.join(tmp_dir, "f.csv"), [["n", "v"]])
    assert read_tsv(spark, path, split_files=True).collect() == []
    path = _write(os.path.join(tmp_dir, "g.csv"), [["n", "v"], ["1", "open\nend"]])
    with open(path, "rb+") as f:  # without its last line feed
        f.truncate(os.path.getsize(path) - 1)
    assert [tuple(r) for r in read_tsv(spark, path, split_files=True).collect()] == [("1", "open\nend")]


def test_partition_columns_stay(spark, tmp_dir):
    from logtab import read_tsv

    for b in (0, 1):
        os.makedirs(os.path.join(tmp_dir, "t", f"batch={b}"))
        _write(os.path.join(tmp_dir, "t", f"batch={b}", "f.csv"), [["n", "v"], [str(b), "x\ny"]])
    df = read_tsv(spark, os.path.join(tmp_dir, "t"), split_files=True)
    assert df.columns == ["n", "v", "batch"] and sorted(tuple(r) for r in df.collect()) == [("0", "x\ny", 0), ("1", "x\ny", 1)]


# --- charsets -------------------------------------------------------------------

def _bytes(path, data):
    with open(path, "wb") as f:
        f.write(data)
    return path


@pytest.mark.parametrize("charset", ["latin-1", "windows-1252", "iso8859-15", "koi8-r", "us-ascii", "utf-8"])
def test_every_character_of_a_charset(spark, tmp_dir, charset):
    from logtab import read_lines

    codes = [bytes([b]) for b in range(0x20, 0x100)]
    chars = [c.decode(charset, "replace") for c in codes] if charset != "utf-8" else ["é", "中", "😀", "ß"]
    data = b"\n".join(codes if charset != "utf-8" else [c.encode() for c in chars])
    path = _bytes(os.path.join(tmp_dir, "a.log"), data)
    got = [r.value for r in read_lines(spark, path, encoding=charset).orderBy("_src_row").collect()]
    assert got == chars
    marked = read_lines(spark, path, encoding=charset, on_bad_bytes="mark").orderBy("_src_row").collect()
    assert [r._src_bad for r in marked] == [c == "�" for c in chars]


def test_bad_utf8(spark, tmp_dir):
    from logtab import parse_logs, read_lines

    good, bad = (CP_LINE + 'a="café"').encode(), (CP_LINE + 'a="caf').encode() + b'\xe9"'
    path = _bytes(os.path.join(tmp_dir, "a.log"), good + b"\n" + bad + b"\n")
    with pytest.raises(Exception, match="bytes that are not UTF-8"):
        read_lines(spark, path, on_bad_bytes="fail").collect()
    with pytest.raises(Exception, match="bytes that are not UTF-8"):
        parse_logs(spark, path, out=os.path.join(tmp_dir, "f"), on_bad_bytes="fail")
    res = parse_logs(spark, path, out=os.path.join(tmp_dir, "r"), on_bad_bytes="reject")
    assert res.counts == {"hw": 0, "cp": 1, "na": 1}
    assert [r.value for r in spark.read.text(res.rejects).collect()] == [CP_LINE + 'a="caf�"']
    assert parse_logs(spark, path, out=os.path.join(tmp_dir, "o")).counts["cp"] == 2
    latin = _bytes(os.path.join(tmp_dir, "l.log"), bad)
    table = parse_logs(spark, latin, out=os.path.join(tmp_dir, "l"), encoding="latin-1").tables["cp"]
    assert '"café"' in open(os.path.join(table, "part-00000.csv"), encoding="utf-8").read()


def test_charsets_that_hide_line_ends_are_refused(spark, tmp_dir):
    from logtab import read_lines

    for charset in ("utf-16", "cp037", "shift_jis"):
        with pytest.raises((ValueError, LookupError)):
            read_lines(spark, _bytes(os.path.join(tmp_dir, "a.log"), b"x"), encoding=charset)


# --- many grammars ----------------------------------------------------------------

def _grammars(n, token):
    from logtab import RegexParser

    return [RegexParser(f"g{i}", header=rf"(?d)^(\S+) dev{i} (.*)$\n?", fields=["host"], pair_pattern=r"(?d)(\w+)=(\w+)",
                        token=f"dev{i}" if token else None) for i in range(n)]


def test_index_gives_what_the_plain_loop_gives(spark):
    from logtab import CP, HW, RegexParser, parse

    rng = random.Random(6)
    lines = [rng.choice(["h", " ", "x-"]) + f" dev{rng.randrange(14)} a={i} b=2" for i in range(120)]
    lines += ["dev1", "h dev1x a=1", "h  dev2 a=1", "dev3 dev4 a=1", CP_LINE + 'a="dev1"', "", "nothing"]
    catch = RegexParser("rest", header=r"(?d)^(nothing)()$\n?", fields=["x", "y"])
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    plain = parse(df, parsers=[HW, *_grammars(12, False), CP, catch]).orderBy("i").collect()
    indexed = parse(df, parsers=[HW, *_grammars(12, True), CP, catch]).orderBy("i").collect()
    assert indexed == plain and {r.parser for r in plain} >= {"g1", "g3", "cp", "rest", "na"}


def test_candidates_are_few(spark):
    from logtab import HW, candidate_parsers

    df = spark.createDataFrame([("h dev7 a=1",), ("none",), ("dev1 dev2",)], "value string")
    got = [r[0] for r in df.select(candidate_parsers(F.col("value"), [HW, *_grammars(100, True)])).collect()]
    assert got == [["hw", "g7"], ["hw"], ["hw", "g1", "g2"]]


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_cut_a_line_once(spark):
    from logtab import HW, RegexParser, candidate_parsers

    twin = RegexParser("twin", header=r"(?d)^(\S+)$", fields=["a"], token="dev2")
    df = spark.createDataFrame([("dev2 dev1 dev2",), (None,), ("",)], "value string")
    found = df.select(candidate_parsers(F.col("value"), [twin, *_grammars(100, True), HW]).alias("c"))
    assert [r.c for r in found.collect()] == [["twin", "g1", "g2", "hw"], ["hw"], ["hw"]]
    assert _optimized(found).count("split(") == 1
    assert df.select(candidate_parsers(F.col("value"), [HW])).first()[0] == ["hw"]


def test_tokens_are_checked(spark):
    from logtab import RegexParser, parse

    odd = [RegexParser(f"g{i}", header="^(x)$", fields=["a"], token="a b") for i in range(4)]
    with pytest.raises(ValueError, match="token"):
        parse(spark.createDataFrame([("x",)], "value string"), parsers=odd)


# --- very long keys ---------------------------------------------------------------

ORIGINAL_CP_PAIRS = r'(?dU)((?<=" ).*?):?="(.*?)"'


def test_cp_pairs_are_the_original_pattern_s(spark):
    from logtab.operators.parsers import CP_PAIRS

    rng = random.Random(7)
    texts = ['" ' + "".join(rng.choice('a=":  \n' if i % 2 else '=": k') for _ in range(rng.randrange(24))) for i in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select(*[F.regexp_extract_all("t", F.lit(p), g).alias(f"c{i}") for g in (0, 1, 2)
                        for i, p in enumerate((CP_PAIRS, ORIGINAL_CP_PAIRS))]).collect()
    assert all(tuple(r)[::2] == tuple(r)[1::2] for r in found)


def test_long_keys_are_not_walked_by_slow_patterns(spark):
    from logtab.functions.kv import stripped_keys
    from logtab.operators.parsers import CP_PAIRS

    def seconds(column):
        times = []
        for _ in range(3):
            start = time.perf_counter()
            df.select(column.alias("x")).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        return min(times)

    df = spark.range(0, 1500, 1, 4).select(F.concat(F.lit('" '), F.repeat(F.lit("k"), 60_000), F.lit('="v'), "id", F.lit('"')).alias("t"))
    assert seconds(F.regexp_extract_all("t", F.lit(CP_PAIRS), 1)) < 0.7 * seconds(F.regexp_extract_all("t", F.lit(ORIGINAL_CP_PAIRS), 1))
    long, spaced = "k" * 3000, "\u2003" + "k" * 3000 + " \x1f"
    cases = [[spaced, " a", long], [" a ", "b\t"], [], None, ["a b", "  c"], ["a  b", "", long], ["a ", "b"], ["\u00a0é", "a"], [" "]]
    keys = spark.createDataFrame([(c,) for c in cases], "k array<string>").select(stripped_keys(F.col("k")).alias("s"))
    assert [r.s for r in keys.collect()] == [c if c is None else [k.strip() for k in c] for c in cases]
    assert "lambda" not in _optimized(keys)  # rows of very long values would be copied for one
    # a blank at the end is looked for at each character, its absence is not
    assert seconds(stripped_keys(F.array("t"))) < 0.7 * seconds(stripped_keys(F.array(F.concat("t", F.lit(" ")))))


def _by_length(monkeypatch, bytes_, df, parsers):
    """The parse with texts from this many bytes on read as long ones."""
    from logtab.operators import parsers as grammars, route

    monkeypatch.setattr(grammars, "LONG_TEXT", bytes_)
    route._column_stages.cache_clear()
    n = route.parse(df, parsers=parsers)
    return [r.asDict(recursive=True) for r in n.orderBy("i").collect()]


def test_long_lines_are_read_as_short_ones(spark, monkeypatch):
    from logtab import CP, HW
    from logtab.operators import route
    from logtab.operators.parsers import CP_HEADER, CP_PAIRS

    rng = random.Random(11)
    keys = ["a", "b", " a", "a\u2003", "", "x=y", "c:", "_a_timestamp", "_c_interface_1 ", "\u00e9", "k" * 50, '" q', "\x1f", "\u3000z"]
    ends = ["", "\n", "\n\n", " ", "\u3000", " tail", ' "open', " \nmore", '" odd="1', " last=", "\u00a0\n"]

    def text():
        if rng.random() < 0.3:
            return "".join(rng.choice('a=": \u2003') for _ in range(rng.randrange(20)))
        gaps = [" "] * 9 + ["", "  ", ", "]
        return "".join((rng.choice(gaps) if i else "") + rng.choice(keys) + rng.choice(["=", ":=", "="]) + f'"{rng.choice("vw ")}{i}"'
                       for i in range(rng.randrange(6)))

    heads = ["Jan  1 00:00:0%d 10.1.0.1 +01:00 192.168.0.1 ", "Feb 12 10:00:0%d 10.1.0.1 -01:00 1 ", "Mar 3 01:02:0%d 10.1.0.1 01:00 1 ",
             "Apr  4 04:04:0%d FW-A %%%%01X/4/Y(l)[3]:k=v, ", "\u0001Jan  1 00:00:0%d 10.1.0.1 +01:00 1 "]
    lines = [rng.choice(heads) % rng.randrange(10) + text() + rng.choice(ends) for _ in range(3000)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, value string").repartition(4)
    short = _by_length(monkeypatch, 1 << 30, df, [HW, CP])
    long = _by_length(monkeypatch, 0, df, [HW, CP])
    route._column_stages.cache_clear()
    assert long == short
    # the header's regex, and pairs by the regex alone where they need no more than a dict
    groups = df.select("i", *[F.regexp_extract("value", CP_HEADER, g).alias(f"g{g}") for g in (6, 7, 8)]).orderBy("i").collect()
    texts = spark.createDataFrame([(r.i, '" ' + (r.g8 or "").strip()) for r in groups], "i int, t string")
    found = [list(zip(r.k, r.v)) for r in texts.select("i", F.regexp_extract_all("t", F.lit(CP_PAIRS), 1).alias("k"),
                                                       F.regexp_extract_all("t", F.lit(CP_PAIRS), 2).alias("v")).orderBy("i").collect()]
    cut = 0
    for r, g, pairs in zip(long, groups, found):
        assert (r["parser"] == "cp") == bool(g.g6)
        if g.g6:
            assert (r["cp"]["_c_interface_1"], r["cp"]["_d_interface_2"]) == (g.g6, g.g7)
            record, bare = {}, {}
            for k, v in [(n, None) for n in CP.base_names] + pairs:
                record[k] = v
            for k, v in record.items():
                bare[k.strip()] = v
            assert r["cp"]["params"] == {k: v for k, v in bare.items() if v is not None}
            cut += bool(pairs)
    assert cut > 500


def test_long_texts_are_cut(spark):
    from logtab import CP

    key = "k" * 60_000
    texts = [f'a="1" {key}:="2" rest', f'a="1", {key}="2"', 'a="1"']
    f = F.array(*[F.lit("x")] * 7, "t")
    cut = spark.createDataFrame([(t,) for t in texts], "t string").select(CP.cut(f).alias("c"))
    keys, values = CP.cut_pairs(F.col("c"))
    rows = cut.select(F.col("c").isNotNull().alias("is_cut"), keys.alias("k"), values.alias("v")).collect()
    # whole pairs are found in the pieces; other long texts and short ones are left to the regex
    assert [tuple(r) for r in rows] == [(True, ["a", key], ["1", "2"]), (True, None, None), (False, None, None)]


def test_staged_keys_have_no_bounds(spark, tmp_dir):
    import pyarrow.dataset as ds

    from logtab import CP, headers, parse, stage

    line = 'Jan 12 00:00:00 10.1.0.1 +01:00 192.168.0.1 b="1" ' + "k" * 5000 + '="2"'
    staged = stage(parse(spark.createDataFrame([(line,)], "value string").coalesce(1)), f"{tmp_dir}/s")
    group = next(ds.dataset(f"{tmp_dir}/s", format="parquet").get_fragments()).metadata.row_group(0)
    bounds = {(c := group.column(i)).path_in_schema: c.is_stats_set for i in range(group.num_columns)}
    assert bounds["parser"] and not bounds["_param_keys.list.element"] and not bounds["cp.params.key_value.key"]
    assert headers(staged, [CP])["cp"] == [*CP.base_names, "b", "k" * 5000]


# --- one expression -----------------------------------------------------------------

@pytest.mark.parametrize("mode", ["null", "reject"])
def test_parse_column_is_the_parse(spark, mode):
    from logtab import CP, HW, RegexParser, parse, parse_column

    lines = [CP_LINE + 'a="1" a ="2" _c_interface_1="x" ="n"', "Nov 28 11:39:51 FW %%01X:k=v, w=2, k=3.", " junk\t", "",
             "Feb 30 00:00:00 10.0.0.1 +01:00 10.0.0.2 z=\"1\"", None, "h dev1 a=1 a=2"]
    grammars = [HW, CP, *_grammars(4, True), RegexParser("d", header=r"^(x)$", fields=["x"])]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    want = parse(df, parsers=grammars, on_bad_date=mode).drop("value").orderBy("i")
    got = df.select("i", parse_column("value", grammars, on_bad_date=mode).alias("p")).select("i", "p.*").orderBy("i")
    assert got.columns == want.columns and got.collect() == want.collect()


def test_parse_column_asks_for_no_types_on_a_line(spark):
    from logtab import parse_column

    plan = _optimized(spark.createDataFrame([("x",)], "value string").select(parse_column("value").alias("p")))
    # an index into a transform would walk its type, all steps of it, on every line
    assert plan.count("element_at(transform(array(") > 5 and "transform(array(" not in plan.replace("element_at(transform(array(", "")


def test_parse_column_in_sql_and_its_limits(spark):
    from logtab import PythonLogParser, parse_column

    df = spark.createDataFrame([(CP_LINE + 'a="1"',), ("x",)], "value string")
    df.select(parse_column(F.col("value")).alias("p")).createOrReplaceTempView("parsed_lines")
    rows = spark.sql("select p.parser, p.cp.params['a'] as a, p.reject from parsed_lines order by a nulls last").collect()
    assert [tuple(r) for r in rows] == [("cp", "1", None), ("na", None, "x")]
    with pytest.raises(ValueError, match="Python"):
        parse_column("value", [PythonLogParser("p", dict)])
    bad = spark.createDataFrame([("Feb 30 00:00:00 10.0.0.1 +01:00 10.0.0.2 a=\"1\"",)], "value string")
    with pytest.raises(Exception, match="impossible date"):
        bad.select(parse_column("value")).collect()
