"""URL filters and chat formatting against SQL and plain Python."""

import re

import duckdb
import pytest

from logtab.llm import chat, urls
from logtab.llm.oracle import SQL
from logtab.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def oracle(name, **tables):
    con = duckdb.connect()
    for t, rows in tables.items():
        con.execute(f"create table {t} ({rows[0]})")
        con.executemany(f"insert into {t} values ({', '.join('?' * (rows[0].count(',') + 1))})", rows[1])
    for t in ("pages", "conversations"):
        if t not in tables:
            con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    return sorted((tuple(map(str, (dict(zip(names, r))[c] for c in sorted(names)))) for r in cur.fetchall()))


def rows_of(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("name", ["op6_urls", "op8_chat"])
def test_given_tables(spark, name):
    out = QUERIES[name](spark, SF)
    assert rows_of(out) == oracle(name) and out.count() > 0
    plan = out._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


URLS = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/x?y", "http://example.com", "http://example.com/en/a", "http://a.b.example.com/en/",
        "http://notexample.com/en/", "https://x.net/es/1#f", "https://x.net/fr/", "https://x.net/de/", "http://h?://other/", "a://b://c.net/es/",
        "http://x.org/wp-admin/x", "http://x.org/WP-ADMIN/x", "http://x.org/login", "http://x.org/loginx", "http://x.org/tag/a/b/page/2",
        "http://x.org/f.exe", "http://x.org/f.exe?x", "http://x.org/docs/wp-admin/", "http://x.org/?a=1&print=1", "http://x.org/?print=12",
        "http://m.a.org/p.html", "http://é.org/É?q=İ", "http://x.org/search?z&q=1\n", "http://x.org/cart/\ncart"]


def test_url_cases(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[7], "h"), (3, URLS[7], None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = urls.filter_urls(df)
    by = {(r.page_id, r.host): r for r in got.collect()}
    assert rows_of(got.drop("n_candidates")) == oracle("op6_urls", pages=("page_id bigint, url varchar, host varchar", rows))
    assert by[0, ""].verdict == "allow" and by[0, ""].rule is None
    assert by[7, "example.com"].rule == "example.com/en/" and by[5, "www.example.com"].rule == "www.example.com/en/"
    assert by[6, "example.com"].rule is None  # no path
    assert by[15, "x.org"].pattern == "/wp-admin/" and by[15, "x.org"].verdict == "block"
    assert by[22, "x.org"].verdict == "allow" and by[22, "x.org"].pattern == "/docs/"
    assert all(r.n_candidates <= 8 for r in by.values())
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_tokens_are_in_every_match():
    for _, p in urls.PATTERN_RULES:
        rx = re.compile(urls.pattern_regex(p).replace(r"\z", r"\Z"))
        for u in URLS:
            low = (u or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            if rx.search(low):
                assert set(urls.pattern_tokens(p)) <= set(re.findall("[a-z0-9]+", low))


def test_rule_without_tokens(spark):
    df = spark.createDataFrame([(1, "http://a.org/xyzzy"), (2, "http://a.org/")], "page_id long, url string")
    got = urls.filter_urls(df, pattern_rules=[("block", "yzz")])
    assert {r.page_id: r.verdict for r in got.collect()} == {1: "block", 2: "allow"}


def make_turns():
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", "é😀"), (1, 3, "ann", None), (1, 3, "ann", None),
            (2, 0, "system", "alone"), (3, None, None, "who"), (3, 5, "ann", ""), (None, 1, "x", "y"), (None, 2, "z", "w")]
    return rows + [(4, i % 7, ["a", "b", "system"][i % 3], f"t{i}") for i in range(700)]


def test_chat_cases(spark):
    rows = make_turns()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = chat.perspectives(df)
    spans = chat.F.transform("spans", lambda s: chat.F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    table = got.withColumn("spans", chat.F.array_join(spans, ","))
    assert rows_of(table) == oracle("op8_chat", conversations=("conv_id bigint, turn bigint, role varchar, text varchar", rows))
    out = {(r.conv_id, r.part, r.speaker): r for r in got.collect()}
    ann = out[1, 0, "ann"]
    assert ann.text == ("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi <| im_end|><|im_end|>\n"
                        "<|im_start|>user name=bob\né😀<|im_end|>\n" + "<|im_start|>assistant\n<|im_end|>\n" * 2)
    assert [ann.text[s.start:s.end] for s in ann.spans] == ["hi <| im_end|><|im_end|>", "<|im_end|>", "<|im_end|>"]
    assert (2, 0, "system") not in out and out[3, 0, "unknown"].n_turns == 2
    assert sum(r.n_turns for k, r in out.items() if k[0] == 4 and k[2] == "a") == 700  # in three parts
    assert chat.perspectives(df.limit(0)).count() == 0


def test_long_dialogues_keep_their_system_turns_and_people(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "system", "more rules"), (1, 2, "early", "hello")]
    rows += [(1, 3 + i, "late", f"t{i}") for i in range(600)] + [(1, 400, "system", "mid")]
    rows += [(None, i, "system", f"s{i}") for i in range(300)] + [(None, 300, "only", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = chat.perspectives(df)
    spans = chat.F.transform("spans", lambda s: chat.F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    table = got.withColumn("spans", chat.F.array_join(spans, ","))
    assert rows_of(table) == oracle("op8_chat", conversations=("conv_id bigint, turn bigint, role varchar, text varchar", rows))
    out = {(r.conv_id, r.part, r.speaker): r for r in got.collect()}
    assert len(out) == 3 * 2 + 2
    for part in (1, 2):
        text = out[1, part, "early"].text
        assert text.startswith("<|im_start|>system\nrules<|im_end|>\n<|im_start|>system\nmore rules<|im_end|>\n<|im_start|>user name=late")
        assert out[1, part, "early"].spans == []
    assert sum(out[1, part, "late"].n_turns for part in range(3)) == 604
    assert out[None, 1, "only"].text.startswith("<|im_start|>system\ns0<|im_end|>")


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, 0, "a", "t", 5, 6)], "conv_id long, turn long, role string, text string, rank long, speaker long")
    assert chat.perspectives(df).count() == 1
