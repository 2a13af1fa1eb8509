"""Golden lines: hand-written inputs with expectations derived from the grammar."""

import pytest

from base_helpers import one

H = "Nov 28 11:39:51 10.0.0.1 +01:00 10.0.0.2 "  # cp header


def test_hw_full_header(spark):
    p, r = one(spark, "Nov 28 11:39:51 10.0.0.1 2020-11-28 11:39:50 FW-A %%01SEC/4/PERMIT(l)[123]:vsys=public, proto=6.")
    assert p == "hw"
    assert r["_a_timestamp"] == 20201128113951
    assert r["_b_datetime"] == "2020-11-28 11:39:51"
    assert (r["_c_interface_1"], r["_d_interface_2"]) == ("10.0.0.1", "FW-A")
    assert (r["_e_event_name"], r["_f_event_brace_round"], r["_g_event_brace_square"]) == ("01SEC/4/PERMIT", "l", "123")
    assert r["params"] == {"vsys": "public", "proto": "6"}


def test_hw_padded_day_and_optional_groups(spark):
    p, r = one(spark, "Nov  8 11:39:51 FW-A %%01SEC/4/PERMIT:vsys=public.")
    assert p == "hw" and r["_b_datetime"] == "2020-11-08 11:39:51"
    assert r["_c_interface_1"] is None and r["_f_event_brace_round"] is None and r["_g_event_brace_square"] is None


def test_hw_single_dotted_token_goes_to_interface_2(spark):
    p, r = one(spark, "Nov 28 11:39:51 10.0.0.1 %%01SHELL/5/CMD(s):x")
    assert p == "hw" and r["_c_interface_1"] is None and r["_d_interface_2"] == "10.0.0.1"
    assert r["params"] == {}


def test_hw_greedy_round_brace(spark):
    p, r = one(spark, "Nov 28 11:39:51 FW %%01X(l)[0]:a(b)[c]:z=1.")
    assert p == "hw"
    assert (r["_f_event_brace_round"], r["_g_event_brace_square"]) == ("l)[0]:a(b", "c")
    assert r["params"] == {"z": "1"}


@pytest.mark.parametrize("line", [
    "Nov 28 11:39:51 FW %%01X(l) [7]:a=1.",
    "Nov   8 11:39:51 FW %%01X:a=1.",
    "Nov 28 11:39:51 FW  %%01X:a=1.",
    "",
])
def test_not_matching(spark, line):
    assert one(spark, line) == ("na", line.strip())


def test_reject_is_stripped(spark):
    assert one(spark, "\t junk \t\x1c") == ("na", "junk")


def test_cp_pairs_last_wins(spark):
    p, r = one(spark, H + 'act="ok" a b:="" a="1" a="2"')
    assert p == "cp" and r["_a_timestamp"] == "20201128113951"
    assert r["params"] == {"act": "ok", "a b": "", "a": "2"}


def test_cp_keys_stripped(spark):
    assert one(spark, H + '  k="v"  z="w"')[1]["params"] == {"k": "v", "z": "w"}


def test_cp_empty_key_kept_in_map(spark):
    assert one(spark, H + '="x" b="y"')[1]["params"] == {"": "x", "b": "y"}


def test_param_overrides_base_field(spark):
    from logtab import CP, parse, tabularize

    df = spark.createDataFrame([(H + '_c_interface_1="9.9.9.9"',)], "value string")
    wide = tabularize(parse(df), CP).collect()[0].asDict()
    assert wide["_c_interface_1"] == "9.9.9.9" and wide["_d_interface_2"] == "10.0.0.2"


def test_padded_twin_of_base_field_wins(spark):
    # ' _c_interface_1' (two blanks before it) is inserted after the base
    # field '_c_interface_1', so after stripping it wins even though the exact
    # key is assigned later in the text
    from logtab import CP, parse, tabularize

    df = spark.createDataFrame([(H + 'a="0"  _c_interface_1="y" _c_interface_1="x"',)], "value string")
    wide = tabularize(parse(df), CP).collect()[0].asDict()
    assert wide["_c_interface_1"] == "y"


def test_unicode_whitespace_and_separators(spark):
    p, r = one(spark, H + 'a="1"  b="2"\u0085')
    assert p == "cp"
    assert r["params"]["a"] == "1"


@pytest.mark.parametrize("params,expected", [
    ("a=1, tail=2", {"a": "1"}),
    ("(a=1, b=2).", {"a": "1", "b": "2)"}),
    ("Login(user=a, ip=b)", {"user": "a", "ip": "b"}),
    ("v=1.5.", {"v": "1.5"}),
    ('a="x,y", b==c.', {"a": "x", "b": "=c"}),
    ("Policy:p1; Src IP:1.1.1.1; Tail:x", {"Policy": "p1", "Src IP": "1.1.1.1"}),
    ("foo;bar:baz;", {"foo;bar": "baz"}),
    ("[x]Key:v;", {"Key": "v"}),
    ("t:12:30:00;", {"t": "12:30:00"}),
    ("a:1; :v;", {"a": "1", "": "v"}),
    (":v;", {}),
    ("foo [x]bar:1;", {"foo [x]bar": "1"}),
    ("a=1,;a:2;", {"a": "2"}),
    ("a=1, a:2;", {"a": "1"}),
])
def test_hw_pairs(spark, params, expected):
    p, r = one(spark, "Nov 28 11:39:51 FW %%01X:" + params)
    assert p == "hw"
    assert r["params"] == expected


def test_key_strip_collision_later_position_wins(spark):
    # 'a' first (value 3 after update), ' a' second: after strip the later one wins
    p, r = one(spark, "Nov 28 11:39:51 FW %%01X:a:1; a:2;a:3;")
    assert r["params"] == {"a": "2"}


@pytest.mark.parametrize("stamp", ["Feb 30 00:00:00", "Nov 0 11:39:51", "Nov 008 11:39:51", "Nov 28 24:00:00",
                                   "Nov 28 11:39:60", "Sept 3 11:39:51", "November 8 11:39:51", "Nov 32 11:00:00"])
def test_bad_dates(spark, stamp):
    line = stamp + ' 10.0.0.1 +01:00 10.0.0.2 a="1"'
    assert one(spark, line, on_bad_date="reject")[0] == "na"
    p, r = one(spark, line, on_bad_date="null")
    assert p == "cp" and r["_b_datetime"] is None and r["_a_timestamp"] is None
    with pytest.raises(Exception, match="impossible date"):
        one(spark, line)


def test_good_date_forms(spark):
    for stamp, iso in [("nov 08 11:39:51", "2020-11-08 11:39:51"), ("FEB 29 00:00:00", "2020-02-29 00:00:00"),
                       ("Dec  1 23:59:59", "2020-12-01 23:59:59")]:
        p, r = one(spark, stamp + ' 10.0.0.1 +01:00 10.0.0.2 a="1"')
        assert p == "cp" and r["_b_datetime"] == iso


def test_leap_day_depends_on_year(spark):
    line = 'Feb 29 00:00:00 10.0.0.1 +01:00 10.0.0.2 a="1"'
    assert one(spark, line, year=2020)[1]["_b_datetime"] == "2020-02-29 00:00:00"
    assert one(spark, line, year=2021, on_bad_date="reject")[0] == "na"


def test_unicode_digits_in_stamp(spark):
    p, r = one(spark, 'Nov 2٨ 11:39:51 10.0.0.1 +01:00 10.0.0.2 a="1"')
    assert p == "cp" and r["_b_datetime"] == "2020-11-28 11:39:51"


def test_key_holding_the_internal_separator(spark):
    # the fast strip joins keys with U+0001; such a key must take the exact path
    p, r = one(spark, H + 'a\x01b="1" c="2"  a\x01b="3"')
    assert p == "cp" and r["params"] == {"a\x01b": "3", "c": "2"}
