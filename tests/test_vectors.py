"""Lines with the results that the two grammars' descriptions give by hand.

None of the library's patterns is used here: each expectation is written
out, so a wrong pattern cannot agree with itself.
"""

import pytest

HW = "Mar  4 05:06:07 "
CP = "Mar  4 05:06:07 10.9.8.7 +01:00 192.168.1.2 "


def hw(if1, if2, event, rnd=None, square=None, **params):
    return "hw", (if1, if2, event, rnd, square), {k.replace("__", " "): v for k, v in params.items()}


VECTORS = [
    # header: optional tokens before the mark
    (HW + "FW-1 %%EV:", hw(None, "FW-1", "EV")),
    (HW + "10.0.0.1 FW-1 %%EV:", hw("10.0.0.1", "FW-1", "EV")),
    (HW + "10.0.0.1 %%EV:", hw(None, "10.0.0.1", "EV")),  # a lone dotted token is the second interface
    (HW + "2020-01-02 03:04:05 FW-1 %%EV:", hw(None, "FW-1", "EV")),
    (HW + "10.0.0.1 2020-01-02 03:04:05 FW-1 %%EV(l)[7]:", hw("10.0.0.1", "FW-1", "EV", "l", "7")),
    (HW + "FW-1 %%EV[7]:", hw(None, "FW-1", "EV", None, "7")),
    (HW + "FW-1 %%EV(a)(b):", hw(None, "FW-1", "EV", "a)(b")),  # round braces are greedy
    # = pairs end at a comma, at a final stop or at a final bracket
    (HW + "FW-1 %%EV:a=1, b=2,c=3.", hw(None, "FW-1", "EV", a="1", b="2", c="3")),
    (HW + 'FW-1 %%EV:a="1 2", b="x".', hw(None, "FW-1", "EV", a="1 2", b="x")),
    (HW + "FW-1 %%EV:text (a=1, b=2)", hw(None, "FW-1", "EV", a="1", b="2")),
    (HW + "FW-1 %%EV:a=1, b=2", hw(None, "FW-1", "EV", a="1")),  # nothing ends the last one
    (HW + "FW-1 %%EV:a=1, a=2,", hw(None, "FW-1", "EV", a="2")),  # the last value stays
    # : pairs end at a semicolon and win over = pairs
    (HW + "FW-1 %%EV:A b:1; C:2;", hw(None, "FW-1", "EV", A__b="1", C="2")),
    (HW + "FW-1 %%EV:a=1, ; a:2;", hw(None, "FW-1", "EV", a="2")),
    (HW + 'FW-1 %%EV:A:"x, y";', hw(None, "FW-1", "EV", A="x, y")),
    (HW + "FW-1 %%EV: plain words only", hw(None, "FW-1", "EV")),
    # not this grammar
    ("Mar  4 05:06 FW-1 %%EV:", None),
    (HW + "FW-1 %EV:", None),
    (HW + "FW-1 %%E V:", None),
    (HW + "%%EV:", None),
    ("  " + HW + "FW-1 %%EV:", None),
    # cp
    (CP + 'a="1" b:="2 3" c d="4"', ("cp", ("10.9.8.7", "192.168.1.2"), {"a": "1", "b": "2 3", "c d": "4"})),
    (CP + 'a="1" a="2"', ("cp", ("10.9.8.7", "192.168.1.2"), {"a": "2"})),
    (CP + 'a=1 b="2"', ("cp", ("10.9.8.7", "192.168.1.2"), {"a=1 b": "2"})),
    (CP + 'a="1"b="2"', ("cp", ("10.9.8.7", "192.168.1.2"), {"a": "1"})),  # a name follows a quote and a blank
    (CP + '="x" a=""', ("cp", ("10.9.8.7", "192.168.1.2"), {"": "x", "a": ""})),
    (CP + "words", ("cp", ("10.9.8.7", "192.168.1.2"), {})),
    (CP.replace("+01:00", "01:00") + 'a="1"', None),
    (CP.replace("192.168.1.2", "host") + 'a="1"', None),
]


def test_vectors(spark):
    from logtab import parse

    lines = [(i, v[0]) for i, v in enumerate(VECTORS)]
    got = {r.i: r for r in parse(spark.createDataFrame(lines, "i int, value string")).collect()}
    for i, (line, want) in enumerate(VECTORS):
        r = got[i]
        if want is None:
            assert (r.parser, r.reject) == ("na", line.strip()), line
            continue
        name, fields, params = want
        assert r.parser == name, line
        record = r[name].asDict()
        assert record.pop("params") == params, line
        assert str(record.pop("_a_timestamp")) == "20200304050607" and record.pop("_b_datetime") == "2020-03-04 05:06:07"
        assert tuple(record.values()) == fields, line


@pytest.mark.parametrize("line", ["", " ", "\t\x0b", "\u00a0x\u00a0"])
def test_rejects_are_stripped(spark, line):
    from logtab import parse_one

    assert parse_one(spark, line) == ("na", {"value": line.strip()})
