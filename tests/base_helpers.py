"""What several test modules of the base library use."""

SF = "/root/testdata/sf0.001"


def one(spark, line, **kw):
    """Parse a single line; return (parser, record dict or reject value)."""
    from logtab import parse

    rows = parse(spark.createDataFrame([(line,)], "value string"), **kw).collect()
    r = rows[0]
    if r.parser == "na":
        return "na", r.reject
    rec = r[r.parser].asDict()
    return r.parser, rec
