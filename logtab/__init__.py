"""logtab: turn raw firewall log lines into analysable tables with Spark.

Typical use::

    from logtab import parse_logs
    parse_logs(spark, "hdfs:///logs/central.log", out="hdfs:///tables/central")

or, staying in DataFrames::

    from logtab import read_lines, parse, records, tabularize, HW
    narrow = parse(read_lines(spark, path))
    hw = tabularize(narrow, HW)
"""

from logtab.functions.dates import stamp_fields
from logtab.functions.kv import record_map
from logtab.functions.text import strip
from logtab.operators.parsers import (CP, DEFAULT_PARSERS, HW, CpParser, HwParser, LogParser,
                                      PythonLogParser, RegexParser, UnparsableLogError)
from logtab.operators.route import REJECT, candidate_parsers, parse, parse_column, parse_one, records, rejects
from logtab.operators.tabularize import (TooManyColumns, discover_headers, distinct_keys, headers,
                                         tabularize, wide_columns)
from logtab.plans.tabulate import (ParseResult, configure, narrow_records, parse_logs, stage,
                                   tabulate_records)
from logtab.sinks.tsv import PANDAS_NA_VALUES, read_tsv, write_lines, write_parquet, write_tsv
from logtab.sources.lines import ORDER_COLS, in_order, lines, natural_key, number_lines, read_lines

__all__ = [
    "CP", "CpParser", "DEFAULT_PARSERS", "HW", "HwParser", "LogParser", "ORDER_COLS",
    "PANDAS_NA_VALUES", "ParseResult", "PythonLogParser", "REJECT", "RegexParser", "TooManyColumns",
    "UnparsableLogError", "candidate_parsers", "configure", "discover_headers", "distinct_keys", "headers", "in_order", "lines",
    "narrow_records", "natural_key", "number_lines", "parse", "parse_column", "parse_logs", "parse_one",
    "read_lines", "read_tsv", "record_map", "records", "rejects", "stage", "stamp_fields", "strip",
    "tabularize", "tabulate_records", "wide_columns", "write_lines", "write_parquet", "write_tsv",
]
