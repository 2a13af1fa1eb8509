"""Tab-separated sink and source, and the plain-text reject sink.

The TSV dialect: tab separator, a header row, every field (header included)
in double quotes, an embedded quote doubled, UTF-8, null and empty string
both written as ``""``, values written verbatim (Spark's CSV writer trims
surrounding blanks unless told not to).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtab.plans import storage
from logtab.sources.records import quoted_records

TSV_WRITE_OPTIONS = {
    "sep": "\t",
    "header": "true",
    "quoteAll": "true",
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "encoding": "UTF-8",
    "lineSep": "\n",
}

TSV_READ_OPTIONS = {
    "sep": "\t",
    "header": "true",
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}

# Tokens pandas.read_csv reads as missing by default (its documented
# ``na_values`` list); pass ``na_values=PANDAS_NA_VALUES`` to read_tsv for
# the same behaviour.
PANDAS_NA_VALUES = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# The reader's own limit (20,480 columns) would refuse wider tables.
MAX_COLUMNS = 1 << 20

Writer = Callable[[DataFrame, str], None]


UNITS = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def byte_count(text: str) -> int:
    """Bytes of a Spark size setting (``64m``, ``4194304b``, ``1024``)."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]*)\s*", text).groups()
    return int(number) * UNITS[(unit.lower() or "b")[0]]


def _single(df: DataFrame, single_file: bool) -> DataFrame:
    # coalesce(1) keeps the upstream sort order (no shuffle); only for small outputs
    return df.coalesce(1) if single_file else df


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists", single_file: bool = False,
              **options: str) -> None:
    """Write ``df`` as quoted TSV part files under directory ``path``.

    Each part file starts with the header row, so any part (or the whole
    directory) reads back on its own.
    """
    opts = {**TSV_WRITE_OPTIONS, **options}
    _single(df, single_file).write.mode(mode).options(**opts).csv(path)


def read_tsv(spark: SparkSession, path: str | Sequence[str], infer_schema: bool = False,
             na_values: Sequence[str] = (), max_columns: int = MAX_COLUMNS, multi_line: bool = True,
             split_files: bool | None = None, **options: str) -> DataFrame:
    """Read TSV written by ``write_tsv``; all columns are strings unless
    ``infer_schema``.  ``""`` reads back as null.

    ``na_values`` lists extra tokens to read as null; types are inferred
    after that, so one ``NA`` does not make a numeric column text.  Column
    names are the header's, by position, also where they differ only in
    case.

    Values may hold line breaks.  Spark's own reader then gives each file to
    one task; with ``split_files`` (default: where a file is larger than
    ``spark.sql.files.maxPartitionBytes``) files are read by several tasks and
    records put together from their lines (``logtab.sources.records``), which
    stores the lines once in the scratch folder.  ``multi_line=False`` is for
    tables whose values hold no line breaks.
    """
    opts = {**TSV_READ_OPTIONS, "multiLine": str(bool(multi_line)).lower(), "maxColumns": str(max_columns), **options}
    df = spark.read.options(**opts).csv(path)
    slots = [f"c{i}" for i in range(len(df.columns))]
    named = df.columns
    headed = str(opts.get("header")).lower() == "true"
    # partition columns (``batch=...``) follow the file's own
    own = len([f for f in df.columns if f not in _partitions(df)])
    if headed:
        head = spark.read.options(**{**opts, "header": "false"}).csv(path).first()
        if head is not None:
            named = ["" if n is None else n for n in head[:own]] + df.columns[own:]
    if split_files is None:
        split_files = multi_line and storage.largest_file(spark, path) > byte_count(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    if split_files and multi_line:
        rows = _from_records(spark, path, slots[:own], headed, opts)
    else:
        rows = df
    rows = rows.toDF(*slots)  # positional names, so any header (backticks, case twins) is safe
    if na_values:
        text = {f.name for f in rows.schema.fields if f.dataType.simpleString() == "string"}
        rows = rows.select(*[F.when(~F.col(c).isin(list(na_values)), F.col(c)).alias(c) if c in text else c for c in slots])
    if infer_schema:
        rows = _inferred(rows)
    return rows.toDF(*named)


def _from_records(spark: SparkSession, path: str | Sequence[str], slots: Sequence[str], headed: bool, opts: dict[str, str]) -> DataFrame:
    """The file's own columns as ``slots``, then partition columns."""
    records = quoted_records(spark, path if isinstance(path, str) else list(path), opts["quote"])
    if headed:
        records = records.where("not is_first")
    parsed = F.from_csv("value", ", ".join(f"{s} string" for s in slots), {**opts, "header": "false", "lineSep": "\n"})
    parts = records.columns[2:]
    return records.select(parsed.alias("__row"), *parts).select("__row.*", *parts)


def _partitions(df: DataFrame) -> set[str]:
    """Names of columns that come from ``name=value`` folders."""
    files = df.inputFiles()[:1]
    return {part.partition("=")[0] for f in files for part in f.split("/")[:-1] if "=" in part}


def _inferred(rows: DataFrame) -> DataFrame:
    """String columns cast to bigint, double or boolean where every value
    can be, in one aggregation over the table."""
    kinds = ("bigint", "double", "boolean")
    texts = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "string"]
    if not texts:
        return rows
    tests = [F.count(c).alias(f"{c}_n") for c in texts]
    tests += [F.count(F.col(c).try_cast(k)).alias(f"{c}_{k}") for c in texts for k in kinds]
    found = rows.agg(*tests).first()

    def kind(c: str) -> str:
        if not found[f"{c}_n"]:
            return "string"
        return next((k for k in kinds if found[f"{c}_{k}"] == found[f"{c}_n"]), "string")

    return rows.select(*[F.col(c).cast(kind(c)).alias(c) if c in texts else F.col(c) for c in rows.columns])


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", single_file: bool = False) -> None:
    """Alternative table sink; names equal up to case get a ``__n`` suffix."""
    from logtab.operators.tabularize import dedupe_names
    _single(df.toDF(*dedupe_names(df.columns)), single_file).write.mode(mode).parquet(path)


def write_lines(df: DataFrame, path: str, col: str = "value", mode: str = "errorifexists",
                single_file: bool = False) -> None:
    """One value per line, e.g. the rejected log lines."""
    _single(df.select(F.col(col).alias("value")), single_file).write.mode(mode).text(path)
