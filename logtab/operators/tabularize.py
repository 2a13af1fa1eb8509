"""Narrow records → wide tables with a data-dependent header.

The header of a grammar's table is every key seen in any of its records:
the base fields plus the union of parameter names, ``''`` excluded, ordered
with ``_``-prefixed keys first, then case-insensitively (ties broken by the
raw key so the order is deterministic).

Discovery is one small aggregation: keys are exploded and made distinct
with a map-side partial aggregate, so each task ships only its distinct
(parser, key) pairs; only the final key list reaches the driver (with
``max_columns``, the job stops with an error beyond that many), where the
keys are ordered with Python's own string rules.  The wide
table is then a single projection of the map, one column per key, with no
shuffle (``groupBy().pivot()`` would shuffle every row).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtab.operators.parsers import DEFAULT_PARSERS, LogParser
from logtab.operators.route import REJECT

WIDE = "__wide"
EXTRA = "_extra"
NEW_KEY_MODES = ("fail", "keep", "ignore")

# from_json must never null a row quietly: any fault fails the job, no field
# name counts as the reader's own, and strings may have any length.
FILL_OPTIONS = {"mode": "FAILFAST", "columnNameOfCorruptRecord": "__corrupt", "maxStringLen": str(2**31 - 1)}


class TooManyColumns(ValueError):
    pass


def _params(narrow: DataFrame, parsers: Sequence[LogParser | str]) -> Column:
    names = [p if isinstance(p, str) else p.name for p in parsers]
    present = [n for n in names if n in narrow.columns]
    return F.coalesce(*[F.col(n).getField("params") for n in present])


def grammar_columns(narrow: DataFrame) -> list[str]:
    """Names of the per-grammar record columns (structs with a params map)."""
    return [f.name for f in narrow.schema.fields
            if isinstance(f.dataType, T.StructType) and "params" in f.dataType.fieldNames()]


# Staged records carry each row's parameter keys in this column too, so key
# discovery reads a small, dictionary-encoded array instead of whole maps
# (Parquet cannot read a map's keys without its values).
KEYS = "_param_keys"


def param_keys(narrow: DataFrame) -> Column:
    """The row's parameter keys (``map_keys`` of its grammar's params), for
    every grammar column present."""
    return F.map_keys(_params(narrow, grammar_columns(narrow)))


def distinct_keys(narrow: DataFrame, parsers: Sequence[LogParser] = DEFAULT_PARSERS) -> DataFrame:
    """``(parser, key)`` for every non-empty parameter key, distinct (A1/A2)."""
    names = [p.name for p in parsers]
    keys = F.col(KEYS) if KEYS in narrow.columns else F.map_keys(_params(narrow, parsers))
    # as bytes: Spark's map of strings hashes a long key one byte at a time
    return (narrow.where(F.col("parser").isin(names))
            .select("parser", F.explode(keys).alias("key"))
            .where(F.col("key") != "")
            .select("parser", F.col("key").cast("binary")).distinct()
            .select("parser", F.col("key").cast("string")))


def header_order(keys) -> list[str]:
    """Order keys as the original tool does: ``_``-prefixed keys first, then
    case-insensitively (Python ``str.lower``, code-point order); ties broken
    by the raw key so the order is deterministic."""
    return sorted(keys, key=lambda k: (not k.startswith("_"), k.lower(), k))


def headers(narrow: DataFrame, parsers: Sequence[LogParser] = DEFAULT_PARSERS,
            max_columns: int | None = None) -> dict[str, list[str]]:
    """Ordered header per grammar: base fields (always, so an empty table
    still has a header) plus every non-empty parameter key seen.

    Only key names reach the driver: as many as the tables have columns.
    ``max_columns`` guards against data that was no log: the distinct-key job
    then stops at ``len(parsers) * max_columns + 1`` names, which means that
    some grammar has more, and raises ``TooManyColumns``.
    """
    keys = distinct_keys(narrow, parsers)
    cap = None if max_columns is None else len(parsers) * max_columns + 1
    rows = (keys if cap is None else keys.limit(cap)).collect()
    found: dict[str, set[str]] = {p.name: set(p.base_names) for p in parsers}
    for r in rows:
        found[r.parser].add(r.key)
    over = [n for n, ks in found.items() if cap is not None and len(ks) > max_columns]
    if over or (cap is not None and len(rows) >= cap):
        raise TooManyColumns(
            f"{over or 'a grammar'}: more than {max_columns} distinct keys; raise max_columns or use "
            f"the narrow records (parser struct with a params map) instead of a wide table")
    return {name: header_order(ks) for name, ks in found.items()}


def discover_headers(narrow: DataFrame, parsers: Sequence[LogParser] = DEFAULT_PARSERS,
                     max_columns: int | None = None) -> DataFrame:
    """Schema summary ``(parser, position, key)``, position from 1 (G1), as
    a small DataFrame built from ``headers``."""
    rows = [(name, i, k) for name, ks in headers(narrow, parsers, max_columns).items()
            for i, k in enumerate(ks, start=1)]
    return narrow.sparkSession.createDataFrame(rows, "parser string, position int, key string")


def slot_name(key: Column) -> Column:
    """Short name of a key inside the fill: its hash and its bytes, so log text
    never becomes a JSON field name."""
    return F.concat(F.hex(F.xxhash64(key)), F.lit("_"), F.octet_length(key).cast("string"))


def slot_names(spark: SparkSession, keys: Sequence[str]) -> list[str]:
    """``slot_name`` of each key, by Spark itself."""
    if not keys:
        return []
    rows = spark.createDataFrame(list(enumerate(keys)), "i int, key string").select("i", slot_name(F.col("key")).alias("s")).collect()
    return [s for _, s in sorted(rows)]


def quoted(name: str) -> str:
    """A column name in SQL."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """A string in SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def wide_columns(parser: LogParser, header: Sequence[str], slots: Sequence[str], record: str = ""
                 ) -> tuple[list[str], Column | None]:
    """One string column per header key over the flat record columns
    (base fields + ``params``), ``record`` optionally naming the struct
    that holds them.  A parameter overrides a base field of the same name.

    Returns the columns as SQL (for ``selectExpr``: thousands of ``Column``
    objects would take minutes to build) and the expression they read from:
    parameter columns are filled in one pass, by serialising the row's
    (small) map once with ``to_json`` and parsing it with ``from_json`` into
    a struct of all header keys - a hash lookup per key present in the row,
    where looking every header key up in the map would scan the map once per
    column.  Field names are the keys' ``slots`` (see ``slot_name``), values
    may have any length, and a row that cannot be read fails the job.  Keys
    whose slots coincide are looked up in the map instead.  Materialise the
    expression as column ``WIDE`` before selecting the columns.
    """
    cols, packed, filled = _filled(parser, header, slots, record, max(1, len(header)))
    return cols, _unpacked(packed, filled[WIDE]) if filled else None


# Columns of one fill: a caller that selects few columns of a table pays for
# the fills they are in, as Spark prunes the others.
GROUP = 256
PACKED = "__packed"


def _unpacked(packed: Column, schemas: tuple[T.StructType, T.StructType]) -> Column:
    schema, places = schemas
    return F.from_json(packed, schema, FILL_OPTIONS).cast(places)


def _filled(parser: LogParser, header: Sequence[str], slots: Sequence[str], record: str, group: int
            ) -> tuple[list[str], Column | None, dict[str, tuple[T.StructType, T.StructType]]]:
    """Columns as SQL, the serialised map, and per fill column of ``group``
    keys (``WIDE``, and the same with a number) what it is read as."""
    inside = f"{quoted(record)}." if record else ""
    params = F.col(f"{inside}params")
    base = set(parser.base_names)
    slot_of = dict(zip(header, slots))
    shared = {s for s, n in Counter(slots).items() if n > 1}
    extra = [k for k in header if k not in base and slot_of[k] not in shared]
    fills: dict[str, tuple[T.StructType, T.StructType]] = {}
    place = {}
    for at in range(0, len(extra), group):
        some, name = extra[at:at + group], WIDE if not at else f"{WIDE}{at // group}"
        # a struct-to-struct cast renames fields by position
        fills[name] = (T.StructType([T.StructField(slot_of[k], T.StringType()) for k in some]),
                       T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(some))]))
        place.update({k: f"{name}.c{i}" for i, k in enumerate(some)})
    packed = None
    if extra:
        named = F.transform_keys(params, lambda k, _: slot_name(k))
        if shared:  # colliding names would not make a map
            named = F.transform_keys(F.map_filter(params, lambda k, _: ~slot_name(k).isin(*shared)), lambda k, _: slot_name(k))
        packed = F.to_json(named)
    cols = []
    for k in header:
        if k in place:
            v = place[k]
        else:
            v = f"{inside}params[{literal(k)}]"
            if k in base:
                v = f"CASE WHEN map_contains_key({inside}params, {literal(k)}) THEN {v} ELSE CAST({inside}{quoted(k)} AS STRING) END"
        cols.append(f"{v} AS {quoted(k)}")
    return cols, packed, fills


def tabularize(narrow: DataFrame, parser: LogParser, header: Sequence[str] | None = None,
               keep: Sequence[str] = (), max_columns: int | None = None, new_keys: str = "ignore") -> DataFrame:
    """Wide table of one grammar: ``keep`` columns, then one string column
    per header key, null where a record lacks the key (T1/T2, K7, K9).

    ``new_keys`` tells what becomes of non-empty keys outside a given
    ``header``: the job fails (``fail``), they go to a last column ``_extra``
    as a JSON object (``keep``), or the caller wants those columns only
    (``ignore``)."""
    if new_keys not in NEW_KEY_MODES:
        raise ValueError(f"new_keys must be one of {NEW_KEY_MODES}")
    if header is None:
        header = headers(narrow, [parser], max_columns)[parser.name]
    if new_keys == "keep" and EXTRA in header:
        raise ValueError(f"the header has a column {EXTRA!r} of its own")
    rows = narrow.where(F.col("parser") == parser.name)
    cols, packed, fills = _filled(parser, header, slot_names(narrow.sparkSession, header), parser.name, GROUP)
    if new_keys != "ignore":
        params = F.col(parser.name).getField("params")
        new = F.array_except(F.map_keys(params), F.lit(["", *header]))
        if new_keys == "fail":
            message = F.concat(F.lit(f"{parser.name}: keys outside the header: "), F.array_join(new, ", "))
            rows = rows.where(F.when(F.size(new) > 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
        else:
            rest = F.map_filter(params, lambda k, _: F.array_contains(new, k))
            rows = rows.withColumn("__new", F.when(F.size(new) > 0, F.to_json(rest)))
            cols.append(f"__new AS {EXTRA}")
    if fills:
        # materialised once; each column then reads one struct field
        rows = rows.withColumn(PACKED, packed)
        rows = rows.withColumns({name: _unpacked(F.col(PACKED), schemas) for name, schemas in fills.items()})
    return rows.selectExpr(*map(quoted, keep), *cols)


def dedupe_names(names: Sequence[str]) -> list[str]:
    """Make names unique case-insensitively by suffixing ``__2``, ``__3``...
    (for sinks such as Parquet that reject names equal up to case)."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = n.lower()
        seen[k] = seen.get(k, 0) + 1
        out.append(n if seen[k] == 1 else f"{n}__{seen[k]}")
    return out
