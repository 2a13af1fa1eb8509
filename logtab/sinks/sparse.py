"""Narrow records rendered as wide TSV lines, without wide rows.

A line of the wide table holds an empty field for every column its record
lacks.  Here it is put together from the record's own entries in header
order, with runs of empty fields between them, so the work follows the
entries and the length of the line, not the number of columns times a cast,
a struct field and a writer call each.  The result is, byte for byte, what
``write_tsv`` makes of the wide table.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtab.operators.parsers import LogParser

EMPTY = '""'
JSON_OPTIONS = {"maxStringLen": str(2**31 - 1)}


def quoted_field(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def header_line(header: Sequence[str]) -> str:
    return "\t".join('"' + name.replace('"', '""') + '"' for name in header)


def constant(value, kind: str) -> Column:
    """A literal array: read from JSON text, which Spark folds once per plan
    (thousands of single literals would take seconds to build)."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind, JSON_OPTIONS)


def place_of(header: Sequence[str]):
    """A function from a key Column to its place in the header (null if it
    has none): a hash table in two literal arrays, places by bucket and the
    names to compare with."""
    size = max(1, 2 * len(header))
    buckets: list[list[int]] = [[] for _ in range(size)]
    for i, name in enumerate(header):
        buckets[zlib.crc32(name.encode()) % size].append(i)
    names, table = constant(list(header), "array<string>"), constant(buckets, "array<array<int>>")

    def place(key: Column) -> Column:
        found = F.get(table, (F.crc32(key) % size).cast("int"))
        return F.get(F.filter(found, lambda i: F.get(names, i) == key), F.lit(0))

    return place


def render(rows: DataFrame, parser: LogParser, header: Sequence[str], keep: Sequence[str] = (), out: str = "value") -> DataFrame:
    """``keep`` columns and the TSV line of each record (struct column named
    after the grammar) under ``header``.  A parameter overrides a base field
    of the same name; keys outside the header are left out."""
    header = list(header)
    at = {name: i for i, name in enumerate(header)}
    record = F.col(parser.name)
    params = record["params"]
    place = place_of(header)
    entry = "struct<place:int,text:string>"
    base = [F.when(F.map_contains_key(params, F.lit(n)), F.lit(None)).otherwise(
        F.struct(F.lit(at[n]).alias("place"), record[n].cast("string").alias("text"))).cast(entry) for n in parser.base_names if n in at]
    own = F.transform(F.map_entries(params), lambda e: F.struct(place(e["key"]).alias("place"), e["value"].alias("text")).cast(entry))
    entries = F.concat(F.array(*base).cast(f"array<{entry}>"), own)
    cells = F.sort_array(F.filter(entries, lambda c: c["place"].isNotNull() & (c["text"] != "")))
    rows = rows.select(*keep, cells.alias("__cells"))

    cells = F.col("__cells")
    gap = f"{EMPTY}\t"

    def field(c: Column, i: Column) -> Column:
        before = F.coalesce(F.get(cells, i - 1)["place"], F.lit(-1))
        return F.concat(F.repeat(F.lit(gap), c["place"] - before - 1), quoted_field(c["text"]))

    last = F.get(cells, F.size(cells) - 1)["place"]
    empty = "\t".join([EMPTY] * len(header))
    line = F.when(F.size(cells) == 0, F.lit(empty)).otherwise(
        F.concat(F.array_join(F.transform(cells, field), "\t"), F.repeat(F.lit("\t" + EMPTY), len(header) - 1 - last)))
    return rows.select(*keep, line.alias(out))
