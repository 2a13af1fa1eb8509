"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtab.plans.storage import delete, scratch_dir

# A word is a run of characters other than space and \x09-\x0D.  Python's
# bytes.split() without arguments breaks at exactly these six bytes, and no
# byte of a multi-byte UTF-8 character is among them.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


_written: list[str] = []


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the cluster's shared checkpoint folder
    and read it back: cuts the lineage, survives the loss of any executor,
    and lets several jobs use the rows without computing them again."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` ends in.  It must return one that it has
    just materialised; all others it has written on the way are deleted, as
    nothing reads them any more."""
    start = len(_written)
    out = build()
    for path in _written[start:-1]:
        delete(out.sparkSession, path)
    del _written[start:]
    return out


def small_batches(batches: Iterable[pa.RecordBatch], max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that no slice holds more than about ``max_bytes``
    (a single larger row stays whole): Python objects are made per slice."""
    for b in batches:
        parts = max(1, -(-b.nbytes // max_bytes))
        step = max(1, -(-b.num_rows // parts))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, ``b''`` for null."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def same(*pairs: tuple[Column, Column]) -> Column:
    """Null-safe equality of every pair (nulls match nulls)."""
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & a.eqNullSafe(b)
    return cond


def row_key(text: Column) -> Column:
    """Tells rows that share an id but not a text apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


SIEVE_BITS = 24


def sieve(rows: DataFrame, value: Column, wanted: DataFrame, bits: int = SIEVE_BITS) -> tuple[DataFrame, Column]:
    """Mark rows whose 64-bit ``value`` may be among ``wanted`` (one bigint
    column): never misses one, lets others through by chance.

    The wanted values' lowest bits are drawn into a bitmap of ``2^bits``
    bits, at most 2 MB by default whatever the input, which is broadcast.
    Returns the rows with the bitmap joined on and the test; callers follow
    it by an exact join, so the bitmap only saves shuffling.
    """
    page, cell = 15, (1 << 15) - 1  # bitmap_construct_agg draws pages of 32,768 bits

    def place(v: Column) -> tuple[Column, Column]:
        low = v.bitwiseAND(F.lit((1 << bits) - 1))
        return F.shiftright(low, page).cast("int"), low.bitwiseAND(F.lit(cell))

    at, bit = place(F.col(wanted.columns[0]))
    drawn = (wanted.select(at.alias("__page"), bit.alias("__bit")).distinct()
             .groupBy("__page").agg(F.bitmap_construct_agg("__bit").alias("__bitmap")))
    at, bit = place(value)
    marked = rows.withColumn("__at", at).withColumn("__cell", bit)
    marked = marked.join(F.broadcast(drawn), F.col("__at") == F.col("__page"), "left")
    byte = F.conv(F.hex(F.expr("substring(__bitmap, cast(shiftright(__cell, 3) as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.expr("shiftleft(1, cast(__cell & 7 as int))").bitwiseAND(byte) != 0
    return marked.drop("__at", "__page"), F.coalesce(hit, F.lit(False))


SIEVE_COLUMNS = ("__cell", "__bitmap")


def without(docs: DataFrame, keys: Callable[[Callable[[str], Column]], Sequence[Column]], gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` (made from its columns, whatever
    their names) are those of no row of ``gone``, unchanged.

    Only rows that the bitmap of ``gone`` lets through are shuffled for the
    exact join; the others' texts stay where they are."""
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    made = keys(lambda c: F.col(f"c{docs.columns.index(c)}"))
    own = [f"__k{i}" for i in range(len(made))]
    rows = named.withColumns(dict(zip(own, made))).withColumn("__hash", F.xxhash64(*own))
    marked, maybe = sieve(rows, F.col("__hash"), gone.select(F.xxhash64(*gone.columns).alias("__hash")))
    marked = marked.withColumn("__maybe", maybe).drop(*SIEVE_COLUMNS, "__hash")
    away = gone.toDF(*[f"__g{i}" for i in range(len(made))])
    left = marked.where("__maybe").join(away, same(*[(F.col(k), F.col(f"__g{i}")) for i, k in enumerate(own)]), "left_anti")
    return left.unionByName(marked.where("not __maybe")).select(*named.columns).toDF(*docs.columns)
