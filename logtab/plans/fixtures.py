"""Deterministic log lines rendered from the ``events`` table.

Used by the registered queries and the tests: every line is a pure function
of one event row, so an independent SQL engine can compute the expected
parse results straight from the event columns, without parsing anything.

Shapes by ``event_id % 10``: 0-4 ``hw`` with ``=`` pairs, 5-6 ``hw`` with
``:`` pairs, 7-8 ``cp`` (an extra trailing ``Action`` when
``event_id % 20 = 7``), 9 a junk line with surrounding blanks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c: Column) -> Column:
    return c.cast("string")


def stamp(ts: Column) -> Column:
    """``Mon dd HH:MM:SS`` with the day left-padded by a blank."""
    return F.concat(F.date_format(ts, "MMM"), F.lit(" "), F.lpad(_s(F.dayofmonth(ts)), 2, " "),
                    F.lit(" "), F.date_format(ts, "HH:mm:ss"))


def render_lines(events: DataFrame, bad_dates: bool = False) -> DataFrame:
    """``(eid, value)``: one rendered log line per event.

    ``bad_dates`` replaces the stamp of every event with ``event_id % 50 = 7``
    by the impossible ``Feb 30 00:00:00``.
    """
    eid, uid, kind = F.col("event_id"), _s(F.col("user_id")), F.col("event_type")
    k = F.regexp_extract(F.col("props"), r"(\d+)", 1)
    cents = _s(F.round(F.col("value") * 100).cast("bigint"))
    pfx = stamp(F.col("ts"))
    if bad_dates:
        pfx = F.when(eid % 50 == 7, F.lit("Feb 30 00:00:00")).otherwise(pfx)
    up = F.upper(kind)
    hw_eq = F.concat(pfx, F.lit(" 10.0."), uid, F.lit(".1 "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
                     F.lit(" FW-A %%01SEC/4/"), up, F.lit("(l)["), _s(eid), F.lit("]:vsys=public, user="),
                     uid, F.lit(', value="'), cents, F.lit('", evt='), kind, F.lit("."))
    hw_colon = F.concat(pfx, F.lit(" FW-B %%01POLICY/6/"), up, F.lit(":Policy:p"), k,
                        F.lit("; Src User:"), uid, F.lit('; Kind:"'), kind, F.lit('";'))
    cp = F.concat(pfx, F.lit(" 10.1."), uid, F.lit(".1 +01:00 192.168.0."), _s(eid % 256),
                  F.lit(' Action="'), kind, F.lit('" UserId:="'), uid, F.lit('" Note="k '), k, F.lit('"'),
                  F.when(eid % 20 == 7, F.lit(' Action="final"')).otherwise(F.lit("")))
    junk = F.concat(F.lit("   junk "), _s(eid), F.lit(" "), kind, F.lit("\t"))
    shape = eid % 10
    line = (F.when(shape < 5, hw_eq).when(shape < 7, hw_colon).when(shape < 9, cp).otherwise(junk))
    return events.select(eid.alias("eid"), line.alias("value"))


def render_mixed_pairs(events: DataFrame) -> DataFrame:
    """``(eid, value)``: one hw line per event with both pair kinds; ``mix``
    occurs as either, and one parameter is named like a base field."""
    eid, uid, kind = _s(F.col("event_id")), _s(F.col("user_id")), F.col("event_type")
    return events.select(F.col("event_id").alias("eid"), F.concat(
        stamp(F.col("ts")), F.lit(" FW-A %%01SEC/4/X:user="), uid, F.lit(", mix="), kind, F.lit(", _d_interface_2=over"), eid,
        F.lit(", end=1, ; mix:"), eid, F.lit(";")).alias("value"))


def render_empty_keys(events: DataFrame) -> DataFrame:
    """``(eid, value)``: one cp line per event whose first parameter has no
    name, and whose others differ only in case."""
    eid, kind = _s(F.col("event_id")), F.col("event_type")
    return events.select(F.col("event_id").alias("eid"), F.concat(
        stamp(F.col("ts")), F.lit(' 10.1.0.1 +01:00 192.168.0.1 ="'), eid, F.lit('" Src="'), kind, F.lit('" src="'), eid, F.lit('"')).alias("value"))


def render_many_keys(events: DataFrame, keys: int) -> DataFrame:
    """``(eid, value)``: one cp line per event with two of ``keys`` names."""
    eid = F.col("event_id")
    at = _s(eid % (keys // 2))
    return events.select(eid.alias("eid"), F.concat(
        stamp(F.col("ts")), F.lit(" 10.1.0.1 +01:00 192.168.0.1 key"), at, F.lit('="'), _s(eid), F.lit('" alt'), at, F.lit('="'), _s(eid),
        F.lit('"')).alias("value"))


def render_hostile_keys(events: DataFrame, length: int) -> DataFrame:
    """``(eid, value)``: one cp line per event with a key of ``length``
    characters and one whose name has a meaning to JSON readers."""
    eid = _s(F.col("event_id"))
    return events.select(F.col("event_id").alias("eid"), F.concat(
        stamp(F.col("ts")), F.lit(' 10.1.0.1 +01:00 192.168.0.1 a="'), eid, F.lit('" _corrupt_record="c'), eid, F.lit('" '),
        F.repeat(F.lit("k"), length), F.lit('="v'), eid, F.lit('"')).alias("value"))


def render_devices(events: DataFrame, kinds: int) -> DataFrame:
    """``(eid, value)``: one short line per event that names one of ``kinds``
    devices."""
    eid = F.col("event_id")
    return events.select(eid.alias("eid"), F.concat(_s(F.col("user_id")), F.lit(" dev"), _s(eid % kinds), F.lit(" n="), _s(eid)).alias("value"))


def document_lines(documents: DataFrame) -> DataFrame:
    """``(doc_id, value)``: the prose of ``documents`` broken into lines the way
    a text file is (``\\r\\n``, ``\\r`` or ``\\n``) - realistic non-log noise."""
    parts = F.split(F.col("text"), "\r\n|\r|\n")
    return documents.select("doc_id", F.explode(parts).alias("value"))
