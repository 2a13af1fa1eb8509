"""Conflict-constrained best-fit packing of documents into sequences."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtab.llm.common import WORD, materialise

CAPACITY = 2048
SHARD_PIECES = 4096


def best_fit(sizes: Iterable[int], sources: Iterable[int], clusters: Iterable[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each piece, given largest first.

    Open bins stand in order of their residual room and carry one bitmap of
    the sources and one of the duplicate clusters they hold.  A piece goes
    to the tightest bin it fits that holds neither its source nor its
    cluster: the search starts at the first residual that is large enough
    and moves to the next larger one until a bin is compatible (equal
    residuals: the older bin); without one a new bin opens.  Source or
    cluster -1 conflicts with nothing.
    """
    order: list[tuple[int, int]] = []
    held: list[list[int]] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        source_bit = 1 << source if source >= 0 else 0
        cluster_bit = 1 << cluster if cluster >= 0 else 0
        at = bisect_left(order, (size, -1))
        while at < len(order):
            room, b = order[at]
            if not (held[b][0] & source_bit or held[b][1] & cluster_bit):
                del order[at]
                break
            at += 1
        else:
            room, b = capacity, len(held)
            held.append([0, 0])
        held[b][0] |= source_bit
        held[b][1] |= cluster_bit
        out.append((b, capacity - room))
        if room > size:
            insort(order, (room - size, b))
    return out


def codes(values: pd.Series) -> np.ndarray:
    """Numbers for values that occur at least twice, -1 for the others and
    for nulls: a bit is only needed where a conflict is possible."""
    at, _ = pd.factorize(values)
    counts = np.bincount(at[at >= 0], minlength=1) if len(at) else np.zeros(1, int)
    often = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)
    return np.where(at >= 0, often[np.maximum(at, 0)], -1)


def pack(docs: DataFrame, id_col: str, tokens: Column, source: Column, cluster: Column, capacity: int = CAPACITY,
         shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``(id_col, piece, start, length, bin, offset)``: where each piece of
    each row of ``docs`` lies.

    A row of more than ``capacity`` tokens is cut into pieces of
    ``capacity`` and a remainder; ``start`` counts tokens of the row.  Whole
    pieces fill a bin alone.  The others are dealt by hash to shards of
    about ``shard_pieces`` (the number of shards follows the number of
    pieces, so memory is bounded), and each shard is packed largest first by
    ``best_fit``: no bin holds two pieces of one source or of one duplicate
    cluster.  As the hash ignores source and cluster, a hot one is spread
    over all shards.  ``bin`` is unique over all shards.

    Rows without tokens (null, zero) get no place.  A null source or cluster
    conflicts with nothing.  Rows with a null id are packed like others;
    repeated rows are packed as often as they occur.
    """
    if capacity < 1 or shard_pieces < 1:
        raise ValueError("capacity and shard_pieces must be positive")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), tokens.cast("long").alias("n"),
                       source.cast("string").alias("source"), cluster.cast("long").alias("cluster")).where("n > 0")
    pieces = rows.select("id", "n", "source", "cluster", F.posexplode(
        F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(capacity).cast("long"))).alias("piece", "start"))
    pieces = pieces.select("id", "piece", "start", F.least(F.col("n") - F.col("start"), F.lit(capacity)).alias("length"), "source", "cluster")
    pieces = materialise(pieces.withColumn("row", F.monotonically_increasing_id()), "pack-pieces")
    whole = pieces.where(F.col("length") == capacity).select(
        "id", "piece", "start", "length", F.concat(F.lit("w"), F.col("row")).alias("bin"), F.lit(0).cast("long").alias("offset"))
    part = pieces.where(F.col("length") < capacity)
    shards = max(1, -(-part.count() // shard_pieces))
    by = F.when(F.col("id").isNull(), F.xxhash64("row")).otherwise(F.xxhash64("id", "piece", "cluster"))
    dealt = part.withColumn("shard", F.pmod(by, F.lit(shards)).cast("long"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "id", "piece", "cluster", "source"], ascending=[False, True, True, True, True], kind="stable")
        placed = best_fit(pdf["length"].tolist(), codes(pdf["source"]).tolist(), codes(pdf["cluster"]).tolist(), capacity)
        shard = int(pdf["shard"].iloc[0])
        out = pdf[["id", "piece", "start", "length"]].copy()
        out["bin"] = [f"s{shard}-{b}" for b, _ in placed]
        out["offset"] = [o for _, o in placed]
        return out

    packed = dealt.groupBy("shard").applyInPandas(run, "id long, piece int, start long, length long, bin string, offset long")
    return whole.unionByName(packed).withColumnRenamed("id", id_col)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def text_cluster(text: Column) -> Column:
    """Duplicate cluster of texts that agree but for case and white space."""
    return F.xxhash64(F.lower(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")))
