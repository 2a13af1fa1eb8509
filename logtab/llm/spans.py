"""What the secret and personal-data scans share: spans and their digests."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtab.llm.common import byte_texts, small_batches

Span = tuple[int, int, str, float]  # start, end (exclusive), kind, score

SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))
SPAN_SCHEMA = "array<struct<start: long, end: long, kind: string, score: double>>"


def to_code_points(raw: bytes, spans: list[Span]) -> list[Span]:
    """Byte offsets of a UTF-8 text to code points."""
    if not spans or raw.isascii():
        return spans
    at = sorted({p for s in spans for p in s[:2]})
    place, done, count = {}, 0, 0
    for p in at:
        count += len(raw[done:p].decode())
        place[p], done = count, p
    return [(place[a], place[b], kind, score) for a, b, kind, score in spans]


def scan_texts(docs: DataFrame, id_col: str, text_col: str, scan: Callable[[bytes], list[Span]], kinds: Sequence[str]) -> DataFrame:
    """``(id, spans)`` of every row: ``scan`` sees each whole text as UTF-8
    (null: empty) and returns byte spans, which come out in code points,
    ordered by start and then by the place of their kind in ``kinds``."""
    rank = {k: i for i, k in enumerate(kinds)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            out = []
            for raw in byte_texts(b.column(1)):
                found = to_code_points(raw, scan(raw))
                found.sort(key=lambda s: (s[0], rank[s[2]], s[1]))
                out.append([dict(zip(("start", "end", "kind", "score"), s)) for s in found])
            yield pa.record_batch([b.column(0), pa.array(out, SPAN_TYPE)], names=["id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id long, spans {SPAN_SCHEMA}")


def of_kinds(spans: Column, kinds: Sequence[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str, base: Sequence[str]) -> DataFrame:
    """The id, ``n_<kind>`` of each base kind, ``base_sha256`` and ``spans``
    (as text) of a table of spans."""
    spans = F.col("spans")
    counts = [F.size(of_kinds(spans, [k])).cast("long").alias(f"n_{k}") for k in base]
    return found.select(F.col("id").alias(id_col), *counts, F.sha2(joined(of_kinds(spans, base)), 256).alias("base_sha256"),
                        joined(spans).alias("spans"), F.size(F.filter(spans, lambda s: ~s["kind"].isin(*base))).cast("long").alias("n_added"),
                        F.array_max(F.transform(spans, lambda s: s["score"])).alias("max_score"))
