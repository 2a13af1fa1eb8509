"""Source divergence audit by single-pass in-memory indexing.

Each task reads its documents once.  Texts are held until they fill a block;
the block's words then go through a hash dictionary, and one sort of (term,
document) pairs inverts them into postings: per term and source, how often and
in how many documents.  The run goes out sorted by term, one segment per
language and hash shard of the terms.  A shard's segments are merged with a
heap into frequencies, and the terms that are frequent enough leave in blocks.
A last pass over those streams each term's corrections to the differences of
the sources that have it.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtab.llm.common import materialise, small_batches

MIN_DOCS = 30
SMOOTH = 5
SCALE = 1000
TOP = 50
BLOCK_BYTES = 16 << 20
MERGE_TERMS = 300_000
OUT_TERMS = 1024
TILE_CELLS = 1 << 20
PIECE_BYTES = 1 << 20

# Terms are runs of ASCII letters and of bytes of other characters; only A-Z
# are lower-cased.  Every other byte becomes a blank.
BLANKED = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in bytes(range(256)).lower())


# ------------------------------------------------------------------------ runs

SEGMENT = "lang binary, shard int, terms array<binary>, docs array<long>, sizes array<int>, names array<binary>, sources array<int>, counts array<long>"


def inverted(texts: list[bytes], groups: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Postings of a block: the distinct terms, and per posting the term's
    place among them, the group, the occurrences and the documents; sorted by
    place and group.  ``groups`` (one per text) must not descend."""
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
    words = lists.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(np.asarray(lists.offsets)))
    met = np.asarray(words.indices).astype(np.int64) << 32 | doc
    blank = pc.index(words.dictionary, pa.scalar("", pa.string())).as_py()
    if blank >= 0:  # texts that begin or end with a separator
        met = met[met >> 32 != blank]
    met.sort()
    fresh = np.concatenate(([True], met[1:] != met[:-1])) if len(met) else np.zeros(0, bool)
    starts = np.flatnonzero(fresh)  # of a term in a document
    times = np.diff(np.append(starts, len(met)))
    term, group = met[starts] >> 32, groups[met[starts] & 0xFFFFFFFF]
    edge = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (group[1:] != group[:-1])))) if len(term) else starts
    return (words.dictionary, term[edge], group[edge], np.add.reduceat(times, edge) if len(edge) else times,
            np.diff(np.append(edge, len(term))))


def counted(text: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``inverted`` of one text that is larger than a block, whose words are
    only held piece by piece."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE_BYTES)
        end = len(text) if end < 0 else end
        found.update(text[at:end].split())
        at = end
    n = len(found)
    return (pa.array(list(found), pa.binary()).view(pa.string()), np.arange(n), np.zeros(n, np.int64),
            np.fromiter(found.values(), np.int64, n), np.ones(n, np.int64))


def segments(lang: bytes, names: list[bytes], postings: tuple, shards: int) -> pa.RecordBatch | None:
    """The postings of one language as sorted segments, a row per shard."""
    terms, term, source, counts, docs = postings
    if not len(term):
        return None
    raw = terms.view(pa.binary())
    shard = np.fromiter((zlib.crc32(t) % shards for t in raw.to_pylist()), np.int64, len(raw))
    order = np.asarray(pc.sort_indices(raw))
    order = order[np.argsort(shard[order], kind="stable")]  # by shard, then term
    rank = np.empty(len(raw), np.int64)
    rank[order] = np.arange(len(raw))
    by = np.argsort(rank[term], kind="stable")  # stays by source within a term
    rank, source, counts, docs = rank[term][by], source[by], counts[by], docs[by]
    first = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
    present = order[rank[first]]
    sizes = np.diff(np.append(first, len(rank)))
    of = shard[present]
    cut = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    rows = np.append(cut, len(present)).astype(np.int32)
    postings_at = np.append(first, len(rank))[rows].astype(np.int32)

    def lists(values: pa.Array, offsets: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    return pa.record_batch(
        [pa.array([lang] * len(cut), pa.binary()), pa.array(of[cut], pa.int32()), lists(raw.take(pa.array(present)), rows),
         lists(pa.array(np.add.reduceat(docs, first), pa.int64()), rows), lists(pa.array(sizes, pa.int32()), rows),
         pa.array([names] * len(cut), pa.list_(pa.binary())), lists(pa.array(source, pa.int32()), postings_at),
         lists(pa.array(counts, pa.int64()), postings_at)],
        names=["lang", "shard", "terms", "docs", "sizes", "names", "sources", "counts"])


def runs(docs: DataFrame, shards: int, block_bytes: int) -> DataFrame:
    """Segments of all runs over ``docs`` (lang, source, text)."""

    def spill(held: dict[bytes, list[tuple[bytes, bytes]]]) -> Iterator[pa.RecordBatch]:
        for lang, pairs in held.items():
            pairs.sort(key=lambda p: p[0])
            names = sorted({p[0] for p in pairs})
            place = {s: i for i, s in enumerate(names)}
            groups = np.array([place[s] for s, _ in pairs], np.int64)
            made = segments(lang, names, inverted([t for _, t in pairs], groups), shards)
            if made is not None:
                yield made
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[tuple[bytes, bytes]]] = {}
        size = 0
        for b in small_batches(batches, block_bytes):
            for lang, source, text in zip(*[c.cast(pa.binary()).to_pylist() for c in b.columns]):
                clean = text.translate(BLANKED)
                if len(clean) > block_bytes:
                    alone = segments(lang, [source], counted(clean), shards)
                    if alone is not None:
                        yield alone
                    continue
                held.setdefault(lang, []).append((source, clean))
                size += len(clean)
                if size >= block_bytes:
                    yield from spill(held)
                    size = 0
        yield from spill(held)

    return docs.mapInArrow(run, SEGMENT)


# ----------------------------------------------------------------------- merge

POSTING = np.dtype([("source", "<i4"), ("n", "<i8")])
KEPT = "lang binary, terms array<binary>, sizes array<int>, sources array<binary>, counts array<long>"
KEPT_KINDS = [pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int64())]


def entries(terms: list[bytes], docs: list[int], sizes: np.ndarray, sources: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """(term, documents, postings as bytes) of a segment."""
    packed = np.empty(len(sources), POSTING)
    packed["source"], packed["n"] = sources, counts
    raw, stops = packed.tobytes(), (np.cumsum(sizes, dtype=np.int64) * POSTING.itemsize).tolist()
    return [(t, d, raw[a:b]) for t, d, a, b in zip(terms, docs, [0, *stops], stops)]


def summed(raw: bytes) -> np.ndarray:
    """Postings with each source once."""
    found = np.frombuffer(raw, POSTING)
    source, at = np.unique(found["source"], return_inverse=True)
    out = np.zeros(len(source), POSTING)
    out["source"] = source
    np.add.at(out["n"], at, found["n"])
    return out


def merged(sorted_segments: Iterable[Iterable[tuple]], most: int = 4096) -> Iterator[tuple]:
    """Heap-merge segments; entries of one term are joined, documents added.
    Postings are folded to one a source where they have grown long."""
    term, docs, parts, size = None, 0, [], 0
    for t, d, raw in heapq.merge(*sorted_segments):
        if t != term:
            if term is not None:
                yield term, docs, b"".join(parts)
            term, docs, parts, size = t, 0, [], 0
        docs += d
        parts.append(raw)
        size += len(raw)
        if size > most * POSTING.itemsize:
            parts = [summed(b"".join(parts)).tobytes()]
            size = len(parts[0]) // 2  # as long again before the next fold
    if term is not None:
        yield term, docs, b"".join(parts)


def kept_terms(lang: bytes, found: Iterable[tuple], min_docs: int, names: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Blocks of the terms found in enough documents, each with its sources
    and counts."""
    held: list[tuple[bytes, np.ndarray]] = []

    def block() -> pa.RecordBatch:
        flat = np.concatenate([p for _, p in held])
        values = [[lang], [[t for t, _ in held]], [[len(p) for _, p in held]], [[names[i] for i in flat["source"].tolist()]],
                  [flat["n"].tolist()]]
        held.clear()
        return pa.record_batch([pa.array(v, k) for v, k in zip(values, KEPT_KINDS)], names=["lang", "terms", "sizes", "sources", "counts"])

    for term, docs, raw in found:
        if docs >= min_docs:
            held.append((term, summed(raw)))
            if len(held) >= OUT_TERMS:
                yield block()
    if held:
        yield block()


def frequencies(runs_: DataFrame, min_docs: int, merge_terms: int) -> DataFrame:
    """Kept terms of all shards.  Segments are merged whenever as many terms
    wait as ``merge_terms`` or have been merged already, so a task holds a
    few times the different terms of one shard, however many runs there
    are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[bytes, int] = {}
        names: list[bytes] = []
        key, whole, waiting, size = None, [], [], 0
        for b in small_batches(batches):
            for i, (lang, shard) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if (lang, shard) != key:
                    if key is not None:
                        yield from kept_terms(key[0], merged([whole, *waiting]), min_docs, names)
                    key, whole, waiting, size = (lang, shard), [], [], 0
                terms, docs, sizes, own, sources, counts = (b.column(c)[i].values for c in range(2, 8))
                mine = own.to_pylist()
                for name in mine:
                    if name not in place:
                        place[name] = len(names)
                        names.append(name)
                known = np.array([place[n] for n in mine], np.int32)
                waiting.append(entries(terms.to_pylist(), docs.to_pylist(), np.asarray(sizes), known[np.asarray(sources)], np.asarray(counts)))
                size += len(terms)
                if size >= max(merge_terms, len(whole)):
                    whole, waiting, size = list(merged([whole, *waiting])), [], 0
        if key is not None:
            yield from kept_terms(key[0], merged([whole, *waiting]), min_docs, names)

    return runs_.repartition("lang", "shard").sortWithinPartitions("lang", "shard").mapInArrow(run, KEPT)


# ----------------------------------------------------------------- differences

def share(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE^3 * (count + SMOOTH) / total), by long division in
    steps that stay exact for totals to 9e15."""
    rest, out = counts + SMOOTH, np.zeros(np.broadcast_shapes(counts.shape, totals.shape), np.int64)
    whole, rest = np.divmod(rest, totals)
    out += whole
    for _ in range(3):
        digit, rest = np.divmod(rest * SCALE, totals)
        out = out * SCALE + digit
    return out + 1


PART = "part string, lang binary, source binary, item binary, value long"


class Corrections:
    """Sums of each source's corrections against all sources of its
    language, in tiles of rows; given out when they fill the bound."""

    def __init__(self, cells: int):
        self.cells = cells
        self.tiles: dict[tuple, np.ndarray] = {}
        self.names: dict[bytes, list[bytes]] = {}

    def add(self, lang: bytes, sources: list[bytes], p: np.ndarray, p0: np.ndarray, here: np.ndarray) -> None:
        """``p`` (terms x sources) are shares, ``p0`` those of a count of
        zero and ``here`` tells the counts that are not.  A pair that has the
        term on both sides is added at its first source."""
        self.names[lang] = sources
        height = max(1, self.cells // (4 * len(sources)))
        for lo in range(0, len(sources), height):
            tile = self.tiles.setdefault((lang, lo), np.zeros((min(height, len(sources) - lo), len(sources)), np.int64))
            for i in range(lo, lo + len(tile)):
                rows = np.flatnonzero(here[:, i])
                if len(rows):
                    once = ~here[rows]
                    once[:, i + 1:] = True
                    once[:, i] = False
                    gain = np.abs(p[rows, i:i + 1] - p[rows]) - np.abs(p0[i] - p0)
                    tile[i - lo] += np.where(once, gain, 0).sum(axis=0)

    def full(self) -> bool:
        return sum(t.size for t in self.tiles.values()) >= self.cells

    def out(self) -> Iterator[pa.RecordBatch]:
        for (lang, lo), tile in self.tiles.items():
            names = self.names[lang]
            i, j = np.nonzero(tile)
            a = pa.array(names, pa.binary()).take(pa.array(i + lo))
            b = pa.array(names, pa.binary()).take(pa.array(j))
            value = pa.array(tile[i, j])
            for x, y in ((a, b), (b, a)):
                yield rows_of("pair", lang, x, y, value)
        self.tiles.clear()


def rows_of(part: str, lang: bytes, source: pa.Array, item: pa.Array, value: pa.Array) -> pa.RecordBatch:
    n = len(value)
    return pa.record_batch([pa.array([part] * n, pa.string()), pa.array([lang] * n, pa.binary()), source, item, value],
                           names=["part", "lang", "source", "item", "value"])


def differences(blocks: DataFrame, cells: int) -> DataFrame:
    """Rows ``(part, lang, source, item, value)``: every term that is more
    usual in a source than in its language (``term``) and partial sums of the
    corrections of pairs (``pair``), from blocks of kept terms that carry
    their language's ``n_terms``, ``n_total``, ``names`` and ``totals``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Corrections(cells)
        for b in small_batches(batches, 4 << 20):
            for lang, names, sizes, sources, counts, v, n, of, totals in zip(*[c.to_pylist() for c in b.columns]):
                place = {s: i for i, s in enumerate(of)}
                column = np.array([place[s] for s in sources], np.int64)
                row = np.repeat(np.arange(len(names)), sizes)
                per = np.array(totals, np.int64) + SMOOTH * v
                found = np.array(counts, np.int64)
                p_own = share(found, per[column])
                overall = np.zeros(len(names), np.int64)
                np.add.at(overall, row, found)
                q = share(overall, np.array([n + SMOOTH * v], np.int64))
                more = np.flatnonzero(p_own > q[row])
                texts, groups = pa.array(names, pa.binary()), pa.array(of, pa.binary())
                yield rows_of("term", lang, groups.take(pa.array(column[more])), texts.take(pa.array(row[more])),
                              pa.array((p_own - q[row])[more]))
                if len(of) < 2:
                    continue
                p0 = share(np.zeros(1, np.int64), per)
                step = max(1, cells // len(of))
                for lo in range(0, len(names), step):
                    own = (row >= lo) & (row < lo + step)
                    p = np.repeat(p0[None, :], min(step, len(names) - lo), axis=0)
                    here = np.zeros(p.shape, bool)
                    p[row[own] - lo, column[own]] = p_own[own]
                    here[row[own] - lo, column[own]] = True
                    sums.add(lang, of, p, p0, here)
                if sums.full():
                    yield from sums.out()
        yield from sums.out()

    return blocks.select("lang", "terms", "sizes", "sources", "counts", "n_terms", "n_total", "names", "totals").mapInArrow(run, PART)


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
               min_docs: int = MIN_DOCS, top: int = TOP, shards: int | None = None, block_bytes: int = BLOCK_BYTES,
               merge_terms: int = MERGE_TERMS, cells: int = TILE_CELLS) -> DataFrame:
    """How the sources of each language differ: ``(lang, source, part, item,
    value, rank)``.

    A language keeps the terms found in ``min_docs`` of its documents.  A
    group (language and source) gives each kept term the share ``1 + floor(1e9
    * (count + 5) / (total + 5 * kept terms))``.  Part ``pair`` sums the
    shares' absolute differences to every other source of the language, part
    ``term`` has the terms that are more usual in the group than in the whole
    language, to rank ``top``.  Ranks count from 1, greatest value first, then
    by the item's UTF-8 bytes.

    Null languages, sources and texts count as empty strings.  Every group
    that occurs takes part, also without a term; where a language keeps no
    term its pairs have value 0.  A source alone in its language has no pair.
    Repeated rows count each time; an empty table gives no row.  A text of
    more than ``block_bytes`` is a run of its own, read in pieces; other
    columns play no part.

    A task holds a block of texts with its words, or the different terms of
    one long text.  ``shards`` per language (default:
    ``spark.sql.shuffle.partitions``) should grow with the corpus.  A
    language's sources stand in one row, as each of them is in the result with
    every other.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def text(name: str):
        return F.coalesce(docs[name].cast("string"), F.lit("")).cast("binary")

    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    spilled = materialise(runs(rows, shards, block_bytes), "spimi-runs")
    kept = materialise(frequencies(spilled, min_docs, merge_terms), "spimi-terms")

    groups = rows.select("lang", "source").distinct()
    totals = (kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("p"))
              .groupBy("lang", F.col("p.sources").alias("source")).agg(F.sum("p.counts").alias("total")))
    sizes = kept.groupBy("lang").agg(F.sum(F.size("terms")).alias("n_terms"))
    named = F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total"))))
    langs = (groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(named.alias("g"), F.sum("total").alias("n_total"))
             .join(sizes, "lang", "left")
             .select("lang", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.coalesce("n_total", F.lit(0)).alias("n_total"),
                     F.col("g.source").alias("names"), F.col("g.total").alias("totals")))
    langs = materialise(langs, "spimi-langs")

    found = materialise(differences(kept.join(langs, "lang"), cells), "spimi-differences")
    zero = F.expr(f"cast({SCALE}L * {SCALE} * {SCALE} * {SMOOTH} div (total + {SMOOTH} * n_terms) + 1 as long)")
    ends = (langs.select("lang", "n_terms", F.explode(F.arrays_zip("names", "totals")).alias("g"))
            .select("lang", "n_terms", F.col("g.names").alias("source"), F.col("g.totals").alias("total"))
            .withColumn("p0", F.when(F.col("n_terms") > 0, zero).otherwise(F.lit(0))))
    # the result itself: every other source of a group's language
    others = langs.select("lang", F.explode("names").alias("item"))
    pairs = ends.join(others, "lang").where("source <> item")
    far = ends.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    added = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("more"))
    pairs = (pairs.join(far, ["lang", "item"]).join(added, ["lang", "source", "item"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item",
                     (F.col("n_terms") * F.abs(F.col("p0") - F.col("q0")) + F.coalesce("more", F.lit(0))).cast("long").alias("value")))
    by_rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by_rank))
    usual = (found.where("part = 'term'").select("lang", "source", "part", "item", "value")
             .withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= top))
    return pairs.union(usual).select(F.col("lang").cast("string"), F.col("source").cast("string"), "part",
                                     F.col("item").cast("string"), "value", "rank")
