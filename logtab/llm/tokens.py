"""Token-id output: frequency-ranked ids in byte-aligned variable-length code.

Ids are replaced by their rank in the corpus (0 for the most frequent), so
that common ids need one byte.  A block keeps its control bytes (two bits per
id: its length less one) apart from its data bytes (one to four per id, lowest
first); each document's codes start a control byte of their own.  A lookup
table over the 256 control bytes gives the lengths back, one over the ranks
the ids.

A dataset is a folder:

* ``ids.u32`` - the ids by rank, little-endian unsigned 32-bit integers;
* ``part-*.svb`` - blocks, documents in ascending order.  A block is a header
  (``HEADER``: magic, documents, control bytes, data bytes), then per document
  whether it has an id (one byte), its id and its number of ids (little-endian
  64-bit integers), then the control bytes and the data bytes;
* ``manifest.parquet`` - the parts and blocks that belong to the dataset, in
  order.  Files that are not in it (of failed tasks) count for nothing.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtab.llm.common import small_batches
from logtab.plans.storage import scratch_dir

HEADER = "<4sIQQ"
HEADER_BYTES = struct.calcsize(HEADER)
MAGIC = b"SVB1"
BLOCK_BYTES = 8 << 20
CACHE_WORDS = 1_000_000
PIECE_CHARS = 1 << 22
END_ID = 2

# Texts of these characters only are unchanged by NFC and lower-cased letter
# by letter, so the tokenizer's own splitting rule can be applied to them here.
SIMPLE = re.compile(r"[\x09-\x0D\x20-\x7EÀ-ÖØ-öø-ÿ]*")
# The splitting rule of ``word_bpe_49k.json``, and the same rule
# restricted to those characters.
RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\x09-\x0D\x20a-zß-öø-ÿ0-9]+")
BLANK = re.compile(r"[\x09-\x0D\x20]")
# Every piece but runs of letters, for setting them apart by blanks.
MARKS = r"'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\x09-\x0D\x20a-zß-öø-ÿ0-9]+"


# ------------------------------------------------------------------ tokenizing

class Words:
    """Encodes texts with a tokenizer file.

    A tokenizer that splits by ``RULE`` never joins what the rule parts, so a
    text's ids are those of its pieces in order.  The ids of pieces already
    met are kept, up to ``CACHE_WORDS`` of them, and new pieces are encoded
    together: each one ends with the only id that stands for a word's end.
    Texts with other characters than ``SIMPLE`` are split at blanks, and what
    is not simple there goes to the tokenizer whole.  Any other tokenizer
    gets whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content for t in added]
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values(), default=0) + 1
        rules = json.loads(self.tokenizer.to_str())
        suffix = rules["model"].get("end_of_word_suffix")
        splits = [p.get("pattern", {}).get("Regex") for p in (rules["pre_tokenizer"] or {}).get("pretokenizers", [])]
        kinds = [n["type"] for n in (rules["normalizer"] or {}).get("normalizers", [])]
        alone = not any(t.lstrip or t.rstrip or t.single_word or BLANK.search(t.content) for t in added)
        self.by_piece = bool(suffix) and alone and splits[:1] == [RULE] and kinds == ["NFC", "Replace", "Lowercase"]
        self.ends = np.zeros(self.size, bool)
        if self.by_piece:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
            # the same model for simple pieces, which need no normalizing and are split already
            rules["normalizer"] = None
            rules["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
            self.simple = Tokenizer.from_str(json.dumps(rules))
            self.marked = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")

    def ids(self, texts: list[str], tokenizer=None) -> list[np.ndarray]:
        found = (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def learn(self, pieces: list[str]) -> None:
        """Make the distinct ``pieces`` known."""
        known = self.known
        new = [p for p in pieces if p not in known]
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = pieces
        simple = [p for p in new if self.plain(p)]
        for i in range(0, len(simple), 1024):
            some = simple[i:i + 1024]
            together = self.ids(["\n".join(some)], self.simple)[0]
            stops = np.flatnonzero(self.ends[together]) + 1
            if len(stops) != len(some):
                raise ValueError("the tokenizer does not end every word with an id of its own")
            raw, at = together.tobytes(), 0
            for piece, stop in zip(some, (4 * stops).tolist()):
                known[piece], at = raw[at:stop], stop
        other = [p for p in new if p not in known] if len(simple) < len(new) else []
        known.update(zip(other, (e.tobytes() for e in self.ids(other))))

    def plain(self, text: str) -> bool:
        return SIMPLE.fullmatch(text) is not None and self.marked.search(text) is None

    def pieces(self, text: str) -> list[str]:
        if self.plain(text):
            return SPLIT.findall(text.lower())
        out: list[str] = []
        for chunk in BLANK.split(text):
            if chunk and self.plain(chunk):
                out += SPLIT.findall(chunk.lower())
            elif chunk:
                out.append(chunk)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_piece:
            return [e.tobytes() for e in self.ids(texts)]
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            for stretch in stretches(text):
                held.append((i, stretch))
                size += len(stretch)
                if size >= PIECE_CHARS:
                    self.encode_some(held, out)
                    held, size = [], 0
        self.encode_some(held, out)
        return [b"".join(o) for o in out]

    def encode_some(self, cuts: list[tuple[int, str]], out: list[list[bytes]]) -> None:
        """Append the ids of each stretch to ``out``: the distinct pieces of
        all are looked up once, and their ids gathered in order."""
        apart = [self.plain(t) for _, t in cuts]
        marked = iter(pc.replace_substring_regex(pa.array([t.lower() for (_, t), p in zip(cuts, apart) if p], pa.string()),
                                                 MARKS, r" \0 ").to_pylist())
        spaced = [next(marked) if p else " ".join(self.pieces(t)) for (_, t), p in zip(cuts, apart)]
        lists = pc.ascii_split_whitespace(pa.array(spaced, pa.string()))
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        self.learn([p for p in pieces if p])
        blobs = [self.known[p] if p else b"" for p in pieces]  # a text may begin or end with a blank
        flat = np.frombuffer(b"".join(blobs), "<u4")
        lengths = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        starts = np.cumsum(lengths) - lengths
        at = np.asarray(coded.indices)
        sizes = lengths[at]
        ends = np.cumsum(sizes)
        ids = flat[np.repeat(starts[at] - ends + sizes, sizes) + np.arange(sizes.sum())].tobytes()
        stops = np.concatenate(([0], 4 * ends))[np.asarray(lists.offsets)].tolist()
        for (i, _), a, b in zip(cuts, stops, stops[1:]):
            out[i].append(ids[a:b])


def stretches(text: str) -> Iterator[str]:
    """The text cut at blanks, which no id spans, after ``PIECE_CHARS``."""
    at = 0
    while at < len(text):
        cut = BLANK.search(text, at + PIECE_CHARS)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


@functools.lru_cache(maxsize=2)
def words(path: str) -> Words:
    """One per Python worker, which serves many tasks."""
    return Words(path)


def narrow(ids: bytes, wide: bool) -> bytes:
    return ids if wide else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def tokenized(docs: DataFrame, tokenizer: str, end_id: int | None, id_col: str, text_col: str, wide: bool) -> DataFrame:
    """``(id, ids)``: each text's ids, two bytes each unless ``wide``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder = words(tokenizer)
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        for b in small_batches(batches, 8 << 20):
            ids = [narrow(e + end, wide) for e in encoder.encode([t or "" for t in b.column(1).to_pylist()])]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, ids binary")


def frequencies(tokens: DataFrame, wide: bool) -> list[tuple[int, int]]:
    """Ids and counts over all tokens; as many as the vocabulary has at most."""
    kind = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in small_batches(batches):
            ids = np.frombuffer(b"".join(b.column(0).to_pylist()), kind)
            counts = np.bincount(ids, minlength=len(total))
            counts[:len(total)] += total
            total = counts
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["id", "n"])

    counted = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return [(r.id, r.n) for r in counted.collect()]


# ------------------------------------------------------------------------ code

def lengths_table() -> np.ndarray:
    """Bytes of each of the four codes of every control byte."""
    control = np.arange(256, dtype=np.uint8)[:, None]
    return ((control >> np.array([0, 2, 4, 6], np.uint8)) & 3).astype(np.uint8) + 1


LENGTHS = lengths_table()


def spans(counts: np.ndarray) -> np.ndarray:
    """Places of the values in slots that start anew, at a multiple of four,
    for each document."""
    slots = -(-counts // 4) * 4
    skipped = np.cumsum(slots - counts) - (slots - counts)
    return np.arange(counts.sum(), dtype=np.int64) + np.repeat(skipped, counts)


def encoded(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit values, ``counts`` of
    them per document, and the data bytes of each document."""
    values = np.ascontiguousarray(values, "<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(int((-(-counts // 4)).sum()) * 4, np.uint8)
    codes[spans(counts)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    width = int(size.max(initial=1))
    kept = np.arange(width, dtype=np.uint8) < size[:, None]
    data = values.view(np.uint8).reshape(-1, 4)[:, :width][kept]
    ends = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    stops = np.cumsum(counts)
    return control, data, ends[stops] - ends[stops - counts]


def decoded(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values again: lengths by table lookup, then each value's bytes."""
    size = LENGTHS[control].reshape(-1)[spans(counts)]
    at = np.cumsum(size, dtype=np.int64) - size
    values = data[at].astype(np.uint32) if len(at) else np.zeros(0, np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        values[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


# ----------------------------------------------------------------------- files

def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


MANIFEST = "file string, part int, block int, offset long, bytes long, documents long, ids long, first long"


def coded(batch: pa.RecordBatch, ranks: np.ndarray, wide: bool) -> Iterator[tuple]:
    """(id, number of ids, control bytes, data bytes) of each row (id, ids)."""
    raw = batch.column(1).to_pylist()
    counts = np.fromiter(map(len, raw), np.int64, len(raw)) // (4 if wide else 2)
    control, data, sizes = encoded(ranks[np.frombuffer(b"".join(raw), "<u4" if wide else "<u2")], counts)
    stops, ends = np.cumsum(-(-counts // 4)).tolist(), np.cumsum(sizes).tolist()
    control, data = control.tobytes(), data.tobytes()
    for doc, n, a, b, c, d in zip(batch.column(0).to_pylist(), counts.tolist(), [0, *stops], stops, [0, *ends], ends):
        yield doc, n, control[a:b], data[c:d]


def write_blocks(tokens: DataFrame, path: str, ids_by_rank: np.ndarray, wide: bool, block_bytes: int) -> DataFrame:
    """Code sorted partitions of (id, ids) and write them as part files; one
    row per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.svb"  # of this attempt alone
        store, root = opened(path)
        ranks = np.zeros(int(ids_by_rank.max(initial=0)) + 1, np.uint32)
        ranks[ids_by_rank] = np.arange(len(ids_by_rank), dtype=np.uint32)
        held: list[tuple] = []
        made: list[tuple] = []
        size = first = offset = 0

        def flush(out) -> None:
            nonlocal held, size, first, offset
            ids, n, control, data = zip(*held)
            valid = bytes(i is not None for i in ids)
            body = [valid, np.array([i or 0 for i in ids], "<i8").tobytes(), np.array(n, "<i8").tobytes(), *control, *data]
            length = HEADER_BYTES + sum(map(len, body))
            out.write(struct.pack(HEADER, MAGIC, len(ids), sum(map(len, control)), sum(map(len, data))))
            for piece in body:
                out.write(piece)
            made.append((name, part, len(made), offset, length, len(ids), sum(n), first))
            first, offset = first + sum(n), offset + length
            held, size = [], 0

        out = None
        for b in small_batches(batches, 4 << 20):
            for row in coded(b, ranks, wide):
                held.append(row)
                size += len(row[2]) + len(row[3]) + 17
                if size >= block_bytes:
                    out = out or store.open_output_stream(f"{root}/{name}", compression=None)
                    flush(out)
        if held:
            out = out or store.open_output_stream(f"{root}/{name}", compression=None)
            flush(out)
        if out:
            out.close()
        names = [c.split()[0] for c in MANIFEST.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 5]
        columns = list(zip(*made)) or [()] * len(names)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return tokens.select("id", "ids").mapInArrow(run, MANIFEST)


def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int | None = END_ID, id_col: str = "doc_id",
                 text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> str:
    """Encode every text with the tokenizer file ``tokenizer`` (a path that
    executors can read), append ``end_id`` and write the dataset folder (see
    module doc); its path is returned (default: a new folder under the shared
    checkpoint folder, which executors must reach as a file system that
    pyarrow knows).

    A null text counts as empty, so an empty document is its end id alone.
    Documents ascend by id, null ids first; rows that share an id are ordered
    by their ids' number and content, repeated rows are kept.  An empty table
    gives a dataset without parts.  Other columns play no part.

    Texts are tokenized once, into a table of ids.  Their counts, one row per
    id of the vocabulary, reach the driver; documents are shuffled into order
    as ids and coded where they are written.
    """
    spark = docs.sparkSession
    path = path or scratch_dir(spark, "tokens")
    wide = max(words(tokenizer).size, (end_id or 0) + 1) > 1 << 16
    stored = scratch_dir(spark, "token-ids")
    tokenized(docs, tokenizer, end_id, id_col, text_col, wide).write.option("compression", "zstd").parquet(stored)
    tokens = spark.read.schema("id long, ids binary").parquet(stored)
    counts = sorted(frequencies(tokens, wide), key=lambda c: (-c[1], c[0]))
    by_rank = np.array([i for i, _ in counts], "<u4")
    store, root = opened(path)
    store.create_dir(root)
    with store.open_output_stream(f"{root}/ids.u32", compression=None) as out:
        out.write(by_rank.tobytes())
    order = ["id", "n", "tie"]
    rows = tokens.withColumns({"n": F.octet_length("ids"), "tie": F.xxhash64("ids")})
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    write_blocks(rows, path, by_rank, wide, block_bytes).write.parquet(f"{path}/manifest.parquet")
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(id, start, n, ids)`` per document of a dataset folder: the number of
    ids before it, its own number and its ids (little-endian unsigned 32-bit
    integers).  Blocks are read one at a time, in any order; the driver gets
    one row per part."""
    manifest = spark.read.parquet(f"{path}/manifest.parquet")
    parts = sorted(tuple(r) for r in manifest.groupBy("part").agg(F.sum("ids")).collect())
    before, total = [], 0
    for part, n in parts:
        before.append((part, total))
        total += n
    starts = spark.createDataFrame(before, "part int, before long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(path)
        with store.open_input_stream(f"{root}/ids.u32", compression=None) as f:
            by_rank = np.frombuffer(f.read(), "<u4")
        for b in batches:
            for name, offset, size, first in zip(*[c.to_pylist() for c in b.columns]):
                with store.open_input_file(f"{root}/{name}") as f:
                    raw = f.read_at(size, offset)
                magic, docs, n_control, n_data = struct.unpack_from(HEADER, raw)
                if magic != MAGIC or HEADER_BYTES + 17 * docs + n_control + n_data != size:
                    raise ValueError(f"{name}: no block at {offset}")
                at = HEADER_BYTES
                valid = np.frombuffer(raw, np.uint8, docs, at).astype(bool)
                ids = np.frombuffer(raw, "<i8", docs, at + docs)
                counts = np.frombuffer(raw, "<i8", docs, at + 9 * docs)
                at += 17 * docs
                control = np.frombuffer(raw, np.uint8, n_control, at)
                data = np.frombuffer(raw, np.uint8, n_data, at + n_control)
                values = by_rank[decoded(control, data, counts)]
                stops = np.cumsum(counts)
                texts = [values[e - n:e].tobytes() for e, n in zip(stops.tolist(), counts.tolist())]
                yield pa.record_batch([pa.array(ids, mask=~valid), pa.array(first + stops - counts), pa.array(counts),
                                       pa.array(texts, pa.binary())], names=["id", "start", "n", "ids"])

    blocks = manifest.join(starts, "part").select("file", "offset", "bytes", (F.col("first") + F.col("before")).alias("first"))
    return blocks.mapInArrow(run, "id long, start long, n long, ids binary")
