"""Token output against the tokenizer on whole texts, and exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logtab.llm import queries, tokens

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"


def brute(rows, path=WORD_BPE, end=(2,)):
    """(id, start, n, crc) over all rows in order."""
    t = Tokenizer.from_file(path)
    coded = [(i, [*t.encode(x or "", add_special_tokens=False).ids, *end]) for i, x in rows]
    coded = [(i, np.array(ids, "<u4").tobytes()) for i, ids in coded]
    out, start = [], 0
    for i, raw in sorted(coded, key=lambda c: (c[0] is not None, c[0] or 0, len(c[1]))):
        out.append((i, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    return out


def result(spark, docs, path=WORD_BPE, **kw):
    back = tokens.read_tokens(spark, tokens.write_tokens(docs, path, **kw)).collect()
    return sorted(((r.id, r.start, r.n, zlib.crc32(r.ids)) for r in back), key=lambda r: r[1])


def sample():
    rng = random.Random(3)
    words = ["the", "Über", "İstanbul", "don't", "42", "$$$", "naïve", "中文字", "<|endoftext|>", "\x1cx", "Σας", "á"]
    texts = [rng.choice([" ", "\n", "  ", " "]).join(rng.choices(words, k=rng.choice([1, 3, 40]))) for _ in range(40)]
    return list(zip(rng.sample(range(1000), 40), texts))


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_whole_texts(spark, path):
    rows = sample() + [(2001, ""), (2002, None), (2003, " \n "), (2004, "word " * 50_000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(spark, docs, path) == brute(rows, path)


def test_many_blocks_without_end_id(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, SCHEMA)
    assert result(spark, docs, block_bytes=64, end_id=None) == brute(rows, end=())


def test_ties_nulls_repeats_and_extra_columns(spark):
    rows = [(5, "b b b"), (5, "a"), (None, "none"), (7, "same"), (7, "same")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], SCHEMA + ", id int, n int")
    assert result(spark, docs) == brute(rows)


def test_empty_table(spark):
    assert result(spark, spark.createDataFrame([], SCHEMA)) == []


def test_long_texts_are_cut_where_no_id_spans(monkeypatch):
    words = tokens.Words(WORD_BPE)
    texts = [t for _, t in sample()]
    whole = words.encode(texts)
    monkeypatch.setattr(tokens, "PIECE_CHARS", 3)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 2)
    assert tokens.Words(WORD_BPE).encode(texts) == whole


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(), max_size=4))
def test_pieces_give_the_ids_of_the_text(texts):
    words = tokens.words(WORD_BPE)
    want = [np.array(words.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert words.encode(texts) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1))), max_size=6))
def test_code_round_trip(docs):
    values = np.array([v for d in docs for v in d], np.uint32)
    counts = np.array([len(d) for d in docs], np.int64)
    control, data, sizes = tokens.encoded(values, counts)
    assert len(control) == sum(-(-len(d) // 4) for d in docs)
    assert sizes.tolist() == [sum(max(1, -(-v.bit_length() // 8)) for v in d) for d in docs]
    assert tokens.decoded(control, data, counts).tolist() == values.tolist()


def test_frequent_ids_get_small_ranks(spark):
    docs = spark.createDataFrame([(1, "rare " + "common " * 9)], SCHEMA)
    path = tokens.write_tokens(docs, WORD_BPE)
    store, root = tokens.opened(path)
    by_rank = np.frombuffer(store.open_input_file(f"{root}/ids.u32").read(), "<u4")
    assert by_rank[0] == Tokenizer.from_file(WORD_BPE).encode("common", add_special_tokens=False).ids[0]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    got = sorted(tuple(r) for r in queries.op11_tokens(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == brute(rows)
