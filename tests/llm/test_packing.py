import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hushframe.llm import packing, queries

TEXTS = ["a b c", "", None, "word " * 3000, "naïve café 😀 " * 40, "x" * 5000, "<|endoftext|> in a text", "a b c"]


def ids_of(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(packing.default_tokenizer()).encode(text or "", add_special_tokens=False).ids, 0]


def test_pieces_rebuild_every_document(spark):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(None, "no id", 1), (0, "a b c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    found = packing.pack(docs.coalesce(1), capacity=64).collect()
    by_doc, by_seq = {}, {}
    for r in found:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length
    for i, text in enumerate(TEXTS):
        want = ids_of(text)
        pieces = sorted(by_doc[i, len(want)], key=lambda r: r.start)
        got = np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces]).tolist()
        assert got == want * (2 if i == 0 else 1) or i == 0 and sorted(got) == sorted(want * 2)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == pieces[0].sequence_tokens <= 64


def test_padding_is_small_and_reruns_agree(spark):
    docs = spark.createDataFrame([(i, "some words of a text " * (i % 400)) for i in range(800)], "doc_id long, text string").coalesce(2)
    a, b = (packing.pack(docs, capacity=1024).collect() for _ in range(2))
    assert a == b
    used, sequences = sum(r.length for r in a), len({r.sequence_id for r in a})
    assert used / (1024 * sequences) > 0.96


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_windows_hold_each_item_once(sizes):
    dealt = packing.windows_for(sizes, 100)
    assert sorted(i for items in dealt for i in items) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in items) <= 100 for items in dealt)


def test_differencing_is_near_equal():
    sums = [sum(s) for s in ([[8, 7, 6, 5, 4][i] for i in items] for items in packing.difference([8, 7, 6, 5, 4], 2))]
    assert sorted(sums) == [14, 16]


def test_query_carries_the_checksum(spark):
    rows = queries.op1_packing(spark, "/root/testdata/sf0.001").filter("start = 0").limit(5).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows:
        want = np.array(ids_of(texts[r.doc_id])[: r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(want) and r.doc_tokens == len(ids_of(texts[r.doc_id]))


@pytest.mark.parametrize("text", ["<|endoftext|>", "a <|endoftext|>b", "plain"])
def test_special_strings_as_the_exact_library(text):
    assert [*packing.encoder(packing.default_tokenizer())(text), 0] == ids_of(text)


def test_the_query_against_the_exact_tokenizer(spark):
    """All of the query's rows: every id of every document in one piece, by the tokenizer itself; sequences gapless, full, and few."""
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.default_tokenizer())
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ids = {d: [*exact.encode(t, add_special_tokens=False).ids, 0] for d, t in docs.items()}
    pieces, sequences = {}, {}
    for r in queries.op1_packing(spark, "/root/testdata/sf0.001").collect():
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(own) == r.length > 0 and r.ids_crc32 == zlib.crc32(own.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for found, total in [(p, len(ids[d])) for d, p in pieces.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert at == total if total is not None else at <= 1024
    tokens = sum(map(len, ids.values()))
    assert len(sequences) <= 1.05 * tokens / 1024 + 8
