from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfmark.llm import packing as K
from shelfmark.llm.tokens import default_tokenizer, encoder

SCHEMA = "doc_id long, text string, length string, lo int, share int"


def item_by_item(counts, size):
    """Sequences that best-fit decreasing opens, one piece at a time."""
    rooms: list[int] = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - length)
            else:
                rooms.append(size - length)
    return len(rooms)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), max_size=25))
def test_plan_fills_sequences_without_gaps(counts):
    rows = K.plan(counts, 64)
    at: dict[int, dict[int, int]] = {}
    ranks: dict[int, list[int]] = {}
    for length, lo, hi, first, per, offset in rows:
        for r in range(lo, hi):
            ranks.setdefault(length, []).append(r)
            place = at.setdefault(first + (r - lo) // per, {})
            start = offset + (r - lo) % per * length
            assert start not in place
            place[start] = length
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for place in at.values():
        end = 0
        for start in sorted(place):
            assert start == end
            end += place[start]
        assert end <= 64
    assert len(at) == item_by_item(counts, 64)


def test_cut_puts_the_rest_first():
    assert K.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)]
    assert K.cut(2048, 2048) == [(0, 2048)] and K.cut(1, 2048) == [(0, 1)] and K.cut(4096, 2048) == [(0, 2048), (2048, 2048)]


def test_ids_are_those_of_the_reference_tokenizer(spark):
    slow, fast = Tokenizer.from_file(default_tokenizer()), encoder(default_tokenizer())
    texts = ["", "a", "<|endoftext|>", "x<|endoftext|>y", "don't  stop\r\n\t now", "é" * 500, "　日本語 mix 123,456", "a" * 20_000, "\u0000\u0085​﻿", " \n \n"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text in texts:
        assert fast(text).tolist() == slow.encode(text, add_special_tokens=False).ids
    every = [c for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    for text in (f"a{chr(c)}b {chr(c)} 1{chr(c)}" for c in every):
        assert fast(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_other_tokenizer_files_work():
    path = public_tokenizers.path("word_bpe_49k.json")
    assert encoder(path)("Hello there").tolist() == Tokenizer.from_file(path).encode("Hello there", add_special_tokens=False).ids


def _pack(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return docs, K.pack(docs).collect()


def test_round_trip_and_places(spark):
    rows = [(1, None), (2, ""), (3, "word " * 9000), (4, "short text"), (4, "short text"), (None, "no id"), (6, "x" * 5)] + [(i, f"document number {i} " * (i % 40)) for i in range(10, 200)]
    _, got = _pack(spark, rows)
    encode = encoder(default_tokenizer())
    want = Counter((k, tuple([*encode(t or "").tolist(), 0])) for k, t in rows)
    # Equal documents have equal pieces, so the pieces of each are looked for rather than joined.
    pieces = Counter((r.id, r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got)
    expected = Counter()
    for (k, ids), n in want.items():
        for i, (start, length) in enumerate(K.cut(len(ids), 2048)):
            expected[k, i, start, ids[start : start + length]] += n
    assert pieces == expected
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048


def test_digest_column_is_that_of_the_ids(spark):
    docs = spark.createDataFrame([(1, "some words here", "x", 1, 2)], SCHEMA)
    row = K.packed_digests(docs).first()
    ids = np.append(encoder(default_tokenizer())("some words here"), 0).astype("<u4")
    assert row.ids_crc32 == zlib.crc32(ids.tobytes()) and row.length == len(ids)


def test_one_hot_length_is_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(K, "RANKED_TOGETHER", 50)
    parts = spark.range(3000).selectExpr("id", "cast(0 as int) piece", "case when id < 2500 then 7 else id % 5 + 1 end as length")
    got = K.place(parts, 64).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 3000
    assert len({r.sequence_id for r in got}) <= 1.05 * sum(r.length for r in got) / 64 + 1


def test_empty_table(spark):
    assert K.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_document_longer_than_any_sequence_keeps_all_ids(spark):
    _, got = _pack(spark, [(1, "z " * 30_000)])
    assert sum(r.length for r in got) == len(encoder(default_tokenizer())("z " * 30_000)) + 1
    assert [r.length for r in sorted(got, key=lambda r: r.piece)][1:] == [2048] * (len(got) - 1)


@pytest.mark.parametrize("counts", [{}, {1: 1}, {2048: 3}])
def test_small_plans(counts):
    assert sum(r[2] - r[1] for r in K.plan(counts, 2048)) == sum(counts.values())


def test_columns_of_any_name_are_kept(spark):
    names = "share, before, rank, lo, hi, first, per, at, row, sequence_id, offset".split(", ")
    parts = spark.createDataFrame([(i % 5 if i % 7 else None, 0, 100 + i % 9, *range(i, i + len(names))) for i in range(60)], "id long, piece int, length long, " + ", ".join(f"{n} int" for n in names))
    got = K.place(parts)
    assert got.columns == [*parts.columns[:-2], "sequence_id", "offset"]
    rows = got.collect()
    assert sorted(r.share for r in rows) == list(range(60)) and len({(r.sequence_id, r.offset) for r in rows}) == 60
