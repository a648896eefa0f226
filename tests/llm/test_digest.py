from __future__ import annotations

import hashlib

from shelfmark.llm import digest as G

SCHEMA = "doc_id long, text string, id string, part int, kind string"


def test_counts_are_those_of_the_definition():
    permutation, _ = G._mixers()
    data = bytes(range(60)) * 3
    want = [0] * G.BUCKETS
    for end in range(4, len(data)):
        for salt, (i, j) in enumerate(G.PAIRS):
            x = permutation[salt * 37 & 255]
            for byte in (data[end], data[end - i], data[end - j]):
                x = permutation[int(x) ^ byte]
            want[int(x) & 127] += 1
    assert G.counts_of(data).tolist() == want


def test_counts_do_not_depend_on_the_step(monkeypatch):
    data = bytes(i * 7 % 251 for i in range(5000))
    whole = G.counts_of(data)
    monkeypatch.setattr(G, "BYTES_AT_ONCE", 137)
    assert (G.counts_of(data) == whole).all() and whole.sum() == 6 * (len(data) - 4)


def test_likeness_is_bounded_and_falls_with_edits():
    text = " ".join(f"word{i * 37 % 411}" for i in range(700)).encode()
    own = G.digest(text)
    some = [G.likeness(own, G.digest(text[: len(text) * (10 - k) // 10] + b"other stuff %d " % k * (12 * k))) for k in range(6)]
    assert some[0] == 1.0 and all(0 <= s <= 1 for s in some) and some[1] > some[5]
    assert 0 <= G.difference("00" * 35, "ff" * 35) <= G.MOST
    assert G.digest(b"") == G.digest(b"") and len({len(G.digest(d)) for d in (b"", b"a", b"abcdefg", text)}) == 1


def test_edited_text():
    assert G.edited("abcdefg", "XYZ") == "abcdeXY" and G.edited("abc", "") == "ab" and G.edited("", "xyz") == "" and G.edited("ab", "zzz") == "ab" and G.edited("äöü🙂🙂🙂", "é") == "äöü🙂é"


def _check(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, "row") for r in rows], SCHEMA)
    got = G.fingerprint_chain(docs).collect()
    assert len(got) == len(rows)
    ordered = sorted(rows, key=lambda r: -r[0])
    by = {r.id: r for r in got}
    for i, (key, text) in enumerate(ordered):
        text, following = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        changed = G.edited(text, following).encode()
        r = by[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed).hexdigest())
        assert r.fingerprint == G.digest(text.encode()) and r.edited_fingerprint == G.digest(changed)
        assert r.near_edited == G.likeness(r.fingerprint, r.edited_fingerprint) and r.near_next == G.likeness(r.fingerprint, G.digest(following.encode()))


def test_chain_is_that_of_one_sorted_list(spark):
    rows = [(i * 3 % 101, f"text {i} " * (i % 13)) for i in range(101)] + [(500, None), (501, ""), (502, "long " * 40_000)]
    _check(spark, rows)
    _check(spark, [(1, "alone")])
    _check(spark, [(1, "a b c d e f"), (2, None)])


def test_repeats_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "same text here", "x", 1, "k")] * 3 + [(None, "no id at all", "x", 1, "k")], SCHEMA)
    got = G.fingerprint_chain(docs).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got if r.id == 1}) == 1
    assert G.fingerprint_chain(docs.limit(0)).count() == 0
