from __future__ import annotations

import shutil
from collections import defaultdict

import pytest

from shelfmark.llm import rollup as R
from shelfmark.llm.common import scratch_path
from shelfmark.llm.tokens import default_tokenizer, encoder

SCHEMA = "doc_id long, text string, source string, lang string, tokenizer int, n_tokens string"


def _docs(spark):
    rows = [(i, f"some words number {i} " * (i % 4), f"s{i % 3}" if i % 7 else None, "en" if i % 2 else None) for i in range(40)] + [(99, None, "s0", "en"), (98, "x " * 50_000, "s0", "en"), (5, "repeat", "s1", "en"), (5, "repeat", "s1", "en")]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA), rows


def test_counts_and_totals(spark):
    docs, rows = _docs(spark)
    encode = encoder(default_tokenizer())
    counts = R.token_counts(docs).withColumn("tokenizer", R.F.lit("v1"))
    store = R.Rollup(spark, scratch_path(spark, "rollup-test"))
    assert store.totals().count() == 0
    assert store.commit("a", R.inserted(counts)) is True
    want = defaultdict(lambda: [0, 0, 0])
    for _, text, source, lang in rows:
        t = want[source, lang, "v1"]
        t[0] += 1
        t[1] += len(encode(text or ""))
        t[2] += len(text or "")
    assert {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens, r.n_chars] for r in store.totals().collect()} == dict(want)


def test_batches_commute_and_repeat_safely(spark):
    counts = R.token_counts(_docs(spark)[0]).withColumn("tokenizer", R.F.lit("v1"))
    part = counts.filter("id % 2 = 0")
    new = part.withColumn("old_tokens", R.F.col("n_tokens")).withColumn("n_tokens", R.F.col("n_tokens") + 3)
    steps = {"load": R.inserted(counts), "revise": R.revised(new), "drop": R.deleted(new)}
    sums = []
    for order in (("load", "revise", "drop"), ("drop", "load", "revise")):
        store = R.Rollup(spark, scratch_path(spark, "rollup-test"))
        for name in order:
            assert store.commit(name, steps[name])
        assert not store.commit("load", steps["load"])
        assert store.batches() == ["drop", "load", "revise"]
        sums.append(sorted(map(str, store.totals().collect())))
    left = R._sums(R.inserted(counts.filter("id % 2 = 1"))).collect()
    assert sums[0] == sums[1] == sorted(map(str, left))


def test_a_batch_that_broke_off_is_written_anew(spark):
    counts = R.token_counts(_docs(spark)[0]).withColumn("tokenizer", R.F.lit("v1"))
    store = R.Rollup(spark, scratch_path(spark, "rollup-test"))
    R._sums(R.inserted(counts)).write.parquet(f"{store.path}/deltas/a")  # deltas without a commit
    assert store.totals().count() == 0
    assert store.commit("a", R.inserted(counts))
    assert store.totals().agg(R.F.sum("n_docs")).first()[0] == counts.count()


def test_names_and_empty_tables(spark):
    store = R.Rollup(spark, scratch_path(spark, "rollup-test"))
    empty = R.token_counts(spark.createDataFrame([], SCHEMA)).withColumn("tokenizer", R.F.lit("v1"))
    assert store.commit("none", R.inserted(empty)) and store.totals().count() == 0
    with pytest.raises(ValueError):
        store.commit("../x", R.inserted(empty))


def test_documents_without_a_token_are_counted(spark, tmp_path):
    rows = [(1, "two words", "a", "en"), (2, None, "a", "en"), (3, "", "a", "en"), (4, " \n ", "a", "en"), (5, "", "b", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_chars) for r in R.op9_token_counts(spark, str(tmp_path)).collect()}
    assert got == {(s, lang, t): n for t in ("words-1", "byte-bpe-50k") for (s, lang), n in {("a", "en"): (4, 12), ("b", "de"): (1, 0)}.items()}


def test_snapshots_give_the_same_totals_and_survive_a_broken_compaction(spark, tmp_path):
    def batch(n):
        return spark.createDataFrame([("s", "l", "t", 1, n, n)], R.DELTA)

    store = R.Rollup(spark, f"file://{tmp_path}/store")
    assert not store.compact()
    store.commit("a", batch(1))
    store.commit("b", batch(2))
    assert store.compact() and not store.compact()
    assert not store.commit("a", batch(100))
    store.commit("c", batch(4))
    assert [tuple(r) for r in store.totals().collect()] == [("s", "l", "t", 3, 7, 7)]
    # Broken off after the snapshot became valid: the deltas it took up are still there.
    (tmp_path / "saved").mkdir()
    shutil.copytree(tmp_path / "store/deltas", tmp_path / "saved/deltas")
    assert store.compact()
    shutil.copytree(tmp_path / "saved/deltas", tmp_path / "store/deltas", dirs_exist_ok=True)
    assert [tuple(r) for r in store.totals().collect()] == [("s", "l", "t", 3, 7, 7)]
    store.commit("d", batch(8))
    # Broken off before it became valid: a snapshot without its list does not count.
    (tmp_path / "store/snapshots/000000000003/totals").mkdir(parents=True)
    assert [tuple(r) for r in store.totals().collect()] == [("s", "l", "t", 4, 15, 15)]
    assert store.compact()
    assert [tuple(r) for r in store.totals().collect()] == [("s", "l", "t", 4, 15, 15)]
    assert store.batches() == ["a", "b", "c", "d"]
    assert not any((tmp_path / "store/deltas").iterdir())
