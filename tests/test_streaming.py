from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

from shelfmark.plans.extract import extract
from shelfmark.plans.samples import PAGES, sample_taxonomy
from shelfmark.sources.stages import shared_folder
from shelfmark.streaming import changes as C
from shelfmark.streaming import events as E
from shelfmark.streaming.ingest import ingest, price_changes, read_pages

SF = "/root/testdata/sf0.001"


def _streamed(spark, build, name, tmp_path):
    static = spark.read.parquet(f"{SF}/events.parquet")
    static.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(static.schema).parquet(str(tmp_path / "in"))
    query = build(stream).writeStream.format("memory").queryName(name).outputMode("complete" if name != "dedup" else "append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(map(tuple, spark.table(name).collect())), sorted(map(tuple, build(static).collect()))


def test_streamed_windows_equal_the_batch(spark, tmp_path):
    got, want = _streamed(spark, lambda e: E.tumbling(e).drop("total"), "tumbling", tmp_path)
    assert got == want and got


def test_streamed_sliding_windows_equal_the_batch(spark, tmp_path):
    got, want = _streamed(spark, lambda e: E.sliding(e).drop("total"), "sliding", tmp_path)
    assert got == want and got


def test_streamed_repeats_are_dropped(spark, tmp_path):
    got, want = _streamed(spark, lambda e: E.distinct_within(e, delay="4000 days").select("event_id"), "dedup", tmp_path)
    assert got == want and got


def test_ingestion_equals_the_batch_plan(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"https://shop.example.com/p/{i}", h) for i, h in PAGES.items() if i in (1, 6)], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "in"))
    folder = Path(shared_folder(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    ingest(read_pages(spark, str(tmp_path / "in")), sample_taxonomy(spark), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert set(folder.iterdir()) == before  # the stage tables of each batch are gone
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = extract(pages, sample_taxonomy(spark))
    assert sorted((r.page_id, r.confidence, r.refused) for r in got.collect()) == sorted((r.page_id, r.confidence, r.refused) for r in want.collect())
    earlier = got.selectExpr("url", "struct(struct(product.price.price + 1 as price) as price) as product").filter("product.price.price is not null")
    assert price_changes(got, earlier).count() == 1


DAY = datetime(2024, 1, 1)
#: Offer, day, price, stock; days arrive in batches of ten.
SEEN = [
    ("a", 0, 5.0, 1.0), ("a", 1, 5.0, 1.0), ("a", 2, 6.0, 1.0), ("a", 3, 6.0, 0.0), ("a", 25, 6.0, 2.0), ("b", 4, 1.0, 1.0), ("b", 11, 1.0, 1.0), ("b", 19, 2.0, 4.0), ("b", 19, 3.0, 4.0), ("c", 28, 9.0, 1.0), ("c", 29, 9.0, 1.0),
    ("d", 0, 7.0, 1.0), ("d", 7, 7.0, 1.0), ("d", 15, 8.0, 1.0), (None, 3, 1.0, 1.0),
]


def _seen(spark, rows):
    return spark.createDataFrame([(o, DAY + timedelta(days=d), p, s) for o, d, p, s in rows], "offer string, at timestamp, price double, stock double")


def test_changes_of_a_stream_are_those_of_the_table(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        table = _seen(spark, SEEN)
        until = DAY + timedelta(days=29)
        want = sorted(map(str, C.changes(C.sightings(table), 7, str(until)).collect()))
        folder = tmp_path / "in"
        folder.mkdir()
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))

        def run():
            query = C.changes_of_stream(stream, 7).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            query.awaitTermination()
            return sorted(map(str, spark.read.schema(C.CHANGE).parquet(str(tmp_path / "out")).collect()))

        for ten in range(3):
            _seen(spark, [r for r in SEEN if r[1] // 10 == ten]).coalesce(1).write.mode("append").parquet(str(folder))
            got = run()
        assert got == want
        assert {r.split("kind=")[1].split(",")[0] for r in got} == {"'new'", "'price'", "'stock'", "'stale'"}
        assert run() == want  # nothing new arrived: nothing is told again
        _seen(spark, [("a", 2, 99.0, 9.0)]).coalesce(1).write.mode("append").parquet(str(folder))
        assert run() == want  # a late row changes nothing
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_first_seen_tells_each_address_once(spark, tmp_path):
    from shelfmark.streaming.ingest import first_seen

    rows = spark.createDataFrame([(f"u{i % 4}", DAY + timedelta(hours=i)) for i in range(12)], "url string, seen_at timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    query = first_seen(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("first").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.url for r in spark.table("first").collect()) == ["u0", "u1", "u2", "u3"]


def test_streams_joined_within_a_time_are_the_batch_join(spark, tmp_path):
    pages = [(f"u{i % 5}", DAY + timedelta(hours=i), i) for i in range(40)]
    offers = [(f"u{i % 7}", DAY + timedelta(hours=i, minutes=30), float(i)) for i in range(0, 40, 2)]
    end = DAY + timedelta(days=30)
    left = spark.createDataFrame(pages, "url string, seen_at timestamp, page int")
    right = spark.createDataFrame(offers, "url string, offered_at timestamp, price double")

    def told(rows):
        return sorted(map(str, rows.filter("url <> 'end'").collect()))

    want = told(E.joined_within(left, right, "url", "seen_at", "offered_at", "3 hours"))
    for name in ("l", "r"):
        (tmp_path / name).mkdir()
    streams = [spark.readStream.schema(t.schema).parquet(str(tmp_path / n)) for n, t in (("l", left), ("r", right))]

    def run():
        query = E.joined_within(*streams, "url", "seen_at", "offered_at", "3 hours", "6 hours").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()

    # Within a batch and five hours between batches rows come late; then both streams say that time has passed.
    for part in range(4):
        left.filter(f"page div 10 = {part}").orderBy("page", ascending=False).coalesce(1).write.mode("append").parquet(str(tmp_path / "l"))
        right.filter(f"floor(price / 10) = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
        run()
    spark.createDataFrame([("end", end, 0)], left.schema).write.mode("append").parquet(str(tmp_path / "l"))
    spark.createDataFrame([("end", end, 0.0)], right.schema).write.mode("append").parquet(str(tmp_path / "r"))
    run()
    run()
    got = told(spark.read.schema(E.joined_within(left, right, "url", "seen_at", "offered_at", "3 hours").schema).parquet(str(tmp_path / "out")))
    assert got == want and any("price=None" in r for r in got) and any("price=None" not in r for r in got)
