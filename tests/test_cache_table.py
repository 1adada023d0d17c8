"""The shared cache: versions, conflicts, crashes, generations, and chunk translation over it."""

import pytest
from pyspark.sql import functions as F

from lexiweave.operators import chunks as ch
from lexiweave.operators import provider as pr
from lexiweave.sources.cache_table import CacheTable, flushing

ENTRY = "key string, t string, scope string, ts timestamp"


def entries(spark, *rows):
    return spark.createDataFrame([(k, t, None, s) for k, t, s in rows], "key string, t string, scope string, s long").select("key", "t", "scope", F.timestamp_seconds("s").alias("ts"))


def content(table):
    return {r.key: r.t for r in table.read().collect()}


def test_versions_and_newest_entries(spark, tmp_path):
    table = CacheTable(spark, str(tmp_path / "c"))
    assert content(table) == {} and table.version().number == 0
    table.merge(entries(spark, ("a", "1", 5), ("b", "1", 5)))
    old = table.version()
    table.merge(entries(spark, ("a", "2", 9), ("b", "0", 1), ("c", "3", 1)))
    assert content(table) == {"a": "2", "b": "1", "c": "3"}
    assert {r.key: r.t for r in table.read(old).collect()} == {"a": "1", "b": "1"}  # readers of a version keep it
    small = CacheTable(spark, str(tmp_path / "c"), most=2)
    small.merge(entries(spark, ("d", "4", 7)))
    assert content(small) == {"a": "2", "d": "4"}


def test_a_crash_before_the_swap_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = CacheTable(spark, str(tmp_path / "c"))
    table.merge(entries(spark, ("a", "1", 1)))
    with monkeypatch.context() as m:
        m.setattr(CacheTable, "committed", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            table.merge(entries(spark, ("b", "2", 2)), flush=("w", 1))
    assert content(table) == {"a": "1"} and table.version().number == 1
    table.merge(entries(spark, ("b", "2", 2)), flush=("w", 1))
    again = table.merge(entries(spark, ("b", "9", 9)), flush=("w", 1))  # the same flush once more
    assert content(table) == {"a": "1", "b": "2"} and again.number == 2


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    """The other writer commits between this one's read and its swap: nothing is lost."""
    table, other = (CacheTable(spark, str(tmp_path / "c")) for _ in range(2))
    plain, first = CacheTable.written, []

    def written(self, rows):
        if self is table and not first:
            first.append(other.merge(entries(spark, ("theirs", "1", 1))))
        return plain(self, rows)

    monkeypatch.setattr(CacheTable, "written", written)
    table.merge(entries(spark, ("mine", "1", 1)))
    assert content(table) == {"theirs": "1", "mine": "1"} and table.version().number == 2


def test_late_writers_of_a_cleared_cache(spark, tmp_path):
    table = CacheTable(spark, str(tmp_path / "c"))
    table.merge(entries(spark, ("a", "1", 1)))
    begun = table.version().generation
    table.clear()
    assert content(table) == {} and table.merge(entries(spark, ("b", "1", 1)), begun) is None and content(table) == {}
    assert table.merge(entries(spark, ("b", "1", 1)), table.version().generation) and content(table) == {"b": "1"}


def test_stream_of_flushes(spark, tmp_path):
    table = CacheTable(spark, str(tmp_path / "c"))
    for i in range(3):
        entries(spark, (f"k{i}", f"t{i}", i), ("same", f"t{i}", i)).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    stream.writeStream.foreachBatch(flushing(table, "q")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert content(table) == {"k0": "t0", "k1": "t1", "k2": "t2", "same": "t2"} and table.version().flushes == {"q": 2}
    flushing(table, "q")(entries(spark, ("same", "late", 99)), 2)  # the engine tries the last batch again
    assert content(table)["same"] == "t2"


class Silent:
    """A provider that must not be asked."""

    def complete(self, items):
        raise AssertionError("asked")

    translate = complete


def batches(spark):
    rows = [(1, [(1, "one a"), (2, "two b")], False, True), (2, [(18, "three"), (19, "four")], True, True), (3, [(17, "bad"), (20, "good")], False, True), (4, [(34, "bad"), (21, "good")], True, True), (5, [(22, "five"), (23, "six")], False, False), (6, [(1, "one a"), (2, "two b")], False, True)]
    return spark.createDataFrame(rows, "batch long, items array<struct<i:long,text:string>>, whole boolean, use_cache boolean")


def told(df):
    return sorted((r.batch, r.i, r.t, r.ok, r.cached, r.attempts > 0) for r in df.collect())


def test_second_run_asks_only_for_what_failed(spark, tmp_path):
    table = CacheTable(spark, str(tmp_path / "c"))
    first = told(ch.translate_cached(batches(spark), table, run="a", semantic=["whole"]))
    assert [x[3] for x in first] == [True, True, True, True, False, True, True, False, True, True, True, True] and not any(x[4] for x in first)
    assert table.read().count() == 5  # two items of copies, two whole, one by itself; nothing of the spoilt whole batch or without cache
    second = told(ch.translate_cached(batches(spark), table, run="b", semantic=["whole"]))
    assert [x[:4] for x in second] == [x[:4] for x in first]
    assert {(b, i): c for b, i, _, _, c, _ in second} == {(1, 1): True, (1, 2): True, (2, 18): True, (2, 19): True, (3, 17): False, (3, 20): True, (4, 21): False, (4, 34): False, (5, 22): False, (5, 23): False, (6, 1): True, (6, 2): True}
    good = batches(spark).where("batch IN (1, 2, 6)")
    assert all(c and not asked for *_, c, asked in told(ch.translate_cached(good, table, Silent(), run="c", semantic=["whole"])))
    other = good.withColumn("target", F.lit("de"))  # another language finds nothing
    assert not any(x[4] for x in told(ch.translate_cached(other, table, run="d", semantic=["whole", "target"])))


def test_machine_batches_are_all_or_nothing(spark, tmp_path):
    table = CacheTable(spark, str(tmp_path / "c"))
    assert len(told(ch.translate_cached(batches(spark), table, run="a", machine=True))) == 12
    again = told(ch.translate_cached(batches(spark).where("use_cache"), table, Silent(), run="b", machine=True))
    assert all(x[4] for x in again)
    changed = batches(spark).where("batch = 1").withColumn("items", F.expr("array(items[1], items[0])"))
    assert not any(x[4] for x in told(ch.translate_cached(changed, table, run="c", machine=True)))


def test_a_run_that_died_is_taken_up(spark, tmp_path, monkeypatch):
    """It dies after the provider has answered: taken up, it asks nobody and loses and doubles nothing."""
    table = CacheTable(spark, str(tmp_path / "c"))
    with monkeypatch.context() as m:
        m.setattr(CacheTable, "committed", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            ch.translate_cached(batches(spark), table, run="a")
    assert table.version().number == 0
    got = told(ch.translate_cached(batches(spark), table, Silent(), run="a"))
    assert len(got) == 12 and table.version().number == 1 and table.read().count() == 5
    assert got == told(ch.translate_cached(batches(spark), table, Silent(), run="a")) and table.version().number == 1
    assert pr.MOST_ATTEMPTS == 9 and all(r.attempts <= 9 for r in ch.translate_cached(batches(spark), table, run="z").collect())


def test_too_long_items_are_not_asked(spark, tmp_path):
    """An item beyond the limit is never in a request, whatever its batch has asked; its neighbours are."""
    rows = [(1, [(1, "one"), (2, "x" * 13_000), (3, "three")], False, True), (2, [(4, "four"), (5, "y" * 13_000)], True, True), (3, [(6, "z" * 13_000)], False, True)]
    frame = spark.createDataFrame(rows, batches(spark).schema)
    table = CacheTable(spark, str(tmp_path / "c"))
    got = {r.i: (r.ok, r.asked) for r in ch.translate_cached(frame, table, run="a").collect()}
    assert got == {1: (True, True), 2: (False, False), 3: (True, True), 4: (True, True), 5: (False, False), 6: (False, False)}
    again = {r.i: (r.cached, r.asked) for r in ch.translate_cached(frame, table, run="b").collect()}
    assert again == {1: (True, False), 2: (False, False), 3: (True, False), 4: (False, True), 5: (False, False), 6: (False, False)}
