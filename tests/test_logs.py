"""Numbers and streaks of logs that are cut into ranges and blocks, against one window over each log."""

import itertools
import random

from pyspark.sql import functions as F

from lexiweave.operators import logs as lo


def events(spark):
    """One log holds most rows, some stamps repeat, one log has no name."""
    r = random.Random(4)
    rows = [(r.choice(["hot"] * 6 + ["b", None]), r.randint(0, 40), i, r.choice([None, "x", "x", "x", "y"])) for i in range(700)]
    return rows, spark.createDataFrame(rows, "log_id string, stamp long, event_id long, category string").repartition(5)


def test_numbers_of_ranges(spark):
    rows, frame = events(spark)
    want = {}
    for _, members in itertools.groupby(sorted(rows, key=lambda x: (x[0] or "", x[1], x[2])), key=lambda x: x[0] or ""):
        want |= {x[2]: n for n, x in enumerate(members, 1)}
    for most in (7, 100, 10_000):
        got = lo.numbered(frame, "log_id", ("stamp", "event_id"), most)
        assert got.columns == [*frame.columns, "n"] and {r.event_id: r.n for r in got.collect()} == want
    assert lo.numbered(frame.limit(0), "log_id", ("stamp", "event_id"), 7).count() == 0


def test_streaks_over_blocks(spark):
    _, frame = events(spark)
    log = lo.numbered(frame.where("log_id IS NOT NULL"), "log_id", ("stamp", "event_id")).cache()
    want = []
    members = sorted(((r.log_id, r.n, r.category) for r in log.collect()))
    for (name, category), run in itertools.groupby(members, key=lambda x: (x[0], x[2])):
        run = list(run)
        if category:
            want.append((name, category, run[0][1], len(run), len(run) >= 3))
    for block in (1, 2, 5, 64, 100_000):
        got = sorted((r.log_id, r.category, r["first"], r.length, r.stops) for r in lo.streaks(log, block=block).collect())
        assert got == sorted(want), block
    long = log.withColumn("category", F.lit("same"))
    assert sorted(r.length for r in lo.streaks(long, block=3).collect()) == sorted(r["count"] for r in long.groupBy("log_id").count().collect())
