"""Lifecycle and diagnostic logs: rings, windows of evidence, usage, streaks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.streaming.flows import shared_folder

RING, SHORT_RING, STOP_AFTER = 240, 80, 3
#: Rows of a range that is numbered in one task, and of a block of a log.
MOST_IN_RANGE, BLOCK = 1_000_000, 100_000
TRANSLATIONS, PREFLIGHTS = ("translate-chunk", "translate-failed"), ("preflight", "preflight-failed")


def numbered(rows: DataFrame, key: str, order: tuple[str, ...], most: int = MOST_IN_RANGE) -> DataFrame:
    """Adds n: the place of each row in its log, from 1 on, by order (unique in a log, or ties are in no order).

    A log may hold any share of all rows: rows are dealt out by ranges of (log,
    order) of about ``most`` rows, numbered in each, and each range begins where
    the counts of those before it end. The ranges are written down first, as
    their bounds are sampled and a lost range must come back the same.
    """
    parts = -(-rows.count() // most)
    if parts <= 1:
        return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))
    at = f"{shared_folder(rows.sparkSession)}/ranges/{uuid.uuid4().hex}"
    rows.repartitionByRange(parts, key, *order).withColumn("_range", F.spark_partition_id()).write.parquet(at)
    dealt = rows.sparkSession.read.parquet(at)
    counts = dealt.groupBy(key, "_range").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(key).orderBy("_range")) - F.col("_rows")
    starts = counts.select(F.col(key).alias("_key"), F.col("_range").alias("_at"), before.alias("_before"))
    place = F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order))
    joined = dealt.join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_at")))
    return joined.withColumn("n", (place + F.col("_before")).cast("long")).select(*rows.columns, "n")


def ring(log: DataFrame, most: int = RING) -> DataFrame:
    """The last so many rows of each log."""
    return log.withColumn("_r", F.row_number().over(Window.partitionBy("log_id").orderBy(F.desc("n")))).where(F.col("_r") <= most).drop("_r")


def ring_state(log: DataFrame, most: int = RING) -> DataFrame:
    """Rows kept and dropped of each log, from its counters alone."""
    out = log.groupBy("log_id").agg(F.max("n").alias("sequence"), F.count("*").alias("rows"))
    return out.select("log_id", "sequence", F.least("rows", F.lit(most)).alias("kept"), (F.col("sequence") - F.least("rows", F.lit(most))).alias("dropped"))


def after_watermark(log: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows behind the copied watermark (log_id, through) of their own log; logs without one stay whole."""
    return log.join(marks, "log_id", "left").where(F.col("through").isNull() | (F.col("n") > F.col("through"))).drop("through")


def complete_sum(x: Column, of: Column, complete: Column) -> Column:
    """The sum over rows ``of``; null when a value is missing or negative or the window is not complete."""
    sound = F.bool_and(F.when(of, x.isNotNull() & (x >= 0)))
    return F.when(complete & F.coalesce(sound, F.lit(True)), F.coalesce(F.sum(F.when(of, x)), F.lit(0)))


def log_window(log: DataFrame) -> DataFrame:
    """A row for each log: counts by event and sums that are null rather than wrong."""
    e = F.col("event")
    translation, request = e.isin(*TRANSLATIONS), e.isin(*TRANSLATIONS, *PREFLIGHTS)
    whole = F.max("n") <= RING
    return log.groupBy("log_id").agg(
        (~whole).alias("incomplete"), F.count_if(e == "session-open").alias("session_opens"), F.count_if(e == "translate-chunk").alias("chunks"),
        F.count_if((e == "translate-chunk") & F.col("hit")).alias("cache_hit_chunks"), complete_sum(F.col("requests"), translation, whole).alias("translation_requests"),
        complete_sum(F.col("requests"), request, whole).alias("provider_requests"), complete_sum(F.col("failed"), translation, whole).alias("failed_units"),
        F.array_join(F.array_sort(F.collect_set(F.when(request, F.col("category")))), ",").alias("categories"),
    )


def restarts(log: DataFrame) -> DataFrame:
    """log_id, restarted: true with two epochs; false if anchored and complete; else unknown."""
    anchored = F.bool_or(F.col("event").isin("capture-start", "worker-start", "session-open") & F.col("epoch").isNotNull())
    return log.groupBy("log_id").agg(F.when(F.countDistinct("epoch") > 1, True).when(anchored & (F.max("n") <= RING), False).alias("restarted"))


def usage(calls: DataFrame) -> DataFrame:
    """Tokens by phase and in all (phase null), incomplete if any part is unknown. calls: phase, input, output."""
    return calls.rollup("phase").agg(F.coalesce(F.sum("input"), F.lit(0)).alias("input"), F.coalesce(F.sum("output"), F.lit(0)).alias("output"), F.bool_or(F.col("input").isNull() | F.col("output").isNull()).alias("incomplete"))


def attempts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("reason").agg(F.count("*").alias("n"))


def streaks(log: DataFrame, stop_after: int = STOP_AFTER, block: int = BLOCK) -> DataFrame:
    """Runs of the same error in a log with nothing else between: log_id, category, first, length, stops.

    Runs are found in blocks of a log. Only the first and the last run of a
    block can go on in a neighbour, so only these meet the other blocks' ones.
    """
    blocks = log.select("log_id", "n", "category", F.floor((F.col("n") - 1) / block).alias("block"))
    within = Window.partitionBy("log_id", "block").orderBy("n")
    fresh = lambda w: F.when(F.row_number().over(w) == 1, 1).when(F.col("category").eqNullSafe(F.lag("category").over(w)), 0).otherwise(1)
    rows = blocks.withColumn("new", fresh(within)).withColumn("run", F.sum("new").over(within))
    runs = rows.groupBy("log_id", "block", "run", "category").agg(F.min("n").alias("first"), F.count("*").alias("length"))
    last = F.max("run").over(Window.partitionBy("log_id", "block"))
    runs = runs.withColumn("edge", (F.col("run") == 1) | (F.col("run") == last))
    inner = runs.where("NOT edge AND category IS NOT NULL").select("log_id", "category", "first", "length")
    along = Window.partitionBy("log_id").orderBy("first")
    goes_on = F.col("category").eqNullSafe(F.lag("category").over(along)) & (F.lag(F.col("first") + F.col("length")).over(along) == F.col("first"))
    edges = runs.where("edge").withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("chain", F.sum("new").over(along))
    whole = edges.where("category IS NOT NULL").groupBy("log_id", "chain", "category").agg(F.min("first").alias("first"), F.sum("length").alias("length"))
    out = inner.unionByName(whole.select("log_id", "category", "first", "length"))
    return out.withColumn("stops", F.col("length") >= stop_after)


def merged_runtime(batches: DataFrame) -> DataFrame:
    """Counters summed and flags or-ed over a page's batches."""
    return batches.groupBy("page_id").agg(F.sum("requests").alias("requests"), F.sum("splits").alias("splits"), F.bool_or("hit").alias("hit"), F.bool_or("incomplete").alias("incomplete"))


COUNTS = ("total", "done", "failed", "inflight", "headings", "source_chars", "hard", "risky", "batches")


def diagnostic(page: DataFrame, engine: Column, *parts: DataFrame) -> DataFrame:
    """One row for each page, of its parts (page_id and their fields). A page without a part has counts of zero; sums and rates stay unknown."""
    out = page.withColumn("engine", engine)
    for part in parts:
        out = out.join(part, "page_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in COUNTS if c in out.columns} | {"has_profile": F.coalesce("has_profile", F.lit(False))})


def authorized(requests: DataFrame) -> DataFrame:
    """Adds outcome to requests: ok, session-expired or no-permission.

    requests: session, at, kind (open, request), permitted. A request needs a
    session that was opened; one without permission closes its session, so the
    ones behind it are refused until it is opened again.
    """
    before = Window.partitionBy("session").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.max(F.when(F.col("kind") == "open", F.col("at"))).over(before)
    closed = F.max(F.when((F.col("kind") == "request") & ~F.coalesce("permitted", F.lit(False)), F.col("at"))).over(before)
    alive = opened.isNotNull() & (closed.isNull() | (opened > closed))
    rows = requests.withColumn("outcome", F.when(~alive, "session-expired").when(~F.coalesce("permitted", F.lit(False)), "no-permission").otherwise("ok"))
    return rows.where("kind = 'request'")
