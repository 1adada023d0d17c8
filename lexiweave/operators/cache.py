"""Translation cache as a table (key, t, ts, scope): lookup, split, write, trim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.functions.scalars import SEPARATOR, hash_of

MOST_ENTRIES, MOST_PROFILES = 4_000, 128
PROFILE_AGE = "INTERVAL 7 DAYS"
MOST_RECORD = 16_000


def batch_keys(items: DataFrame, kind: str, fingerprint: Column) -> DataFrame:
    """Adds key: bound to the whole ordered batch and the item's place in it. items: batch, i, pos, text."""
    # A batch is made and hashed once and then opened again, so its texts do not ride on each of its rows.
    rest = [c for c in items.columns if c != "batch"]
    whole = items.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in rest if c != "pos"]))).alias("m"))
    whole = whole.withColumn("bound", F.sha2(F.array_join(F.transform("m", lambda x: x["text"]), SEPARATOR), 256))
    rows = whole.select("batch", "bound", F.posexplode("m").alias("place", "x")).select("batch", "bound", "place", *[F.col("x")[c].alias(c) for c in rest])
    return rows.withColumn("key", hash_of(fingerprint, F.lit(kind), F.col("bound"), F.col("place"), F.col("text"))).select(*items.columns, "key")


def looked_up(items: DataFrame, cache: DataFrame) -> DataFrame:
    """items (key) with t and scope of their entry, nulls where there is none."""
    return items.join(cache.select("key", "t", "scope"), "key", "left")


def all_or_nothing(found: DataFrame) -> DataFrame:
    """Hits count only where every item of the batch hit: adds hit."""
    return found.withColumn("hit", F.bool_and(F.col("t").isNotNull()).over(Window.partitionBy("batch")))


def read_plan(found: DataFrame, bypass: Column, whole: Column) -> DataFrame:
    """Adds cached: never when bypassed, all or nothing for whole pages, item by item else."""
    return all_or_nothing(found).withColumn("cached", ~bypass & F.when(whole, F.col("hit")).otherwise(F.col("t").isNotNull()))


def writable(results: DataFrame) -> DataFrame:
    """Whole batches without failures and with fresh rows only, tagged by whether splits were needed. results: batch, ok, cached, splits."""
    w = Window.partitionBy("batch")
    rows = results.withColumns({"_all": F.bool_and(F.col("ok") & ~F.col("cached")).over(w), "_splits": F.max("splits").over(w)})
    return rows.where("_all").withColumn("scope", F.when(F.col("_splits") > 0, "recovered").otherwise("whole-page")).drop("_all", "_splits")


def upserted(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The newest row of each key."""
    latest = F.max_by(F.struct("t", "scope", "ts"), F.col("ts")).alias("m")
    return cache.unionByName(new).groupBy("key").agg(latest).select("key", "m.t", "m.scope", "m.ts")


def trimmed(cache: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """The most recently used entries; a distributed top-k, not a window over all."""
    return cache.orderBy(F.desc("ts"), "key").limit(most)


def trimmed_by(cache: DataFrame, space: Column, most: int = MOST_PROFILES) -> DataFrame:
    w = Window.partitionBy("_space").orderBy(F.desc("ts"), "key")
    return cache.withColumn("_space", space).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_space", "_n")


def live_profiles(profiles: DataFrame, now: Column) -> DataFrame:
    """Records of the last seven days, none from the future, none too long."""
    return profiles.where((F.col("created_at") <= now) & (F.col("created_at") >= now - F.expr(PROFILE_AGE)) & (F.length("profile") <= MOST_RECORD))


def owned_writes(writes: DataFrame) -> DataFrame:
    """Of all writers of a key only the one that claimed it last may write. writes: key, seq, profile."""
    return writes.groupBy("key").agg(F.max_by("profile", "seq").alias("profile"), F.max("seq").alias("seq"))


def cache_plan(batches: DataFrame, semantic: list[str], page: list[str]) -> DataFrame:
    """Adds fingerprint and how a batch may be read: per_item, or whole. batches: texts (ordered array), use_cache, whole.

    ``semantic`` are the columns that change a translation, ``page`` those of the
    page's context; nulls and blanks differ from each other.
    """
    text = lambda names: F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    meaning = hash_of(text(semantic))
    rows = batches.withColumn("fingerprint", hash_of(meaning, text(page), F.to_json("texts")))
    use, whole = F.coalesce("use_cache", F.lit(False)), F.coalesce("whole", F.lit(False))
    return rows.withColumns({"per_item": use & ~whole, "whole_page": use & whole})


def preflight(pages: DataFrame, cache: DataFrame, now: Column, profiler) -> DataFrame:
    """pages (key, ...) with profile and source: a live cached profile, else what the profiler (a function of the page's columns) makes.

    Pages with one key ask once: the first page of a key owns the request.
    """
    kept = live_profiles(cache, now).groupBy("key").agg(F.max_by("profile", "created_at").alias("kept"))
    known = pages.join(kept, "key", "left")
    asked = known.where("kept IS NULL")
    owner = asked.groupBy("key").agg(F.min_by(F.struct(*[c for c in pages.columns if c != "key"]), "page_id").alias("r"))
    made = owner.select("key", profiler(F.col("r")).alias("made"))
    rows = known.join(made, "key", "left")
    return rows.select(*pages.columns, F.coalesce("kept", "made").alias("profile"), F.when(F.col("kept").isNotNull(), "cache").otherwise("profiler").alias("source"))


def new_profiles(answered: DataFrame, now: Column) -> DataFrame:
    """Rows for the cache of profiles that were asked for: key, created_at, profile; none too long."""
    return answered.where((F.col("source") == "profiler") & F.col("profile").isNotNull() & (F.length("profile") <= MOST_RECORD)).select("key", now.alias("created_at"), "profile").dropDuplicates(["key"])
