"""Chunk translation as one job: cache plan, lookup, provider for what is missing, write-back, merge.

batches: batch, items array<struct<i, text>> in order, whole (context of the
whole page: all or nothing), use_cache, and whatever else changes a translation.
Steps that are expensive to repeat (what was found, what the provider said) are
written under the run's name; a run that died is taken up where it stopped, and
the provider isn't asked again for what it has answered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiweave.functions.scalars import hash_of
from lexiweave.operators import cache as ca
from lexiweave.operators import provider as pr
from lexiweave.sources.cache_table import CacheTable


def keys_of(batches: DataFrame, semantic: list[str], page: list[str], machine: bool = False) -> DataFrame:
    """batch, i, place, text, key, bound, use_cache of each item.

    A key hangs on all that changes the translation: the columns named, and the
    batch's texts in order. Items that are bound to their batch (whole pages and
    machine engines) also hang on their place in it.
    """
    texts = F.transform("items", lambda m: m["text"])
    rows = batches.withColumns({"texts": texts, "whole": F.coalesce("whole", F.lit(False)), "use_cache": F.coalesce("use_cache", F.lit(False))})
    rows = ca.cache_plan(rows, semantic, page).withColumn("bound", F.lit(machine) | F.col("whole"))
    rows = rows.select("batch", "fingerprint", "bound", "use_cache", F.posexplode("items").alias("place", "m"))
    own = hash_of(F.col("fingerprint"), F.lit("item"), F.col("m.text"))
    placed = hash_of(F.col("fingerprint"), F.lit("machine" if machine else "whole-page"), F.col("place"), F.col("m.text"))
    return rows.select("batch", F.col("m.i").alias("i"), "place", F.col("m.text").alias("text"), F.when(F.col("bound"), placed).otherwise(own).alias("key"), "bound", "use_cache")


def found(items: DataFrame, entries: DataFrame) -> DataFrame:
    """items with t of their entry and whether it counts (cached): item by item, or all or nothing where bound."""
    rows = ca.all_or_nothing(ca.looked_up(items, entries).drop("scope"))
    return rows.withColumn("cached", F.col("use_cache") & F.when(F.col("bound"), F.col("hit")).otherwise(F.col("t").isNotNull())).drop("hit")


def missing(rows: DataFrame) -> DataFrame:
    """Batches of what is not cached, in order."""
    m = F.struct("place", "i", "text")
    whole = rows.where(~F.col("cached")).groupBy("batch").agg(F.array_sort(F.collect_list(m)).alias("m"))
    return whole.select("batch", F.transform("m", lambda x: F.struct(x["i"].alias("i"), x["text"].alias("text"))).alias("items"))


def fresh_entries(rows: DataFrame, now: Column) -> DataFrame:
    """Entries to keep: each fresh item, where items stand for themselves; of bound batches only those that are fresh and whole."""
    w = F.bool_and(F.col("ok") & ~F.col("cached"))
    split = F.max(F.when(~F.col("cached"), F.col("splits")))
    by_batch = rows.where("use_cache").groupBy("batch").agg(w.alias("complete"), split.alias("most_splits"))
    kept = rows.where(F.col("use_cache") & F.col("ok") & ~F.col("cached")).join(by_batch, "batch").where(~F.col("bound") | F.col("complete"))
    scope = F.when(F.col("bound"), F.when(F.col("most_splits") > 0, "recovered").otherwise("whole-page"))
    one = kept.groupBy("key").agg(F.min_by(F.struct("t", scope.alias("scope")), F.struct("batch", "i")).alias("m"))  # copies ask for the same
    return one.select("key", "m.t", "m.scope", now.alias("ts"))


class Run:
    """Steps of a job under a name: a step that was written whole is read again instead of worked out."""

    def __init__(self, table: CacheTable, name: str):
        self.table, self.at = table, f"{table.folder}/runs/{name}"

    def step(self, name: str, make) -> DataFrame:
        path = f"{self.at}/{name}"
        if not self.table.files.exists(f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return self.table.spark.read.parquet(path)


def translate_cached(batches: DataFrame, table: CacheTable, provider=None, *, run: str, machine: bool = False, semantic: list[str] = (), page: list[str] = (), now: Column | None = None) -> DataFrame:
    """batch, i, t, ok, cached, attempts (of its batch), asked (whether a request held it) of each item; what is new is in the cache when this returns.

    run names the job: the same name again gives the same rows and calls no
    provider. Entries are merged only if nobody cleared the cache meanwhile.
    """
    job, begun = Run(table, run), table.version()
    known = job.step("found", lambda: found(keys_of(batches, list(semantic), list(page), machine), table.read(begun)).withColumn("generation", F.lit(begun.generation)))
    said = job.step("said", lambda: pr.translate(missing(known), provider, machine))
    said = said.select("batch", "i", F.col("t").alias("new"), F.col("ok").alias("done"), "attempts", "splits", "sent")
    rows = known.join(said, ["batch", "i"], "left")
    rows = rows.withColumns({"t": F.when(F.col("cached"), F.col("t")).otherwise(F.col("new")), "ok": F.col("cached") | F.coalesce("done", F.lit(False))})
    entries = fresh_entries(rows, now if now is not None else F.current_timestamp())
    first = known.select("generation").first()
    if first is not None:
        table.merge(entries, first["generation"], flush=(f"run:{run}", 0))
    return rows.select("batch", "i", "t", "ok", "cached", F.when(F.col("cached"), 0).otherwise(F.col("attempts")).cast("long").alias("attempts"), (~F.col("cached") & F.coalesce("sent", F.lit(False))).alias("asked"))
