"""Benchmark decontamination: prefix-filtered set join (operator 3).

Each benchmark item is cut into windows of ``window`` words (an item of fewer
is one window), a set of shingles each. A document contaminates only where it
contains a window wholly, that is with similarity 1, so the necessary prefix of
a window under the global order by rarity is its rarest shingle (one word; the
rarity is counted over all documents). Document positions join the prefix
shingles; the position of the shingle in the window and the document's length
bound the only place where the window can lie; there the words are compared.

Words: A-Z lower-cased, runs of digits, letters a-z and everything from U+0080.

The prefix table is broadcast in blocks of ``block`` windows at most, each
joined with all documents, so its size has a bound at any benchmark size.

Defined results
* null, empty or wordless text: no words, nothing hit, not contaminated
* null or wordless items have no window; items that repeat count by item_id;
  a null item_id is not counted or listed, though its words are hit
* rows repeating doc_id and text are one document and give one row
* overlapping windows hit a word once; empty benchmark: nothing is hit
* empty documents: empty result; other columns are never read
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.llm.common import keyed, rows_of, with_keys

WINDOW = 13
BLOCK = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN, -1), "")


def item_windows(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: w (words), items (sorted distinct ids)."""
    rows = items.select(F.col(id_col).alias("item"), words_of(F.coalesce(F.col(text_col), F.lit(""))).alias("ws")).where(F.size("ws") > 0)
    starts = F.when(F.size("ws") <= window, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - (window - 1))))
    rows = rows.select("item", "ws", F.explode(starts).alias("s")).select("item", F.slice("ws", F.col("s"), F.lit(window)).alias("w"))
    return rows.groupBy("w").agg(F.array_sort(F.collect_set("item")).alias("items"))


def rarity(words: DataFrame, vocabulary: DataFrame, small: bool) -> DataFrame:
    """Occurrences over all documents of the words of the vocabulary: x, n."""
    seen = words.select(F.explode("ws").alias("x"))
    if small:
        seen = seen.join(F.broadcast(vocabulary), "x", "left_semi").groupBy("x").count()
    else:
        seen = seen.groupBy("x").count().join(vocabulary, "x", "left_semi")
    return vocabulary.join(seen, "x", "left").select("x", F.coalesce("count", F.lit(0)).alias("n"))


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Each window's rarest shingle x and where in it that lies first (at)."""
    each = windows.select("w", "items", F.posexplode("w").alias("at", "x")).join(counts, "x")
    return each.groupBy("w").agg(F.min(F.struct("n", "x", "at")).alias("m"), F.first("items").alias("items")).select(F.col("m.x").alias("x"), F.col("m.at").alias("at"), "w", F.size("w").alias("len"), "items")


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """k, h, n_words, and start, len, items of each occurrence; a row with null start for each document."""
    words = docs.select("k", "h", words_of(F.col("t")).alias("ws"))
    windows = item_windows(benchmark, window)
    n = windows.count()
    vocabulary = windows.select(F.explode("w").alias("x")).distinct()
    table = prefixes(windows, rarity(words, vocabulary, n <= block))
    blocks = max(1, -(-n // block))
    out = None
    for i in range(blocks):
        part = table if blocks == 1 else table.where(F.pmod(F.xxhash64("w"), F.lit(blocks)) == i)
        rows = words.select("k", "h", "ws", F.posexplode_outer("ws").alias("pos", "x")).join(F.broadcast(part), "x", "left")
        start = F.col("pos") - F.col("at")
        held = (start >= 0) & (start + F.col("len") <= F.size("ws"))
        held = F.coalesce(held & F.when(held, F.slice("ws", F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("w")), F.lit(False))
        rows = rows.select("k", "h", F.size("ws").cast("long").alias("n_words"), "pos", held.alias("held"), start.alias("start"), "len", "items")
        rows = rows.where(F.col("held") | F.coalesce(F.col("pos") == 0, F.lit(True)))
        rows = rows.select("k", "h", "n_words", *[F.when(F.col("held"), F.col(c)).alias(c) for c in ("start", "len", "items")])
        out = rows if out is None else out.unionByName(rows)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """A row for each document: doc_id, text_hash, n_words, n_hit, items (array), contaminated."""
    rows = occurrences(keyed(docs, id_col, text_col), benchmark, window, block)
    before = Window.partitionBy("k", "h").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("reach", F.coalesce(F.max(F.col("start") + F.col("len")).over(before), F.lit(0)))
    rows = rows.withColumn("add", F.greatest(F.lit(0), F.col("start") + F.col("len") - F.greatest("start", "reach")))
    rows = rows.withColumn("add", F.when(F.col("start").isNull(), F.lit(0)).otherwise(F.col("add")))
    rows = rows.groupBy("k", "h").agg(F.max("n_words").alias("n_words"), F.sum("add").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return rows.select(F.col("k").alias("doc_id"), F.col("h").alias("text_hash"), "n_words", "n_hit", "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without contaminated rows, all columns as they were."""
    bad = contamination(docs, benchmark, **how).where("contaminated").select(F.col("doc_id").alias("bk"), F.col("text_hash").alias("bh"))
    rows = with_keys(docs, how.get("id_col", "doc_id"), how.get("text_col", "text"))
    return rows_of(rows.join(bad, rows["k"].eqNullSafe(bad["bk"]) & (rows["h"] == bad["bh"]), "left_anti"), docs)
