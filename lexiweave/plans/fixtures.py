"""Ordered units, translations, settings and logs derived from the supplied tables, for queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.functions.text import normalize
from lexiweave.operators.logs import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Places of a page's lines among unit ids, and of its batches of four lines among batch ids.
LINES, BATCHES = 2**31, 2**29
BATCH = "page_id * 536870912 + pos // 4"


def batch_of(page: Column, pos: Column) -> Column:
    """The batch of a line: four lines of one page, never of two."""
    return page * BATCHES + F.floor(pos / 4)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents: page_id, unit_id, pos, lang, tag, role, mode, text.

    Documents are dealt out by page before their lines come apart, so whatever
    works on pages afterwards needs no shuffle of its own, and the work on lines
    spreads however few files or row groups hold the documents.

    Unit ids keep LINES places for each page, more than a text can have lines, so
    two pages never share one; a page id too large for that is an overflow error.
    """
    lines = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").repartition("doc_id").select(F.col("doc_id").alias("page_id"), "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "raw"))
    lines = lines.select("page_id", (F.col("page_id") * LINES + F.col("pos")).alias("unit_id"), F.col("pos").cast("long").alias("pos"), "lang", normalize(F.col("raw")).alias("text")).where("text <> ''")
    tag = F.when(F.col("pos") == 0, "H1").when(F.col("pos") % 6 == 3, "H2").when(F.col("pos") % 6 == 4, "LI").otherwise("P")
    lines = lines.withColumn("tag", tag)
    return lines.withColumns({"role": F.when(F.col("tag").isin("H1", "H2"), "heading").otherwise("body"), "mode": F.when(F.col("tag") == "LI", "append").otherwise("after")})


UNITS = r"""
lines0 AS (SELECT doc_id AS page_id, lang, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
lines1 AS (SELECT page_id, page_id * 2147483648 + pos AS unit_id, pos, lang, trim(regexp_replace(replace(regexp_replace(raw, '[\t\r\n]+', ' ', 'g'), chr(160), ' '), '\s{2,}', ' ', 'g')) AS text FROM lines0),
lines2 AS (SELECT *, CASE WHEN pos = 0 THEN 'H1' WHEN pos % 6 = 3 THEN 'H2' WHEN pos % 6 = 4 THEN 'LI' ELSE 'P' END AS tag FROM lines1 WHERE text <> ''),
units AS (SELECT *, CASE WHEN tag IN ('H1', 'H2') THEN 'heading' ELSE 'body' END AS role, CASE WHEN tag = 'LI' THEN 'append' ELSE 'after' END AS mode FROM lines2)"""


def translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """units with the mock provider's state and translation t: upper case behind a mark, with misses."""
    state = F.when(F.col("unit_id") % 11 == 0, "failed").when(F.col("unit_id") % 17 == 0, "pending").otherwise("done")
    t = F.concat(F.lit("[fr] "), F.when(F.col("unit_id") % 7 == 0, F.lower("text")).otherwise(F.upper(F.replace("text", F.lit("ß"), F.lit("ss")))))
    return units(spark, sf_dir).withColumns({"state": state, "t": t})


TRANSLATED = UNITS + r""",
translated AS (SELECT *, CASE WHEN unit_id % 11 = 0 THEN 'failed' WHEN unit_id % 17 = 0 THEN 'pending' ELSE 'done' END AS state,
  '[fr] ' || CASE WHEN unit_id % 7 = 0 THEN lower(text) ELSE upper(replace(text, 'ß', 'ss')) END AS t FROM units)"""


def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, term, target, kind: the profile's terms, from words of the benchmark items."""
    word = F.regexp_extract("text", r"([A-Za-z]{4,})", 1)
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), F.lower(word).alias("term")).where("term <> ''")
    rows = rows.groupBy("term").agg(F.min("pos").alias("pos"))
    kind = F.when(F.col("pos") % 3 == 0, "locked").when(F.col("pos") % 3 == 1, "suggested").otherwise("risky")
    return rows.select("pos", "term", F.upper("term").alias("target"), kind.alias("kind"))


CONTRACT = r"""
contract AS (SELECT min(item_id) AS pos, lower(regexp_extract(text, '([A-Za-z]{4,})', 1)) AS term, upper(lower(regexp_extract(text, '([A-Za-z]{4,})', 1))) AS target,
  CASE WHEN min(item_id) % 3 = 0 THEN 'locked' WHEN min(item_id) % 3 = 1 THEN 'suggested' ELSE 'risky' END AS kind
  FROM benchmark WHERE regexp_extract(text, '([A-Za-z]{4,})', 1) <> '' GROUP BY ALL)"""


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a lifecycle log: log_id (day), n, stamp, event, requests, failed, epoch, hit, category, bytes."""
    e = table(spark, sf_dir, "events")
    name = F.when(F.col("event_type") == "purchase", "translate-chunk").when(F.col("event_type") == "error", "translate-failed").when(F.col("event_type") == "signup", "session-open").when(F.col("event_type") == "click", "preflight").otherwise("heartbeat")
    k = F.get_json_object("props", "$.k").cast("long")
    category = F.when(F.col("event_type") == "error", F.when(k % 3 == 0, "timeout").when(k % 3 == 1, "rate-limit").otherwise("network"))
    rows = e.select("event_id", F.col("ts").cast("timestamp").alias("stamp"), "user_id", name.alias("event"), k.alias("k"), category.alias("category"))
    rows = rows.withColumns({"log_id": F.date_format("stamp", "yyyy-MM-dd"), "requests": F.when(F.col("k") % 50 != 7, F.col("k") % 4), "failed": F.col("k") % 3, "epoch": F.concat(F.lit("e"), F.floor(F.col("event_id") / 997)), "hit": F.col("k") % 5 == 0})
    return numbered(rows, "log_id", ("stamp", "event_id"))


LIFECYCLE = r"""
life0 AS (SELECT event_id, ts AS stamp, user_id, CASE event_type WHEN 'purchase' THEN 'translate-chunk' WHEN 'error' THEN 'translate-failed' WHEN 'signup' THEN 'session-open' WHEN 'click' THEN 'preflight' ELSE 'heartbeat' END AS event,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events),
lifecycle AS (SELECT event_id, stamp, user_id, event, k, CASE WHEN event_type = 'error' THEN CASE k % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'rate-limit' ELSE 'network' END END AS category,
  strftime(stamp, '%Y-%m-%d') AS log_id, CASE WHEN k % 50 <> 7 THEN k % 4 END AS requests, k % 3 AS failed, 'e' || (event_id // 997) AS epoch, k % 5 = 0 AS hit,
  row_number() OVER (PARTITION BY strftime(stamp, '%Y-%m-%d') ORDER BY stamp, event_id) AS n FROM life0)"""
