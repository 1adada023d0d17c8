"""Line dedup: winnowing over line hashes (operator 1).

The lines of a text that have words form a sequence. A window is the fewest
whole lines from a line on that have ``min_words`` words together. Of each
window the smallest line hash (the last of equals) is selected, and neighbouring
windows mostly select the same line: only these positions are kept as
fingerprints, each with its reach, the windows that selected it. Two equal
windows select the same line of theirs, so every repeated run of ``min_words``
words has a fingerprint that its earlier copy has too.

Fingerprints are joined by hash. Where two have the same reach, the match
extends over the whole of it to both sides, and the later one goes wholly.
Where their reaches differ, the match extends to the windows that both have:
only first occurrences of reaches whose fingerprint has several are opened up
for that. Overlapping matches grow into runs. Of each run the first occurrence,
by (id, line), stays and later ones go. No pairs within a group are made: a
reach that occurs n times yields n - 1 matches.

Defined results
* null or empty text: one empty line, nothing removed
* repeated runs within one document count like those of two documents
* rows repeating id and text are one document: each row gets its result
* texts of fewer than ``min_words`` words have no window and stay as they are
* lines without words stay, but for those inside a removed run
* empty table: empty result; extra columns pass through ``dedup_lines``, but
  for ones named like a result column, which the result replaces
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.llm.common import keyed, stored

MIN_WORDS = 8


def line_windows(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each window: k, h, first, last (line numbers), x, place (hash and number of the line it selects), w1, w2 (hashes of its lines)."""
    lines = docs.select("k", "h", F.posexplode(F.split("t", "\n", -1)).alias("pos", "line"))
    lines = lines.select("k", "h", "pos", F.xxhash64("line").alias("x"), F.length("line").alias("n"), F.regexp_count("line", F.lit(r"[^ \t-\r]+")).cast("long").alias("wc")).where("wc > 0")
    lines = lines.repartition("k", "h").groupBy("k", "h", "pos").agg(F.first("x").alias("x"), F.first("n").alias("n"), F.first("wc").alias("wc"))
    before = Window.partitionBy("k", "h").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("s", F.coalesce(F.sum("wc").over(before), F.lit(0)))
    ahead = Window.partitionBy("k", "h").orderBy("s").rangeBetween(0, min_words - 1)
    lines = lines.select(
        "k", "h", F.col("pos").alias("first"), F.max("pos").over(ahead).alias("last"), F.sum("wc").over(ahead).alias("words"),
        F.min(F.struct("x", (-F.col("pos")).alias("back"))).over(ahead).alias("least"), F.collect_list(F.struct("x", "n")).over(ahead).alias("all"),
    )
    return lines.where(F.col("words") >= min_words).select("k", "h", "first", "last", F.col("least.x").alias("x"), (-F.col("least.back")).alias("place"), F.xxhash64("all").alias("w1"), F.hash("all").alias("w2"))


def fingerprints(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each selected line: k, h, x (its hash), lo, hi (the lines it reaches over), c1, c2 (hashes of its windows), wins (these, where there are several)."""
    windows = line_windows(docs, min_words)
    wins = F.array_sort(F.collect_list(F.struct("first", "last", "w1", "w2")))
    rows = windows.groupBy("k", "h", "place", "x").agg(wins.alias("wins"), F.max("last").alias("hi"))
    rows = rows.select("k", "h", "x", F.col("wins")[0]["first"].alias("lo"), "hi", F.xxhash64("wins.w1").alias("c1"), F.hash("wins.w2").alias("c2"), F.when(F.size("wins") > 1, F.col("wins")).alias("wins"), F.col("wins")[0].alias("win"))
    return rows.select("k", "h", "x", "lo", "hi", *[F.when(F.col("wins").isNull(), F.col(f"win.{w}")).otherwise(F.col(c)).alias(c) for c, w in (("c1", "w1"), ("c2", "w2"))], "wins")


def later_matches(marks: DataFrame) -> DataFrame:
    """k, h, first, last of each match with an earlier position."""
    same = marks.groupBy("x", "c1", "c2").agg(F.min(F.struct("k", "h", "lo", "hi", "wins")).alias("origin"), F.count("*").alias("n"))
    same = stored(same, "reaches")
    # One more key keeps the join apart from the aggregation, so that a hot fingerprint's rows can be split.
    key = F.xxhash64("x", "c1", "c2").alias("key")
    origin = F.struct("origin.k", "origin.h", "origin.lo").alias("origin")
    copies = same.where("n > 1").select("x", "c1", "c2", origin, key)
    whole = marks.select("k", "h", "lo", "hi", "x", "c1", "c2", key).join(copies, ["key", "x", "c1", "c2"]).where(~F.struct("k", "h", "lo").eqNullSafe(F.col("origin")))
    whole = whole.select("k", "h", F.col("lo").alias("first"), F.col("hi").alias("last"))
    several = same.groupBy("x").agg(F.count("*").alias("n")).where("n > 1").select("x")
    single = F.array(F.struct(F.col("origin.lo").alias("first"), F.col("origin.hi").alias("last"), F.col("c1").alias("w1"), F.col("c2").alias("w2")))
    opened = same.join(several, "x").select("x", "origin.k", "origin.h", F.explode(F.coalesce("origin.wins", single)).alias("w")).select("x", "k", "h", "w.*")
    opened = stored(opened, "opened")
    at = F.struct("k", "h", "first")
    firsts = opened.groupBy("x", "w1", "w2").agg(F.min(at).alias("origin"), F.count("*").alias("n")).where("n > 1").drop("n")
    key = F.xxhash64("x", "w1", "w2").alias("key")
    parts = opened.select("*", key).join(firsts.select("*", key), ["key", "x", "w1", "w2"]).where(~at.eqNullSafe(F.col("origin")))
    return whole.unionByName(parts.select("k", "h", "first", "last"))


def repeated_runs(docs: DataFrame, min_words: int) -> DataFrame:
    """k, h, runs: array of (lo, hi) line numbers that go, in order and apart."""
    later = later_matches(stored(fingerprints(docs, min_words), "marks"))
    order = Window.partitionBy("k", "h").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("new", F.when(F.col("first") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    runs = later.groupBy("k", "h", "run").agg(F.min("first").alias("lo"), F.max("last").alias("hi"))
    return runs.groupBy("k", "h").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text_col replaced by the text without later repeated runs, and n_lines, n_removed (long)."""
    runs = repeated_runs(keyed(docs, id_col, text_col), min_words).select(F.col("k").alias("rk"), F.col("h").alias("rh"), "runs")
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    whole = whole.withColumn("h", F.xxhash64("t"))
    both = whole.join(runs, whole["k"].eqNullSafe(runs["rk"]) & (whole["h"] == runs["rh"]), "left")
    lines = F.split("t", "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.exists("runs", lambda r: i.between(r["lo"], r["hi"])))
    gone = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + (r["hi"] - r["lo"] + 1))
    text = F.when(F.col("runs").isNull(), F.col(f"row.`{text_col}`")).otherwise(F.array_join(kept, "\n"))
    out = [F.col(f"row.`{c}`").alias(c) if c != text_col else text.alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return both.select(*out, F.size(lines).cast("long").alias("n_lines"), F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"))
