"""Operators over ordered units of pages: paths, chunks, digests, cost and mode.

A unit is a row page_id, unit_id, pos, tag, role, mode, text. pos orders the
units of a page. Windows are partitioned by page, whose size is that of a page.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.functions.text import SPACE, clip, trim

# Fixed values of the cost model and the limits.
FIXED_INPUT, CHARS_PER_TOKEN, INPUT_PER_UNIT, OUTPUT_PER_CHAR, OUTPUT_PER_UNIT = 3000, 4, 15, 0.36, 6
MOST_TOTAL, MOST_OUTPUT, MOST_UNITS, MOST_CHARS = 16_000, 6_000, 160, 12_000
CHUNK_CHARS, CHUNK_UNITS, DIGEST_BUDGET = 2_800, 20, 12_000
NEIGHBOR_CHARS, CONTEXT_CHARS = 360, 1_400


def by_page():
    return Window.partitionBy("page_id").orderBy("pos")


def with_paths(units: DataFrame) -> DataFrame:
    """Adds path: of a heading the trail above it, of other units the last two entries of the trail."""
    so_far = by_page().rowsBetween(Window.unboundedPreceding, 0)
    level = F.when(F.col("role") != "heading", None).when(F.col("tag") == "H1", 1).when(F.col("tag") == "H2", 2).otherwise(3)
    out = units.withColumn("_level", level)
    for n in (1, 2, 3):
        out = out.withColumn(f"_h{n}", F.last(F.when(F.col("_level") == n, F.struct("pos", F.substring("text", 1, 60).alias("t"))), ignorenulls=True).over(so_far))
    live2 = F.col("_h1").isNull() | (F.col("_h2.pos") > F.col("_h1.pos"))
    above3 = F.greatest(F.col("_h1.pos"), F.col("_h2.pos"))
    live3 = above3.isNull() | (F.col("_h3.pos") > above3)
    trail = F.array_compact(F.array(F.col("_h1.t"), F.when(live2, F.col("_h2.t")), F.when(live3, F.col("_h3.t"))))
    out = out.withColumn("_trail", F.filter(trail, lambda x: x != ""))
    n = F.size("_trail")
    path = F.when(F.col("role") == "heading", F.slice("_trail", 1, F.greatest(n - 1, F.lit(0)))).otherwise(F.slice("_trail", F.greatest(n - 1, F.lit(1)), 2))
    return out.withColumn("path", F.array_join(path, " > ")).drop("_level", "_h1", "_h2", "_h3", "_trail")


def _chunker(most_chars: int, most_units: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, chunk, count, chars, closed = object(), 0, 0, 0, False
        for batch in batches:
            out = []
            for p, heading, size in zip(*(batch.column(c).to_pylist() for c in ("page_id", "_heading", "_size")), strict=True):
                alone = size >= most_chars
                if p != page:
                    page, chunk, count, chars, closed = p, 0, 0, 0, False
                elif closed or count and (heading or alone or count >= most_units or chars + size > most_chars):
                    chunk, count, chars, closed = chunk + 1, 0, 0, False
                count, chars, closed = count + 1, chars + size, alone
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.int64())], [*batch.schema.names[:-2], "chunk_id"])

    return run


def with_chunks(units: DataFrame, most_chars: int = CHUNK_CHARS, most_units: int = CHUNK_UNITS) -> DataFrame:
    """Adds chunk_id, from 0 on each page: a heading opens a chunk, a unit of most_chars stands alone, and
    a chunk closes before it would pass either limit. Pages are read as a sorted stream, of any size."""
    rows = units.withColumns({"_heading": F.col("role") == "heading", "_size": F.length("text")})
    rows = rows.repartition("page_id").sortWithinPartitions("page_id", "pos")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema)
    return rows.mapInArrow(_chunker(most_chars, most_units), fields + ", chunk_id bigint")


def digest(units: DataFrame, budget: int = DIGEST_BUDGET) -> DataFrame:
    """A row for each page: page_id, digest, chars, sampled, kept, total.

    Distinct lines with markers for headings and list items; beyond the budget
    all headings, two paragraphs and three list items of each section, cut at
    the budget.
    """
    text = trim(F.regexp_replace(F.regexp_replace("text", rf"https?://[^{SPACE[1:-1]}]+", ""), f"{SPACE}{{2,}}", " "))
    level = F.when(F.col("tag") == "H1", 1).when(F.col("tag") == "H2", 2).otherwise(3)
    item = (F.col("mode") == "append") & F.col("tag").isin("LI", "DT", "DD")
    lines = units.select("page_id", "pos", text.alias("t"), F.when(F.col("role") == "heading", "h").when(item, "li").otherwise("p").alias("kind"), level.alias("level")).where("t <> ''")
    lines = lines.withColumn("line", F.when(F.col("kind") == "h", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("t"))).when(F.col("kind") == "li", F.concat(F.lit("- "), F.col("t"))).otherwise(F.col("t")))
    lines = lines.groupBy("page_id", "line").agg(F.min(F.struct("pos", "kind")).alias("m")).select("page_id", "line", "m.pos", "m.kind")
    page = Window.partitionBy("page_id")
    lines = lines.withColumns({"total": F.count("*").over(page), "chars": F.sum(F.length("line")).over(page) + F.count("*").over(page) - 1, "section": F.sum(F.when(F.col("kind") == "h", 1).otherwise(0)).over(by_page())})
    rank = F.row_number().over(Window.partitionBy("page_id", "section", "kind").orderBy("pos"))
    lines = lines.withColumns({"rank": rank, "sampled": F.col("chars") > budget})
    lines = lines.where(~F.col("sampled") | (F.col("kind") == "h") | ((F.col("kind") == "p") & (F.col("rank") <= 2)) | ((F.col("kind") == "li") & (F.col("rank") <= 3)))
    used = F.coalesce(F.sum(F.length("line") + 1).over(by_page().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumn("room", F.when(F.col("sampled"), budget - used).otherwise(F.length("line"))).where("room > 0")
    lines = lines.withColumn("line", F.substring("line", F.lit(1), F.col("room").cast("int")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    out = lines.groupBy("page_id").agg(joined.alias("digest"), F.first("sampled").alias("sampled"), F.count("*").alias("kept"), F.first("total").alias("total"))
    return out.select("page_id", "digest", F.length("digest").cast("long").alias("chars"), "sampled", "kept", "total")


def cost(units: DataFrame, *keys: str) -> DataFrame:
    """Token estimate of each group of units."""
    chars, n = F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")
    out = units.groupBy(*keys).agg(chars.alias("source_chars"), n.alias("unit_count"))
    out = out.withColumn("input_tokens", F.ceil(FIXED_INPUT + F.col("source_chars") / CHARS_PER_TOKEN + F.col("unit_count") * INPUT_PER_UNIT))
    out = out.withColumn("output_tokens", F.ceil(F.round(F.col("source_chars") * OUTPUT_PER_CHAR + F.col("unit_count") * OUTPUT_PER_UNIT, 6)))
    return out.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def mode_reason(prefer_whole: bool = True, by_tokens: bool = True, most_chars: int = MOST_CHARS, most_units: int = MOST_UNITS) -> Column:
    reason = F.lit("user-disabled") if not prefer_whole else F.when(F.col("unit_count") == 0, "no-content")
    if prefer_whole and by_tokens:
        reason = reason.when(F.col("output_tokens") > MOST_OUTPUT, "estimated-output-token-limit").when(F.col("total_tokens") > MOST_TOTAL, "estimated-total-token-limit")
    elif prefer_whole:
        reason = reason.when(F.col("source_chars") > most_chars, "source-char-limit")
    return reason.when(F.col("unit_count") > most_units, "unit-hard-limit").otherwise("within-safe-range") if prefer_whole else reason


def translation_mode(units: DataFrame, *keys: str, **how) -> DataFrame:
    """cost() with mode and mode_reason."""
    out = cost(units, *keys).withColumn("mode_reason", mode_reason(**how))
    return out.withColumn("mode", F.when(F.col("mode_reason") == "within-safe-range", "whole-page").otherwise("chunked"))


def neighbor_context(units: DataFrame) -> DataFrame:
    """page_id, chunk_id, context: two units before and after each chunk. units have chunk_id."""
    w = by_page()
    near = {f"{way}{n}": (F.lag if way == "b" else F.lead)("text", n).over(w) for way in "ba" for n in (1, 2)}
    ends = units.withColumns(near)
    line = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(name + ": "), clip(c, NEIGHBOR_CHARS)))
    first = F.min_by(F.concat_ws("\n", line("Before", F.col("b2")), line("Before", F.col("b1"))), "pos")
    last = F.max_by(F.concat_ws("\n", line("After", F.col("a1")), line("After", F.col("a2"))), "pos")
    parts = ends.groupBy("page_id", "chunk_id").agg(first.alias("_b"), last.alias("_a"))
    parts = parts.withColumn("context", F.concat_ws("\n", F.when(F.col("_b") != "", F.col("_b")), F.when(F.col("_a") != "", F.col("_a"))))
    return parts.select("page_id", "chunk_id", F.substring("context", 1, CONTEXT_CHARS).alias("context"))


def rejection_counts(units: DataFrame, reason: Column) -> DataFrame:
    """Units by the first reason that leaves them out; null: kept."""
    return units.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


def progress(units: DataFrame) -> DataFrame:
    """Totals by state, the share done and the phase of each page."""
    out = units.groupBy("page_id").agg(F.count("*").alias("total"), F.count_if(F.col("state") == "done").alias("done"), F.count_if(F.col("state") == "failed").alias("failed"))
    phase = F.when(F.col("done") + F.col("failed") < F.col("total"), "translating").when(F.col("failed") == 0, "done").when(F.col("done") == 0, "error").otherwise("partial")
    return out.withColumn("phase", phase)


def phases(pages: DataFrame, units: DataFrame) -> DataFrame:
    """page_id, phase of every page, with units or not. pages: page_id, scanned (null: not begun, false: under way)."""
    rows = pages.join(progress(units).select("page_id", "phase"), "page_id", "left")
    early = F.when(F.col("scanned").isNull(), "idle").when(~F.col("scanned"), "scanning")
    return rows.select("page_id", F.coalesce(early, "phase", F.lit("done")).alias("phase"))


def rendered(nodes: DataFrame, results: DataFrame) -> DataFrame:
    """unit_id, hash, state, t of each place for a translation.

    nodes: unit_id, hash (of the text that stands there now), connected. results:
    unit_id, hash (of the text that was sent), t (null: it failed). A place is
    loading until a result of its own text comes, which fills or fails it; a
    result of an older text is dropped, a place that left the page is detached.
    """
    rows = nodes.join(results.select("unit_id", F.col("hash").alias("_sent"), "t"), "unit_id", "left")
    fits = F.col("_sent").eqNullSafe(F.col("hash"))
    state = F.when(~F.col("connected"), "detached").when(~fits, "loading").when(F.col("t").isNull(), "error").otherwise("done")
    return rows.withColumn("state", state).select("unit_id", "hash", "state", F.when(F.col("state") == "done", F.col("t")).alias("t"))


def exportable(places: DataFrame) -> DataFrame:
    """Places that go into an export: done, of the unit's own text, no interface; in a head or foot only within an article.

    places: state, t, hash, node_hash (null: not told), connected, role, framed, article.
    """
    return places.where((F.col("state") == "done") & F.col("connected") & F.coalesce(F.col("node_hash") == F.col("hash"), F.lit(True)) & (trim(F.col("t")) != "") & (F.col("role") != "ui") & (~F.col("framed") | F.col("article")))
