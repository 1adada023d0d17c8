"""Queries over units: filters, projections, paths, chunks, digests, cost, mode."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiweave.functions import text as tx
from lexiweave.operators import units as un
from lexiweave.plans import fixtures as fx
from lexiweave.plans.registry import query

SINGLE = r"""(NOT regexp_matches(text, '[.!?。！？…]["''”’)）]?$') AND trim(regexp_replace(text, '[\p{P}\p{S}]', ' ', 'g')) <> '' AND NOT regexp_matches(trim(regexp_replace(text, '[\p{P}\p{S}]', ' ', 'g')), '[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]|\s'))"""
REASON = rf"""CASE WHEN text = '' THEN 'empty' WHEN length(text) < 2 THEN 'too-short' WHEN NOT regexp_matches(text, '\p{{L}}') THEN 'noise'
 WHEN regexp_matches(text, '(?i)^(?:https?://|www\.|mailto:|[\w.+-]+@[\w-]+\.\w+)\S*$') THEN 'url-or-email' WHEN tag NOT IN ('H1', 'H2') AND {SINGLE} THEN 'single-token' END"""
CAPS = r"(length(regexp_replace(text, '[^A-Z]', '', 'g')) >= 0.9 * length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AND length(text) <= 140 AND len(regexp_extract_all(text, '[A-Za-z]+')) BETWEEN 1 AND 18)"


@query("flt_text", f"WITH {fx.UNITS} SELECT unit_id, {REASON} AS reason FROM units")
def flt_text(spark, d):
    return fx.units(spark, d).select("unit_id", tx.text_rejection(F.col("text"), F.col("tag")).alias("reason"))


@query("flt_single", f"WITH {fx.UNITS} SELECT unit_id, {SINGLE} AS single FROM units")
def flt_single(spark, d):
    return fx.units(spark, d).select("unit_id", tx.is_single_token(F.col("text")).alias("single"))


@query("flt_accept", f"WITH {fx.UNITS} SELECT unit_id, coalesce({REASON}, CASE WHEN tag = 'LI' AND length(text) <= 24 AND NOT regexp_matches(text, '[.!?。！？…][\"''”’)）]?$') THEN 'auxiliary-label' END) AS reason FROM units")
def flt_accept(spark, d):
    u = fx.units(spark, d)
    label = F.when((F.col("tag") == "LI") & (F.length("text") <= 24) & ~tx.is_sentence_end(F.col("text")), "auxiliary-label")
    return u.select("unit_id", F.coalesce(tx.text_rejection(F.col("text"), F.col("tag")), label).alias("reason"))


@query("agg_extract", f"WITH {fx.UNITS}, r AS (SELECT {REASON} AS reason, text FROM units) SELECT reason, count(*) AS n, sum(length(text)) AS chars FROM r GROUP BY reason")
def agg_extract(spark, d):
    return un.rejection_counts(fx.units(spark, d), tx.text_rejection(F.col("text"), F.col("tag")))


@query("flt_headingish", f"WITH {fx.UNITS} SELECT unit_id, role = 'heading' OR {CAPS} AS headingish FROM units")
def flt_headingish(spark, d):
    return fx.units(spark, d).select("unit_id", tx.looks_like_heading(F.col("text"), F.col("role")).alias("headingish"))


@query("fn_norm", r"SELECT conv_id, turn, trim(regexp_replace(replace(regexp_replace(text, '[\t\r\n]+', ' ', 'g'), chr(160), ' '), '\s{2,}', ' ', 'g')) AS text FROM conversations")
def fn_norm(spark, d):
    return fx.table(spark, d, "conversations").select("conv_id", "turn", tx.normalize(F.col("text")).alias("text"))


@query("prj_unit", f"WITH {fx.UNITS} SELECT page_id, unit_id, pos, tag, role, mode, text, sha256(text) AS hash, 'pending' AS state FROM units")
def prj_unit(spark, d):
    return fx.units(spark, d).select("page_id", "unit_id", "pos", "tag", "role", "mode", "text", F.sha2("text", 256).alias("hash"), F.lit("pending").alias("state"))


@query("prj_role", f"WITH {fx.UNITS} SELECT unit_id, CASE WHEN tag IN ('H1', 'H2') THEN 'heading' WHEN length(text) <= 24 AND pos % 2 = 1 THEN 'ui' ELSE 'body' END AS role FROM units")
def prj_role(spark, d):
    return fx.units(spark, d).select("unit_id", tx.role_of(F.col("text"), F.col("tag"), F.col("pos") % 2 == 1).alias("role"))


@query("prj_mode", f"WITH {fx.UNITS} SELECT unit_id, CASE WHEN tag = 'LI' THEN 'append' ELSE 'after' END AS mode FROM units")
def prj_mode(spark, d):
    return fx.units(spark, d).select("unit_id", tx.placement_of(F.col("tag")).alias("mode"))


@query("win_path", f"""WITH {fx.UNITS},
lv AS (SELECT *, CASE WHEN tag = 'H1' THEN 1 WHEN tag = 'H2' THEN 2 END AS level FROM units),
p AS (SELECT *, max(CASE WHEN level = 1 THEN pos END) OVER w AS p1, max(CASE WHEN level = 2 THEN pos END) OVER w AS p2 FROM lv WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
j AS (SELECT p.*, substr(a.text, 1, 60) AS h1, CASE WHEN p1 IS NULL OR p2 > p1 THEN substr(b.text, 1, 60) END AS h2 FROM p LEFT JOIN units a ON a.page_id = p.page_id AND a.pos = p1 LEFT JOIN units b ON b.page_id = p.page_id AND b.pos = p2)
SELECT unit_id, CASE WHEN level = 1 THEN '' WHEN level = 2 THEN coalesce(h1, '') ELSE concat_ws(' > ', h1, h2) END AS path FROM j""")
def win_path(spark, d):
    return un.with_paths(fx.units(spark, d)).select("unit_id", "path")


@query("win_chunk", f"""WITH RECURSIVE {fx.UNITS},
o AS (SELECT page_id, unit_id, role, length(text) AS size, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rn FROM units),
r AS (SELECT page_id, unit_id, rn, 0 AS chunk_id, 1 AS cnt, size AS chars, size >= 2800 AS closed FROM o WHERE rn = 1
 UNION ALL SELECT o.page_id, o.unit_id, o.rn,
  CASE WHEN r.closed OR o.role = 'heading' OR o.size >= 2800 OR r.cnt >= 20 OR r.chars + o.size > 2800 THEN r.chunk_id + 1 ELSE r.chunk_id END,
  CASE WHEN r.closed OR o.role = 'heading' OR o.size >= 2800 OR r.cnt >= 20 OR r.chars + o.size > 2800 THEN 1 ELSE r.cnt + 1 END,
  CASE WHEN r.closed OR o.role = 'heading' OR o.size >= 2800 OR r.cnt >= 20 OR r.chars + o.size > 2800 THEN o.size ELSE r.chars + o.size END,
  o.size >= 2800 FROM r JOIN o ON o.page_id = r.page_id AND o.rn = r.rn + 1)
SELECT unit_id, chunk_id FROM r""")
def win_chunk(spark, d):
    return un.with_chunks(fx.units(spark, d)).select("unit_id", "chunk_id")


@query("win_take", f"""WITH RECURSIVE {fx.UNITS},
o AS (SELECT page_id, unit_id, 'body' AS role, length(text) AS size, row_number() OVER (PARTITION BY page_id ORDER BY pos % 2, pos) AS rn FROM units),
r AS (SELECT page_id, unit_id, rn, 0 AS chunk_id, 1 AS cnt, size AS chars, size >= 2800 AS closed FROM o WHERE rn = 1
 UNION ALL SELECT o.page_id, o.unit_id, o.rn, CASE WHEN r.closed OR o.size >= 2800 OR r.cnt >= 20 OR r.chars + o.size > 2800 THEN r.chunk_id + 1 ELSE r.chunk_id END,
  CASE WHEN r.closed OR o.size >= 2800 OR r.cnt >= 20 OR r.chars + o.size > 2800 THEN 1 ELSE r.cnt + 1 END,
  CASE WHEN r.closed OR o.size >= 2800 OR r.cnt >= 20 OR r.chars + o.size > 2800 THEN o.size ELSE r.chars + o.size END, o.size >= 2800 FROM r JOIN o ON o.page_id = r.page_id AND o.rn = r.rn + 1)
SELECT unit_id, chunk_id FROM r""")
def win_take(spark, d):
    """Units near the reader (here: even positions) are taken first, then document order."""
    order = F.row_number().over(Window.partitionBy("page_id").orderBy(F.col("pos") % 2, "pos")).cast("long")
    u = fx.units(spark, d).withColumn("pos", order).withColumn("role", F.lit("body"))
    return un.with_chunks(u).select("unit_id", "chunk_id")


DIGEST = r"""lines_d AS (SELECT page_id, pos, CASE WHEN role = 'heading' THEN 'h' WHEN tag = 'LI' THEN 'li' ELSE 'p' END AS kind,
 CASE WHEN tag = 'H1' THEN '# ' WHEN tag = 'H2' THEN '## ' WHEN tag = 'LI' THEN '- ' ELSE '' END || trim(regexp_replace(regexp_replace(text, 'https?://\S+', '', 'g'), '\s{2,}', ' ', 'g')) AS line,
 trim(regexp_replace(regexp_replace(text, 'https?://\S+', '', 'g'), '\s{2,}', ' ', 'g')) AS t FROM units),
first_d AS (SELECT page_id, line, min(pos) AS pos, arg_min(kind, pos) AS kind FROM lines_d WHERE t <> '' GROUP BY page_id, line),
sec_d AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS total, sum(length(line) + 1) OVER (PARTITION BY page_id) - 1 AS chars, sum((kind = 'h')::INT) OVER (PARTITION BY page_id ORDER BY pos) AS section FROM first_d),
rank_d AS (SELECT *, row_number() OVER (PARTITION BY page_id, section, kind ORDER BY pos) AS rank FROM sec_d),
kept_d AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY page_id ORDER BY pos) - length(line) - 1 AS used FROM rank_d WHERE chars <= {0} OR kind = 'h' OR (kind = 'p' AND rank <= 2) OR (kind = 'li' AND rank <= 3)),
digests AS (SELECT page_id, string_agg(CASE WHEN chars <= {0} THEN line ELSE substr(line, 1, ({0} - used)::BIGINT) END, chr(10) ORDER BY pos) AS digest, bool_or(chars > {0}) AS sampled, count(*) AS kept, max(total) AS total FROM kept_d WHERE chars <= {0} OR used < {0} GROUP BY page_id)"""

DIGEST_1500, DIGEST_FULL = DIGEST.replace("{0}", "1500"), DIGEST.replace("{0}", "12000")


@query("win_digest", f"WITH {fx.UNITS}, {DIGEST_1500} SELECT page_id, digest, length(digest) AS chars, sampled, kept, total FROM digests")
def win_digest(spark, d):
    return un.digest(fx.units(spark, d), budget=1500)


@query("set_digestdup", f"WITH {fx.UNITS}, {DIGEST_1500} SELECT page_id, pos, line FROM first_d")
def set_digestdup(spark, d):
    u = fx.units(spark, d)
    mark = F.when(F.col("tag") == "H1", "# ").when(F.col("tag") == "H2", "## ").when(F.col("tag") == "LI", "- ").otherwise("")
    text = tx.trim(F.regexp_replace(F.regexp_replace("text", r"https?://\S+", ""), r"\s{2,}", " "))
    return u.select("page_id", "pos", F.concat(mark, text).alias("line"), text.alias("t")).where("t <> ''").groupBy("page_id", "line").agg(F.min("pos").alias("pos"))


@query("agg_digestinfo", f"WITH {fx.UNITS}, {DIGEST_FULL} SELECT page_id, length(digest) AS chars, sampled, CAST(floor(length(digest) / 3.5 + 0.5) AS BIGINT) AS est_tokens FROM digests")
def agg_digestinfo(spark, d):
    return un.digest(fx.units(spark, d)).select("page_id", "chars", "sampled", F.floor(F.col("chars") / 3.5 + 0.5).alias("est_tokens"))


COST = "cost AS (SELECT *, input_tokens + output_tokens AS total_tokens FROM (SELECT page_id, sum(length(text)) AS source_chars, count(*) AS unit_count, CAST(ceil(3000 + sum(length(text)) / 4 + count(*) * 15) AS BIGINT) AS input_tokens, CAST(ceil(round(sum(length(text)) * 0.36 + count(*) * 6, 6)) AS BIGINT) AS output_tokens FROM units GROUP BY page_id))"
MODE = "modes AS (SELECT *, CASE WHEN output_tokens > 6000 THEN 'estimated-output-token-limit' WHEN total_tokens > 16000 THEN 'estimated-total-token-limit' WHEN unit_count > 160 THEN 'unit-hard-limit' ELSE 'within-safe-range' END AS mode_reason FROM cost)"


@query("agg_cost", f"WITH {fx.UNITS}, {COST} SELECT * FROM cost")
def agg_cost(spark, d):
    return un.cost(fx.units(spark, d), "page_id")


@query("agg_mode", f"WITH {fx.UNITS}, {COST}, {MODE} SELECT *, CASE WHEN mode_reason = 'within-safe-range' THEN 'whole-page' ELSE 'chunked' END AS mode FROM modes")
def agg_mode(spark, d):
    return un.translation_mode(fx.units(spark, d), "page_id")


@query("agg_mode_mt", f"WITH {fx.UNITS}, {COST} SELECT page_id, CASE WHEN source_chars > 4500 THEN 'source-char-limit' WHEN unit_count > 60 THEN 'unit-hard-limit' ELSE 'within-safe-range' END AS mode_reason FROM cost")
def agg_mode_mt(spark, d):
    return un.translation_mode(fx.units(spark, d), "page_id", by_tokens=False, most_chars=4500, most_units=60).select("page_id", "mode_reason")


@query("jn_neighbor", f"""WITH {fx.UNITS},
c AS (SELECT *, pos // 4 AS chunk_id, lag(text, 2) OVER w AS b2, lag(text) OVER w AS b1, lead(text) OVER w AS a1, lead(text, 2) OVER w AS a2 FROM units WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
k AS (SELECT page_id, chunk_id, pos, {", ".join(f"CASE WHEN length({x}) > 360 THEN substr({x}, 1, 359) || '…' ELSE {x} END AS {x}" for x in ("b2", "b1", "a1", "a2"))} FROM c),
e AS (SELECT page_id, chunk_id, arg_min(concat_ws(chr(10), 'Before: ' || b2, 'Before: ' || b1), pos) AS b, arg_max(concat_ws(chr(10), 'After: ' || a1, 'After: ' || a2), pos) AS a FROM k GROUP BY page_id, chunk_id)
SELECT page_id, chunk_id, substr(concat_ws(chr(10), nullif(b, ''), nullif(a, '')), 1, 1400) AS context FROM e""")
def jn_neighbor(spark, d):
    return un.neighbor_context(fx.units(spark, d).withColumn("chunk_id", F.floor(F.col("pos") / 4)))


@query("agg_progress", f"WITH {fx.TRANSLATED} SELECT page_id, count(*) AS total, count_if(state = 'done') AS done, count_if(state = 'failed') AS failed FROM translated GROUP BY page_id")
def agg_progress(spark, d):
    return un.progress(fx.translated(spark, d)).drop("phase")


@query("stm_phase", f"""WITH {fx.TRANSLATED}, p AS (SELECT page_id, count(*) AS total, count_if(state = 'done') AS done, count_if(state = 'failed') AS failed FROM translated GROUP BY page_id)
SELECT doc_id AS page_id, CASE WHEN doc_id % 10 = 0 THEN 'idle' WHEN doc_id % 10 = 1 THEN 'scanning' WHEN done + failed < total THEN 'translating' WHEN failed = 0 THEN 'done' WHEN done = 0 THEN 'error' WHEN total > 0 THEN 'partial' ELSE 'done' END AS phase FROM documents LEFT JOIN p ON p.page_id = doc_id""")
def stm_phase(spark, d):
    """Every page's phase; a tenth has not begun, a tenth is being scanned."""
    i = F.col("doc_id")
    pages = fx.table(spark, d, "documents").select(i.alias("page_id"), F.when(i % 10 != 0, i % 10 != 1).alias("scanned"))
    return un.phases(pages, fx.translated(spark, d))


@query("flagship", f"""WITH {fx.UNITS}, {COST}, {MODE} SELECT page_id, unit_count, source_chars, mode_reason FROM modes""")
def flagship(spark, d):
    return un.translation_mode(fx.units(spark, d), "page_id").select("page_id", "unit_count", "source_chars", "mode_reason")


@query("flt_usable", f"""WITH {fx.TRANSLATED} SELECT unit_id, t IS NOT NULL AND trim(v) <> '' AND NOT (regexp_matches(text, '[\\p{{L}}\\p{{N}}]') AND NOT regexp_matches(v, '[\\p{{L}}\\p{{N}}]')) AS usable FROM (SELECT *, CASE WHEN unit_id % 17 = 0 THEN '-' ELSE t END AS v FROM translated)""")
def flt_usable(spark, d):
    t = fx.translated(spark, d).withColumn("v", F.when(F.col("unit_id") % 17 == 0, "-").otherwise(F.col("t")))
    return t.select("unit_id", tx.is_usable(F.col("text"), F.col("v"), F.lit("French")).alias("usable"))


RENDERED = f"""{fx.TRANSLATED}, places AS (SELECT page_id, unit_id, role, sha256(text) AS hash, CASE WHEN unit_id % 13 = 0 THEN 'detached' WHEN state = 'pending' OR unit_id % 5 = 0 THEN 'loading' WHEN state = 'failed' THEN 'error' ELSE 'done' END AS state, t FROM translated)"""


def places(spark, d):
    """Units, their results (some failed, some of an older text, some not come) and places, some of which left the page."""
    rows, i = fx.translated(spark, d), F.col("unit_id")
    sent = F.sha2(F.concat("text", F.when(i % 5 == 0, "x").otherwise("")), 256)
    results = rows.where("state <> 'pending'").select("unit_id", sent.alias("hash"), F.when(F.col("state") == "done", F.col("t")).alias("t"))
    return un.rendered(rows.select("unit_id", F.sha2("text", 256).alias("hash"), (i % 13 != 0).alias("connected")), results)


@query("snk_render", f"WITH {RENDERED} SELECT unit_id, hash, CASE WHEN state = 'done' THEN t END AS t, state FROM places")
def snk_render(spark, d):
    return places(spark, d)


@query("flt_export", f"WITH {RENDERED} SELECT unit_id FROM places WHERE state = 'done' AND unit_id % 8 <> 0 AND trim(t) <> '' AND (unit_id % 6 <> 0 OR unit_id % 4 = 0) AND unit_id % 19 <> 0")
def flt_export(spark, d):
    """Places of which some belong to another text, some to the interface, some to a head, of an article or not."""
    i = F.col("unit_id")
    rows = places(spark, d).withColumns({"node_hash": F.when(i % 8 == 0, "other").when(i % 8 == 1, F.col("hash")), "connected": F.col("state") != "detached", "role": F.when(i % 19 == 0, "ui").otherwise("body"), "framed": i % 6 == 0, "article": i % 4 == 0})
    return un.exportable(rows).select("unit_id")


@query("srt_page", f"WITH {fx.UNITS} SELECT page_id, unit_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS place FROM units")
def srt_page(spark, d):
    return fx.units(spark, d).select("page_id", "unit_id", F.row_number().over(un.by_page()).cast("long").alias("place"))


@query("fn_mdesc", r"""WITH """ + fx.UNITS + r""" SELECT unit_id, regexp_replace(regexp_replace(regexp_replace(replace(text, '&', '&amp;'), '([\\`*_{}\[\]<>|#!])', '\\\1', 'g'), '^(\s*)([-+])(\s)', '\1\\\2\3'), '^(\s*)(\d+)([.)])(\s)', '\1\2\\\3\4') AS escaped FROM units""")
def fn_mdesc(spark, d):
    return fx.units(spark, d).select("unit_id", tx.markdown_escaped(F.col("text")).alias("escaped"))
