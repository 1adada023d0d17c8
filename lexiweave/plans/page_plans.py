"""Queries over raw pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiweave.functions import scalars as sc
from lexiweave.functions import text as tx
from lexiweave.plans import fixtures as fx
from lexiweave.plans.registry import query
from lexiweave.plans.unit_plans import REASON
from lexiweave.sources import pages as pg

INLINE = "|".join(pg.INLINE)


def _decoded(x: str) -> str:
    for name, char in pg.ENTITIES.items():
        x = f"replace({x}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


def _plain(x: str) -> str:
    inner = _decoded(f"regexp_replace({x}, '<[^>]*>', '', 'g')")
    return rf"trim(regexp_replace(replace(regexp_replace({inner}, '[\t\r\n]+', ' ', 'g'), chr(160), ' '), '\s{{2,}}', ' ', 'g'))"


SCAN = rf"""b0 AS (SELECT page_id, url, regexp_replace('<body>' || coalesce(html, ''), '(?is)<!--.*?-->', '', 'g') AS b FROM pages),
b1 AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(b, '(?is)<(?:head|script|style)[\s>].*?</(?:head|script|style)>', '', 'g'), '(?i)<br\s*/?>', ' ', 'g'), '(?i)</?(?:{INLINE})(?:\s[^>]*)?>', '', 'g') AS b FROM b0),
b2 AS (SELECT page_id, unnest(regexp_extract_all(b, '<(/?[A-Za-z][A-Za-z0-9]*)[^>]*>([^<]*)', 1)) AS tag0, unnest(regexp_extract_all(b, '<(/?[A-Za-z][A-Za-z0-9]*)[^>]*>([^<]*)', 2)) AS run,
 unnest(range(len(regexp_extract_all(b, '<(/?[A-Za-z][A-Za-z0-9]*)[^>]*>([^<]*)', 1)))) AS pos FROM b1),
b3 AS (SELECT page_id, pos, CASE WHEN starts_with(tag0, '/') THEN 'DIV' ELSE upper(tag0) END AS tag, {_plain("run")} AS text FROM b2),
scanned AS (SELECT * FROM b3 WHERE text <> '')"""
HOST = r"lower(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://(?:[^@/?#]*@)?([^/?#:]*)', 1))"
RULES = [(0, "example.net", "forum"), (1, "tionsh.example.net", "academic"), (2, "blog.tionble.example.com", "technical"), (3, "example.org", "bogus")]
RULES_SQL = "rules(pos, host, preset) AS (VALUES " + ", ".join(f"({a}, '{b}', '{c}')" for a, b, c in RULES) + ")"


def rules(spark):
    return spark.createDataFrame(RULES, "pos int, host string, preset string")


def pages(spark, d):
    return fx.table(spark, d, "pages")


@query("src_scan", f"WITH {SCAN} SELECT page_id, pos, tag, text FROM scanned")
def src_scan(spark, d):
    return pg.scan(pages(spark, d))


@query("src_scan_accepted", f"WITH {SCAN}, u AS (SELECT *, {REASON.replace(chr(39) + 'H1' + chr(39) + ', ' + chr(39) + 'H2' + chr(39), ', '.join(chr(39) + t + chr(39) for t in tx.HEADING_TAGS))} AS reason FROM scanned) SELECT page_id, pos, tag FROM u WHERE reason IS NULL")
def src_scan_accepted(spark, d):
    return pg.scan(pages(spark, d)).where(tx.text_rejection(F.col("text"), F.col("tag")).isNull()).select("page_id", "pos", "tag")


CONTEXT = rf"""ctx0 AS (SELECT page_id, url, coalesce(html, '') AS html, list_filter(list_transform(regexp_extract_all(html, '(?is)<h[12][^>]*>(.*?)</h[12]>', 1), lambda x: {_plain("x")}), lambda x: x <> '') AS hs FROM pages),
ctx AS (SELECT page_id, {_plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, {HOST} AS hostname, array_to_string(hs[1:12], '|') AS headings, len(regexp_extract_all(html, '(?i)<pre[\s>]')) AS code_blocks,
 len(regexp_extract_all(html, '(?i)(?:class|id)=["''][^"'']*(?:comment|reply)')) AS comment_nodes FROM ctx0)"""


@query("src_context", f"WITH {CONTEXT} SELECT * FROM ctx")
def src_context(spark, d):
    return pg.context(pages(spark, d)).select("page_id", "title", "hostname", F.array_join("headings", "|").alias("headings"), "code_blocks", "comment_nodes")


@query("flt_linklist", r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<ul[^>]*>(.*?)</ul>', 1)) AS inn, unnest(range(len(regexp_extract_all(html, '(?is)<ul[^>]*>(.*?)</ul>', 1)))) AS place FROM pages),
s AS (SELECT page_id, place, length(regexp_replace(regexp_replace(inn, '<[^>]*>', '', 'g'), '\s+', '', 'g')) AS chars, list_transform(regexp_extract_all(inn, '(?is)<a[\s>][^>]*>(.*?)</a>', 1), lambda x: length(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '\s+', '', 'g'))) AS sizes FROM l)
SELECT page_id, place, len(sizes) AS links, list_sum(sizes)::BIGINT AS link_chars, chars, len(sizes) >= 3 AND chars > 0 AND list_sum(sizes) >= 0.75 * chars AND len(list_filter(sizes, lambda x: x > 30)) <= 0.3 * len(sizes) AS is_list FROM s""")
def flt_linklist(spark, d):
    return pg.link_lists(pages(spark, d))


@query("flt_inject", "SELECT page_id, regexp_matches(url, '^(https?|file)://') AND NOT starts_with(url, 'https://chromewebstore.google.com') AS injectable FROM pages")
def flt_inject(spark, d):
    return pages(spark, d).select("page_id", sc.is_injectable(F.col("url")).alias("injectable"))


@query("fn_urlsafe", r"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '(?i)^(https?://[^/?#\s]+)', 1)) AS origin, regexp_extract(url, '(?i)^https?://[^/?#]+(/[^?#]*)?', 1) AS path FROM pages)
SELECT page_id, CASE WHEN trim(url) = '' THEN '' WHEN origin = '' THEN '[invalid-url]' ELSE origin || CASE WHEN path = '' THEN '/' ELSE path END END AS safe FROM p""")
def fn_urlsafe(spark, d):
    return pages(spark, d).select("page_id", sc.safe_url(F.col("url")).alias("safe"))


@query("fn_origin", r"SELECT page_id, lower(regexp_extract(url, '(?i)^(https?)://', 1)) || '://' || lower(regexp_extract(url, '(?i)^https?://(?:[^@/?#]*@)?([^/?#:]+)', 1)) || '/*' AS origin FROM pages")
def fn_origin(spark, d):
    return pages(spark, d).select("page_id", sc.origin_pattern(F.col("url")).alias("origin"))


HOSTS = "ht(ord, preset, part) AS (VALUES " + ", ".join(f"({n}, '{p}', '{x}')" for n, (p, xs) in enumerate(pg.HOST_TABLE.items()) for x in xs.split()) + ")"


@query("jn_hosttable", f"WITH {HOSTS}, h AS (SELECT page_id, {HOST} AS host FROM pages) SELECT h.page_id, arg_min(preset, ord) AS preset FROM h LEFT JOIN ht ON contains(h.host, ht.part) GROUP BY h.page_id")
def jn_hosttable(spark, d):
    return pg.host_class(pages(spark, d))


@query("jn_siterule", f"WITH {RULES_SQL}, h AS (SELECT page_id, {HOST} AS host FROM pages) SELECT h.page_id, min(pos) AS rule_pos, arg_min(preset, pos) AS preset FROM h LEFT JOIN rules r ON h.host = r.host OR ends_with(h.host, '.' || r.host) GROUP BY h.page_id")
def jn_siterule(spark, d):
    return pg.site_rule(pages(spark, d), rules(spark))


@query("fn_classify", f"""WITH {CONTEXT}, {RULES_SQL}, {HOSTS}, r AS (SELECT c.page_id, arg_min(preset, pos) AS preset FROM ctx c JOIN rules ON c.hostname = rules.host OR ends_with(c.hostname, '.' || rules.host) GROUP BY c.page_id),
h AS (SELECT c.page_id, arg_min(preset, ord) AS preset FROM ctx c JOIN ht ON contains(c.hostname, ht.part) GROUP BY c.page_id),
s AS (SELECT page_id, CASE WHEN {" + ".join(f"contains(lower(headings), '{x}')::INT" for x in pg.ACADEMIC_HEADINGS)} >= 2 THEN 'academic' WHEN code_blocks >= 3 THEN 'technical' WHEN comment_nodes >= 8 THEN 'forum' END AS preset FROM ctx)
SELECT s.page_id, coalesce(CASE WHEN r.preset <> 'bogus' THEN r.preset END, h.preset, s.preset, 'general') AS preset, CASE WHEN r.preset <> 'bogus' THEN 'site-rule' WHEN h.preset IS NOT NULL THEN 'host' WHEN s.preset IS NOT NULL THEN 'structure' ELSE 'fallback' END AS reason
FROM s LEFT JOIN r ON r.page_id = s.page_id LEFT JOIN h ON h.page_id = s.page_id""")
def fn_classify(spark, d):
    return pg.classified(pages(spark, d), rules(spark))


@query("prj_promptctx", f"WITH {CONTEXT} SELECT page_id, title, array_to_string(string_split(headings, '|')[1:8], '|') AS headings FROM ctx")
def prj_promptctx(spark, d):
    return pg.context(pages(spark, d)).select("page_id", "title", F.array_join(F.slice("headings", 1, 8), "|").alias("headings"))


@query("jn_reconcile", f"WITH {SCAN}, o AS (SELECT page_id, tag, sha256(text) AS hash FROM scanned WHERE pos % 3 <> 0) SELECT s.page_id, s.pos, sha256(s.text) AS hash FROM scanned s WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.page_id = s.page_id AND o.tag = s.tag AND o.hash = sha256(s.text))")
def jn_reconcile(spark, d):
    now = pg.scan(pages(spark, d))
    return pg.changed(now.where("pos % 3 <> 0"), now).select("page_id", "pos", "hash")


@query("jn_reuse", f"""WITH {SCAN}, t AS (SELECT page_id, pos, sha256(text || CASE WHEN pos % 2 = 0 THEN 'x' ELSE '' END) AS hash FROM scanned WHERE pos % 5 <> 0)
SELECT s.page_id, s.pos, t.hash IS NOT NULL AS reuse_slot FROM scanned s LEFT JOIN t ON t.page_id = s.page_id AND t.pos = s.pos WHERE t.hash IS NULL OR t.hash <> sha256(s.text)""")
def jn_reuse(spark, d):
    """Units whose stored translation is missing (new) or of an older text (its slot is used again)."""
    now = pg.scan(pages(spark, d)).withColumn("hash", F.sha2("text", 256))
    old = now.where("pos % 5 <> 0").select("page_id", "pos", F.sha2(F.concat("text", F.when(F.col("pos") % 2 == 0, "x").otherwise("")), 256).alias("old"))
    rows = now.join(old, ["page_id", "pos"], "left").where(F.col("old").isNull() | (F.col("old") != F.col("hash")))
    return rows.select("page_id", "pos", F.col("old").isNotNull().alias("reuse_slot"))


@query("win_listnum", f"""WITH {fx.UNITS}, l AS (SELECT page_id, unit_id, pos, pos // 6 AS list, CASE WHEN page_id % 4 > 0 THEN page_id % 4 END AS start, CASE WHEN pos % 6 = 4 AND page_id % 5 = 0 THEN 20 + pos END AS value, page_id % 3 = 0 AS back FROM units WHERE pos % 6 >= 2),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id, list ORDER BY pos) AS n, count(*) OVER (PARTITION BY page_id, list) AS size, last_value(value IGNORE NULLS) OVER (PARTITION BY page_id, list ORDER BY pos) AS v FROM l), a AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN n END IGNORE NULLS) OVER (PARTITION BY page_id, list ORDER BY pos) AS nth FROM n)
SELECT unit_id, CASE WHEN v IS NOT NULL THEN v + (n - nth) * CASE WHEN back THEN -1 ELSE 1 END WHEN back THEN coalesce(start, size) - n + 1 ELSE coalesce(start, 1) + n - 1 END AS number FROM a""")
def win_listnum(spark, d):
    """Lists of up to four lines: some start late, run backwards or have an item with a value of its own."""
    i, pos = F.col("page_id"), F.col("pos")
    rows = fx.units(spark, d).where("pos % 6 >= 2").select("page_id", "unit_id", "pos", F.floor(pos / 6).alias("list"), F.when(i % 4 > 0, i % 4).alias("start"), F.when((pos % 6 == 4) & (i % 5 == 0), pos + 20).alias("value"), (i % 3 == 0).alias("reversed"))
    return pg.numbered_items(rows).select("unit_id", "number")
