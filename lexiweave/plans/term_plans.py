"""Queries over terms: mining, tracking, telemetry, drift, precedents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiweave.functions import text as tx
from lexiweave.operators import rules as ru
from lexiweave.operators import terms as tm
from lexiweave.plans import fixtures as fx
from lexiweave.plans.registry import query
from lexiweave.plans.rule_plans import RULES as RULE_PAGES
from lexiweave.plans.rule_plans import rules
from lexiweave.plans.unit_plans import CAPS
from lexiweave.streaming.flows import kept

STOPS = ", ".join(f"'{x}'" for x in tx.STOP_WORDS)
TOKENS = rf"""tok0 AS (SELECT page_id, unit_id, pos, role, text, role = 'heading' OR {CAPS} AS shape, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9''’_-]*') AS ts FROM units),
tok1 AS (SELECT page_id, unit_id, pos, role, shape, unnest(ts) AS token, unnest(range(len(ts))) AS idx FROM tok0),
tok2 AS (SELECT *, CASE WHEN lower(token) IN ({STOPS}) OR regexp_matches(lower(token), '^(i|you|we|they|he|she|it)[''’](m|re|ve|ll|d|s)$') THEN NULL
 WHEN regexp_matches(token, '[a-z][A-Z]|[a-z]-[A-Z]|[A-Za-z][0-9]|[0-9][A-Za-z]') THEN 'fixed'
 WHEN shape AND (regexp_matches(token, '^[A-Z]{{2,}}$') OR (regexp_matches(token, '^[MDCLXVI]+$') AND regexp_matches(token, '^M{{0,4}}(CM|CD|D?C{{0,3}})(XC|XL|L?X{{0,3}})(IX|IV|V?I{{0,3}})$'))) THEN 'structural'
 WHEN length(token) >= 3 THEN 'lexical' END AS kind FROM tok1),
tokens AS (SELECT *, CASE WHEN kind = 'fixed' THEN 'fixed:' || token ELSE 'lexical:' || lower(token) END AS key, CASE kind WHEN 'fixed' THEN 4 WHEN 'lexical' THEN 2 ELSE 1 END AS kr FROM tok2 WHERE kind IS NOT NULL)"""
MINED = """surf AS (SELECT page_id, key, token, count(*) AS n FROM tokens GROUP BY ALL),
sl AS (SELECT page_id, key, string_agg(token || ':' || n, '|' ORDER BY n DESC, token) AS surfaces FROM surf GROUP BY ALL),
tg AS (SELECT page_id, key, arg_min(token, pos * 2147483648 + idx) AS term, count(*) AS cnt, count(DISTINCT unit_id) AS n_units, max(kr) AS kr FROM tokens GROUP BY ALL HAVING count(DISTINCT unit_id) >= 2),
tr AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY kr DESC, n_units DESC, cnt DESC, length(term) DESC, lower(term), term) AS rank FROM tg),
mined AS (SELECT tr.page_id, term, CASE WHEN kr = 4 THEN term ELSE lower(term) END AS lemma, CASE kr WHEN 4 THEN 'fixed' WHEN 2 THEN 'lexical' ELSE 'structural' END AS kind, CASE WHEN kr = 4 THEN 'AUTO' ELSE 'OBSERVED' END AS trust, cnt, n_units, surfaces, rank
 FROM tr JOIN sl ON sl.page_id = tr.page_id AND sl.key = tr.key WHERE rank <= 48)"""


@query("flt_stop", rf"WITH {fx.UNITS}, {TOKENS} SELECT token, count(*) AS n FROM tok2 WHERE kind IS NOT NULL AND kind <> 'fixed' GROUP BY token")
def flt_stop(spark, d):
    return tm.tokens(fx.units(spark, d)).where("kind <> 'fixed'").groupBy("token").agg(F.count("*").alias("n"))


@query("flt_fixedform", rf"WITH {fx.UNITS}, {TOKENS} SELECT token, count(*) AS n FROM tok2 WHERE kind = 'fixed' GROUP BY token")
def flt_fixedform(spark, d):
    return tm.tokens(fx.units(spark, d)).where("kind = 'fixed'").groupBy("token").agg(F.count("*").alias("n"))


@query("agg_terms", rf"WITH {fx.UNITS}, {TOKENS}, {MINED} SELECT page_id, term, lemma, kind, trust, cnt, n_units, surfaces FROM mined")
def agg_terms(spark, d):
    rows = tm.mine(fx.units(spark, d))
    return rows.withColumn("surfaces", tm.surfaces_text()).drop("rank")


@query("top_terms", rf"WITH {fx.UNITS}, {TOKENS}, {MINED} SELECT page_id, term, rank FROM mined")
def top_terms(spark, d):
    return tm.mine(fx.units(spark, d)).select("page_id", "term", "rank")


@query("fn_lemma", rf"WITH {fx.UNITS}, {TOKENS} SELECT DISTINCT token, CASE WHEN kind = 'fixed' THEN token ELSE lower(token) END AS lemma, key FROM tokens")
def fn_lemma(spark, d):
    rows = tm.tokens(fx.units(spark, d))
    return rows.select("token", tx.lemma_of(F.col("token"), F.col("kind")).alias("lemma"), tx.identity_of(F.col("token"), F.col("kind")).alias("key")).distinct()


HITS = r"""hits AS (SELECT t.*, c.term, c.kind, c.target, c.pos AS cpos, regexp_extract(t.text, '(?i)(?:^|[^A-Za-z0-9_])(' || c.term || ')(?:$|[^A-Za-z0-9_])', 1) AS surface FROM translated t JOIN contract c ON contains(lower(t.text), c.term)
 WHERE regexp_matches(t.text, '(?i)(?:^|[^A-Za-z0-9_])(' || c.term || ')(?:$|[^A-Za-z0-9_])'))"""
SEEN = r"""seen0 AS (SELECT *, CASE WHEN kind = 'locked' THEN 'fixed' ELSE kind END AS metric, CASE WHEN unit_id % 13 <> 0 THEN CASE WHEN unit_id % 7 = 0 THEN lower(surface) ELSE upper(surface) END END AS raw FROM hits),
seen AS (SELECT *, CASE WHEN raw IS NOT NULL AND contains(t, raw) THEN raw END AS rendered FROM seen0)"""


def hits(spark, d):
    return tm.term_hits(fx.translated(spark, d), fx.contract(spark, d))


def seen(spark, d):
    """The mock provider aligns a term with its upper- or lower-case form, and leaves some out."""
    raw = F.when(F.col("unit_id") % 13 != 0, F.when(F.col("unit_id") % 7 == 0, F.lower("surface")).otherwise(F.upper("surface")))
    return tm.observed(hits(spark, d).withColumn("raw", raw))


FIX = f"WITH {fx.TRANSLATED}, {fx.CONTRACT}, {HITS}, {SEEN}"


@query("jn_term", f"{FIX} SELECT unit_id, term, surface FROM hits")
def jn_term(spark, d):
    return hits(spark, d).select("unit_id", "term", "surface")


@query("fn_find", f"{FIX} SELECT unit_id, term, position(surface IN text) > 0 AS found FROM hits")
def fn_find(spark, d):
    return hits(spark, d).select("unit_id", "term", F.contains("text", "surface").alias("found"))


@query("jn_coverage", f"""WITH {fx.TRANSLATED}, {fx.CONTRACT}, {HITS} SELECT c.kind, count(*) AS total, count(h.term) AS matched, coalesce(string_agg(CASE WHEN h.term IS NULL THEN c.term END, ',' ORDER BY c.term), '') AS unmatched
FROM contract c LEFT JOIN (SELECT DISTINCT term FROM hits) h ON h.term = c.term GROUP BY c.kind""")
def jn_coverage(spark, d):
    return tm.coverage(fx.contract(spark, d), fx.units(spark, d))


@query("jn_drift", f"""WITH {fx.TRANSLATED}, {fx.CONTRACT}, dc AS (SELECT pos AS cpos, term, target || CASE WHEN pos % 4 = 0 THEN 'X' ELSE '' END || CASE WHEN pos % 4 = 1 THEN 'x' ELSE '' END AS target FROM contract),
v AS (SELECT t.unit_id, dc.term, dc.target, substr(t.text, 1, 80) AS excerpt, row_number() OVER (PARTITION BY t.unit_id ORDER BY dc.cpos, dc.term) AS n FROM translated t JOIN dc ON contains(lower(t.text), dc.term) AND NOT contains(t.t, dc.target) WHERE t.state = 'done' AND lower(dc.term) <> lower(dc.target))
SELECT unit_id, term, target, excerpt FROM v WHERE n = 1""")
def jn_drift(spark, d):
    c = fx.contract(spark, d).withColumn("target", F.concat("target", F.when(F.col("pos") % 4 == 0, "X").when(F.col("pos") % 4 == 1, "x").otherwise("")))
    return tm.drift(fx.translated(spark, d).drop("pos"), c)


@query("agg_telemetry", f"""{FIX}, e AS (SELECT term, kind, count(*) AS expected, count(rendered) AS aligned, count(DISTINCT rendered) AS variant_count, count(DISTINCT CASE WHEN rendered IS NOT NULL THEN raw END) AS raw_count FROM seen GROUP BY ALL),
v AS (SELECT term, kind, string_agg(rendered || ':' || n, '|' ORDER BY n DESC, rendered) AS variants FROM (SELECT term, kind, rendered, count(*) AS n FROM seen WHERE rendered IS NOT NULL GROUP BY ALL) GROUP BY ALL)
SELECT e.*, v.variants FROM e JOIN v ON v.term = e.term AND v.kind = e.kind""")
def agg_telemetry(spark, d):
    out = tm.telemetry(seen(spark, d))
    return out.select("term", "kind", "expected", "aligned", "variant_count", "raw_count", tm.surfaces_text("variants").alias("variants"))


@query("agg_taxonomy", f"""{FIX}, e AS (SELECT term, kind, count(DISTINCT rendered) AS n FROM seen WHERE rendered IS NOT NULL GROUP BY ALL)
SELECT term, kind, CASE WHEN kind IN ('locked', 'fixed') THEN 'FIXED' WHEN n <= 1 THEN 'STABLE' ELSE 'UNKNOWN' END AS taxonomy, CASE WHEN n > 1 AND kind IN ('locked', 'fixed') THEN 'DRIFT' WHEN n > 1 THEN 'UNRESOLVED' ELSE 'CONSISTENT' END AS consistency FROM e""")
def agg_taxonomy(spark, d):
    return tm.telemetry(seen(spark, d)).select("term", "kind", "taxonomy", "consistency")


@query("agg_summary", f"""{FIX}, k AS (SELECT term, kind, count(DISTINCT rendered) AS n FROM seen WHERE rendered IS NOT NULL GROUP BY ALL),
o AS (SELECT count(*) AS expected, count(rendered) AS aligned, count_if(metric <> 'structural') AS semantic_expected, count_if(metric <> 'structural' AND rendered IS NOT NULL) AS semantic_aligned FROM seen),
t AS (SELECT count(*) AS terms, count_if(kind = 'locked') AS fixed, count_if(kind = 'locked' AND n > 1) AS drift, count_if(kind <> 'locked' AND n <= 1) AS stable, count_if(kind <> 'locked' AND n > 1) AS unknown FROM k)
SELECT *, CASE WHEN expected > 0 THEN aligned / expected::DOUBLE ELSE 0 END AS rate, CASE WHEN semantic_expected > 0 THEN semantic_aligned / semantic_expected::DOUBLE ELSE 0 END AS semantic_rate FROM o, t""")
def agg_summary(spark, d):
    return tm.summary(seen(spark, d))


@query("agg_summary_kind", f"{FIX} SELECT metric, count(*) AS expected, count(rendered) AS aligned, count(rendered) / count(*)::DOUBLE AS rate FROM seen GROUP BY metric")
def agg_summary_kind(spark, d):
    return tm.by_metric(seen(spark, d))


CONTEXT = "CASE WHEN length(x) <= 216 THEN x ELSE substr(x, 1, 215) || '…' END"


@query("top_samples", f"""{FIX}, s AS (SELECT *, row_number() OVER (PARTITION BY term, kind ORDER BY page_id, pos) AS sample, position(surface IN text) AS spot FROM seen WHERE rendered IS NOT NULL),
c AS (SELECT *, trim(regexp_replace(CASE WHEN spot > 101 THEN '…' ELSE '' END || substr(text, greatest(1, spot - 100), least(length(text) + 1, spot + length(surface) + 100) - greatest(1, spot - 100)) || CASE WHEN spot + length(surface) + 100 <= length(text) THEN '…' ELSE '' END, '\\s+', ' ', 'g')) AS x FROM s WHERE sample <= 8)
SELECT term, kind, sample, unit_id, surface, rendered, {CONTEXT} AS context FROM c""")
def top_samples(spark, d):
    return tm.samples(seen(spark, d))


@query("win_context", f"""{FIX}, s AS (SELECT *, position(surface IN text) AS spot FROM hits),
c AS (SELECT *, trim(regexp_replace(CASE WHEN spot > 101 THEN '…' ELSE '' END || substr(text, greatest(1, spot - 100), least(length(text) + 1, spot + length(surface) + 100) - greatest(1, spot - 100)) || CASE WHEN spot + length(surface) + 100 <= length(text) THEN '…' ELSE '' END, '\\s+', ' ', 'g')) AS x FROM s)
SELECT unit_id, term, {CONTEXT} AS context FROM c""")
def win_context(spark, d):
    return hits(spark, d).select("unit_id", "term", tx.context_around(F.col("text"), F.col("surface")).alias("context"))


@query("srt_variants", f"{FIX}, v AS (SELECT term, kind, rendered, count(*) AS n FROM seen WHERE rendered IS NOT NULL GROUP BY ALL) SELECT term, kind, rendered, n, row_number() OVER (PARTITION BY term, kind ORDER BY n DESC, rendered) AS place FROM v")
def srt_variants(spark, d):
    v = seen(spark, d).where("rendered IS NOT NULL").groupBy("term", "kind", "rendered").agg(F.count("*").alias("n"))
    return v.withColumn("place", F.row_number().over(Window.partitionBy("term", "kind").orderBy(F.desc("n"), "rendered")).cast("long"))


@query("top_suspect", f"{FIX}, k AS (SELECT term, kind, count(DISTINCT rendered) AS n FROM seen WHERE rendered IS NOT NULL GROUP BY ALL) SELECT term, kind FROM k WHERE n > 1 ORDER BY n DESC, term LIMIT 6")
def top_suspect(spark, d):
    return tm.telemetry(seen(spark, d)).where("variant_count > 1").orderBy(F.desc("variant_count"), "term").limit(6).select("term", "kind")


TRIGGER = r"""trg AS (SELECT *, regexp_extract_all(substr(text, 1, spot - 1), '[A-Za-z][A-Za-z0-9''’_-]*') AS bw, regexp_extract_all(substr(text, spot + length(term)), '[A-Za-z][A-Za-z0-9''’_-]*') AS aw FROM
 (SELECT *, position(regexp_extract(lower(text), '(?:^|[^a-z0-9_])(' || term || ')(?:$|[^a-z0-9_])') IN lower(text)) + CASE WHEN regexp_matches(lower(text), '^' || term || '($|[^a-z0-9_])') THEN 0 ELSE 1 END AS spot FROM seen)),
trig AS (SELECT *, lower(array_to_string(list_concat(list_concat(bw[greatest(len(bw) - 1, 1):], [term]), aw[:2]), ' ')) AS trigger FROM trg)"""
PRECEDENT = r"""pr AS (SELECT page_id, term AS lemma, trigger, rendered, raw, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM trig WHERE rendered IS NOT NULL AND kind NOT IN ('locked', 'fixed', 'structural') GROUP BY ALL),
prec AS (SELECT page_id, lemma, trigger, count(DISTINCT rendered) AS targets, sum(n)::BIGINT AS observations, count(DISTINCT rendered) = 1 AS usable, CASE WHEN count(DISTINCT rendered) = 1 THEN min(raw) END AS preferred, min(first_pos) AS first_pos, max(last_pos) AS last_pos FROM pr GROUP BY ALL)"""


def triggered(spark, d):
    return tm.with_trigger(seen(spark, d))


@query("win_trigger", f"{FIX}, {TRIGGER} SELECT unit_id, term, trigger FROM trig")
def win_trigger(spark, d):
    return triggered(spark, d).select("unit_id", "term", "trigger")


@query("agg_precedent", f"{FIX}, {TRIGGER}, {PRECEDENT} SELECT page_id, lemma, trigger, targets, observations, usable FROM prec")
def agg_precedent(spark, d):
    return tm.precedents(triggered(spark, d)).select("page_id", "lemma", "trigger", "targets", "observations", "usable")


@query("agg_prefraw", f"{FIX}, {TRIGGER}, {PRECEDENT} SELECT page_id, lemma, trigger, preferred FROM prec WHERE usable")
def agg_prefraw(spark, d):
    return tm.precedents(triggered(spark, d)).where("usable").select("page_id", "lemma", "trigger", "preferred")


@query("top_precedent", f"{FIX}, {TRIGGER}, {PRECEDENT} SELECT page_id, lemma, trigger FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY last_pos DESC, lemma, trigger) AS n FROM prec) WHERE n <= 96")
def top_precedent(spark, d):
    return tm.latest_precedents(tm.precedents(triggered(spark, d))).select("page_id", "lemma", "trigger")


@query("flt_rendering", f"{FIX} SELECT unit_id, term, rendered IS NOT NULL AND kind NOT IN ('locked', 'fixed', 'structural') AS accepted FROM seen")
def flt_rendering(spark, d):
    return seen(spark, d).select("unit_id", "term", (F.col("rendered").isNotNull() & ~F.col("kind").isin("locked", "fixed", "structural")).alias("accepted"))


HINTS = r"""hint0 AS (SELECT DISTINCT c.page_id, c.pos // 4 AS chunk, c.term, c.trigger, p.preferred, p.usable, p.first_pos, min(c.pos) OVER (PARTITION BY c.page_id, c.pos // 4, c.term, c.trigger) AS first_at
 FROM trig c JOIN prec p ON p.page_id = c.page_id AND p.lemma = c.term AND p.trigger = c.trigger WHERE c.kind NOT IN ('locked', 'fixed', 'structural') AND p.first_pos // 4 < c.pos // 4),
hints AS (SELECT *, row_number() OVER (PARTITION BY page_id, chunk ORDER BY first_at, term, trigger) AS n FROM hint0 WHERE usable)"""


def coming_back(spark, d):
    """Triggered terms that stand in several chunks of their page: only these can have a precedent or be one. Written once, as it is read twice."""
    rows = seen(spark, d).where(~F.col("kind").isin("locked", "fixed", "structural")).withColumn("chunk", F.floor(F.col("pos") / 4))
    place = Window.partitionBy("page_id", "term")
    rows = rows.withColumns({"_lo": F.min("chunk").over(place), "_hi": F.max("chunk").over(place)}).where("_lo < _hi").drop("_lo", "_hi")
    rows = tm.with_trigger(rows).select("page_id", "pos", "chunk", "unit_id", "term", "kind", "trigger", "rendered", "raw")
    return kept(rows, "coming-back")


def hints(c):
    need = c.groupBy("page_id", "chunk", "term", "trigger").agg(F.min("pos").alias("at"))
    p = tm.precedents(c).where("usable").select("page_id", F.col("lemma").alias("term"), "trigger", "preferred", "target", "first_pos")
    rows = need.join(p, ["page_id", "term", "trigger"]).where(F.floor(F.col("first_pos") / 4) < F.col("chunk"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("page_id", "chunk").orderBy("at", "term", "trigger")).cast("long"))


@query("jn_precedent", f"{FIX}, {TRIGGER}, {PRECEDENT}, {HINTS} SELECT page_id, chunk, term, trigger, preferred FROM hints")
def jn_precedent(spark, d):
    """Precedents of earlier chunks for the terms of each chunk."""
    return hints(coming_back(spark, d)).select("page_id", "chunk", "term", "trigger", "preferred")


@query("top_hints", f"{FIX}, {TRIGGER}, {PRECEDENT}, {HINTS} SELECT page_id, chunk, term, trigger, n FROM hints WHERE n <= 8")
def top_hints(spark, d):
    return hints(coming_back(spark, d)).where(F.col("n") <= tm.MOST_HINTS).select("page_id", "chunk", "term", "trigger", "n")


@query("jn_hint_out", f"""{FIX}, {TRIGGER}, {PRECEDENT}, {HINTS} SELECT CASE WHEN t.rendered IS NULL THEN 'unaligned' WHEN t.rendered = h.preferred THEN 'matched' ELSE 'diverged' END AS outcome, count(*) AS n
FROM hints h JOIN trig t ON t.page_id = h.page_id AND t.pos // 4 = h.chunk AND t.term = h.term AND t.trigger = h.trigger GROUP BY ALL""")
def jn_hint_out(spark, d):
    t = coming_back(spark, d)
    rows = hints(t).join(t.select("page_id", "chunk", "term", "trigger", "rendered"), ["page_id", "chunk", "term", "trigger"])
    outcome = F.when(F.col("rendered").isNull(), "unaligned").when(F.col("rendered") == F.col("target"), "matched").otherwise("diverged")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


POOL = r"""given AS (SELECT term, term AS lemma, kind, CASE kind WHEN 'locked' THEN 5 ELSE 7 END AS tier, (kind = 'risky')::INT AS risky, pos AS place FROM contract),
pool AS (SELECT NULL AS page_id, * FROM given UNION ALL SELECT page_id, term, lemma, kind, 10, 0, rank FROM mined)"""


@query("set_pool", f"WITH {fx.UNITS}, {fx.CONTRACT}, {TOKENS}, {MINED}, {POOL} SELECT page_id, term, lemma, kind, tier, risky, place FROM pool")
def set_pool(spark, d):
    """Candidates of all pages: the contract's once (no page), each page's own mined ones."""
    return tm.candidate_pool(fx.contract(spark, d), tm.mine(fx.units(spark, d))).select("page_id", "term", "lemma", "kind", "ord.tier", "ord.risky", "ord.place")


TRACKED = r"""alltext AS (SELECT page_id, string_agg(text, chr(10) ORDER BY pos) AS body FROM units GROUP BY page_id),
everywhere AS (SELECT DISTINCT m.page_id, g.* FROM mined m, given g UNION ALL SELECT * FROM pool WHERE page_id IS NOT NULL),
hit0 AS (SELECT e.*, (tier, risky, place) AS ord FROM everywhere e JOIN alltext USING (page_id) WHERE regexp_matches(body, CASE WHEN kind = 'fixed' THEN '' ELSE '(?i)' END || '(?:^|[^A-Za-z0-9_])' || term || '(?:$|[^A-Za-z0-9_])')),
hit1 AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(lemma), kind = 'lexical' ORDER BY ord) AS n, max((kind <> 'lexical')::INT) OVER (PARTITION BY page_id, lower(lemma)) AS prior FROM hit0),
hit2 AS (SELECT * FROM hit1 WHERE n = 1 AND (kind <> 'lexical' OR prior = 0)),
hit3 AS (SELECT *, row_number() OVER (PARTITION BY page_id, kind = 'lexical' ORDER BY ord) AS r, count_if(kind = 'lexical') OVER (PARTITION BY page_id) AS l, count_if(kind <> 'lexical') OVER (PARTITION BY page_id) AS p FROM hit2),
tracked AS (SELECT * FROM hit3 WHERE r <= CASE WHEN kind = 'lexical' THEN greatest(least(8, l, 32), 32 - p) ELSE greatest(32 - least(8, l, 32), 32 - l) END)"""


@query("top_tracked", f"WITH {fx.UNITS}, {fx.CONTRACT}, {TOKENS}, {MINED}, {POOL}, {TRACKED} SELECT page_id, term, kind FROM tracked")
def top_tracked(spark, d):
    u = fx.units(spark, d)
    return tm.tracked(tm.matched(fx.contract(spark, d), tm.mine(u), u)).select("page_id", "term", "kind")


@query("set_observe", f"""WITH {fx.UNITS}, {fx.CONTRACT}, {TOKENS}, {MINED}, u AS (SELECT page_id, lemma, kind, 0 AS src, rank AS ord FROM mined UNION ALL SELECT DISTINCT m.page_id, c.term, c.kind, 1, c.pos FROM mined m, contract c),
l AS (SELECT *, row_number() OVER (PARTITION BY page_id, lemma ORDER BY src DESC, ord DESC) AS n FROM u), f AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY src, ord) AS k FROM l WHERE n = 1) SELECT page_id, lemma, kind FROM f WHERE k <= 32""")
def set_observe(spark, d):
    """Mined rows and the contract's, the last of each lemma, 32 a page."""
    return tm.observed_pool(fx.contract(spark, d), tm.mine(fx.units(spark, d)))


@query("prj_view", f"{FIX} SELECT format('{{}} of {{}} aligned', count(rendered), count(*)) AS line FROM seen")
def prj_view(spark, d):
    return seen(spark, d).agg(F.format_string("%d of %d aligned", F.count("rendered"), F.count("*")).alias("line"))


@query("prj_view_page", f"""WITH {RULE_PAGES}, c AS (SELECT page_id, array_to_string(list(term ORDER BY pos, term) FILTER (WHERE tier = 'domain')[1:2], ' / ') AS domain, count_if(tier = 'preferred') AS preferred, count_if(tier = 'risky') AS risky, count_if(tier = 'keep') AS keep FROM rules WHERE source = 'user' GROUP BY page_id)
SELECT page_id, CASE WHEN coalesce(domain, '') <> '' THEN domain ELSE 'read' END AS peek, CASE WHEN preferred + risky + keep > 0 THEN preferred || ' suggestions, ' || risky || ' ambiguous' ELSE 'no suggestions' END || ', snapshot ' || left(sha256(page_id::VARCHAR), 8) AS info FROM c""")
def prj_view_page(spark, d):
    """A panel's lines on each page: its first two domains, and what its profile suggests."""
    profiles = rules(spark, d).where("source = 'user'")
    return ru.views(profiles, F.sha2(F.col("page_id").cast("string"), 256))
