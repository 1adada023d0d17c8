"""Queries over logs, from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiweave.functions import scalars as sc
from lexiweave.operators import logs as lo
from lexiweave.plans import fixtures as fx
from lexiweave.plans.registry import query
from lexiweave.plans.rule_plans import RULES

LIFE = f"WITH {fx.LIFECYCLE}"
#: The rules of pages without the units that they are made of.
RULES_ONLY = RULES[len(fx.UNITS) + 2 :]


@query("qry_ring", f"{LIFE} SELECT log_id, n, event FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY n DESC) AS r FROM lifecycle) WHERE r <= 240")
def qry_ring(spark, d):
    return lo.ring(fx.lifecycle(spark, d)).select("log_id", "n", "event")


@query("qry_ring_short", f"{LIFE} SELECT log_id, n FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY n DESC) AS r FROM lifecycle) WHERE r <= 80")
def qry_ring_short(spark, d):
    return lo.ring(fx.lifecycle(spark, d), lo.SHORT_RING).select("log_id", "n")


@query("snk_log", f"{LIFE} SELECT log_id, max(n) AS sequence, least(count(*), 240) AS kept, max(n) - least(count(*), 240) AS dropped FROM lifecycle GROUP BY log_id")
def snk_log(spark, d):
    return lo.ring_state(fx.lifecycle(spark, d))


@query("qry_clear", f"{LIFE} SELECT log_id, n FROM lifecycle WHERE n > CASE WHEN day(stamp) % 2 = 0 THEN 100 ELSE 0 END")
def qry_clear(spark, d):
    log = fx.lifecycle(spark, d)
    marks = log.where(F.day("stamp") % 2 == 0).select("log_id", F.lit(100).alias("through")).distinct()
    return lo.after_watermark(log, marks).select("log_id", "n")


WINDOW = """w AS (SELECT log_id, max(n) > 240 AS incomplete, count_if(event = 'session-open') AS session_opens, count_if(event = 'translate-chunk') AS chunks, count_if(event = 'translate-chunk' AND hit) AS cache_hit_chunks,
 CASE WHEN max(n) <= 240 AND coalesce(bool_and(requests IS NOT NULL) FILTER (WHERE event IN ('translate-chunk', 'translate-failed')), true) THEN coalesce(sum(requests) FILTER (WHERE event IN ('translate-chunk', 'translate-failed')), 0)::BIGINT END AS translation_requests,
 CASE WHEN max(n) <= 240 AND coalesce(bool_and(requests IS NOT NULL) FILTER (WHERE event IN ('translate-chunk', 'translate-failed', 'preflight')), true) THEN coalesce(sum(requests) FILTER (WHERE event IN ('translate-chunk', 'translate-failed', 'preflight')), 0)::BIGINT END AS provider_requests,
 CASE WHEN max(n) <= 240 THEN coalesce(sum(failed) FILTER (WHERE event IN ('translate-chunk', 'translate-failed')), 0)::BIGINT END AS failed_units,
 coalesce(string_agg(DISTINCT category, ',' ORDER BY category), '') AS categories FROM lifecycle GROUP BY log_id)"""


@query("agg_logwin", f"{LIFE}, {WINDOW} SELECT * FROM w")
def agg_logwin(spark, d):
    return lo.log_window(fx.lifecycle(spark, d))


@query("agg_logwin_user", f"""WITH {fx.LIFECYCLE.replace("strftime(stamp, '%Y-%m-%d')", "CAST(user_id AS VARCHAR)")}, {WINDOW} SELECT * FROM w""")
def agg_logwin_user(spark, d):
    log = fx.lifecycle(spark, d).drop("n").withColumn("log_id", F.col("user_id").cast("string"))
    return lo.log_window(lo.numbered(log, "log_id", ("stamp", "event_id")))


@query("agg_restart", f"{LIFE} SELECT log_id, CASE WHEN count(DISTINCT epoch) > 1 THEN true WHEN bool_or(event = 'session-open') AND max(n) <= 240 THEN false END AS restarted FROM lifecycle GROUP BY log_id")
def agg_restart(spark, d):
    return lo.restarts(fx.lifecycle(spark, d))


@query("agg_curpage", f"{LIFE} SELECT user_id, CASE WHEN bool_and(event <> 'session-open') THEN count_if(event = 'heartbeat') END AS reconnects, sum(requests)::BIGINT AS requests FROM lifecycle GROUP BY user_id")
def agg_curpage(spark, d):
    readable = F.bool_and(F.col("event") != "session-open")
    return fx.lifecycle(spark, d).groupBy("user_id").agg(F.when(readable, F.count_if(F.col("event") == "heartbeat")).alias("reconnects"), F.sum("requests").alias("requests"))


CALLS = "calls AS (SELECT CASE WHEN event = 'preflight' THEN 'preflight' ELSE 'translation' END AS phase, CASE WHEN k % 10 <> 3 THEN k * 10 END AS input, k * 4 AS output FROM lifecycle WHERE event IN ('translate-chunk', 'preflight'))"


@query("agg_usage", f"{LIFE}, {CALLS} SELECT phase, coalesce(sum(input), 0)::BIGINT AS input, coalesce(sum(output), 0)::BIGINT AS output, bool_or(input IS NULL OR output IS NULL) AS incomplete FROM calls GROUP BY ROLLUP (phase)")
def agg_usage(spark, d):
    log = fx.lifecycle(spark, d).where(F.col("event").isin("translate-chunk", "preflight"))
    return lo.usage(log.select(F.when(F.col("event") == "preflight", "preflight").otherwise("translation").alias("phase"), F.when(F.col("k") % 10 != 3, F.col("k") * 10).alias("input"), (F.col("k") * 4).alias("output")))


@query("agg_reasons", f"{LIFE} SELECT CASE WHEN category IS NULL THEN 'initial' ELSE 'retry:' || category END AS reason, count(*) AS n FROM lifecycle GROUP BY ALL")
def agg_reasons(spark, d):
    return lo.attempts(fx.lifecycle(spark, d).select(F.when(F.col("category").isNull(), "initial").otherwise(F.concat(F.lit("retry:"), F.col("category"))).alias("reason")))


@query("agg_streak", f"""{LIFE}, a AS (SELECT *, CASE WHEN category IS NOT DISTINCT FROM lag(category) OVER (PARTITION BY log_id ORDER BY n) THEN 0 ELSE 1 END AS new FROM lifecycle),
b AS (SELECT *, sum(new) OVER (PARTITION BY log_id ORDER BY n) AS run FROM a) SELECT log_id, category, min(n) AS first, count(*) AS length, count(*) >= 3 AS stops FROM b WHERE category IS NOT NULL GROUP BY log_id, run, category""")
def agg_streak(spark, d):
    return lo.streaks(fx.lifecycle(spark, d))


@query("agg_runtime", f"{LIFE} SELECT user_id AS page_id, sum(requests)::BIGINT AS requests, sum(failed)::BIGINT AS splits, bool_or(hit) AS hit, bool_or(requests IS NULL) AS incomplete FROM lifecycle GROUP BY user_id")
def agg_runtime(spark, d):
    log = fx.lifecycle(spark, d)
    return lo.merged_runtime(log.select(F.col("user_id").alias("page_id"), "requests", F.col("failed").alias("splits"), "hit", F.col("requests").isNull().alias("incomplete")))


@query("fn_errclass", r"""SELECT event_id, CASE WHEN s IN (401, 403) THEN 'authentication' WHEN s = 404 THEN 'endpoint-not-found' WHEN s = 408 THEN 'timeout' WHEN s = 429 THEN 'rate-limit' WHEN s >= 500 THEN 'server-error' WHEN regexp_matches(m, 'json|parse') THEN 'invalid-response' WHEN regexp_matches(m, 'network|fetch') THEN 'network' ELSE 'unclassified' END AS category
FROM (SELECT event_id, CASE event_type WHEN 'error' THEN [401, 404, 408, 429, 500, 0][event_id % 6 + 1] ELSE 0 END AS s, CASE event_type WHEN 'click' THEN 'bad json here' WHEN 'view' THEN 'fetch failed' ELSE 'odd' END AS m FROM events)""")
def fn_errclass(spark, d):
    e = fx.table(spark, d, "events")
    status = F.when(F.col("event_type") == "error", F.element_at(F.array(*map(F.lit, (401, 404, 408, 429, 500, 0))), (F.col("event_id") % 6 + 1).cast("int"))).otherwise(0)
    message = F.when(F.col("event_type") == "click", "bad json here").when(F.col("event_type") == "view", "fetch failed").otherwise("odd")
    return e.select("event_id", sc.error_class(message, status).alias("category"))


@query("fn_failclass", r"""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'source-limit' WHEN event_id % 5 = 0 THEN 'invalid-response' WHEN event_type = 'error' THEN 'timeout' WHEN event_id % 2 = 0 THEN 'missing-items' END AS category FROM events""")
def fn_failclass(spark, d):
    i = F.col("event_id")
    message = F.when(F.col("event_type") == "error", "timed out")
    one = lambda c: F.when(c, 1).otherwise(0)
    return fx.table(spark, d, "events").select("event_id", sc.failure_class(one(i % 7 == 0), one(i % 5 == 0), message, F.lit(0), one(i % 2 == 0)).alias("category"))


@query("src_diag", f"""WITH {fx.TRANSLATED}, {RULES_ONLY},
p AS (SELECT doc_id AS page_id, length(coalesce(text, '')) AS page_chars FROM documents), s AS (SELECT page_id, count(*) AS total, count_if(state = 'done') AS done, count_if(state = 'failed') AS failed, count_if(state = 'pending') AS inflight FROM translated GROUP BY page_id),
x AS (SELECT page_id, count_if(role = 'heading') AS headings, sum(length(text))::BIGINT AS source_chars FROM translated GROUP BY page_id), u AS (SELECT page_id, count(*) AS batches, sum(n) AS requests FROM (SELECT page_id, pos // 4 AS b, count(*) AS n FROM translated WHERE state <> 'pending' GROUP BY ALL) GROUP BY page_id),
r AS (SELECT page_id, count_if(tier = 'hard') AS hard, count_if(tier = 'risky') AS risky FROM rules GROUP BY page_id), a AS (SELECT page_id, count(*) AS expected, count_if(contains(t, upper(replace(text, 'ß', 'ss')))) AS aligned FROM translated WHERE state = 'done' GROUP BY page_id)
SELECT p.page_id, page_chars, 'llm' AS engine, coalesce(total, 0) AS total, coalesce(done, 0) AS done, coalesce(failed, 0) AS failed, coalesce(inflight, 0) AS inflight, coalesce(headings, 0) AS headings, coalesce(source_chars, 0) AS source_chars, r.page_id IS NOT NULL AS has_profile, coalesce(hard, 0) AS hard, coalesce(risky, 0) AS risky,
 coalesce(batches, 0) AS batches, requests, expected, aligned FROM p LEFT JOIN s USING (page_id) LEFT JOIN x USING (page_id) LEFT JOIN u USING (page_id) LEFT JOIN r USING (page_id) LEFT JOIN a USING (page_id)""")
def src_diag(spark, d):
    """One diagnostic row for each page, joined of seven parts: page, config, session, extraction, profile, usage, consistency."""
    from lexiweave.plans.rule_plans import rules

    t = fx.translated(spark, d)
    state = lambda name: F.count_if(F.col("state") == name)
    page = fx.table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.char_length(F.coalesce("text", F.lit(""))).alias("page_chars"))
    session = t.groupBy("page_id").agg(F.count("*").alias("total"), state("done").alias("done"), state("failed").alias("failed"), state("pending").alias("inflight"))
    extraction = t.groupBy("page_id").agg(F.count_if(F.col("role") == "heading").alias("headings"), F.sum(F.length("text")).alias("source_chars"))
    calls = t.where("state <> 'pending'").groupBy("page_id", F.floor(F.col("pos") / 4).alias("b")).agg(F.count("*").alias("n"))
    usage = calls.groupBy("page_id").agg(F.count("*").alias("batches"), F.sum("n").alias("requests"))
    profile = rules(spark, d).groupBy("page_id").agg(F.lit(True).alias("has_profile"), F.count_if(F.col("tier") == "hard").alias("hard"), F.count_if(F.col("tier") == "risky").alias("risky"))
    aligned = t.where("state = 'done'").groupBy("page_id").agg(F.count("*").alias("expected"), F.count_if(F.contains("t", F.upper(F.replace("text", F.lit("ß"), F.lit("ss"))))).alias("aligned"))
    return lo.diagnostic(page, F.lit("llm"), session, extraction, profile, usage, aligned)


@query("src_panel", f"{LIFE}, l AS (SELECT DISTINCT user_id FROM lifecycle), c AS (SELECT user_id, count(*) AS n FROM lifecycle WHERE event = 'translate-chunk' GROUP BY user_id) SELECT l.user_id, coalesce(n, 0) AS events, CASE WHEN n IS NULL THEN 'content-log-unavailable' ELSE 'read' END AS source FROM l LEFT JOIN c ON c.user_id = l.user_id")
def src_panel(spark, d):
    log = fx.lifecycle(spark, d)
    read = log.where("event = 'translate-chunk'").groupBy("user_id").agg(F.count("*").alias("n"))
    rows = log.select("user_id").distinct().join(read, "user_id", "left")
    return rows.select("user_id", F.coalesce("n", F.lit(0)).alias("events"), F.when(F.col("n").isNull(), "content-log-unavailable").otherwise("read").alias("source"))


@query("fn_count", "SELECT event_id, CASE WHEN value > 0 AND event_id % 9 <> 0 THEN value ELSE 0 END AS count FROM events")
def fn_count(spark, d):
    return fx.table(spark, d, "events").select("event_id", sc.finite_count(F.when(F.col("event_id") % 9 == 0, float("inf")).otherwise(F.col("value"))).alias("count"))


@query("jn_auth", f"""{LIFE}, w AS (SELECT *, max(CASE WHEN event = 'session-open' THEN event_id END) OVER w AS opened, max(CASE WHEN event = 'translate-chunk' AND event_id % 7 = 0 THEN event_id END) OVER w AS closed FROM lifecycle WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, CASE WHEN opened IS NULL OR coalesce(closed, -1) > opened THEN 'session-expired' WHEN event_id % 7 = 0 THEN 'no-permission' ELSE 'ok' END AS outcome FROM w WHERE event = 'translate-chunk'""")
def jn_auth(spark, d):
    """Requests of registered sessions with a permission; every seventh has lost it, which closes its session."""
    log = fx.lifecycle(spark, d).where("event IN ('session-open', 'translate-chunk')")
    rows = log.select(F.col("user_id").alias("session"), F.col("event_id").alias("at"), F.when(F.col("event") == "session-open", "open").otherwise("request").alias("kind"), (F.col("event_id") % 7 != 0).alias("permitted"))
    return lo.authorized(rows).select(F.col("at").alias("event_id"), "outcome")
