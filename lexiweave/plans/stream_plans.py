"""Queries with streaming behaviour, on events. All run a stream but stm_navigate, stm_stale and flt_relevant_mut, which apply their steps to the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiweave.plans import fixtures as fx
from lexiweave.plans.registry import query
from lexiweave.streaming import flows as fl
from lexiweave.streaming import timed as td


def events(spark, d):
    return fx.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def stream(spark, d):
    return fl.event_stream(spark, d)


@query("stm_source", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stm_source(spark, d):
    return fl.drained(stream(spark, d).select("event_id", "event_type"), "source").groupBy("event_type").agg(F.count("*").alias("n"))


@query("stm_rescan", "SELECT DISTINCT user_id, event_type FROM events")
def stm_rescan(spark, d):
    return fl.drained(fl.rescanned(stream(spark, d).select("user_id", "event_type"), "user_id", "event_type"), "rescan")


@query("stm_memory", """WITH o AS (SELECT user_id, event_type || chr(0) || event_id % 4 AS name, event_id % 3 AS target FROM events), e AS (SELECT user_id, name, count(DISTINCT target) AS targets, count(*) AS n FROM o GROUP BY ALL)
SELECT user_id, count(*) AS entries, count_if(targets = 1) AS usable, count_if(targets > 1) AS conflicted, sum(n)::BIGINT AS observations FROM e GROUP BY user_id""")
def stm_memory(spark, d):
    rows = stream(spark, d).select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").alias("at"), F.col("event_type").alias("lemma"), (F.col("event_id") % 4).cast("string").alias("trigger"), (F.col("event_id") % 3).cast("string").alias("target"), F.lit("r").alias("raw"))
    return fl.newest(fl.drained(fl.remembered(rows), "memory", "update"), "user_id", "observations")


@query("stm_log", """WITH l AS (SELECT user_id, count(*) AS n, max(CASE WHEN event_id % 5 <> 0 THEN event_id END) AS good FROM events GROUP BY user_id), w AS (SELECT l.user_id, n, count_if(e.event_id > coalesce(good, -1)) AS waiting FROM l JOIN events e ON e.user_id = l.user_id GROUP BY l.user_id, n)
SELECT user_id, n - waiting AS sequence, least(8, n - waiting) AS kept, greatest(0, n - waiting - 8) AS dropped, waiting FROM w""")
def stm_log(spark, d):
    """Logs of each user with a ring of eight; every fifth row can't be written at first."""
    rows = stream(spark, d).select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").alias("at"), F.col("event_type").alias("event"), (F.col("event_id") % 5 == 0).alias("fails"))
    got = fl.drained(fl.logged(rows, 8), "log", "update").withColumn("seen", F.col("sequence") + F.col("waiting"))
    return fl.newest(got, "user_id", "seen").drop("seen")


@query("stm_order", """WITH p AS (SELECT user_id, event_type AS name, arg_max(event_id % 100, event_id) AS value, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, sum(n)::BIGINT AS version, '{' || string_agg('"' || name || '":' || value, ',' ORDER BY name) || '}' AS record FROM p GROUP BY user_id""")
def stm_order(spark, d):
    """Settings patches of each user, written one after the other."""
    rows = stream(spark, d).select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").alias("at"), F.col("event_type").alias("name"), (F.col("event_id") % 100).alias("value"))
    return fl.newest(fl.drained(fl.written(rows), "order", "update"), "user_id", "version")


@query("stm_navigate", "SELECT event_id, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM events")
def stm_navigate(spark, d):
    return fl.sessions_by_mark(events(spark, d), "user_id", ("ts", "event_id"), F.col("event_type") == "signup").select("event_id", "session")


@query("stm_stale", "SELECT doc_id AS key FROM documents WHERE doc_id % 6 = 1")
def stm_stale(spark, d):
    docs = fx.table(spark, d, "documents")
    before = docs.select(F.col("doc_id").alias("key"), F.sha2("text", 256).alias("hash"))
    now = F.when(F.col("doc_id") % 6 == 1, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    return fl.stale(before, docs.select(F.col("doc_id").alias("key"), F.sha2(now, 256).alias("hash")))


@query("flt_relevant_mut", "SELECT event_id FROM events WHERE event_type <> 'view'")
def flt_relevant_mut(spark, d):
    """Changes that are not the engine's own."""
    return events(spark, d).where("event_type <> 'view'").select("event_id")


@query("stm_debounce", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 400 MILLISECONDS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, b")
def stm_debounce(spark, d):
    """Bursts come out once the watermark has passed them, so only open ones are held."""
    rows = td.replayed_stream(events(spark, d).select("user_id", "ts"), "ts")
    bursts = fl.drained(fl.debounced(rows, "user_id"), "debounce").where("user_id IS NOT NULL")
    return bursts.select("user_id", F.unix_micros("start").alias("start_us"), "n")


SLOT_MS = 6 * 3600 * 1000
#: Users are put into shards of about so many rows, for a user by itself may have a handful in a micro-batch.
ROWS_OF_SHARD = 5000


@query("stm_delay", f"""WITH i AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_type = 'signup' AS answer FROM events), s AS (SELECT user_id, ms // {SLOT_MS} AS slot, count(*) AS n FROM i WHERE NOT answer GROUP BY ALL),
f AS (SELECT user_id, min(slot) AS first FROM s GROUP BY user_id), a AS (SELECT f.user_id, first, min(ms) AS answered FROM f LEFT JOIN i ON i.user_id = f.user_id AND answer AND ms >= (first + 1) * {SLOT_MS} GROUP BY ALL)
SELECT s.user_id, slot, n, CASE WHEN slot = first THEN (slot + 1) * {SLOT_MS} ELSE greatest((slot + 1) * {SLOT_MS}, answered) END AS released_ms FROM s JOIN a ON a.user_id = s.user_id WHERE slot = first OR answered IS NOT NULL""")
def stm_delay(spark, d):
    """Arrivals of six hours are a batch; all but a user's first wait until that one is answered."""
    kind = F.when(F.col("event_type") == "signup", "answer").otherwise("item")
    rows = events(spark, d).select(F.col("user_id").cast("long").alias("user_id"), "ts", F.unix_millis("ts").alias("at_ms"), F.col("event_id").alias("seq"), kind.alias("kind"))
    shards = max(16, rows.count() // ROWS_OF_SHARD)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("user_id"), F.lit(shards)))
    out = td.drained_state(spark, "delay", lambda: td.stateful(td.replayed_stream(rows, "ts"), "shard", td.Barrier(SLOT_MS), td.Barrier.OUT))
    return out.where("user_id IS NOT NULL")


@query("stm_heartbeat", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id, epoch_ms(ts) // 20000")
def stm_heartbeat(spark, d):
    got = fl.drained(fl.throttled(stream(spark, d), "user_id", 20), "heartbeat", "update")
    return got.groupBy("user_id", "slot").agg(F.min("event_id").alias("event_id")).drop("slot")


def states(rows, name, drop="seen"):
    """The last state of each user of a keyed fold."""
    return fl.newest(fl.drained(rows, name, "update"), "user_id", "seen").drop(drop)


def control(spark, d, **columns):
    return stream(spark, d).select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").alias("at"), *[c.alias(n) for n, c in columns.items()])


TAB = """s AS (SELECT user_id, event_id, event_id % 3 AS session, CASE WHEN event_id % 11 = 0 THEN 'abort-tab' WHEN event_id % 11 = 1 THEN 'abort' WHEN event_id % 11 < 5 THEN 'open' ELSE 'request' END AS kind FROM events),
p AS (SELECT *, coalesce(max(CASE WHEN kind = 'abort-tab' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS tab, coalesce(max(CASE WHEN kind = 'open' THEN event_id END) OVER w, -1) AS o, coalesce(max(CASE WHEN kind = 'abort' THEN event_id END) OVER w, -1) AS a
 FROM s WINDOW w AS (PARTITION BY user_id, session ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, o > greatest(tab, a) AS live FROM p),
t AS (SELECT user_id, session, max(CASE WHEN kind = 'open' THEN event_id END) AS o, coalesce(max(CASE WHEN kind = 'abort' THEN event_id END), -1) AS a FROM s GROUP BY ALL),
z AS (SELECT user_id, coalesce(max(CASE WHEN kind = 'abort-tab' THEN event_id END), -1) AS tab FROM s GROUP BY user_id),
e AS (SELECT t.user_id, count_if(o > greatest(a, tab)) AS alive FROM t JOIN z ON z.user_id = t.user_id GROUP BY t.user_id)"""


@query("stm_session", f"""WITH {TAB} SELECT l.user_id, any_value(alive) AS alive, count_if(kind = 'open' AND NOT live) AS opened, count_if(kind = 'open' AND NOT live) - any_value(alive) AS aborted, count_if(kind = 'request' AND live) AS served, count_if(kind = 'request' AND NOT live) AS refused
FROM l JOIN e ON e.user_id = l.user_id GROUP BY l.user_id""")
def stm_session(spark, d):
    """Sessions of each user's tab, opened, asked of and aborted, alone or with the tab."""
    i = F.col("event_id")
    kind = F.when(i % 11 == 0, "abort-tab").when(i % 11 == 1, "abort").when(i % 11 < 5, "open").otherwise("request")
    return states(fl.sessions(control(spark, d, kind=kind, session=(i % 3).cast("string"), allowed=F.lit(True))), "session")


@query("stm_late_session", """WITH e AS (SELECT user_id, event_id, event_id // 500 - CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS epoch FROM events), o AS (SELECT *, max(epoch) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
SELECT user_id, max(epoch) AS newest, count_if(coalesce(epoch < before, false)) AS dropped FROM o GROUP BY user_id""")
def stm_late_session(spark, d):
    """Results that come when a newer session has answered are dropped."""
    i = F.col("event_id")
    return states(fl.late_dropped(control(spark, d, epoch=F.floor(i / 500) - F.when(i % 5 == 0, 1).otherwise(0))), "late-session")


GATES = """g AS (SELECT user_id, event_id, CASE WHEN event_id % 6 = 0 THEN 'begin' WHEN event_id % 6 <> 1 THEN 'wait' WHEN event_id % 4 < 2 THEN 'clear' ELSE 'old' END AS kind FROM events),
b AS (SELECT *, max(CASE WHEN kind = 'begin' THEN event_id END) OVER w AS begun, max(CASE WHEN kind = 'clear' THEN event_id END) OVER w AS cleared, max(CASE WHEN kind = 'clear' THEN event_id END) OVER (PARTITION BY user_id) AS latest FROM g WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


@query("stm_gate", f"""WITH {GATES}, c AS (SELECT *, kind = 'wait' AND coalesce(begun, -1) > coalesce(cleared, -1) AND coalesce(latest, -1) < event_id AS waits FROM b)
SELECT user_id, count_if(kind = 'begin') AS generation, count_if(kind = 'wait' AND NOT waits) AS released, count_if(waits) AS waiting FROM c GROUP BY user_id""")
def stm_gate(spark, d):
    """Waiters follow the gates that replace each other; half of the clears belong to a gate that was replaced."""
    i = F.col("event_id")
    kind = F.when(i % 6 == 0, "begin").when(i % 6 == 1, "clear").otherwise("wait")
    return states(fl.gated(control(spark, d, kind=kind, back=F.when(i % 4 < 2, 0).otherwise(1))), "gate")


@query("stm_gate_rows", """WITH g AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, CASE WHEN event_id % 6 = 0 THEN 'begin' WHEN event_id % 6 <> 1 THEN 'wait' WHEN event_id % 4 < 2 THEN 'clear' ELSE 'old' END AS kind FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS n FROM g),
b AS (SELECT *, max(CASE WHEN kind = 'begin' THEN n END) OVER w AS begun, max(CASE WHEN kind = 'clear' THEN n END) OVER w AS cleared, min(CASE WHEN kind = 'clear' THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM n WINDOW w AS (PARTITION BY user_id ORDER BY n)),
o AS (SELECT user_id, event_id AS waiter, CASE WHEN coalesce(begun, 0) > coalesce(cleared, 0) THEN next ELSE n END AS by FROM b WHERE kind = 'wait') SELECT o.user_id, waiter, n.event_id AS released_by FROM o JOIN n ON n.user_id = o.user_id AND n.n = o.by""")
def stm_gate_rows(spark, d):
    """The waiters themselves, with the event that let each go on; those that still wait don't come out."""
    i = F.col("event_id").cast("long")
    kind = F.when(i % 6 == 0, "begin").when(i % 6 == 1, "clear").otherwise("wait")
    rows = events(spark, d).select(F.col("user_id").cast("long").alias("user_id"), "ts", F.unix_millis("ts").alias("at_ms"), i.alias("seq"), kind.alias("kind"), F.when(i % 4 < 2, 0).otherwise(1).alias("back"))
    return td.drained_state(spark, "gate-rows", lambda: td.stateful(td.replayed_stream(rows, "ts"), "user_id", td.Gate(), td.Gate.OUT)).where("user_id IS NOT NULL")


@query("stm_reconnect", """WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 7 <> 0 THEN event_id // 500 END AS epoch FROM events), m AS (SELECT *, epoch <> lag(epoch) OVER (PARTITION BY user_id ORDER BY event_id) AS moved FROM e WHERE epoch IS NOT NULL),
n AS (SELECT user_id, count_if(moved) AS replayed FROM m GROUP BY user_id)
SELECT e.user_id, coalesce(any_value(n.replayed), 0) AS replayed, count_if(epoch IS NULL) AS failed FROM e LEFT JOIN n ON n.user_id = e.user_id GROUP BY e.user_id""")
def stm_reconnect(spark, d):
    """Requests over restarts of the worker; every seventh reply names no epoch."""
    i = F.col("event_id")
    return states(fl.replayed(control(spark, d, epoch=F.when(i % 7 != 0, F.floor(i / 500)))), "reconnect")
