"""Processing-time behaviour as Structured Streaming. Each step is a function of a
DataFrame that may be a stream or a table, so both give the same rows."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
QUIET, LATE = "400 milliseconds", "10 minutes"
MOST_REMEMBERED = 96


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """A stream of a folder's event files with ts as a timestamp, so that it can carry a watermark."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a master on one machine may go without."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return at or tempfile.mkdtemp(prefix="lexiweave-")


def kept(rows: DataFrame, name: str) -> DataFrame:
    """rows written to the shared folder and read again: worked out once, and not lost with an executor."""
    at = f"{shared_folder(rows.sparkSession)}/kept/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now and read what it wrote; the stream runs while the plan is made.

    Sink and checkpoint lie in the folder the cluster shares; the file sink's
    commit log makes retried micro-batches idempotent.
    """
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{at}/out").outputMode("append").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/out")

    written: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        written.append(number)
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/_part={number}")

    writer.foreachBatch(keep).outputMode(mode).start().awaitTermination()
    wanted = written[-1:] if mode == "complete" else written
    return spark.read.parquet(*[f"{at}/out/_part={i}" for i in wanted])


def rescanned(rows: DataFrame, *key: str) -> DataFrame:
    """Only rows whose key did not come before; state is bounded by the watermark where ts is among the key's columns."""
    return rows.dropDuplicates(list(key))


def debounced(rows: DataFrame, key: str, quiet: str = QUIET) -> DataFrame:
    """One row for each burst: a burst ends when its key is quiet for so long."""
    return rows.groupBy(F.session_window("ts", quiet).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def batched(rows: DataFrame, width: str, key: str) -> DataFrame:
    """Arrivals within a window's width are one batch."""
    return rows.groupBy(F.window("ts", width).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def fenced(rows: DataFrame, key: str, epoch: str) -> DataFrame:
    """Rows of each key's newest epoch; what older ones still deliver is dropped."""
    newest = rows.groupBy(key).agg(F.max(epoch).alias("_newest"))
    return rows.join(newest, key).where(F.col(epoch) == F.col("_newest")).drop("_newest")


def folded(rows: DataFrame, key: str, order: str, begin, step, end, out: str) -> DataFrame:
    """Keyed state over a stream, as JSON: begin() makes it, step(state, row) takes a row in, in order, end(state) tells what is emitted.

    rows: key and the columns that step reads; rows of a micro-batch are put in
    order, so the result hangs on the order of batches and rows alone.
    """

    def run(keys: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else begin()
        for row in pd.concat(list(parts)).sort_values(order, kind="stable").to_dict("records"):
            step(now, row)
        state.update((json.dumps(now, ensure_ascii=False),))
        yield pd.DataFrame([{key: keys[0], **end(now)}])

    return rows.groupBy(key).applyInPandasWithState(run, f"{key} long, {out}", "state string", "update", "NoTimeout")


def remembered(rows: DataFrame, most: int = MOST_REMEMBERED) -> DataFrame:
    """Renderings by (lemma, trigger) for each page: user_id, entries, usable, conflicted, observations.

    A trigger seen with two targets is in conflict and no longer usable. The
    ``most`` entries observed last are kept. rows: user_id, at, lemma, trigger, target, raw.
    """

    def step(now, row):
        name = f"{row['lemma']}\0{row['trigger']}"
        entry = now["entries"].pop(name, {})
        raws = entry.setdefault(row["target"], {})
        raws[row["raw"]] = raws.get(row["raw"], 0) + 1
        now["entries"][name] = entry  # the newest is last
        now["observations"] += 1
        if len(now["entries"]) > most:
            del now["entries"][next(iter(now["entries"]))]

    def end(now):
        usable = sum(len(e) == 1 for e in now["entries"].values())
        return {"entries": len(now["entries"]), "usable": usable, "conflicted": len(now["entries"]) - usable, "observations": now["observations"]}

    return folded(rows, "user_id", "at", lambda: {"entries": {}, "observations": 0}, step, end, "entries long, usable long, conflicted long, observations long")


def logged(rows: DataFrame, most: int = 240) -> DataFrame:
    """An append-only log for each key: user_id, sequence, kept, dropped, waiting.

    Rows that can't be written wait and go before the next one that can; numbers
    are given when a row is written. rows: user_id, at, event, fails.
    """

    def step(now, row):
        now["waiting"].append(row["event"])
        if not row["fails"]:
            for event in now["waiting"]:
                now["sequence"] += 1
                now["ring"].append([now["sequence"], event])
            now["waiting"] = []
            now["dropped"] += max(0, len(now["ring"]) - most)
            now["ring"] = now["ring"][-most:]

    def end(now):
        return {"sequence": now["sequence"], "kept": len(now["ring"]), "dropped": now["dropped"], "waiting": len(now["waiting"])}

    return folded(rows, "user_id", "at", lambda: {"sequence": 0, "ring": [], "waiting": [], "dropped": 0}, step, end, "sequence long, kept long, dropped long, waiting long")


def written(rows: DataFrame) -> DataFrame:
    """Patches of a record taken in one after the other: user_id, version (raised by each), record (JSON, in key order). rows: user_id, at, name, value."""

    def step(now, row):
        now["record"][row["name"]] = row["value"]
        now["version"] += 1

    return folded(rows, "user_id", "at", lambda: {"version": 0, "record": {}}, step, lambda now: {"version": now["version"], "record": json.dumps(now["record"], sort_keys=True, separators=(",", ":"))}, "version long, record string")


def configured(rows: DataFrame, effect_of) -> DataFrame:
    """Patches of a configuration: user_id, version, accepted, rejected, restarts, rescans, next_batches.

    A patch of an older version than the one known is rejected; one of the same
    version counts. A value that doesn't change has no effect. rows: user_id,
    at, version, key, value; effect_of(key): restart, rescan, next_batch or None.
    """

    def step(now, row):
        if now["version"] is not None and row["version"] < now["version"]:
            now["rejected"] += 1
            return
        now["version"] = row["version"]
        now["accepted"] += 1
        effect = effect_of(row["key"])
        if effect and now["values"].get(row["key"]) != row["value"]:
            now[effect] += 1
        now["values"][row["key"]] = row["value"]

    def end(now):
        return {"version": now["version"], "accepted": now["accepted"], "rejected": now["rejected"], "restarts": now["restart"], "rescans": now["rescan"], "next_batches": now["next_batch"]}

    begin = lambda: {"version": None, "values": {}, "accepted": 0, "rejected": 0, "restart": 0, "rescan": 0, "next_batch": 0}
    return folded(rows, "user_id", "at", begin, step, end, "version long, accepted long, rejected long, restarts long, rescans long, next_batches long")


def sessions(rows: DataFrame) -> DataFrame:
    """Registered sessions of each tab: user_id, seen, alive, opened, aborted, served, refused.

    A session is opened once; a request never opens one, so it is refused where
    its session is not registered. An abort ends one session, abort-tab all of
    the tab, recheck those whose permission (allowed) is gone. rows: user_id,
    at, kind (open, request, abort, abort-tab, recheck), session, allowed.
    """

    def step(now, row):
        alive, kind, name = now["alive"], row["kind"], row["session"]
        now["seen"] += 1
        if kind == "open":
            now["opened"] += name not in alive
            alive.setdefault(name, bool(row["allowed"]))
        elif kind == "request":
            now["served" if name in alive else "refused"] += 1
        else:
            ends = {"abort": lambda s: s == name, "abort-tab": lambda s: True, "recheck": lambda s: not alive[s]}[kind]
            gone = [s for s in alive if ends(s)]
            now["aborted"] += len(gone)
            for s in gone:
                del alive[s]

    def end(now):
        return {**now, "alive": len(now["alive"])}

    return folded(rows, "user_id", "at", lambda: {"alive": {}, **dict.fromkeys(("seen", "opened", "aborted", "served", "refused"), 0)}, step, end, "seen long, alive long, opened long, aborted long, served long, refused long")


def replayed(rows: DataFrame) -> DataFrame:
    """Requests that met a worker's restart: user_id, seen, replayed, failed.

    A request is sent again once, and only after a change of epoch that both
    sides have told; one whose reply names no epoch fails. rows: user_id, at, epoch.
    """

    def step(now, row):
        now["seen"] += 1
        if row["epoch"] is None or row["epoch"] != row["epoch"]:
            now["failed"] += 1
        else:
            now["replayed"] += now["epoch"] is not None and row["epoch"] != now["epoch"]
            now["epoch"] = row["epoch"]

    return folded(rows, "user_id", "at", lambda: {"epoch": None, "seen": 0, "replayed": 0, "failed": 0}, step, lambda now: {k: now[k] for k in ("seen", "replayed", "failed")}, "seen long, replayed long, failed long")


def gated(rows: DataFrame) -> DataFrame:
    """Waiters at gates that replace each other: user_id, seen, generation, released, waiting.

    A waiter goes on when the gate that stands then is cleared; clearing one that
    was replaced does nothing. rows: user_id, at, kind (begin, clear, wait), back
    (a clear's: how many generations before the newest it belongs to).
    """

    def step(now, row):
        now["seen"] += 1
        if row["kind"] == "begin":
            now["generation"] += 1
            now["gate"] = now["generation"]
        elif row["kind"] == "wait":
            now["released" if now["gate"] is None else "waiting"] += 1
        elif now["gate"] is not None and now["generation"] - row["back"] == now["gate"]:
            now["gate"], now["released"], now["waiting"] = None, now["released"] + now["waiting"], 0

    keys = ("seen", "generation", "released", "waiting")
    return folded(rows, "user_id", "at", lambda: {"gate": None, **dict.fromkeys(keys, 0)}, step, lambda now: {k: now[k] for k in keys}, "seen long, generation long, released long, waiting long")


def late_dropped(rows: DataFrame) -> DataFrame:
    """Results against the newest epoch met before: user_id, seen, newest, dropped. rows: user_id, at, epoch."""

    def step(now, row):
        now["seen"] += 1
        if now["newest"] is not None and row["epoch"] < now["newest"]:
            now["dropped"] += 1
        else:
            now["newest"] = row["epoch"]

    return folded(rows, "user_id", "at", lambda: {"seen": 0, "newest": None, "dropped": 0}, step, dict, "seen long, newest long, dropped long")


def newest(rows: DataFrame, key: str, by: str) -> DataFrame:
    """Of what a stream emitted on and on the last row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (key, "_batch")]), by).alias("m")).select(key, "m.*")


def sessions_by_mark(rows: DataFrame, key: str, order: tuple[str, ...], mark) -> DataFrame:
    """Adds session: how many marks a key has met so far, so a mark opens a new one."""
    return rows.withColumn("session", F.sum(F.when(mark, 1).otherwise(0)).over(Window.partitionBy(key).orderBy(*order)))


def throttled(rows: DataFrame, key: str, width_s: int) -> DataFrame:
    """The first row of a key in each slot of so many seconds."""
    slot = F.floor(F.unix_millis("ts") / (1000 * width_s))
    return rows.groupBy(key, slot.alias("slot")).agg(F.min("event_id").alias("event_id"))


def stale(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys whose content changed while a request was under way: their result is void."""
    return before.join(after.withColumnRenamed("hash", "now"), "key", "left").where(~F.col("hash").eqNullSafe(F.col("now"))).select("key")


def released(waits: DataFrame, gates: DataFrame) -> DataFrame:
    """When each waiter goes on: after the last gate opened of those that replaced each other. gates: key, opened."""
    return waits.join(gates.groupBy("key").agg(F.max("opened").alias("go_at")), "key", "left")
