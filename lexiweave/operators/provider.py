"""Batched provider calls: budget, retries, halving, markers, validation; deterministic provider by default.

A provider is any object with complete(items) -> Reply for chat models or
translate(text) -> str for machine engines. Calls run inside partitions; the
loop of one batch holds that batch alone. Nothing here sleeps: delays are
reported, not waited for, unless a sleep function is given.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from lexiweave.functions.formats import first_object

MOST_ATTEMPTS, MOST_RETRIES, MOST_DEPTH, MOST_CONCURRENT = 9, 2, 2, 8
MOST_SOURCE, MOST_COMPILED = 12_000, 48_000
TOO_LARGE = (413, 414)
LETTERS = re.compile(r"[^\W_]")


class CallError(Exception):
    def __init__(self, message: str, status: int = 0, retryable: bool = False, splits: bool = False, after_ms: float = 0):
        super().__init__(message)
        self.status, self.retryable, self.splits, self.after_ms = status, retryable, splits, after_ms


class Mock:
    """Marks and upper-cases; drops, doubles or spoils items by their id, so that every path is taken."""

    def __init__(self, language: str = "fr"):
        self.language = language

    def complete(self, items: list[tuple[int, str]]) -> str:
        rows = []
        for i, text in items:
            if i % 11 == 0 and len(items) > 1:
                continue
            t = "-" if i % 17 == 0 else f"[{self.language}] {text.upper()}"
            rows += [{"i": i, "t": t}] * (2 if i % 13 == 0 and len(items) > 2 else 1)
        return json.dumps({"items": rows}, ensure_ascii=False)

    def translate(self, text: str) -> str:
        return re.sub(r"(?m)^(?!__LW_).*$", lambda m: m[0].upper(), text)


def usable(source: str, target) -> bool:
    if not isinstance(target, str) or not target.strip():
        return False
    return not LETTERS.search(source) or bool(LETTERS.search(target))


def parsed_reply(raw: str, wanted: list[int]) -> tuple[dict[int, str], dict[int, dict], bool]:
    """Texts and alignments by id; ids given twice or not asked for are void; whether there was an object at all."""
    got = first_object(raw)
    texts: dict[int, str] = {}
    aligned: dict[int, dict] = {}
    seen: Counter = Counter()
    for entry in got.get("items") or [] if got else []:
        if not isinstance(entry, dict):
            continue
        i, t = entry.get("i", entry.get("id")), entry.get("t", entry.get("text", entry.get("translation")))
        if not isinstance(i, (int, float)) or not isinstance(t, str) or i not in wanted:
            continue
        seen[i] += 1
        texts[i] = t
        pairs = entry.get("a")
        aligned[i] = {k.strip(): v.strip() for k, v in pairs.items() if isinstance(v, str) and k.strip() and v.strip()} if isinstance(pairs, dict) else {}
    for i in [i for i, n in seen.items() if n > 1]:
        texts.pop(i), aligned.pop(i, None)
    return texts, aligned, got is not None


def backoff_ms(attempt: int, after_ms: float = 0) -> float:
    return after_ms or min(8000, 600 * 2**attempt)


@dataclass
class Run:
    """What one logical batch may spend and has met."""

    sleep: Callable[[float], None] | None = None
    attempts: int = 0
    reasons: Counter = field(default_factory=Counter)
    splits: int = 0
    failure: str | None = None
    sent: set[int] = field(default_factory=set)

    def attempt(self, depth: int, reason: str) -> None:
        if self.attempts >= MOST_ATTEMPTS:
            raise CallError("the batch's requests are used up")
        self.attempts += 1
        self.splits += depth > 0
        self.reasons[reason] += 1

    def retried(self, call: Callable[[], str], depth: int, reason: str, retries: int = MOST_RETRIES) -> str:
        tried = 0
        while True:
            try:
                self.attempt(depth, reason)
                return call()
            except CallError as e:
                if tried >= retries or not e.retryable:
                    raise
                if self.sleep:
                    self.sleep(backoff_ms(tried, e.after_ms) / 1000)
                reason = f"retry:{e.status or 'error'}"
                tried += 1


#: What follows an outcome: why the items that are left are asked for again in smaller parts, whether a single item is too.
AFTER = {"answered": ("missing-items", True), "source-limit": ("source-limit", False), "unreadable": ("invalid-response", False)}


@dataclass(frozen=True)
class Ask:
    """A part of a batch that is still to be asked for."""

    items: tuple
    depth: int = 0
    reason: str = "initial"

    def smaller(self, items: tuple, reason: str) -> list[Ask]:
        cut = (len(items) + 1) // 2
        return [Ask(x, self.depth + 1, reason) for x in (items[:cut], items[cut:]) if x]


def source_units(items) -> int:
    """UTF-16 units of the sources."""
    return sum(len(t.encode("utf-16-le", "surrogatepass")) // 2 for _, t in items)


def compiled_chars(provider, items) -> int:
    """Characters of the prompt that the provider makes of items; 0 where it makes none."""
    made = getattr(provider, "messages", None)
    return sum(map(len, made(list(items)))) if made else 0


def too_long(provider, items) -> bool:
    """Beyond the limits of the sources or of the prompt that the provider makes of them; a provider that takes any length says so by ``unlimited``."""
    if getattr(provider, "unlimited", False):
        return False
    return source_units(items) > MOST_SOURCE or compiled_chars(provider, items) > MOST_COMPILED


def answer(provider, ask: Ask, run: Run) -> tuple[str, dict[int, str]]:
    """(outcome, texts by id) of one request with its retries; a refusal is noted in the run."""
    if too_long(provider, ask.items):
        return "source-limit", {}
    wanted = [i for i, _ in ask.items]

    def call() -> dict[int, str]:
        run.sent.update(wanted)
        texts, _, readable = parsed_reply(provider.complete(list(ask.items)), wanted)
        if not readable:
            raise CallError("no object in the reply", retryable=True, splits=True)
        return texts

    try:
        return "answered", run.retried(call, ask.depth, ask.reason, 0 if ask.reason == "invalid-response" else MOST_RETRIES)
    except CallError as e:
        if e.splits:
            return "unreadable", {}
        run.failure = str(e)
        return "refused", {}


def translate_batch(provider, items: list[tuple[int, str]], run: Run) -> tuple[dict[int, str], list[int]]:
    """Translations by id and the ids that failed. Parts are worked off first to last; what one leaves goes back on the list, twice at most."""
    done: dict[int, str] = {}
    todo = [Ask(tuple(items))] if items else []
    while todo and not run.failure:
        ask = todo.pop(0)
        outcome, texts = answer(provider, ask, run)
        done |= {i: texts[i] for i, t in ask.items if usable(t, texts.get(i))}
        left = tuple(x for x in ask.items if x[0] not in done)
        reason, single = AFTER.get(outcome, ("", False))
        if reason and left and ask.depth < MOST_DEPTH and (single or len(left) > 1):
            todo = ask.smaller(left, reason) + todo
    return done, [i for i, _ in items if i not in done]


def pack_markers(items: list[tuple[int, str]], context: str = "") -> tuple[str, str]:
    """One text with a marker before each item, and the markers' prefix."""
    nonce = hashlib.sha256(json.dumps([items, context], ensure_ascii=False).encode()).hexdigest()[:16]
    prefix = f"__LW_{nonce}_"
    parts = [f"{prefix}CONTEXT__\n{context.strip()}\n{prefix}CONTEXT_END__"] if context.strip() else []
    parts += [f"{prefix}UNIT_{n}__\n{t}" for n, (_, t) in enumerate(items)]
    return "\n".join([*parts, f"{prefix}END__"]), prefix


def unpack_markers(text: str, items: list[tuple[int, str]], prefix: str) -> dict[int, str] | None:
    """Texts by id; None if a marker is missing, doubled or out of order."""
    cuts = list(re.finditer(re.escape(prefix) + r"UNIT_(\d+)__", text))
    end = text.find(prefix + "END__", cuts[-1].end() if cuts else 0)
    if [int(m[1]) for m in cuts] != list(range(len(items))) or end < 0:
        return None
    stops = [m.start() for m in cuts[1:]] + [end]
    return {i: text[m.end() : stop].strip() for (i, _), m, stop in zip(items, cuts, stops, strict=True)}


def machine_reply(provider, part: list[tuple[int, str]], run: Run, depth: int, context: str) -> dict[int, str] | None:
    """Texts of a part sent as one marked text, or bare where it is one item without context; None where they are spoilt."""
    bare = len(part) == 1 and not context
    text, prefix = (part[0][1], "") if bare else pack_markers(part, context)

    def call() -> str:
        run.sent.update(i for i, _ in part)
        return provider.translate(text)

    try:
        reply = run.retried(call, depth, "recovery" if depth else "initial")
    except CallError as e:
        if e.status not in TOO_LARGE:
            run.failure = str(e)
        return None
    got = {part[0][0]: reply.strip()} if bare else unpack_markers(reply, part, prefix)
    return got if got and all(usable(t, got.get(i)) for i, t in part) else None


def translate_machine(provider, items: list[tuple[int, str]], run: Run, context: str = "") -> tuple[dict[int, str], list[int]]:
    """Spans of the batch by their ends: a spoilt one is cut in the middle, a spoilt single item goes once more without the context."""
    done: dict[int, str] = {}
    spans = [(0, len(items), 0, context)] if items else []
    while spans and not run.failure:
        lo, hi, depth, around = spans.pop()
        if got := machine_reply(provider, items[lo:hi], run, depth, around):
            done |= got
        elif hi - lo > 1:
            middle = (lo + hi + 1) // 2
            # A part of one item that recovery made is sent bare at once.
            spans += [(a, b, depth + 1, around if b - a > 1 else "") for a, b in ((middle, hi), (lo, middle))]
        elif around:
            spans.append((lo, hi, depth + 1, ""))
    return done, [i for i, _ in items if i not in done]


def _calling(provider, machine: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                items = [(m["i"], m["text"]) for m in members]
                state = Run()
                done, failed = (translate_machine if machine else translate_batch)(provider, items, state)
                rows += [(key, i, done.get(i), i in done, state.attempts, state.splits, i in state.sent) for i, _ in items]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], ["batch", "i", "t", "ok", "attempts", "splits", "sent"])

    return run


def translate(batches: DataFrame, provider=None, machine: bool = False, concurrency: int | None = None) -> DataFrame:
    """batch, i, t, ok, attempts and splits of its batch, sent (whether a request held the item itself) of each item.

    batches: batch, items array<struct<i, text>>; concurrency is 1 to 8 calls at once.
    """
    rows = batches.select("batch", "items")
    if concurrency:
        rows = rows.repartition(max(1, min(MOST_CONCURRENT, concurrency)), "batch")
    return rows.mapInArrow(_calling(provider or Mock(), machine), "batch bigint, i bigint, t string, ok boolean, attempts bigint, splits bigint, sent boolean")


def by_batch(make: Callable, kinds: list[tuple[str, str]]):
    """An Arrow step over (batch, items, more...): make(items, *more) gives rows without the batch, which goes before them."""
    arrow = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, members, *more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(key, *r) for r in make([(m["i"], m["text"]) for m in members], *more)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], arrow[k]) for j, (_, k) in enumerate(kinds)], [n for n, _ in kinds])

    return run, ", ".join(f"{n} {k}" for n, k in kinds)


def fitting(batches: DataFrame, provider) -> DataFrame:
    """batch, units (UTF-16, of the sources), compiled (characters of the prompt), fits: whether one request may take the batch."""
    make = lambda items: [(source_units(items), compiled_chars(provider, items), not too_long(provider, items))]
    return batches.select("batch", "items").mapInArrow(*by_batch(make, [("batch", "bigint"), ("units", "bigint"), ("compiled", "bigint"), ("fits", "boolean")]))


def packed(batches: DataFrame, context: str = "") -> DataFrame:
    """batch, packed, prefix: each batch as one text with markers."""
    make = lambda items: [pack_markers(items, context)]
    return batches.select("batch", "items").mapInArrow(*by_batch(make, [("batch", "bigint"), ("packed", "string"), ("prefix", "string")]))


def unpacked(replies: DataFrame) -> DataFrame:
    """batch, i, t of replies (batch, items, reply, prefix); t is null throughout a batch whose markers are missing, doubled or out of order."""

    def make(items, reply, prefix):
        got = unpack_markers(reply or "", items, prefix) or {}
        return [(i, got.get(i)) for i, _ in items]

    return replies.select("batch", "items", "reply", "prefix").mapInArrow(*by_batch(make, [("batch", "bigint"), ("i", "bigint"), ("t", "string")]))


def _retrying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, failures, after_ms in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            waits: list[float] = []
            run, left = Run(sleep=waits.append), [failures]

            def call() -> str:
                left[0] -= 1
                if left[0] >= 0:
                    raise CallError("busy", status=429, retryable=True, after_ms=after_ms)  # noqa: B023
                return "ok"

            try:
                ok = run.retried(call, 0, "initial") == "ok"
            except CallError:
                ok = False
            rows.append((key, run.attempts, round(1000 * sum(waits)), ok))
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], ["key", "attempts", "waited_ms", "ok"])


def retried(calls: DataFrame) -> DataFrame:
    """key, attempts, waited_ms, ok of calls that fail so many times first. calls: key, failures, after_ms (what the provider asks to wait, or 0)."""
    return calls.select("key", "failures", "after_ms").mapInArrow(_retrying, "key bigint, attempts bigint, waited_ms bigint, ok boolean")


def _queueing(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, slots = None, []
        for batch in batches:
            out = []
            for name, job, takes, cancelled in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if queue != (name,):
                    queue, slots = (name,), [0] * limit
                now = heapq.heappop(slots)
                if cancelled is not None and cancelled <= now:  # the slot is free, the job is gone
                    heapq.heappush(slots, now)
                    out.append((name, job, None))
                else:
                    heapq.heappush(slots, now + takes)
                    out.append((name, job, now))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(3)], ["queue", "job", "started"])

    return run


def queued(jobs: DataFrame, limit: int = 3) -> DataFrame:
    """queue, job, started: when each job starts, first come first served, ``limit`` (1 to 8) at once; null if it was cancelled before.

    jobs: queue, job (their order), takes, cancelled (a time or null). A queue is
    read as a sorted stream, so only its running jobs are held.
    """
    rows = jobs.select("queue", "job", "takes", "cancelled").repartition("queue").sortWithinPartitions("queue", "job")
    return rows.mapInArrow(_queueing(min(MOST_CONCURRENT, max(1, limit))), "queue bigint, job bigint, started bigint")
