"""Wires, request limits, queues, redaction and keyed state beyond what the registered queries reach."""

import heapq
import json
import random

import pytest
from pyspark.sql import functions as F

from lexiweave.functions import formats as fm
from lexiweave.operators import provider as pr
from lexiweave.operators import wires as wi
from lexiweave.streaming import flows as fl


def test_requests():
    r = wi.chat_request("https://h/v1/", "k&y", "m", "s", "u", auth="query", query="v=1")
    assert r["url"] == "https://h/v1/chat/completions?key=k%26y&v=1" and "Authorization" not in r["headers"]
    assert json.loads(r["body"])["response_format"] == {"type": "json_object"}
    r = wi.messages_request("https://h/v1", "k", "m", "s", "u")
    assert r["headers"]["x-api-key"] == "k" and json.loads(r["body"])["max_tokens"] == 8192
    r = wi.form_request("", "a&b é", "", "zh-CN")
    assert r["body"] == "q=a%26b%20%C3%A9" and "sl=auto&tl=zh-CN" in r["url"]
    assert json.loads(wi.json_request(" https://h ", "t", "", "FR")["body"]) == {"text": "t", "source_lang": "AUTO", "target_lang": "FR"}


def test_json_mode_is_given_up_once():
    model = wi.Model(wi.Offline())
    for _ in range(3):
        assert json.loads(model.complete([(1, "x")]).strip("`json\n"))["items"] == [{"i": 1, "t": "[fr] x"}]
    assert model.fallbacks == 1


@pytest.mark.parametrize(
    ("status", "body", "text_of", "retryable"),
    [(429, "", wi.chat_text, True), (401, "", wi.chat_text, False), (200, "{}", wi.chat_text, True), (200, "no", wi.messages_text, True), (200, '{"code": 500}', wi.json_text, True), (200, '{"code": 403, "data": "x"}', wi.json_text, False), (200, "{}", wi.json_text, False)],
)
def test_bad_replies(status, body, text_of, retryable):
    with pytest.raises(pr.CallError) as e:
        wi.read(status, body, text_of)
    assert e.value.retryable is retryable


def test_replies():
    assert wi.read(200, '{"sentences": [{"trans": "a"}, {"x": 1}, {"trans": "b"}]}', wi.form_text) == "ab"
    assert wi.read(200, '[[["a", 1], ["b"]]]', wi.form_text) == "ab"
    assert wi.read(200, '{"code": 200, "translation": "t"}', wi.json_text) == "t"
    assert wi.read(200, '{"content": [{"type": "text", "text": "a"}, {"type": "other", "text": "x"}, {"type": "text", "text": "b"}]}', wi.messages_text) == "ab"


def test_compiled_limit():
    """A prompt beyond 48,000 characters is split like sources beyond 12,000."""
    model = wi.Model(wi.Offline(), compile=lambda items: ("s" * 30_000 * len(items), json.dumps({"items": [{"i": i, "t": t} for i, t in items]})))
    run = pr.Run()
    done, failed = pr.translate_batch(model, [(1, "a"), (2, "b")], run)
    assert done == {1: "[fr] a", 2: "[fr] b"} and not failed and run.reasons["source-limit"] == 2


def test_queue(spark):
    r = random.Random(2)
    jobs = [(q, j, r.randint(1, 9), r.choice([None, None, 0, 5, 12])) for q in (1, 2) for j in range(40)]
    got = {(x.queue, x.job): x.started for x in pr.queued(spark.createDataFrame(jobs, "queue long, job long, takes long, cancelled long"), 3).collect()}
    for q in (1, 2):
        slots = [0, 0, 0]
        for _, j, takes, gone in (x for x in jobs if x[0] == q):
            now = min(slots)
            if gone is not None and gone <= now:
                assert got[q, j] is None
            else:
                heapq.heapreplace(slots := sorted(slots), now + takes)
                assert got[q, j] == now


def test_redaction():
    record = {"prompt": "x", "note": "Bearer abc see https://u:p@h.example/a?q#f", "pageUrl": "nothing", "n": float("inf"), "a": [{"b": [{"c": [1]}]}], "list": list(range(50))}
    assert fm.redacted(record) == {"note": "Bearer [redacted] see https://h.example/a", "pageUrl": "[invalid-url]", "n": None, "a": [{"b": ["[truncated]"]}], "list": list(range(40))}
    assert fm.redacted("x" * 400) == "x" * 320


def test_memory_keeps_the_latest(spark, tmp_path):
    """Beyond the bound the entry observed longest ago goes, and comes back without its past."""
    rows = [(1, 1, "a", "t", "x"), (1, 2, "b", "t", "y"), (1, 3, "c", "t", "z"), (1, 4, "a", "t", "other"), (1, 5, "c", "t", "odd")]
    spark.createDataFrame(rows, "user_id long, at long, lemma string, trigger string, target string").withColumn("raw", F.col("target")).coalesce(1).write.parquet(f"{tmp_path}/o")
    stream = spark.readStream.schema("user_id long, at long, lemma string, trigger string, target string, raw string").parquet(f"{tmp_path}/o")
    r = fl.newest(fl.drained(fl.remembered(stream, 2), "memory-test", "update"), "user_id", "observations").first()
    assert (r.entries, r.usable, r.conflicted, r.observations) == (2, 1, 1, 5)
