"""Queries over scalar functions, on columns of the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiweave.functions import formats as fm
from lexiweave.functions import scalars as sc
from lexiweave.plans import fixtures as fx
from lexiweave.plans.registry import query

SEP = "chr(1)"


def docs(spark, d):
    return fx.table(spark, d, "documents")


@query("fn_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def fn_hash(spark, d):
    return docs(spark, d).select("doc_id", sc.hash_of(F.col("text")).alias("hash"))


@query("fn_cachekey", f"SELECT doc_id, sha256(concat_ws({SEP}, source, 'https://a.example', 'm', lang, text)) AS key FROM documents")
def fn_cachekey(spark, d):
    return docs(spark, d).select("doc_id", sc.cache_key(F.col("source"), F.lit("https://a.example"), F.lit("m"), F.col("lang"), F.col("text")).alias("key"))


@query("fn_fingerprint", f"SELECT doc_id, sha256(concat_ws({SEP}, '14', 'general', lang, '', source, CASE WHEN doc_id % 2 = 0 THEN 'whole-page' ELSE '' END, '0.2')) AS fingerprint FROM documents")
def fn_fingerprint(spark, d):
    whole = F.when(F.col("doc_id") % 2 == 0, "whole-page")
    return docs(spark, d).select("doc_id", sc.hash_of(F.lit(sc.PROMPT_VERSION), F.lit("general"), F.col("lang"), F.lit(None), F.col("source"), whole, F.lit("0.2")).alias("fingerprint"))


@query("fn_prekey", f"SELECT doc_id, CASE WHEN source <> 'src3' AND length(source) <= 128 THEN 'profile:' || sha256(concat_ws({SEP}, source, text)) END AS key FROM documents")
def fn_prekey(spark, d):
    identity = F.when(F.col("source") != "src3", F.col("source"))
    key = F.when(identity.isNotNull() & (F.length(identity) <= 128), F.concat(F.lit("profile:"), sc.hash_of(identity, F.col("text"))))
    return docs(spark, d).select("doc_id", key.alias("key"))


NAMES = ["English", "en_us", "chinese traditional", "DE", "Français", "pt-br", "iw", "???", "klingonese", "nb", " thai ", "zh-hant"]
CODES = ["en", "en-US", "zh-TW", "de", "fr", "pt-BR", "iw", "", "", "nb", "th", "zh-HANT"]
BASES = ["en", "en", "zh", "de", "fr", "pt", "he", "", "", "no", "th", "zh"]
LABELS = ["English", "English", "繁體中文", "Deutsch", "Français", "Português", "עברית", "???", "klingonese", "Norsk", "ไทย", "繁體中文"]


def named(spark, d):
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % len(NAMES) + 1).cast("int"))
    return docs(spark, d).select("doc_id", name.alias("name"))


def _pick(values, nulls=False):
    listed = ", ".join(f"'{v}'" if v is not None else "NULL" for v in values)
    return f"([{listed}])[doc_id % {len(values)} + 1]"


@query("fn_lang", f"SELECT doc_id, {_pick(CODES)} AS code FROM documents")
def fn_lang(spark, d):
    return named(spark, d).select("doc_id", sc.language_code(F.col("name")).alias("code"))


@query("fn_langnorm", f"SELECT doc_id, {_pick(BASES)} AS base, {_pick(LABELS)} AS label FROM documents")
def fn_langnorm(spark, d):
    return named(spark, d).select("doc_id", sc.language_base(F.col("name")).alias("base"), sc.language_label(F.col("name")).alias("label"))


@query("fn_mttarget", f"SELECT doc_id, CASE WHEN c <> '' THEN CASE WHEN doc_id % 2 = 0 THEN CASE c WHEN 'zh-TW' THEN 'ZH-HANT' WHEN 'zh-CN' THEN 'ZH' ELSE upper(c) END ELSE c END END AS target FROM (SELECT doc_id, {_pick(CODES)} AS c FROM documents)")
def fn_mttarget(spark, d):
    provider = F.when(F.col("doc_id") % 2 == 0, "deeplx").otherwise("google-translate")
    return named(spark, d).select("doc_id", sc.machine_target(F.col("name"), provider).alias("target"))


SECRETS = ["see https://u:p@a.example/x?k=1#f ok", "Authorization: abc", "Bearer abc.def here", "my sk-abcdefgh1234 key", "plain"]
SAFE = ["see https://a.example/x ok", "Authorization=[redacted]", "Bearer [redacted] here", "my [redacted-key] key", "plain"]


@query("fn_strsafe", f"SELECT doc_id, {_pick(SAFE)} AS safe FROM documents")
def fn_strsafe(spark, d):
    x = F.element_at(F.array(*map(F.lit, SECRETS)), (F.col("doc_id") % len(SECRETS) + 1).cast("int"))
    return docs(spark, d).select("doc_id", sc.safe_string(x).alias("safe"))


@query("flt_redact", f"""SELECT doc_id, {_pick(SAFE)} AS note, NULL AS key, 'https://x.example/a/[id]' AS url, least(40, doc_id % 60 + 1) AS listed, CASE WHEN doc_id % 2 = 0 THEN '[truncated]' ELSE lang END AS deep FROM documents""")
def flt_redact(spark, d):
    """Nested records with secrets, addresses, long lists and deep values."""
    x = F.element_at(F.array(*map(F.lit, SECRETS)), (F.col("doc_id") % len(SECRETS) + 1).cast("int"))
    deep = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.struct(F.col("lang").alias("e")).alias("d")))).otherwise(F.to_json(F.struct(F.col("lang").alias("d"))))
    deep = F.concat(F.lit('{"b":{"c":'), deep, F.lit("}}"))
    record = F.concat(
        F.lit('{"note":'), F.to_json(F.struct(x.alias("x"))), F.lit(',"apiKey":"k","url":"https://u:p@X.example/a/'), F.lit("a1" * 13), F.lit('?q=1#f","list":'),
        F.to_json(F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 60).cast("int")), lambda i: i)), F.lit(',"a":'), deep, F.lit("}"),
    )
    got = F.from_json(fm.redacted_udf(record), "note struct<x:string>, apiKey string, url string, list array<int>, a struct<b:struct<c:struct<d:string>>>")
    return docs(spark, d).select("doc_id", got.alias("r")).select("doc_id", "r.note.x", F.col("r.apiKey").alias("key"), "r.url", F.size("r.list").cast("long").alias("listed"), "r.a.b.c.d").toDF("doc_id", "note", "key", "url", "listed", "deep")


BASES_IN = ['"https://api.x.example/v1/chat/completions",', "localhost:11434/", "api.x.example", "https://api.x.example/v1/", ""]
BASES_OUT = ["https://api.x.example/v1", "http://localhost:11434", "https://api.x.example/v1", "https://api.x.example/v1", ""]


@query("fn_baseurl", f"SELECT doc_id, {_pick(BASES_OUT)} AS base FROM documents")
def fn_baseurl(spark, d):
    x = F.element_at(F.array(*map(F.lit, BASES_IN)), (F.col("doc_id") % len(BASES_IN) + 1).cast("int"))
    return docs(spark, d).select("doc_id", sc.base_url(x, F.lit("https://api.x.example/v1")).alias("base"))


@query("fn_keycheck", f"SELECT doc_id, {_pick(['ok', 'warn', 'warn', 'empty'])} AS level FROM documents")
def fn_keycheck(spark, d):
    x = F.element_at(F.array(*map(F.lit, ("sk-1", "sk 1", "key-1", " "))), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs(spark, d).select("doc_id", sc.key_level(x, F.lit("^sk-")).alias("level"))


@query("fn_configured", "SELECT doc_id, doc_id % 2 = 0 AND lang <> 'de' AS configured FROM documents")
def fn_configured(spark, d):
    i = F.col("doc_id")
    given = lambda c: F.when(c, "x")
    return docs(spark, d).select("doc_id", sc.is_configured(F.lit("b"), given(i % 2 == 0), F.lit(None).cast("string"), given(F.col("lang") != "de"), F.lit(True), F.lit(True), F.lit(False)).alias("configured"))


@query("fn_retrydelay", "SELECT doc_id, CAST(CASE doc_id % 3 WHEN 0 THEN 12000 WHEN 1 THEN 60000 ELSE 0 END AS DOUBLE) AS ms FROM documents")
def fn_retrydelay(spark, d):
    x = F.element_at(F.array(*map(F.lit, ("12", "Mon, 01 Jan 2024 00:01:00 GMT", "soon"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return docs(spark, d).select("doc_id", sc.retry_delay_ms(x, F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("ms"))


RENDERED = ['  “Ａ  b” ', '"「x」"', "plain text", "'", "ﬁne"]
COMPARED = ["A b", "x", "plain text", "''", "fine"]


@query("fn_rendernorm", f"SELECT doc_id, {_pick(COMPARED)} AS compared FROM documents")
def fn_rendernorm(spark, d):
    x = F.element_at(F.array(*map(F.lit, RENDERED)), (F.col("doc_id") % len(RENDERED) + 1).cast("int"))
    return docs(spark, d).select("doc_id", fm.comparable_udf(x).alias("compared"))


REPLIES = ['```json\n{"a": 1}\n```', 'Sure: {"b": {"c": "}"}} bye', "none", '{"cut": ', "﻿{\"d\": 2}"]


@query("fn_json", f"SELECT doc_id, {_pick(['{"a": 1}', '{"b": {"c": "}"}}', None, None, '{"d": 2}'])} AS object FROM documents")
def fn_json(spark, d):
    x = F.element_at(F.array(*map(F.lit, REPLIES)), (F.col("doc_id") % len(REPLIES) + 1).cast("int"))
    return docs(spark, d).select("doc_id", fm.first_object_udf(x).alias("object"))


PROFILES = ["```yaml\n领域: maps\n```", "  ", "优先:\n  a: b", "# only a comment"]


@query("fn_profile", f"SELECT doc_id, {_pick([True, False, True, False]).replace(chr(39), '')} AS usable FROM documents")
def fn_profile(spark, d):
    x = F.element_at(F.array(*map(F.lit, PROFILES)), (F.col("doc_id") % len(PROFILES) + 1).cast("int"))
    parsed = fm.rules_json_udf(F.regexp_replace(x, r"(?is)```(?:ya?ml|json)?\s*(.*?)```", "$1"))
    r = F.from_json(parsed, "principle string, domain array<string>, hard map<string,string>, preferred map<string,string>, risky map<string,string>, keep array<string>")
    empty = (r["principle"] == "") & (F.size(r["domain"]) == 0) & (F.size(r["hard"]) == 0) & (F.size(r["preferred"]) == 0) & (F.size(r["risky"]) == 0) & (F.size(r["keep"]) == 0)
    return docs(spark, d).select("doc_id", (~empty).alias("usable"))


MESSAGES = ["{0} of {1} done", "no slots", "{1}/{0}"]


@query("fn_uimsg", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN doc_id || ' of ' || n_chars || ' done' WHEN 1 THEN 'no slots' ELSE n_chars || '/' || doc_id END AS message FROM documents")
def fn_uimsg(spark, d):
    m = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("doc_id") % 3 + 1).cast("int"))
    return docs(spark, d).select("doc_id", F.replace(F.replace(m, F.lit("{0}"), F.col("doc_id").cast("string")), F.lit("{1}"), F.col("n_chars").cast("string")).alias("message"))


PRESETS = {"general": "Plain words.", "academic": "Keep terms exact.", "technical": "Leave commands and code alone.", "forum": "Keep the speaker's tone.", "news": "Neutral and brief."}


@query("fn_preset", f"SELECT doc_id, coalesce({_pick(['Plain words.', 'Neutral and brief.', None])}, 'Plain words.') AS guidance FROM documents")
def fn_preset(spark, d):
    x = F.element_at(F.array(*map(F.lit, ("general", "news", "bogus"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return docs(spark, d).select("doc_id", F.coalesce(sc.mapped(x, PRESETS), F.lit(PRESETS["general"])).alias("guidance"))


@query("fn_align", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a=' || source ELSE '' END AS pairs FROM documents")
def fn_align(spark, d):
    m = F.create_map(F.lit(" a "), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.lit(" ")), F.lit(" "), F.lit("b"))
    clean = F.map_filter(m, lambda k, v: (F.trim(k) != "") & (F.trim(v) != ""))
    return docs(spark, d).select("doc_id", F.array_join(F.transform(F.map_entries(clean), lambda e: F.concat_ws("=", F.trim(e["key"]), F.trim(e["value"]))), ",").alias("pairs"))


@query("src_models", """SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(CASE WHEN doc_id % 3 = 0 THEN ['embed-' || lang, 'tts-1'] WHEN doc_id % 3 = 1 THEN ['m-' || doc_id % 7, 'm-0'] ELSE ['m-' || lang, 'x'] END, lambda x: x IS NOT NULL))), ',') AS models FROM documents""")
def src_models(spark, d):
    """A provider's reply for each document, in each of its shapes: flattened, distinct, sorted; names that are no chat models go unless none is left."""
    name, lang = F.concat(F.lit("m-"), (F.col("doc_id") % 7).cast("string")), F.col("lang")
    quoted = lambda x: F.coalesce(F.concat(F.lit('"'), x, F.lit('"')), F.lit("null"))
    none = F.concat(F.lit('{"data": [{"id": '), quoted(F.concat(F.lit("embed-"), lang)), F.lit('}, {"id": "tts-1"}, {"id": "tts-1"}]}'))
    some = F.concat(F.lit('{"models": [{"name": '), quoted(name), F.lit('}, {"model": "m-0"}, {"name": "whisper-x"}, {"id": "  "}, {}]}'))
    bare = F.concat(F.lit('["x", '), quoted(F.concat(F.lit("m-"), lang)), F.lit(', "dall-e", "x"]'))
    reply = F.when(F.col("doc_id") % 3 == 0, none).when(F.col("doc_id") % 3 == 1, some).otherwise(bare)
    return docs(spark, d).select("doc_id", F.array_join(sc.chat_models(sc.model_list(reply)), ",").alias("models"))


@query("jn_provider", "SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN 'mt' ELSE 'llm' END AS kind FROM documents")
def jn_provider(spark, d):
    catalog = spark.createDataFrame([(0, "chat", "llm"), (1, "forms", "mt")], "ord int, id string, kind string")
    rows = docs(spark, d).select("doc_id", F.element_at(F.array(*map(F.lit, ("chat", "forms", "gone"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("id"))
    return rows.join(F.broadcast(catalog), "id", "left").select("doc_id", F.coalesce("kind", F.lit("llm")).alias("kind"))


@query("flt_valid_items", "SELECT conv_id, count(*) BETWEEN 1 AND 160 AND count(DISTINCT turn) = count(*) AND bool_and(text IS NOT NULL) AS valid FROM conversations GROUP BY conv_id")
def flt_valid_items(spark, d):
    rows = fx.table(spark, d, "conversations").groupBy("conv_id")
    return rows.agg((F.count("*").between(1, 160) & (F.countDistinct("turn") == F.count("*")) & F.bool_and(F.col("text").isNotNull())).alias("valid"))
