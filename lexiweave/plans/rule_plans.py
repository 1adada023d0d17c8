"""Queries over rules and settings. Rules of a page: words of its document's lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiweave.functions import formats as fm
from lexiweave.operators import rules as ru
from lexiweave.operators import settings as st
from lexiweave.plans import fixtures as fx
from lexiweave.plans.registry import query
from lexiweave.streaming import flows as fl

RULES = rf"""{fx.UNITS}, rw AS (SELECT page_id, pos, tag, lower(regexp_extract(text, '([A-Za-z]{{3,}})', 1)) AS w, upper(regexp_extract(text, '([A-Za-z]{{3,}})', 1)) AS up FROM units),
rules0 AS (SELECT page_id, CASE WHEN pos % 2 = 0 THEN 'auto' ELSE 'user' END AS source, CASE pos % 5 WHEN 0 THEN 'hard' WHEN 1 THEN 'preferred' WHEN 2 THEN 'risky' WHEN 3 THEN 'domain' ELSE 'keep' END AS tier, pos, w AS term, up || pos AS value FROM rw WHERE w <> ''),
rules AS (SELECT page_id, source, tier, term, arg_max(value, pos) AS value, min(pos) AS pos FROM rules0 GROUP BY page_id, source, tier, term)"""


def rules0(spark, d):
    word = F.regexp_extract("text", r"([A-Za-z]{3,})", 1)
    tier = F.element_at(F.array(*map(F.lit, ("hard", "preferred", "risky", "domain", "keep"))), (F.col("pos") % 5 + 1).cast("int"))
    rows = fx.units(spark, d).select("page_id", F.when(F.col("pos") % 2 == 0, "auto").otherwise("user").alias("source"), tier.alias("tier"), "pos", F.lower(word).alias("term"), F.concat(F.upper(word), F.col("pos")).alias("value"))
    return rows.where("term <> ''")


def rules(spark, d):
    return ru.normalized(rules0(spark, d))


@query("set_norm", f"WITH {RULES} SELECT page_id, source, tier, term, value FROM rules")
def set_norm(spark, d):
    return rules(spark, d).select("page_id", "source", "tier", "term", "value")


SOFT = """s0 AS (SELECT page_id, source, CASE WHEN tier = 'hard' THEN 'preferred' ELSE tier END AS tier, term, arg_max(value, CASE WHEN tier = 'hard' THEN 1 ELSE 0 END) AS value FROM rules WHERE tier <> 'keep' GROUP BY ALL),
soft AS (SELECT * FROM s0 WHERE tier <> 'preferred' OR NOT EXISTS (SELECT 1 FROM s0 r WHERE r.tier = 'risky' AND r.page_id = s0.page_id AND lower(r.term) = lower(s0.term)))"""


@query("set_soften", f"WITH {RULES.replace('rules AS (SELECT', 'rules1 AS (SELECT')}, rules AS (SELECT * FROM rules1 WHERE source = 'auto'), {SOFT} SELECT page_id, tier, term, value FROM soft")
def set_soften(spark, d):
    return ru.softened(rules(spark, d).where("source = 'auto'")).select("page_id", "tier", "term", "value")


MERGE = """m0 AS (SELECT page_id, tier, term, arg_max(value, (value <> '')::INT * 2 + (source = 'user')::INT) AS value FROM rules GROUP BY page_id, tier, term),
m1 AS (SELECT * FROM m0 WHERE tier <> 'preferred' OR NOT EXISTS (SELECT 1 FROM m0 h WHERE h.tier = 'hard' AND h.page_id = m0.page_id AND h.term = m0.term)),
merged AS (SELECT * FROM m1 WHERE tier <> 'risky' OR NOT EXISTS (SELECT 1 FROM m1 h WHERE h.tier IN ('hard', 'preferred') AND h.page_id = m1.page_id AND lower(h.term) = lower(m1.term)))"""


@query("set_merge", f"WITH {RULES}, {MERGE} SELECT page_id, tier, term, value FROM merged")
def set_merge(spark, d):
    return ru.merged(rules(spark, d)).select("page_id", "tier", "term", "value")


@query("set_effective", f"WITH {RULES.replace('rules AS (SELECT', 'rules1 AS (SELECT')}, rules AS (SELECT * FROM rules1 WHERE source = 'user' OR tier = 'domain'), {MERGE} SELECT page_id, tier, term, value FROM merged")
def set_effective(spark, d):
    return ru.effective(rules(spark, d)).select("page_id", "tier", "term", "value")


@query("fmt_tree", f"WITH {RULES} SELECT page_id, tier, term, CASE WHEN count(DISTINCT source) = 2 THEN 'both' ELSE min(source) END AS tag FROM rules GROUP BY ALL")
def fmt_tree(spark, d):
    return ru.provenance(rules(spark, d))


@query("agg_profile", f"WITH {RULES}, {MERGE} SELECT page_id, tier, count(*) AS n FROM merged GROUP BY ALL")
def agg_profile(spark, d):
    return ru.tier_counts(ru.merged(rules(spark, d)))


@query("fmt_rules_in", f"WITH {RULES} SELECT page_id, string_agg(term, ',' ORDER BY pos, term) AS domain FROM rules WHERE tier = 'domain' AND source = 'user' GROUP BY page_id")
def fmt_rules_in(spark, d):
    """A page's domain words written as rules text and parsed again."""
    rows = rules(spark, d).where("tier = 'domain' AND source = 'user'").groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("domain"))
    parsed = fm.rules_json_udf(F.concat(F.lit("领域: "), F.array_join("domain", ", ")))
    return rows.select("page_id", F.array_join(F.from_json(F.get_json_object(parsed, "$.domain"), "array<string>"), ",").alias("domain"))


@query("fmt_rules_out", f"WITH {RULES} SELECT page_id, '锁定:' || chr(10) || string_agg('  ' || term || ': ' || value, chr(10) ORDER BY pos, term) AS text FROM rules WHERE tier = 'hard' AND source = 'user' GROUP BY page_id")
def fmt_rules_out(spark, d):
    rows = rules(spark, d).where("tier = 'hard' AND source = 'user'").groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term", "value"))), lambda x: F.concat(F.lit("  "), x["term"], F.lit(": "), x["value"])).alias("l"))
    return rows.select("page_id", fm.rules_round_trip_udf(F.concat(F.lit("锁定:\n"), F.array_join("l", "\n"))).alias("text"))


@query("fmt_yaml_out", "SELECT conv_id, turn, 'page:' || chr(10) || '  role: \"' || role || '\"' || chr(10) || '  turn: ' || turn AS yaml FROM conversations")
def fmt_yaml_out(spark, d):
    value = F.to_json(F.struct(F.struct("role", "turn").alias("page")))
    return fx.table(spark, d, "conversations").select("conv_id", "turn", fm.prompt_yaml_udf(value).alias("yaml"))


# Settings records, one for each document, written in SQL that both engines read.
KEYS = ("displayMode", "minTextLength", "maxCharsPerChunk", "semanticRevision", "semanticConsistency", "configVersion", "providerId", "model", "custom", "extra")
SETTINGS = f"""k AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{k}')" for i, k in enumerate(KEYS))}) t(pos, key)),
base AS (SELECT doc_id, key, key || doc_id % 7 AS value FROM documents, k WHERE key <> 'extra'),
next AS (SELECT doc_id, key, key || (doc_id % 7 + CASE WHEN (doc_id + pos) % 3 = 0 THEN 0 ELSE 1 END) AS value FROM documents, k WHERE key <> 'custom')"""


def settings(spark, d, which):
    """doc_id, key, value: a record before (base) and after (next) a change of two thirds of its keys."""
    lacks = "extra" if which == "base" else "custom"
    keys = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(k).alias("key")) for i, k in enumerate(KEYS) if k != lacks])
    rows = fx.table(spark, d, "documents").select("doc_id", F.inline(keys))
    moved = 0 if which == "base" else F.when((F.col("doc_id") + F.col("pos")) % 3 == 0, 0).otherwise(1)
    return rows.select("doc_id", "key", F.concat("key", (F.col("doc_id") % 7 + moved).cast("string")).alias("value"))


@query("set_cfgdiff", f"""WITH {SETTINGS}, f AS (SELECT coalesce(b.doc_id, n.doc_id) AS doc_id, coalesce(b.key, n.key) AS key, b.value AS b, n.value AS n FROM base b FULL JOIN next n ON n.key = b.key AND n.doc_id = b.doc_id)
SELECT doc_id, key, CASE key WHEN 'semanticRevision' THEN 'semantic' WHEN 'minTextLength' THEN 'extraction' WHEN 'maxCharsPerChunk' THEN 'scheduling' WHEN 'semanticConsistency' THEN 'observation' WHEN 'displayMode' THEN 'presentation' ELSE 'other' END AS "group" FROM f WHERE b IS DISTINCT FROM n AND key <> 'configVersion'""")
def set_cfgdiff(spark, d):
    return ru.config_changes(settings(spark, d, "base"), settings(spark, d, "next"), "doc_id")


@query("jn_override", f"WITH {SETTINGS} SELECT coalesce(b.doc_id, n.doc_id) AS doc_id, coalesce(b.key, n.key) AS key, coalesce(n.value, b.value) AS value FROM base b FULL JOIN (SELECT * FROM next WHERE key IN ('providerId', 'apiBase', 'apiKey', 'model')) n ON n.key = b.key AND n.doc_id = b.doc_id")
def jn_override(spark, d):
    """A panel's draft over the saved record, as far as its keys are allowed."""
    return ru.overlaid(settings(spark, d, "base"), settings(spark, d, "next"), "doc_id", allowed=ru.DRAFT_KEYS)


#: A record's fields at some schema version, and its accounts; absent where null.
FIELDS = {
    "providerId": "CASE WHEN doc_id % 2 = 0 THEN 'gemini' ELSE 'other' END",
    "apiBase": f"CASE WHEN doc_id % 3 = 0 THEN 'https://{st.OFFICIAL_HOST}/v1' ELSE 'https://x.example' END",
    "apiKey": "CASE WHEN doc_id % 5 < 3 THEN 'k' ELSE '' END",
    "model": "CASE doc_id % 4 WHEN 0 THEN 'gemini-2.0-flash' WHEN 2 THEN 'gemini-2.0-flash-lite' WHEN 1 THEN '' ELSE 'm' END",
    "autoPreflight": "'false'", "temperature": "'0.2'", "useGlossary": "'true'", "lazy": "'true'", "alwaysOn": "'false'", "semanticPrecedent": "'true'", "wholePageTranslation": "'false'",
    "skipSameScript": "CASE WHEN doc_id % 7 = 0 THEN 'false' ELSE 'true' END",
    "skipTightLayout": "CASE WHEN doc_id % 7 = 1 THEN 'false' END",
    "experimentalAlignedTerms": "CASE doc_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END",
    "translationColor": "CASE WHEN doc_id % 6 < 4 THEN 'inherit' WHEN doc_id % 6 = 4 THEN 'custom' END",
    "textColorLight": "CASE WHEN doc_id % 4 = 0 THEN '#1F1F2E' WHEN doc_id % 4 = 1 THEN '#000000' END",
}


def records(spark, d):
    """doc_id, version (0 to 14), m, accounts, and what documents say of lang and source."""
    m = F.map_filter(F.create_map(*[x for k, v in FIELDS.items() for x in (F.lit(k), F.expr(v))]), lambda k, v: v.isNotNull())
    kept = F.create_map(F.lit("gemini"), F.struct(F.lit(f"https://{st.OFFICIAL_HOST}").alias("apiBase"), F.lit("k2").alias("apiKey"), F.lit("gemini-2.0-flash").alias("model")))
    return fx.table(spark, d, "documents").select("doc_id", "lang", "source", (F.col("doc_id") % 15).cast("int").alias("version"), m.alias("m"), F.when(F.col("doc_id") % 11 == 0, kept).alias("accounts"))


def shown(m):
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")


RECORDS = f"r AS (SELECT doc_id, lang, source, doc_id % 15 AS v, {', '.join(f'{v} AS "{k}"' for k, v in FIELDS.items())} FROM documents)"
STEPPED = f"""{RECORDS}, q AS (SELECT *, v < 9 AND coalesce("translationColor", 'inherit') = 'inherit' AND coalesce(lower("textColorLight"), '#1f1f2e') = '#1f1f2e' AS old,
 contains("apiBase", '{st.OFFICIAL_HOST}') AND model IN ('gemini-2.0-flash', 'gemini-2.0-flash-lite') AS gone FROM r),
stepped AS (SELECT *, list_sort(list_filter([
 'providerId=' || "providerId", 'apiBase=' || "apiBase", 'apiKey=' || "apiKey", 'model=' || CASE WHEN v < 4 AND "providerId" = 'gemini' AND gone THEN '{st.SUCCESSOR}' ELSE model END,
 'autoPreflight=' || (v < 2), CASE WHEN v < 3 THEN 'smartFilter=' || CASE WHEN 'false' IN ("skipSameScript", "skipTightLayout") THEN 'false' ELSE 'true' END END,
 CASE WHEN v >= 3 THEN 'skipSameScript=' || "skipSameScript" END, CASE WHEN v >= 3 THEN 'skipTightLayout=' || "skipTightLayout" END, CASE WHEN v >= 3 THEN 'temperature=0.2' END,
 CASE WHEN v >= 5 THEN 'useGlossary=true' END, CASE WHEN v >= 6 THEN 'lazy=true' END, CASE WHEN v >= 7 THEN 'alwaysOn=false' END, CASE WHEN v >= 8 THEN 'experimentalAlignedTerms=' || "experimentalAlignedTerms" END,
 CASE WHEN v < 10 THEN 'semanticConsistency=true' END, 'semanticPrecedent=' || CASE WHEN v < 12 THEN 'false' ELSE 'true' END, 'wholePageTranslation=' || CASE WHEN v < 13 THEN 'true' ELSE 'false' END,
 CASE WHEN old THEN 'translationColor=custom' ELSE 'translationColor=' || "translationColor" END, CASE WHEN old THEN 'textColorLight=#9A4F2D' ELSE 'textColorLight=' || "textColorLight" END,
 CASE WHEN old THEN 'textColorDark=#F2A06B' END, CASE WHEN old THEN 'accentColorLight=#F2783C' END, CASE WHEN old THEN 'accentColorDark=#F59A64' END], lambda x: x IS NOT NULL)) AS items,
 list_sort(list_filter([CASE WHEN doc_id % 11 = 0 THEN 'gemini=https://{st.OFFICIAL_HOST}/' || CASE WHEN v < 4 THEN '{st.SUCCESSOR}' ELSE 'gemini-2.0-flash' END END,
  CASE WHEN v < 1 AND ("apiKey" <> '' OR model <> '') AND NOT (doc_id % 11 = 0 AND "providerId" = 'gemini') THEN "providerId" || '=' || "apiBase" || '/' || CASE WHEN "providerId" = 'gemini' AND gone THEN '{st.SUCCESSOR}' ELSE model END END], lambda x: x IS NOT NULL)) AS accounts FROM q)"""


@query("set_migrate", f"WITH {STEPPED} SELECT doc_id, 13 AS version, array_to_string(items, ',') AS record, array_to_string(accounts, ',') AS accounts FROM stepped")
def set_migrate(spark, d):
    """Records of versions 0 to 14 taken to the last version by the steps they lack."""
    accounts = F.transform_values("accounts", lambda k, v: F.concat_ws("/", v["apiBase"], v["model"]))
    return st.migrated(records(spark, d)).select("doc_id", "version", shown("m").alias("record"), shown(accounts).alias("accounts"))


@query("src_settings", f"WITH {STEPPED} SELECT doc_id, array_to_string(list_sort(list_concat(items, ['targetLang=' || coalesce(lang, 'en'), 'presetId=general'])), ',') AS record FROM stepped")
def src_settings(spark, d):
    """Stored records over the defaults, the target language from the user's own where none is stored, brought to the last version."""
    defaults = F.create_map(F.lit("presetId"), F.lit("general"), F.lit("model"), F.lit("none"))
    rows = records(spark, d).withColumn("m", st.loaded(F.col("m"), defaults, F.coalesce("lang", F.lit("en"))))
    return st.migrated(rows).select("doc_id", shown("m").alias("record"))


@query("fn_revision", f"""WITH {RECORDS} SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 1 THEN '{{"exposed":{{"wholePageTranslation":"false"}},"private":{{"apiBase":"' || "apiBase" || '","providerId":"' || "providerId" || '"}},"promptVersion":14}}'
 ELSE '{{"exposed":{{"autoPreflight":"false","semanticPrecedent":"true","siteRules":[{{"background":"","host":' || to_json(coalesce(source, '')) || ',"presetId":"general","rulesText":' || to_json(coalesce(lang, '')) || '}}],"wholePageTranslation":"false"}},"private":{{"apiBase":"' || "apiBase" || '","model":"' || model || '","providerId":"' || "providerId" || '"}},"promptVersion":14}}' END) AS revision FROM r""")
def fn_revision(spark, d):
    """The revision of each record; a site rule's selectors are no part of it, every third engine is a machine's."""
    rule = F.struct(F.col("source").alias("host"), F.lit("general").alias("presetId"), F.lit(None).cast("string").alias("background"), F.col("lang").alias("rulesText"), F.col("doc_id").cast("string").alias("selectors"))
    return records(spark, d).select("doc_id", st.semantic_revision(F.col("m"), F.array(rule), F.col("doc_id") % 3 == 1).alias("revision"))


@query("prj_runtime", f"""WITH {RECORDS} SELECT doc_id, array_to_string(list_sort(list_filter(['autoPreflight=false', 'wholePageTranslation=false', 'wholePageMaxItems=160', 'wholePageMaxSourceChars=12000', 'translationColor=' || "translationColor", 'textColorLight=' || "textColorLight",
 'semanticPrecedent=' || CASE WHEN doc_id % 3 = 1 THEN 'false' ELSE 'true' END, CASE WHEN doc_id % 3 = 1 THEN 'semanticConsistency=false' END, 'engineKind=' || CASE WHEN doc_id % 3 = 1 THEN 'mt' ELSE 'llm' END, 'configVersion=0'], lambda x: x IS NOT NULL)), ',') AS config FROM r""")
def prj_runtime(spark, d):
    return records(spark, d).select("doc_id", shown(st.runtime(F.col("m"), F.col("doc_id") % 3 == 1)).alias("config"))


CONFIGS = """c AS (SELECT user_id, event_id, event_id // 10 - CASE WHEN event_id % 4 = 0 THEN 20 ELSE 0 END AS version, event_id % 5 AS key, event_id % 3 AS value FROM events),
o AS (SELECT *, max(version) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM c),
a AS (SELECT *, value IS DISTINCT FROM lag(value) OVER (PARTITION BY user_id, key ORDER BY event_id) AS moved FROM o WHERE seen IS NULL OR version >= seen)"""


@query("stm_config", f"""WITH {CONFIGS}, n AS (SELECT user_id, count(*) AS n FROM c GROUP BY user_id)
SELECT a.user_id, max(version) AS version, any_value(n) - count(*) AS rejected, count_if(moved AND key IN (0, 3)) AS restarts, count_if(moved AND key = 1) AS rescans, count_if(moved AND key = 2) AS next_batches FROM a JOIN n ON n.user_id = a.user_id GROUP BY a.user_id""")
def stm_config(spark, d):
    """A stream of patches to each user's configuration, some of them older than what is known."""
    key = F.element_at(F.array(*map(F.lit, KEYS[3:4] + KEYS[1:3] + KEYS[4:5] + KEYS[:1])), (F.col("event_id") % 5 + 1).cast("int"))
    version = F.floor(F.col("event_id") / 10) - F.when(F.col("event_id") % 4 == 0, 20).otherwise(0)
    rows = fl.event_stream(spark, d).select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").alias("at"), version.alias("version"), key.alias("key"), (F.col("event_id") % 3).cast("string").alias("value"))
    got = fl.drained(fl.configured(rows, ru.effect_of), "config", "update").withColumn("seen", F.col("accepted") + F.col("rejected"))
    return fl.newest(got, "user_id", "seen").drop("seen", "accepted")


@query("set_accounts", """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'p' || doc_id % 4 END AS now, 'p' || doc_id % 5 AS next, 'm' || doc_id AS model FROM documents)
SELECT doc_id, CASE WHEN now = 'p0' THEN 'p0=' || model || ',p1=old' WHEN now = 'p1' THEN 'p0=first,p1=' || model WHEN now = '' THEN 'p0=first,p1=old' ELSE 'p0=first,p1=old,' || now || '=' || model END AS accounts,
 CASE WHEN next = now THEN model WHEN next = 'p0' THEN 'first' WHEN next = 'p1' THEN 'old' END AS model FROM r""")
def set_accounts(spark, d):
    """A settings record that moves to another provider: its fields are kept under the one it leaves, and that other's are taken, if it has any."""
    i = F.col("doc_id")
    kept = F.create_map(F.lit("p0"), F.lit("first"), F.lit("p1"), F.lit("old"))
    now = F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("p"), (i % 4).cast("string")))
    rows = fx.table(spark, d, "documents").select("doc_id", *ru.switched(kept, now, F.concat(F.lit("p"), (i % 5).cast("string")), F.concat(F.lit("m"), i.cast("string"))))
    listed = F.array_sort(F.transform(F.map_entries("accounts"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return rows.select("doc_id", F.array_join(listed, ",").alias("accounts"), F.col("next").alias("model"))
