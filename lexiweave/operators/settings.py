"""Settings records: schema steps, what a page gets to see, and the revision of what changes a translation.

A record is a row with version (int), m (map of texts by key) and accounts
(map of provider to apiBase, apiKey, model). A key that is absent is unset.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiweave.functions.scalars import PROMPT_VERSION

ACCOUNT = "struct<apiBase:string,apiKey:string,model:string>"

# Keys a page sees, keys that count for the revision alone, limits.
EXPOSED = (
    "targetLang", "presetId", "background", "rulesText", "maxCharsPerChunk", "concurrency", "useCache", "wholePageTranslation", "minTextLength", "smartFilter",
    "skipSelectors", "contentRootOnly", "displayMode", "translationStyle", "translationFont", "translationColor", "textColorLight", "textColorDark", "accentColorLight",
    "accentColorDark", "autoPreflight", "semanticConsistency", "semanticPrecedent", "floatButton", "floatPosition", "floatOffset", "siteRules", "debug",
)
PRIVATE = ("providerId", "apiBase", "model", "customPrompt")
SEMANTIC = ("targetLang", "presetId", "background", "rulesText", "autoPreflight", "semanticPrecedent", "wholePageTranslation")
MACHINE_SEMANTIC = ("targetLang", "wholePageTranslation")
MACHINE_PRIVATE = ("providerId", "apiBase")
MACHINE_LACKS = ("autoPreflight", "semanticConsistency", "semanticPrecedent")
WHOLE_PAGE = {"wholePageMaxSourceChars": "12000", "wholePageMaxItems": "160"}
# A retired model's names and host, and the colours before and after version 9.
RETIRED_MODELS, SUCCESSOR, OFFICIAL_HOST = ("gemini-2.0-flash", "gemini-2.0-flash-lite"), "gemini-3.7-flash", "generativelanguage.googleapis.com"
OLD_COLORS = {"textColorLight": "#1f1f2e", "textColorDark": "#e8e8f4", "accentColorLight": "#5a4fe0", "accentColorDark": "#8a80ff"}
NEW_COLORS = {"textColorLight": "#9A4F2D", "textColorDark": "#F2A06B", "accentColorLight": "#F2783C", "accentColorDark": "#F59A64"}


def of(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def _set(**values: str) -> Callable[[Column], dict[str, Column]]:
    return lambda m: {k: F.lit(v) for k, v in values.items()}


def _nothing(m: Column) -> dict[str, Column]:
    return {}


def _retired(base: Column, model: Column) -> Column:
    return F.coalesce(F.contains(base, F.lit(OFFICIAL_HOST)) & model.isin(*RETIRED_MODELS), F.lit(False))


def _old_colors(m: Column) -> Column:
    out = F.coalesce(of(m, "translationColor"), F.lit("inherit")) == "inherit"
    for key, value in OLD_COLORS.items():
        out = out & F.coalesce(F.lower(of(m, key)).isin(value, ""), F.lit(True))
    return out


def _first_account(m: Column, accounts: Column) -> Column:
    """The flat fields become the account of the provider in use, if it has none."""
    provider = F.coalesce(of(m, "providerId"), F.lit(""))
    filled = (F.coalesce(of(m, "apiKey"), F.lit("")) != "") | (F.coalesce(of(m, "model"), F.lit("")) != "")
    one = F.struct(*[of(m, k).alias(k) for k in ("apiBase", "apiKey", "model")])
    return F.when(filled & ~F.map_contains_key(accounts, provider), F.map_concat(accounts, F.create_map(provider, one))).otherwise(accounts)


def _renamed_model(m: Column, accounts: Column) -> Column:
    return F.transform_values(accounts, lambda k, v: F.when((k == "gemini") & _retired(v["apiBase"], v["model"]), v.withField("model", F.lit(SUCCESSOR))).otherwise(v))


class Step(NamedTuple):
    """What a version takes away, sets (where ``when`` holds) and does to accounts."""

    drops: tuple[str, ...] = ()
    sets: Callable[[Column], dict[str, Column]] = _nothing
    when: Callable[[Column], Column] | None = None
    accounts: Callable[[Column, Column], Column] | None = None


SWITCHES = ("skipSameScript", "skipSingleToken", "skipTightLayout")

STEPS = (
    Step(accounts=_first_account),
    Step(sets=_set(autoPreflight="true")),
    Step((*SWITCHES, "temperature", "maxItemsPerChunk"), lambda m: {"smartFilter": F.when(F.array_contains(F.array(*[F.coalesce(of(m, k), F.lit("")) for k in SWITCHES]), "false"), "false").otherwise("true")}),
    Step(sets=_set(model=SUCCESSOR), when=lambda m: (F.coalesce(of(m, "providerId"), F.lit("")) == "gemini") & _retired(of(m, "apiBase"), of(m, "model")), accounts=_renamed_model),
    Step(("useGlossary",)),
    Step(("lazy",)),
    Step(("alwaysOn",)),
    Step(("experimentalAlignedTerms",), lambda m: {"betaConsistency": F.when(of(m, "experimentalAlignedTerms").isin("", "false", "0"), "false").otherwise("true")}, lambda m: F.map_contains_key(m, F.lit("experimentalAlignedTerms"))),
    Step(sets=_set(translationColor="custom", **NEW_COLORS), when=_old_colors),
    Step(("betaConsistency",), _set(semanticConsistency="true")),
    Step(sets=_set(wholePageTranslation="false")),
    Step(sets=_set(semanticPrecedent="false")),
    Step(sets=_set(wholePageTranslation="true")),
)


def migrated(records: DataFrame) -> DataFrame:
    """Records with the steps they lack applied in order; version is then the last one.

    A null version counts as 0, a later one than is known keeps the record as it
    is, null maps as empty ones. Each step is one projection: no shuffle.
    """
    rows = records.withColumns({
        "version": F.coalesce("version", F.lit(0)), "m": F.coalesce("m", F.expr("cast(map() as map<string,string>)")), "accounts": F.coalesce("accounts", F.expr(f"cast(map() as map<string,{ACCOUNT}>)")),
    })
    for number, step in enumerate(STEPS, 1):
        m, accounts, due = F.col("m"), F.col("accounts"), F.col("version") < number
        changes = {}
        if step.accounts:
            changes["accounts"] = F.when(due, step.accounts(m, accounts)).otherwise(accounts)
        sets = step.sets(m)
        if gone := (*step.drops, *sets):
            kept = F.map_filter(m, lambda k, v: ~k.isin(*gone))  # noqa: B023
            after = F.map_concat(kept, F.create_map(*[x for k, v in sets.items() for x in (F.lit(k), v)])) if sets else kept
            changes["m"] = F.when(due & step.when(m) if step.when else due, after).otherwise(m)
        rows = rows.withColumns(changes)
    return rows.withColumn("version", F.lit(len(STEPS)))


def _object(m: Column, keys: tuple[str, ...], more: dict[str, Column] | None = None) -> Column:
    """JSON with the keys in order; absent ones are left out."""
    quoted = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)
    fields = {k: F.when(of(m, k).isNotNull(), F.concat(F.lit(f'"{k}":'), quoted(of(m, k)))) for k in keys}
    fields |= {k: F.concat(F.lit(f'"{k}":'), v) for k, v in (more or {}).items()}
    return F.concat(F.lit("{"), F.concat_ws(",", *[fields[k] for k in sorted(fields)]), F.lit("}"))


def semantic_revision(m: Column, site_rules: Column, machine: Column) -> Column:
    """One hash of all that changes a translation, over nested JSON in key order.

    site_rules: array of host, presetId, background, rulesText, selectors; the
    last is no part of it. Machine engines know of no prompts, models or rules.
    """
    rules = F.coalesce(F.to_json(F.transform(site_rules, lambda r: F.struct(*[F.coalesce(r[k], F.lit("")).alias(k) for k in ("background", "host", "presetId", "rulesText")]))), F.lit("[]"))
    whole = lambda exposed, private: F.concat(F.lit('{"exposed":'), exposed, F.lit(',"private":'), private, F.lit(f',"promptVersion":{PROMPT_VERSION}}}'))
    text = F.when(machine, whole(_object(m, MACHINE_SEMANTIC), _object(m, MACHINE_PRIVATE))).otherwise(whole(_object(m, SEMANTIC, {"siteRules": rules}), _object(m, PRIVATE)))
    return F.sha2(text, 256)


def runtime(m: Column, machine: Column) -> Column:
    """What a page gets: the exposed keys, the engine's kind and limits; what a machine engine can't do is off."""
    lacks = F.when(machine, F.create_map(*[x for k in MACHINE_LACKS for x in (F.lit(k), F.lit("false"))])).otherwise(F.expr("cast(map() as map<string,string>)"))
    limits = F.create_map(*[x for k, v in WHOLE_PAGE.items() for x in (F.lit(k), F.lit(v))])
    derived = F.map_concat(F.create_map(F.lit("engineKind"), F.when(machine, "mt").otherwise("llm"), F.lit("configVersion"), F.coalesce(F.try_to_number(of(m, "configVersion"), F.lit("999999999")).cast("string"), F.lit("0"))), limits)
    seen = F.map_filter(m, lambda k, v: k.isin(*EXPOSED) & ~(machine & k.isin(*MACHINE_LACKS)))
    return F.map_concat(seen, lacks, derived)


def loaded(stored: Column, defaults: Column, language: Column) -> Column:
    """A stored map over the defaults; without a target language the user's own."""
    initial = F.map_concat(F.map_filter(defaults, lambda k, v: k != "targetLang"), F.create_map(F.lit("targetLang"), language))
    return F.map_concat(F.map_filter(initial, lambda k, v: ~F.map_contains_key(stored, k)), stored)
