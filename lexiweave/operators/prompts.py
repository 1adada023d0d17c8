"""Prompts as expressions: a system text of ordered blocks, each there only if it has something to say, and a user text of data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiweave.functions import formats as fm
from lexiweave.functions.text import trim

# What a prompt holds at most.
MOST_BACKGROUND, MOST_SUGGESTIONS, MOST_TRACKED, MOST_MEMORY, MOST_DESCRIPTION, MOST_HEADINGS, MOST_NOTES = 500, 32, 32, 8, 300, 8, 2000

HEAD = "Translate every item below into {0}. Answer with one JSON object, {{\"items\": [{{\"i\": id, \"t\": translation}}]}}: each id once, in the order given, and nothing around it."
MANNER = "Items are parts of one page in reading order. Write as an author of {0} would. Keep code, paths, addresses, numbers and product names as they are; add no remarks; leave alone what is in {0} already."
TRACKED = "Where an item holds a tracked term, add \"a\" to it: the term as listed and the exact words of \"t\" that stand for it. This only reports; it changes no translation."
MEMORY = "Earlier renderings, each only for the very words shown:"
WHOLE = "These are all items of the page: settle names, forms of address and recurring terms once, for all of them."
BACKGROUND, PROFILE, SUGGESTED, OWN = "What the reader says about the page:", "What is known about the page:", "Unchecked suggestions, to be left where they don't fit:", "The reader's own wishes come first, the answer's form apart:"
SURVEY = "Describe this page for a translator into {0}. Answer in lines: a line of domains, then preferred terms with a rendering, then words of doubtful sense with the sense in the page's language. Only words of the digest; few of them; no fixed rules."
CONVERT = "Turn these notes into one JSON object with the keys principle, domain, hard, preferred, risky and keep, for a translator into {0}. Take only what the notes say; leave out what they don't."


def block(title: str, lines: Column) -> Column:
    """A title over its lines, null without lines. lines: array of strings, nulls left out."""
    some = F.array_compact(lines)
    return F.when(F.size(some) > 0, F.concat(F.lit(f"\n{title}\n"), F.array_join(some, "\n")))


def one(text: Column) -> Column:
    return F.array(F.when(trim(F.coalesce(text, F.lit(""))) != "", trim(text)))


def pairs(of: Column, sign: str, most: int | None = None) -> Column:
    """Lines "- a sign b" of an array of (k, v) with both."""
    good = F.filter(F.coalesce(of, F.array().cast("array<struct<k:string,v:string>>")), lambda x: (trim(x["k"]) != "") & (trim(x["v"]) != ""))
    return F.transform(F.slice(good, 1, most) if most else good, lambda x: F.concat(F.lit("- "), x["k"], F.lit(f" {sign} "), x["v"]))


def profile_lines(p: Column) -> Column:
    """Lines of a profile (struct of RULES_TYPE), from what binds most to what binds least."""
    listed = lambda name, words: F.array(F.when(F.size(words) > 0, F.concat(F.lit(f"{name}: "), F.array_join(words, ", "))))
    headed = lambda name, lines: F.when(F.size(lines) > 0, F.concat(F.array(F.lit(f"{name}:")), lines)).otherwise(F.array().cast("array<string>"))
    senses = F.transform(p["risky"], lambda x: F.concat(F.lit("- "), x["k"], F.when(x["v"] != "", F.concat(F.lit(": perhaps "), x["v"])).otherwise(": see the sentence")))
    return F.concat(
        F.array(F.when(p["principle"] != "", F.concat(F.lit("Principle: "), p["principle"]))), listed("Domain, a hint only", p["domain"]), headed("Fixed terms", pairs(p["hard"], "=")),
        headed("Preferred terms, for the same sense", pairs(p["preferred"], "=")), headed("Words of several senses", senses), listed("Leave untranslated", p["keep"]),
    )


def system(target: Column, *, whole: Column, tracked: Column, memory: Column, background: Column, profile: Column, suggestions: Column, custom: Column) -> Column:
    """The system text. memory: array of (trigger, term, target); tracked: distinct terms."""
    said = lambda text: F.replace(F.lit(text.replace("{{", "{").replace("}}", "}")), F.lit("{0}"), target)
    earlier = F.transform(F.slice(F.filter(memory, lambda m: (m["trigger"] != "") & (m["target"] != "")), 1, MOST_MEMORY), lambda m: F.concat(F.lit("- "), m["trigger"], F.lit(" ("), m["term"], F.lit(") = "), m["target"]))
    return F.concat_ws(
        "\n", said(HEAD), F.when(F.size(tracked) > 0, F.lit(TRACKED)), block(MEMORY, earlier), F.when(whole, F.lit(WHOLE)), said(MANNER),
        block(BACKGROUND, F.transform(one(background), lambda x: F.substring(x, 1, MOST_BACKGROUND))), block(PROFILE, profile_lines(profile)), block(SUGGESTED, pairs(suggestions, "~", MOST_SUGGESTIONS)), block(OWN, one(custom)),
    )


def tracked_terms(terms: Column) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(terms, trim), lambda x: x != "")), 1, MOST_TRACKED)


def user(context: Column, tracked: Column, items: Column) -> Column:
    """The user text: page, tracked terms if there are any, items. context: struct of title, site, description, section, headings."""
    page = F.struct(context["title"].alias("title"), context["site"].alias("site"), F.substring(context["description"], 1, MOST_DESCRIPTION).alias("description"), context["section"].alias("section"), F.slice(context["headings"], 1, MOST_HEADINGS).alias("headings"))
    rows = F.transform(items, lambda m: F.struct(m["i"].alias("i"), m["text"].alias("t")))
    return fm.prompt_yaml_udf(F.to_json(F.struct(page.alias("page"), F.when(F.size(tracked) > 0, tracked).alias("tracked_terms"), rows.alias("items"))))


def survey(target: Column, title: Column, site: Column, digest: Column) -> tuple[Column, Column]:
    """(system, user) that ask for a page's profile."""
    return F.replace(F.lit(SURVEY), F.lit("{0}"), target), fm.prompt_yaml_udf(F.to_json(F.struct(F.struct(title.alias("title"), site.alias("site")).alias("page"), digest.alias("digest"))))


def conversion(target: Column, title: Column, site: Column, notes: Column) -> tuple[Column, Column]:
    """(system, user) that turn a reader's notes into rules."""
    return F.replace(F.lit(CONVERT), F.lit("{0}"), target), fm.prompt_yaml_udf(F.to_json(F.struct(F.struct(title.alias("title"), site.alias("site")).alias("page"), F.substring(notes, 1, MOST_NOTES).alias("notes"))))
