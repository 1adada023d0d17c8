"""Text predicates and normalisers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space and punctuation classes, tag sets, word lists.
SPACE = "[ \\t\\n\\u000b\\f\\r\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
HEADING_TAGS = ("H1", "H2", "H3", "H4", "H5", "H6", "LEGEND", "CAPTION", "FIGCAPTION", "DT", "SUMMARY")
APPEND_TAGS = ("LI", "TD", "TH", "DD", "DT", "FIGCAPTION", "CAPTION", "SUMMARY", "BLOCKQUOTE", "BUTTON", "A")
NO_SPACE_SCRIPTS = ("Han", "Hiragana", "Katakana", "Hangul", "Thai", "Lao", "Khmer", "Myanmar")
NON_LATIN_SCRIPTS = ("Han", "Hiragana", "Katakana", "Hangul", "Thai", "Arabic", "Cyrillic")
STOP_WORDS = (
    "a an the and or for to of in on at by as if is am are was were "
    "be been being do does did done not no yes but so nor yet one its our "
    "you your yours we us they their them he his she her it this that these "
    "those who whom whose which what when where why how has had have having can "
    "could may might must shall should will would about after again against almost along "
    "already also among another because before between both every first from great here "
    "into itself more most much never other over same since some still such than then "
    "there thing through under until very while with without however therefore perhaps "
    "although though "
    "all any him only even two upon toward towards "
    "across away back down now out"
).split()
TOKEN = r"[A-Za-z][A-Za-z0-9'’_-]*"
ROMAN = r"^M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})\z"


def scripts(names: tuple[str, ...]) -> str:
    return "[" + "".join(f"\\p{{Is{x}}}" for x in names) + "]"


def trim(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+\\z", "")


def normalize(x: Column) -> Column:
    """Tabs and line breaks to a space, NBSP to a space, runs of white space to one, trimmed."""
    return trim(F.regexp_replace(F.translate(F.regexp_replace(x, r"[\t\r\n]+", " "), " ", " "), f"{SPACE}{{2,}}", " "))


def utf16_length(x: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(x, "UTF-16LE")) / 2).cast("int")


def clip(x: Column, most: int) -> Column:
    """White space collapsed, at most so long, the last character an ellipsis where cut."""
    flat = trim(F.regexp_replace(x, f"{SPACE}+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most - 1), F.lit("…")))


def is_sentence_end(x: Column) -> Column:
    return x.rlike(r"""[.!?。！？…]["'”’)）]?\z""")


def is_single_token(x: Column) -> Column:
    """One word without sentence end, in a script that puts spaces between words."""
    bare = trim(F.regexp_replace(x, r"[\p{P}\p{S}]", " "))
    return ~is_sentence_end(x) & (bare != "") & ~bare.rlike(scripts(NO_SPACE_SCRIPTS)) & ~bare.rlike(SPACE)


def text_rejection(x: Column, tag: Column, min_length: int = 2, skip_single: bool = True) -> Column:
    """The first reason to leave a text out, else null."""
    noise = ~x.rlike(r"\p{L}") | x.rlike(f"^(?:{SPACE}|[0-9]|\\p{{P}}|\\p{{S}})*\\z")
    urlish = x.rlike(r"(?i)^(?:https?://|www\.|mailto:|[\w.+-]+@[\w-]+\.\w+)[^" + SPACE[1:-1] + r"]*\z")
    out = F.when(x.isNull() | (x == ""), "empty").when(utf16_length(x) < min_length, "too-short").when(noise, "noise").when(urlish, "url-or-email")
    if skip_single:
        out = out.when(~F.coalesce(tag.isin(*HEADING_TAGS), F.lit(False)) & is_single_token(x), "single-token")
    return out


def role_of(x: Column, tag: Column, in_interface: Column, most: int = 24) -> Column:
    return F.when(tag.isin(*HEADING_TAGS), "heading").when((F.length(x) <= most) & in_interface, "ui").otherwise("body")


def placement_of(tag: Column) -> Column:
    return F.when(tag.isin(*APPEND_TAGS), "append").otherwise("after")


def is_usable(source: Column, target: Column, language: Column) -> Column:
    """Whether a translation may be kept; a source with letters or digits needs some."""
    src, out = trim(F.coalesce(source, F.lit(""))), trim(F.coalesce(target, F.lit("")))
    phrase = (F.length(F.regexp_replace(src, f"[^{scripts(NON_LATIN_SCRIPTS)[1:-1]}]", "")) >= 4) | src.rlike("[。！？!?]")
    copied = language.rlike("(?i)english|英语|英文") & src.rlike(scripts(NON_LATIN_SCRIPTS)) & phrase & (src == out)
    return target.isNotNull() & (out != "") & ~(src.rlike(r"[\p{L}\p{N}]") & ~out.rlike(r"[\p{L}\p{N}]")) & ~F.coalesce(copied, F.lit(False))


def is_stop_word(low: Column) -> Column:
    """For a lower-case token without white space."""
    return low.isin(*STOP_WORDS) | low.rlike(r"^(?:i|you|we|they|he|she|it)['’](?:m|re|ve|ll|d|s)\z")


def is_stop(token: Column) -> Column:
    return is_stop_word(F.lower(trim(token)))


def has_fixed_shape(token: Column) -> Column:
    return token.rlike(r"[a-z][A-Z]|[a-z]-[A-Z]|[A-Za-z][0-9]|[0-9][A-Za-z]")


def is_fixed_form(token: Column) -> Column:
    """The shape of an identifier: inner capital, lower-hyphen-capital, or letters and digits side by side."""
    return ~is_stop(token) & has_fixed_shape(token)


def looks_like_heading(x: Column, role: Column) -> Column:
    letters = F.length(F.regexp_replace(x, "[^A-Za-z]", ""))
    capitals = F.length(F.regexp_replace(x, "[^A-Z]", ""))
    words = F.regexp_count(x, F.lit("[A-Za-z]+"))
    return (role == "heading") | ((F.length(trim(x)) <= 140) & words.between(1, 18) & (capitals >= 0.9 * letters))


def is_structural(token: Column, heading_like: Column) -> Column:
    return heading_like & (token.rlike(r"^[A-Z]{2,}\z") | (token.rlike("^[MDCLXVI]+\\z") & token.rlike(ROMAN)))


def lemma_of(term: Column, kind: Column) -> Column:
    return F.when(kind == "fixed", trim(term)).otherwise(F.lower(trim(term)))


def identity_of(term: Column, kind: Column) -> Column:
    t = trim(term)
    return F.when(kind == "fixed", F.concat(F.lit("fixed:"), t)).when(kind == "locked", F.concat(F.lit("locked:"), F.lower(t))).otherwise(F.concat(F.lit("lexical:"), F.lower(t)))


def rank_of(kind: Column) -> Column:
    return F.when(kind == "locked", 5).when(kind == "fixed", 4).when(kind.isin("suggested", "risky"), 3).when(kind == "lexical", 2).otherwise(1)


def bounded_pattern(term: Column) -> Column:
    """A regular expression for the term between characters other than letters, digits and _."""
    quoted = F.regexp_replace(term, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit(r"(?:^|[^A-Za-z0-9_])("), quoted, F.lit(r")(?=\z|[^A-Za-z0-9_])"))


def find_term(text: Column, term: Column, case_sensitive: Column) -> Column:
    """The first bounded occurrence as written, null if none."""
    pattern = F.concat(F.when(case_sensitive, F.lit("")).otherwise(F.lit("(?i)")), bounded_pattern(term))
    hit = F.call_function("regexp_extract", text, pattern, F.lit(1))
    return F.when((hit != "") & (term != ""), hit)


def context_around(text: Column, surface: Column, radius: int = 100) -> Column:
    """The text around the first place of surface, ellipses where cut."""
    at = F.call_function("instr", text, surface)
    start = F.greatest(F.lit(1), at - radius)
    end = F.least(F.length(text) + 1, at + F.length(surface) + radius)
    out = F.concat(F.when(start > 1, "…").otherwise(""), F.substring(text, start, end - start), F.when(end <= F.length(text), "…").otherwise(""))
    return clip(out, 2 * radius + 16)


def markdown_escaped(x: Column) -> Column:
    """One line as Markdown text."""
    out = F.regexp_replace(F.replace(x, F.lit("&"), F.lit("&amp;")), r"([\\`*_{}\[\]<>|#!])", r"\\$1")
    out = F.regexp_replace(out, r"^(\s*)([-+])(?=\s)", r"$1\\$2")
    return F.regexp_replace(out, r"^(\s*)(\d+)([.)])(?=\s)", r"$1$2\\$3")

