"""PII: anchor expansion (operator 7).

An Aho-Corasick automaton runs over the whole text once and stops at anchors:
at-signs, plus signs, digits, digit-dot pairs, schemes and identifier cues. At
each a deterministic parser of its kind expands to both sides, never behind the
end of its last match, and validates: e-mail and IP addresses, card numbers
(Luhn) and phone numbers, whose matches equal leftmost non-overlapping matches
of the kinds' patterns; and beyond those IBANs (length by country and mod 97),
secrets after a cue (``password=...``, ``API key is "..."``, ``Bearer ...``) or
of a known form, access keys, logins in urls, IPv6 addresses, social security
numbers, handles (``@name``), account and document numbers after a cue, of any
length, and street addresses around a street word of four languages.
Cues are found in any letter case: the automaton reads the text with A-Z in
lower case, the parsers read the text itself. Every parser is linear in the text.

Defined results
* null or empty text: no spans; offsets are code points, ends exclusive
* spans are ordered by kind as in KINDS, then start
* each row gives a row, repeated ones too; other columns are never read
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.llm.common import small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "secret", "login", "ipv6", "ssn", "handle", "account", "street")
SCHEMA = "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>"
CUES = ("password", "passwd", "pwd", "passphrase", "secret", "token", *(f"{a}{b}{c}" for a, c in (("api", "key"), ("access", "key"), ("secret", "key"), ("private", "key")) for b in ("", "_", "-", " ")))
ACCOUNT_CUES = ("account", "acct", "a/c", "passport", "tax id", "customer id", "social security", "licence", "license", "policy", "member id")
# Words that end a street's name, begin it, or are its last part.
STREET_AFTER = ("street", "st", "avenue", "ave", "road", "rd", "lane", "ln", "drive", "dr", "boulevard", "blvd", "court", "square", "terrace", "place", "way")
STREET_BEFORE = ("rue", "avenue", "boulevard", "calle", "avenida", "plaza")
STREET_WITHIN = ("straße", "strasse", "str.", "platz", "gasse", "weg", "allee")
TOKEN_FORMS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "xoxb-", "xoxp-", "xoxa-", "sk-", "eyj")
# Lengths of IBANs by country, fixed values.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "BR": 29, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23,
    "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26, "UA": 29,
}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
CUED_IBAN = re.compile(r"(?:[ \t]{1,4}(?i:is|number|no\.?))?[: =#]{0,4}([A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30})(?![A-Za-z0-9])")
SECRET = re.compile(r"""["']?(?:[ \t]{0,4}[:=]|([ \t]{1,4}(?i:is|was)(?=[ \t:])))[ \t:]{0,4}["']?([^\s"',;<>]{8,})""")
BEARER = re.compile(r"[ \t]{1,4}([A-Za-z0-9._~+/-]{16,}=*)")
SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
HANDLE = re.compile(r"@[A-Za-z_][A-Za-z0-9_]+")
ACCOUNT_LEAD = re.compile(r"(?:[ \t]{1,4}(?i:number|num|no|nr|id)\b\.?)?(?:[ \t]{0,4}[:=#]|[ \t]{1,4}(?i:is|was)\b:?)?[ \t]{0,4}#?")
ACCOUNT = re.compile(r"[A-Z0-9](?:[ -]?[A-Z0-9])*+")
TOKEN = re.compile(r"gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|xox[abp]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+)?")
#: A street's name is looked for so many characters around its word.
NEAR = 80
NAME = r"[A-ZÀ-ÖØ-Þ][\w'’.-]*"
LEFT_OF_STREET = re.compile(rf"(?<![\w.-])[0-9]{{1,6}}[A-Za-z]?,? (?:(?:[NSEW]|{NAME}|[0-9]+(?:st|nd|rd|th)) ){{1,4}}\Z")
RIGHT_OF_STREET = re.compile(rf"\.?(?:,? (?:Apt|Suite|Unit|Floor|#)\.? ?[A-Za-z0-9-]+)?(?:,? {NAME}(?: {NAME}){{0,2}})?(?:,? [A-Z]{{2}})?(?:,? [0-9]{{5}}(?:-[0-9]{{4}})?)?")
AFTER_RUE = re.compile(rf" (?:(?:de|du|des|la|le|les|del|los|las|l'|d') ?){{0,3}}{NAME}(?:[ -](?:(?:de|du|des|la|le|del) )?{NAME}){{0,3}}(?:,? (?:n[º°o]\.? ?)?[0-9]{{1,5}}(?![0-9]))?(?:,? [0-9]{{5}} {NAME})?")
BEFORE_RUE = re.compile(r"(?<![\w.-])[0-9]{1,5}(?: ?(?:bis|ter))?,? \Z")
AFTER_STRASSE = re.compile(rf" ?[0-9]{{1,4}} ?[a-z]?(?![\w])(?:,? [0-9]{{5}} {NAME})?")
BEFORE_STRASSE = re.compile(rf"(?:(?:{NAME}[ -])?[A-ZÀ-ÖØ-Þ][\w-]*\.?|{NAME} str(?:aße|asse|\.))\Z")
V6 = re.compile(r"[0-9A-Fa-f:]*(?:[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)?")
V6_CHARS = frozenset("0123456789ABCDEFabcdef:")
KEY = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")
LOGIN = re.compile(r"([^\s/?#@:]+:[^\s/?#]+)@")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    rest = 0
    for c in iban[4:] + iban[:4]:
        rest = (rest * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return rest == 1


def iban_at(text: str, at: int) -> int | None:
    """The end of the IBAN that starts there, of the length its country has, if its check digits are right."""
    most = IBAN_LENGTHS.get(text[at : at + 2].upper(), 0)
    found, i = [], at
    while len(found) < most and i < len(text):
        c = text[i]
        if c.isascii() and c.isalnum():
            found.append(c)
        elif c != " " or text[i - 1] == " ":
            break
        i += 1
    whole = len(found) == most > 0 and not (i < len(text) and text[i].isalnum())
    return i if whole and "".join(found[2:4]).isdigit() and mod97("".join(found).upper()) else None


def is_v6(run: str) -> bool:
    """Whether a run of hex digits and colons is an address rather than a time, a scope or a ratio."""
    groups = [x for x in run.split(":") if x]
    if run.count(":") < 2 or not (len(groups) > 2 or any(len(x) > 2 and any(c in DIGITS for c in x) for x in groups)):
        return False
    try:
        ipaddress.IPv6Address(run)
    except ValueError:
        return False
    return True


LOW = {i: i + 32 for i in range(65, 91)}


def bracketed_v6(text: str, lo: int, end: int) -> bool:
    """Short addresses count in brackets only, as in urls."""
    if text[lo - 1 : lo] != "[" or text[end : end + 1] != "]" or end - lo > 45:
        return False
    try:
        ipaddress.IPv6Address(text[lo:end])
    except ValueError:
        return False
    return True


def lowered(text: str) -> str:
    """A-Z in lower case; every character keeps its place."""
    return text.lower() if text.isascii() else text.translate(LOW)


def automaton():
    """Of lower-case anchors: (kind, width) each."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in [("@", "@"), ("+", "+"), ("://", "://"), ("akia", "AKIA"), (":", ":"), ("bearer", "bearer"), ("iban", "iban"), *((d, "0") for d in DIGITS), *((f"{d}.", "0.") for d in DIGITS), *((f"{d}-", "0-") for d in DIGITS)]:
        found.add_word(word, (kind, len(word)))
    for kind, words in (("cue", CUES), ("account", ACCOUNT_CUES), ("form", TOKEN_FORMS)):
        for word in words:
            found.add_word(word, (kind, len(word)))
    # A word that both ends and begins names is tried as both; spaces keep them apart from parts of other words.
    for word in dict.fromkeys(STREET_AFTER + STREET_BEFORE):
        found.add_word(f" {word}", ("street", len(word) + 1))
    for word in STREET_WITHIN:
        found.add_word(word, ("within", len(word)))
    found.make_automaton()
    return found


def account_at(text: str, at: int) -> tuple[int, int, int]:
    """(start, end, where the run of groups ends) of the number after a cue; start is -1 where there is none."""
    lo = ACCOUNT_LEAD.match(text, at).end()
    m = ACCOUNT.match(text, lo)
    if not m:
        return -1, -1, lo
    end = m.end()
    if end < len(text) and text[end].isalnum():  # the last group goes on in lower case
        end = max(text.rfind(" ", lo, end), text.rfind("-", lo, end))
    groups = [(g.start() + lo, g.end() + lo) for g in re.finditer(r"[A-Z0-9]+", text[lo : max(lo, end)])]
    while groups and not any(c in DIGITS for c in text[groups[-1][0] : groups[-1][1]]):
        groups.pop()
    while groups and not any(c in DIGITS for c in text[groups[0][0] : groups[0][1]]) and groups[0][1] - groups[0][0] > 3:
        groups.pop(0)
    if not groups or sum(c in DIGITS for c in text[groups[0][0] : groups[-1][1]]) < 5 or groups[-1][1] - groups[0][0] < 6:
        return -1, -1, m.end()
    return groups[0][0], groups[-1][1], m.end()


def street_at(text: str, lo: int, hi: int, word: str) -> tuple[int, int] | None:
    """The address whose street word lies at lo..hi: a number before a name that the word ends, or a name after it."""
    if hi < len(text) and text[hi].isalnum():
        return None
    left = text[max(0, lo - NEAR) : lo]
    if word in STREET_AFTER and text[lo].isupper() and (m := LEFT_OF_STREET.search(left)):
        return lo - len(left) + m.start(), RIGHT_OF_STREET.match(text, hi, hi + NEAR).end()
    if word in STREET_BEFORE and (m := AFTER_RUE.match(text, hi, hi + NEAR)):
        if n := BEFORE_RUE.search(left):
            return lo - len(left) + n.start(), m.end()
        if any(c in DIGITS for c in m[0]) and text[lo].isupper():
            return lo, m.end()
    return None


def spans_of(text: str, anchors) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of each span, sorted."""
    out = []
    email = ip = card = phone = secret = v6 = account = street = 0
    low = lowered(text)
    for last, (kind, width) in anchors.iter(low):
        if kind == "0":
            if last >= card:
                if m := CARD.match(text, last):
                    card = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        out.append((2, last, card))
                else:
                    card = last + 1
            if last > 1 and "a" <= low[last - 1] <= "z" and "a" <= low[last - 2] <= "z" and (last == 2 or not text[last - 3].isalnum()) and (end := iban_at(text, last - 2)):
                out.append((4, last - 2, end))
        elif kind == "0.":
            lo = last
            while lo > ip and text[lo - 1] in DIGITS:
                lo -= 1
            if lo < last and (m := IP.match(text, lo)):
                ip = m.end()
                parts = [x.lstrip("0") for x in m[0].split(".")]
                if all(len(x) <= 3 and int(x or 0) <= 255 for x in parts):
                    out.append((1, lo, ip))
        elif kind == "@":
            lo = last
            while lo > email and text[lo - 1] in LOCAL:
                lo -= 1
            if lo < last and (m := DOMAIN.match(text, last + 1)):
                email = m.end()
                out.append((0, lo, email))
            else:
                email = last + 1
                if lo == last and (last == 0 or not text[last - 1].isalnum()) and (m := HANDLE.match(text, last)):
                    out.append((9, last, m.end()))
        elif kind == "+":
            if last >= phone and (m := PHONE.match(text, last)):
                phone = m.end()
                if 8 <= sum(c in DIGITS for c in m[0]) <= 15:
                    out.append((3, last, phone))
        elif kind == "iban":
            if m := CUED_IBAN.match(text, last + 1):
                if end := iban_at(text, m.start(1)):
                    out.append((4, m.start(1), end))
                elif mod97(m[1].replace(" ", "").upper()):
                    out.append((4, m.start(1), m.end(1)))
        elif kind == "0-":
            lo = last - 1
            if lo > 1 and text[lo - 1] in DIGITS and text[lo - 2] in DIGITS and (lo == 2 or text[lo - 3] not in "0123456789-") and (m := SSN.match(text, lo - 2)):
                out.append((8, lo - 2, m.end()))
        elif kind == ":":
            if last >= v6:
                lo = last
                while lo > v6 and text[lo - 1] in V6_CHARS:
                    lo -= 1
                run = V6.match(text, lo)
                v6 = max(run.end(), last + 1)
                end = run.end() - (run[0][-1:] == ":" and run[0][-2:] != "::")
                if (lo == 0 or not text[lo - 1].isalnum()) and not (end < len(text) and text[end].isalnum()) and (is_v6(text[lo:end]) or bracketed_v6(text, lo, end)):
                    out.append((7, lo, end))
        elif kind == "account":
            if last >= account and (last == width - 1 or not text[last - width].isalnum()):
                lo, end, account = account_at(text, last + 1)
                if lo >= 0:
                    out.append((10, lo, end))
        elif kind == "form":
            if (last == width - 1 or not text[last - width].isalnum()) and last >= secret and (m := TOKEN.match(text, last - width + 1)):
                secret = m.end()
                out.append((5, m.start(), m.end()))
        elif kind == "street":
            if last >= street and (got := street_at(text, last - width + 2, last + 1, low[last - width + 2 : last + 1])):
                street = got[1]
                out.append((11, *got))
        elif kind == "within":
            left = text[max(0, last - width + 1 - NEAR) : last + 1]
            if last >= street and (n := BEFORE_STRASSE.search(left)) and (m := AFTER_STRASSE.match(text, last + 1, last + 1 + NEAR)):
                street = m.end()
                out.append((11, last + 1 - len(n[0]), street))
        elif kind == "bearer":
            if m := BEARER.match(text, last + 1):
                out.append((5, m.start(1), m.end(1)))
        elif kind == "cue":
            if last >= secret and (m := SECRET.match(text, last + 1)):
                secret = m.end()
                if not m[1] or any(c in DIGITS for c in m[2]):  # "is" alone also leads to plain words
                    out.append((5, m.start(2), m.end(2)))
        elif kind == "AKIA":
            if m := KEY.match(text, last - width + 1):
                out.append((5, m.start(), m.end()))
        elif m := LOGIN.match(text, last + 1):
            out.append((6, m.start(1), m.end(1)))
    return sorted(set(out))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    kind_of = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        found = [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans_of(x.as_py() or "", anchors)] for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(kind_of))], ["doc_id", "spans"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> of each row."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_batches, SCHEMA)
