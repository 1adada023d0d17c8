"""Pages as a source: units, context, link lists and classes from raw HTML, as Column expressions.

This tier knows tags, not trees: comments, head, scripts and styles go, inline
tags join, every other tag parts text. ``lexiweave.sources.html`` walks trees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.functions import text as tx

INLINE = ("a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr")
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}
# Parts of host names by class, in order of precedence.
HOST_TABLE = {
    "academic": "arxiv.org biorxiv.org medrxiv.org ssrn.com jstor.org nature.com science.org sciencedirect.com springer.com wiley.com tandfonline.com acm.org ieee.org pubmed.ncbi.nlm.nih.gov doi.org semanticscholar.org researchgate.net plos.org mdpi.com openreview.net .edu",
    "technical": "github.com gitlab.com stackoverflow.com stackexchange.com readthedocs.io developer.mozilla.org npmjs.com pypi.org crates.io rust-lang.org kernel.org man7.org learn.microsoft.com docs. developer. devblogs. cisco.com juniper.net kubernetes.io docker.com postgresql.org redis.io nginx.org openwrt.org wiki.archlinux.org godbolt.org huggingface.co",
    "forum": "reddit.com news.ycombinator.com lobste.rs v2ex.com discourse. forum. bbs. quora.com zhihu.com tildes.net hackernews",
    "news": "nytimes.com wsj.com bbc. reuters.com apnews.com theguardian.com bloomberg.com ft.com economist.com cnn.com npr.org cbc.ca theglobeandmail.com aljazeera.com politico.com axios.com theverge.com arstechnica.com techcrunch.com",
}
ACADEMIC_HEADINGS = ("abstract", "introduction", "related work", "methodology", "references", "bibliography", "conclusion", "acknowledg", "摘要", "参考文献")
PRESETS = ("general", "academic", "technical", "forum", "news")


def body_of(html: Column) -> Column:
    """HTML without comments, head, scripts and styles; line breaks are spaces, inline tags gone."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?is)<(?:head|script|style)[\s>].*?</(?:head|script|style)>", "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>", " ")
    return F.regexp_replace(out, rf"(?i)</?(?:{'|'.join(INLINE)})(?:\s[^>]*)?>", "")


def decoded(x: Column) -> Column:
    for name, char in ENTITIES.items():
        x = F.replace(x, F.lit(name), F.lit(char))
    return x


def scan(pages: DataFrame) -> DataFrame:
    """page_id, pos, tag, text of each run of text between block tags, in order; texts that filters reject are kept."""
    body = body_of(F.concat(F.lit("<body>"), F.coalesce("html", F.lit(""))))
    tag, run = r"<(/?[A-Za-z][A-Za-z0-9]*)[^>]*>", r"<[^>]*>([^<]*)"
    parts = F.arrays_zip(F.regexp_extract_all("body", F.lit(tag + "([^<]*)"), F.lit(1)).alias("tag"), F.regexp_extract_all("body", F.lit(tag + "([^<]*)"), F.lit(2)).alias("run"))
    rows = pages.select("page_id", body.alias("body")).select("page_id", F.posexplode(parts).alias("pos", "p"))
    rows = rows.select("page_id", F.col("pos").cast("long").alias("pos"), F.upper("p.tag").alias("tag"), tx.normalize(decoded(F.col("p.run"))).alias("text"))
    return rows.where("text <> ''").withColumn("tag", F.when(F.col("tag").startswith("/"), "DIV").otherwise(F.col("tag")))


def context(pages: DataFrame) -> DataFrame:
    """page_id, title, hostname, description, headings (12 at most), code_blocks, has_byline, comment_nodes."""
    html = F.coalesce("html", F.lit(""))
    meta = lambda name: F.regexp_extract(html, rf"""(?is)<meta[^>]*(?:name|property)=["']{name}["'][^>]*content=["']([^"']*)["']""", 1)
    plain = lambda x: tx.normalize(decoded(F.regexp_replace(x, r"<[^>]*>", "")))
    heads = F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h[12][^>]*>(.*?)</h[12]>"), F.lit(1)), plain), lambda x: x != "")
    described = F.when(meta("description") != "", meta("description")).otherwise(meta("og:description"))
    return pages.select(
        "page_id", plain(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), hostname(F.col("url")).alias("hostname"), described.alias("description"), meta("og:type").alias("og_type"),
        F.slice(heads, 1, 12).alias("headings"), F.regexp_count(html, F.lit(r"(?i)<pre[\s>]")).cast("long").alias("code_blocks"),
        html.rlike(r"""(?i)rel=["']author|class=["'][^"']*byline|itemprop=["']author""").alias("has_byline"), F.regexp_count(html, F.lit(r"""(?i)(?:class|id)=["'][^"']*(?:comment|reply)""")).cast("long").alias("comment_nodes"),
    )


def hostname(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^@/?#]*@)?([^/?#:]*)", 1), F.lit("")))


def link_lists(pages: DataFrame, least_links: int = 3, most_chars: int = 30) -> DataFrame:
    """page_id, place, links, link_chars, chars, is_list of each ul: short links and little else."""
    lists = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<ul[^>]*>(.*?)</ul>"), F.lit(1))).alias("place", "inner"))
    bare = lambda x: F.length(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", ""), r"\s+", ""))
    lists = lists.select("page_id", F.col("place").cast("long").alias("place"), bare(F.col("inner")).cast("long").alias("chars"), F.transform(F.regexp_extract_all("inner", F.lit(r"(?is)<a[\s>][^>]*>(.*?)</a>"), F.lit(1)), bare).alias("sizes"))
    link_chars = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    lists = lists.withColumns({"links": F.size("sizes").cast("long"), "link_chars": link_chars, "long_links": F.size(F.filter("sizes", lambda x: x > most_chars))})
    is_list = (F.col("links") >= least_links) & (F.col("chars") > 0) & (F.col("link_chars") >= 0.75 * F.col("chars")) & (F.col("long_links") <= 0.3 * F.col("links"))
    return lists.select("page_id", "place", "links", "link_chars", "chars", is_list.alias("is_list"))


def host_class(pages: DataFrame) -> DataFrame:
    """page_id, preset by the first class of HOST_TABLE a part of which the host name holds; null if none."""
    rows = [(n, preset, part) for n, (preset, parts) in enumerate(HOST_TABLE.items()) for part in parts.split()]
    fixed = pages.sparkSession.createDataFrame(rows, "ord int, preset string, part string")
    hosts = pages.select("page_id", hostname(F.col("url")).alias("host"))
    hits = hosts.join(F.broadcast(fixed), F.contains("host", "part")).groupBy("page_id").agg(F.min_by("preset", "ord").alias("preset"))
    return hosts.join(hits, "page_id", "left").select("page_id", "preset")


def site_rule(pages: DataFrame, rules: DataFrame, most: int = 10_000) -> DataFrame:
    """Each page's first rule (pos, host, preset) whose host it has or lies under; nulls if none.

    A host is expanded into its suffixes, so this is a join on equality; rules
    of a checked number are broadcast by the planner's own size rule.
    """
    parts = F.split(F.col("host_name"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = pages.select("page_id", hostname(F.col("url")).alias("host_name"))
    hits = hosts.select("page_id", F.explode(F.array_distinct(suffixes)).alias("s")).join(rules.select(F.lower("host").alias("s"), "pos", "preset"), "s").groupBy("page_id").agg(F.min(F.struct("pos", "preset")).alias("m"))
    return hosts.join(hits, "page_id", "left").select("page_id", F.col("m.pos").alias("rule_pos"), F.col("m.preset").alias("preset"))


def classified(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, preset, reason: site rule, host table, structure, or general."""
    joined = F.lower(F.array_join("headings", " "))
    academic = sum((F.contains(joined, F.lit(h)).cast("int") for h in ACADEMIC_HEADINGS), F.lit(0))
    structure = F.when(academic >= 2, "academic").when(F.col("code_blocks") >= 3, "technical").when((F.col("og_type") == "article") & F.col("has_byline"), "news").when(F.col("comment_nodes") >= 8, "forum")
    rows = context(pages).select("page_id", structure.alias("s")).join(site_rule(pages, rules).select("page_id", F.col("preset").alias("r")), "page_id").join(host_class(pages).select("page_id", F.col("preset").alias("h")), "page_id")
    rule = F.when(F.col("r").isin(*PRESETS), F.col("r"))
    reason = F.when(rule.isNotNull(), "site-rule").when(F.col("h").isNotNull(), "host").when(F.col("s").isNotNull(), "structure").otherwise("fallback")
    return rows.select("page_id", F.coalesce(rule, "h", "s", F.lit("general")).alias("preset"), reason.alias("reason"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Units of a newer scan that the older one has not, by (page, tag, hash)."""
    key = ["page_id", "tag", "hash"]
    hashed = lambda d: d.withColumn("hash", F.sha2("text", 256))
    return hashed(after).join(hashed(before).select(*key), key, "left_anti")


def numbered_items(items: DataFrame) -> DataFrame:
    """items with number: page_id, list, pos, start, value, reversed.

    A list counts from its start, or where it has none from 1, or its size if it
    is reversed; an item with a value goes on from there.
    """
    of_list = Window.partitionBy("page_id", "list")
    w = of_list.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    nth, step = F.row_number().over(of_list.orderBy("pos")), F.when(F.coalesce("reversed", F.lit(False)), -1).otherwise(1)
    first = F.coalesce("start", F.when(step == -1, F.count("*").over(of_list)).otherwise(1))
    rows = items.withColumns({"_n": nth, "_first": first}).withColumn("_at", F.struct(F.col("_n").alias("n"), F.col("value").alias("value")))
    rows = rows.withColumn("_set", F.last(F.when(F.col("value").isNotNull(), F.col("_at")), ignorenulls=True).over(w))
    number = F.coalesce(F.col("_set.value") + step * (F.col("_n") - F.col("_set.n")), F.col("_first") + step * (F.col("_n") - 1))
    return rows.withColumn("number", number.cast("long")).drop("_n", "_first", "_at", "_set")
