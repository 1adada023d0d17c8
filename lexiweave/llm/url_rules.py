"""URL filters: association rules (operator 6).

FP-growth mines token combinations of the labelled bad urls, of ``most_tokens``
tokens at most, among all tokens that are frequent enough there. A url of many
tokens goes to it as parts that between them hold every such combination, so
that a template of many words does not make it try all its subsets; its counts
are candidates only, and each combination is then counted on all labelled urls.

A rule has to hold on ``min_count`` labelled bad pages and on the share
``min_support`` of all, its confidence has to reach ``min_confidence``, and the
lower end of that confidence's interval (Wilson, ``z`` deviations) has to be
above the share of bad pages among all, so that neither a few pages nor a
common label make a rule. A rule goes if a part of its tokens is a rule of no
less confidence.

Rules that are left are indexed by their rarest token (inverted index); a page's
tokens join that index, and the rest of the rule's tokens is then looked for
among the page's. The index is broadcast if it has ``SMALL_INDEX`` rules at
most, else dealt out with salted tokens. A page that a rule matches is blocked.
Explicit (host, path, verdict) rules come first; the longest wins, of equally
long ones the first.

Defined results
* null url, or one without ``://``: host and path empty, no rule fits, and the
  association rules see no tokens: allowed
* a label counts as bad if quality is 0 or toxic is 1; null labels are ignored
* no labels, or no rule good enough: everything the rules leave is allowed
* rows repeating page_id and url each get their row; html is never read
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiweave.llm.common import stored
from lexiweave.llm.decontaminate import LOWER, UPPER

# Fixed by the contract of op6: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MIN_SUPPORT = 0.0005
MIN_CONFIDENCE = 0.5
MIN_COUNT = 10
Z = 4.0
#: Tokens of a rule; no bound on those of a url.
MOST_TOKENS = 4
#: Tokens of a url that go to FP-growth in one piece.
PIECE = 16
SMALL_INDEX = 10_000


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens: host labels, path words, names of the query's fields."""
    host = F.transform(F.filter(F.split(host_of(url), r"[.:@-]"), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    path = F.transform(F.filter(F.split(F.lower(path_of(url)), r"[^\p{L}\p{N}]+"), lambda x: (x != "") & ~x.rlike(r"^[0-9]+$")), lambda x: F.concat(F.lit("p:"), x))
    query = F.transform(F.regexp_extract_all(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1)), lambda x: F.concat(F.lit("q:"), x))
    scheme = F.filter(F.array(F.concat(F.lit("s:"), F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)))), lambda x: x != "s:")
    return F.when(url.contains("://"), F.array_distinct(F.concat(scheme, host, path, query))).otherwise(F.array().cast("array<string>"))


def explicit_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. rules is a short list, part of the plan."""
    fits = lambda h, p: ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    rule = reduce(lambda w, r: w.when(fits(r[0], r[1]), F.lit(r[0] + r[1])), ordered[1:], F.when(fits(*ordered[0][:2]), F.lit("".join(ordered[0][:2]))))
    verdict = reduce(lambda w, r: w.when(fits(r[0], r[1]), F.lit(r[2])), ordered[1:], F.when(fits(*ordered[0][:2]), F.lit(ordered[0][2])))
    return rule, verdict


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """tokens and bad of the pages that have a label."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    marks = labels.where(F.col("quality").isNotNull() | F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("page")).agg(F.max(F.coalesce(bad, F.lit(False))).alias("bad"))
    rows = pages.select(F.col("page_id").alias("page"), tokens_of(F.col("url")).alias("tokens"), F.monotonically_increasing_id().alias("row"))
    return rows.join(marks, "page").where(F.size("tokens") > 0)


def lower_end(share: Column, n: Column, z: float) -> Column:
    """The lower end of Wilson's interval of a share seen on n cases."""
    middle = (share + z * z / (2 * n)) / (1 + z * z / n)
    return middle - z / (1 + z * z / n) * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))


def pruned(rules: DataFrame) -> DataFrame:
    """Rules without those of which a part is a rule of no less confidence."""
    rules = rules.withColumn("rule", F.xxhash64(F.array_sort("antecedent")))
    part = rules.select(F.col("rule").alias("part"), F.col("antecedent").alias("fewer"), F.col("confidence").alias("as_good"), F.array_min("antecedent").alias("token"))
    each = rules.select("rule", "antecedent", "confidence", F.explode("antecedent").alias("token")).join(part, "token")
    less = each.where((F.size("fewer") < F.size("antecedent")) & (F.col("as_good") >= F.col("confidence")) & (F.size(F.array_except("fewer", "antecedent")) == 0)).select("rule").distinct()
    return rules.join(less, "rule", "left_anti").drop("rule")


def combined(tokens: Column, most_tokens: int, piece: int) -> list[tuple[str, Column]]:
    """Columns that explode, one after the other, to parts of tokens: unions of ``most_tokens`` blocks, so that any so many tokens are in one part."""
    width = max(1, piece // most_tokens)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / width)), lambda i: F.slice(tokens, (i * width + 1).cast("int"), width))
    last = F.size("blocks") - 1
    # The blocks' numbers rise; where there are no more blocks than that, the first choice is the only one.
    few = F.size("blocks") <= most_tokens
    steps = [("blocks", blocks)]
    for i in range(most_tokens):
        low = F.col(f"i{i - 1}") + 1 if i else F.lit(0)
        high = F.when(few, low).otherwise(last - (most_tokens - 1 - i))
        steps.append((f"i{i}", F.explode(F.sequence(low.cast("int"), high.cast("int")))))
    return steps


def parted(rows: DataFrame, most_tokens: int = MOST_TOKENS, piece: int = PIECE) -> DataFrame:
    """items: the parts of each row's tokens (none is empty)."""
    for name, column in combined(F.col("tokens"), most_tokens, piece):
        rows = rows.withColumn(name, column)
    chosen = F.flatten(F.filter(F.array(*[F.get("blocks", f"i{i}") for i in range(most_tokens)]), lambda x: x.isNotNull()))
    return rows.select(chosen.alias("items"))


def mine(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT, z: float = Z, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """Rules (antecedent array<string>, confidence, support) for the bad label, over all labelled pages; a table."""
    rows = stored(labelled(pages, labels), "url-labels")
    seen = rows.agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")).first()
    n, base = seen["n"], (seen["bad"] or 0) / max(1, seen["n"])
    least = max(1, min_count, min_support * n)
    each = rows.where("bad").select("row", F.explode("tokens").alias("token"))
    usual = each.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    items = each.join(usual, "token").groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]).alias("tokens"))
    items = stored(parted(items.select("tokens"), most_tokens), "url-items")
    model = FPGrowth(minSupport=min(1.0, (least - 0.5) / max(1, items.count()))).fit(items)
    some = model.freqItemsets.where(F.size("items") <= most_tokens).select(F.col("items").alias("antecedent"))
    counted = holding(rows.select("bad", "row", "tokens"), stored(some, "url-candidates")).groupBy("rule").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("hits"), F.first("antecedent").alias("antecedent"))
    rules = counted.select("antecedent", "n", "hits", (F.col("hits") / F.col("n")).alias("confidence"), (F.col("hits") / max(1, n)).alias("support"))
    rules = rules.where((F.col("hits") >= least) & (F.col("confidence") >= min_confidence) & (lower_end(F.col("confidence"), F.col("n"), z) > base))
    return stored(pruned(rules.select("antecedent", "confidence", "support")), "url-rules")


def holding(rows: DataFrame, rules: DataFrame, small: int = SMALL_INDEX, salts: int = 32) -> DataFrame:
    """rows (with tokens) with each rule all of whose tokens they have: rule (hash), antecedent."""
    few = rules.count() <= small
    near = F.broadcast if few else (lambda x: x)
    each = rules.select(F.xxhash64(F.array_sort("antecedent")).alias("rule"), "antecedent", F.explode("antecedent").alias("token"))
    wanted = each.select("token").distinct()
    seen = rows.select(F.explode("tokens").alias("token"))
    seen = seen.join(F.broadcast(wanted), "token", "left_semi").groupBy("token") if few else seen.groupBy("token")
    seen = seen.agg(F.count("*").alias("n"))
    index = each.join(near(seen), "token").groupBy("rule").agg(F.min(F.struct("n", "token")).alias("m"), F.first("antecedent").alias("antecedent")).select(F.col("m.token").alias("token"), "rule", "antecedent")
    hits = rows.select("*", F.explode("tokens").alias("token"))
    if few:
        hits = hits.join(F.broadcast(index), "token")
    else:
        hits = hits.withColumn("salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c != "tokens"]), F.lit(salts)))
        hits = hits.join(index.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["token", "salt"]).drop("salt")
    return hits.where(F.size(F.array_except("antecedent", "tokens")) == 0).drop("token")


def matched(pages: DataFrame, rules: DataFrame, small: int = SMALL_INDEX, salts: int = 32) -> DataFrame:
    """page, u (hash of url) of pages that have all tokens of some rule."""
    rows = pages.select(F.col("page_id").alias("page"), F.xxhash64(F.coalesce(F.col("url"), F.lit(""))).alias("u"), tokens_of(F.col("url")).alias("tokens"))
    return holding(rows, rules, small, salts).select("page", "u").distinct()


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """A row for each page row: page_id, host, path, rule, verdict."""
    hits = matched(pages, mine(pages, labels, min_support, min_confidence)).select(F.col("page").alias("hit_page"), F.col("u").alias("hit_u"))
    rows = pages.select("page_id", "url", F.xxhash64(F.coalesce(F.col("url"), F.lit(""))).alias("u"))
    rows = rows.join(hits, rows["page_id"].eqNullSafe(hits["hit_page"]) & (rows["u"] == hits["hit_u"]), "left")
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("hit_u").isNotNull().alias("hit"))
    rule, verdict = explicit_rule(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
