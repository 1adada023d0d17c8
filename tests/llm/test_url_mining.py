"""Rules of urls with many tokens, and the registered query against plain rules."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from lexiweave.llm import queries, url_rules
from tests.llm.test_operators import plain_rules

LABELS = "doc_id bigint, quality int, toxic int"
PAGES = "page_id bigint, url string"


def test_a_common_token_of_long_urls_makes_a_rule(spark):
    """Bad exactly where the host is spam.com; thirteen rarer words in each url hide nothing."""
    r = random.Random(1)
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    urls = [f"http://{'spam' if i % 2 else 'fine'}.com/" + "/".join(r.sample(words, 13)) for i in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), PAGES)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(400)], LABELS)
    got = {x.page_id: x.verdict for x in url_rules.judge(pages, labels, rules=(("org", "/", "allow"),)).collect()}
    assert all((v == "block") == bool(i % 2) for i, v in got.items())


def test_combinations_in_a_long_template(spark):
    """Fourteen words that all urls share: no subset of them is tried, and the two that matter are found together only."""
    shared = "/".join(f"part{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(14))
    kinds = [(a, b) for a in ("buy", "read", "see") for b in ("now", "later", "never")]
    urls = [f"http://site.io/{shared}/{'/'.join(kinds[i % 9])}" for i in range(270)]
    bad = [int(i % 9 == 0) for i in range(270)]
    pages = spark.createDataFrame(list(enumerate(urls)), PAGES)
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, b in enumerate(bad)], LABELS)
    assert {tuple(sorted(x.antecedent)) for x in url_rules.mine(pages, labels).collect()} == {("p:buy", "p:now")}


def test_parts_hold_every_combination(spark):
    for size in (1, 3, 16, 17, 22):
        names = [f"t{i}" for i in range(size)]
        rows = url_rules.parted(spark.createDataFrame([(names,)], "tokens array<string>")).collect()
        assert all(0 < len(x["items"]) <= 16 and len(set(x["items"])) == len(x["items"]) for x in rows)
        have = {c for x in rows for c in combinations(sorted(x["items"]), min(4, size))}
        assert have == set(combinations(sorted(names), min(4, size)))


def test_query_equals_plain_rules(spark, tmp_path):
    """Explicit rules first, then mined ones; null urls, repeated rows, null labels, a very long url."""
    r = random.Random(7)
    hosts = ["ads.one.io", "news.one.io", "www.two.com", "b.net", "x.example.net", "y.example.com", "z.org"]
    urls = [f"http://{r.choice(hosts)}/{r.choice(['de', 'en', 'fr'])}/{r.choice(['win', 'read', 'buy'])}/{r.choice(['x', 'y'])}?{r.choice('pq')}=1" for _ in range(600)]
    bad = [int(("ads." in u and "/win" in u) or ("two" in u and "q=" in u) or r.random() < 0.03) for u in urls]
    urls += [None, "no scheme", "http://ads.one.io/en/win/" + "long/" * 20_000]
    spark.createDataFrame([*enumerate(urls), (0, urls[0])], PAGES).withColumn("verdict", F.lit("own")).write.parquet(f"{tmp_path}/pages.parquet")
    labels = [(i, 1 - b, 0) for i, b in enumerate(bad)] + [(1, None, None), (None, 0, 1), (10**6, 0, 0)]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    tokens = dict(enumerate(x.tokens or [] for x in spark.createDataFrame(list(enumerate(urls)), PAGES).orderBy("page_id").select(url_rules.tokens_of(F.col("url")).alias("tokens")).collect()))
    seen = [0, *range(len(bad))]  # the repeated row counts twice
    rules = {x for x in plain_rules([tokens[i] for i in seen], [bad[i] for i in seen], 10, url_rules.MIN_CONFIDENCE, url_rules.Z) if len(x) <= 4}
    assert rules

    def verdict(i):
        url = urls[i] or ""
        host, _, path = url.partition("://")[2].partition("/") if "://" in url else ("", "", "")
        path = "/" + path.split("?")[0]
        under = lambda h: host == h or host.endswith("." + h)
        fits = [(h + p, v) for h, p, v in url_rules.RULES if under(h) and path.startswith(p)]
        if fits:
            return max(fits, key=lambda f: len(f[0]))
        return None, "block" if any(set(x) <= set(tokens[i]) for x in rules) else "allow"

    got = queries.op6_url_rules(spark, str(tmp_path)).collect()
    assert len(got) == len(urls) + 1
    for x in got:
        assert (x.rule, x.verdict) == verdict(x.page_id), (x, urls[x.page_id])
    assert next(x.verdict for x in got if x.page_id == len(urls) - 1) == "block"
