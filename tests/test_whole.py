"""Queries over the whole of their tables: what is expected is worked out here, apart from their SQL."""

import os
import re

import pytest

import __spark_entry__ as entry
from lexiweave.operators import terms as tm
from lexiweave.plans import fixtures as fx
from lexiweave.plans import flow_plans

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no supplied tables")


@pytest.mark.parametrize("name", ["src_llm_chat", "src_llm_msg", "src_mt_gt", "src_mt_dlx"])
def test_connectors_get_all_batches(spark, name):
    got = sorted((r.batch, r.i) for r in entry.queries()[name](spark, FOLDER).collect())
    want = sorted((r.batch, m["i"]) for r in flow_plans.batches(spark, FOLDER).collect() for m in r["items"])
    assert got == want and any(b % 5 for b, _ in got)


def test_contract_has_terms_of_all_items(spark):
    """The first word of four letters or more of each item, by the first item that has it."""
    want = {}
    for r in sorted(fx.table(spark, FOLDER, "benchmark").collect(), key=lambda r: r.item_id):
        if word := re.search(r"[A-Za-z]{4,}", r.text):
            want.setdefault(word[0].lower(), r.item_id)
    assert {r.term: r.pos for r in fx.contract(spark, FOLDER).collect()} == want and max(want.values()) >= 32
    total = sum(r.total for r in entry.queries()["jn_coverage"](spark, FOLDER).collect())
    assert total == len(want)


def test_rules_come_from_all_lines(spark):
    """A page's user domain words, the first line of each in order, far past the twelfth line."""
    want = {}
    for r in sorted(fx.units(spark, FOLDER).collect(), key=lambda r: r.pos):
        if r.pos % 10 == 3 and (word := re.search(r"[A-Za-z]{3,}", r.text)):
            words = want.setdefault(r.page_id, [])
            words += [w for w in [word[0].lower()] if w not in words]
    got = {r.page_id: r.domain for r in entry.queries()["fmt_rules_in"](spark, FOLDER).collect()}
    assert got == {k: ",".join(v) for k, v in want.items()} and max(len(v) for v in want.values()) > 2


def test_no_term_of_a_large_contract_is_lost(spark):
    """1,500 terms, each in one unit: all are hits, drift, matched and in the pool, with and without a broadcast."""
    n = 1500
    contract = spark.range(n).selectExpr("id AS pos", "concat('term', id + 10000) AS term", "concat('wort', id + 10000) AS target", "'locked' AS kind")
    units = spark.range(n).selectExpr("id AS unit_id", "id % 3 AS page_id", "concat('a term', id + 10000, ' b') AS text", "'x' AS t", "'done' AS state")
    mined = spark.createDataFrame([(1, "m", "m", "lexical", 1)], "page_id bigint, term string, lemma string, kind string, rank bigint")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for most in (was, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
            assert tm.term_hits(units, contract).select("term").distinct().count() == n
            assert tm.drift(units, contract).count() == n
            assert [(r.total, r.matched, r.unmatched) for r in tm.coverage(contract, units).collect()] == [(n, n, "")]
            assert tm.candidate_pool(contract, mined).count() == n + 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


@pytest.fixture(scope="module")
def long_pages(spark, tmp_path_factory):
    """Documents of 41, 401 and 100,001 lines next to short ones, and benchmark items with large ids."""
    at = tmp_path_factory.mktemp("long")
    counts = {1: 41, 2: 2, 3: 401, 4: 2, 5: 100_001, 6: 2}
    docs = [(k, "\n".join(f"zeta line {k} {i}" for i in range(n)), "en") for k, n in counts.items()]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(f"{at}/documents.parquet")
    items = [(39_001, "zeta opens"), (39_002, "line follows"), (60_000, "absent word")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), counts


def test_batches_and_units_belong_to_one_page(spark, long_pages):
    folder, counts = long_pages
    units = fx.units(spark, folder)
    assert units.select("unit_id").distinct().count() == sum(counts.values())
    page = {r.unit_id: r.page_id for r in units.where("page_id < 5 OR pos < 8").collect()}
    whole = flow_plans.batches(spark, folder)
    assert whole.count() == sum(-(-n // 4) for n in counts.values())
    for r in whole.collect():
        assert len(r["items"]) <= 4 and len({page.get(m["i"], 5) for m in r["items"]}) == 1


def test_pool_order_does_not_hang_on_item_ids(spark, long_pages):
    folder, _ = long_pages
    contract = fx.contract(spark, folder)
    kinds = {r.term: r.kind for r in contract.collect()}
    assert kinds == {"zeta": "suggested", "line": "risky", "absent": "locked"}
    mined = spark.createDataFrame([(1, "Mined", "mined", "lexical", 1)], "page_id bigint, term string, lemma string, kind string, rank bigint")
    order = [r.term for r in tm.candidate_pool(contract, mined).orderBy("ord").collect()]
    assert order == ["absent", "zeta", "line", "Mined"]
    units = spark.createDataFrame([(1, "zeta line mined absent"), (2, "zeta alone")], "page_id bigint, text string")
    got = sorted((r.page_id, r.term) for r in tm.matched(contract, mined, units).collect())
    assert got == [(1, "Mined"), (1, "absent"), (1, "line"), (1, "zeta")]  # page 2 mined nothing


def test_budget_covers_long_items(spark, tmp_path):
    """Every batch comes out, also those whose items are too long for a request."""
    lengths = [[13_000], [5, 13_000], [7000, 7000], [7000, 5, 7000], [5, 5, 13_000, 5], [7000] * 4, [13_000] * 4, [1, 1, 1, 1]]
    docs = [(i, "\n".join("a" * n for n in x)) for i, x in enumerate(lengths)]
    spark.createDataFrame([(*d, "en") for d in docs], "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.batch // fx.BATCHES: r.attempts for r in entry.queries()["udf_budget"](spark, str(tmp_path)).collect()}
    assert got == {0: 0, 1: 3, 2: 6, 3: 8, 4: 8, 5: 9, 6: 0, 7: 9}


def test_splits_hang_on_replies_whatever_the_length(spark, tmp_path):
    """Lines beyond 12,000 units split nothing by themselves, and spoilt ones do also where they are the only line."""
    docs = [(i, "\n".join("a" * n for n in (13_000, 5, 5))) for i in range(1, 240)] + [(i, "a" * 13_000) for i in range(240, 480)]
    spark.createDataFrame([(*d, "en") for d in docs], "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")

    def split(page, lines):
        ids = [page * fx.LINES + n for n in range(lines)]
        return any(i % 17 == 0 for i in ids) or (lines > 1 and any(i % 11 == 0 for i in ids)) or (lines > 2 and any(i % 13 == 0 for i in ids))

    want = {i: split(i, 3 if i < 240 else 1) for i, _ in docs}
    got = {r.batch // fx.BATCHES: r.was_split for r in entry.queries()["udf_split"](spark, str(tmp_path)).collect()}
    assert got == want and {want[i] for i in range(240, 480)} == {True, False} == {want[i] for i in range(1, 240)}


def test_profiles_written_last_by_id(spark, tmp_path):
    """128 keys of each space, by id, also where later ids have earlier times."""
    spark.range(2400).selectExpr("id AS event_id", "timestamp_seconds(1704067200 + 60 * (id % 800)) AS ts", "id % 9 AS user_id", "'view' AS event_type", "1.0D AS value", "concat('{\"k\": ', id % 3, '}') AS props").write.parquet(f"{tmp_path}/events.parquet")
    last = {}
    for i in range(2400):
        if i % 17:
            last.setdefault(i % 3, {})[i // 2] = i
    want = {(s, str(k)) for s, keys in last.items() for k in sorted(keys, key=keys.get)[-128:]}
    assert {(r.space, r.key) for r in entry.queries()["snk_profile"](spark, str(tmp_path)).collect()} == want
