"""Many terms in texts, against plain search, whole and in shards."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lexiweave.operators import terms as tm
from lexiweave.operators.matcher import contained

TERMS = [("Bank", "a"), ("bank", "b"), ("river bank", "c"), ("ß", "d"), ("İx", "e"), ("", "f"), (None, "g"), ("a", "h"), ("ana", "i"), ("🙂", "j")]
TEXTS = ["The BANK by the river bank", "banana", None, "", "Straße 🙂", "İX marks", "an a"]


@pytest.mark.parametrize("most", [1, 300, 32_000_000])
def test_contained(spark, most):
    units = spark.createDataFrame(list(enumerate(TEXTS)), "unit_id long, text string").repartition(2)
    terms = spark.createDataFrame(TERMS, "term string, kind string")
    got = sorted((r.unit_id, r.term, r.kind) for r in contained(units, terms, most_bytes=most).collect())
    low = {x: spark.createDataFrame([(x,)], "x string").select(F.lower("x")).first()[0] for x in [*TEXTS, *(t for t, _ in TERMS)] if x}
    want = sorted((i, t, k) for i, x in enumerate(TEXTS) for t, k in TERMS if x and t and low[t] in low[x])
    assert got == want and (0, "Bank", "a") in got and (0, "bank", "b") in got


def test_empty_tables(spark):
    units = spark.createDataFrame([], "unit_id long, text string")
    terms = spark.createDataFrame([], "term string, kind string")
    some = spark.createDataFrame([("x", "k")], "term string, kind string")
    assert contained(units, some).count() == 0
    assert contained(spark.createDataFrame([(1, "x")], "unit_id long, text string"), terms).count() == 0


def test_a_hundred_thousand_terms(spark):
    """No loop over terms, and a text that has a word of a third of all terms costs its hits only."""
    r = random.Random(3)
    names = [f"common {i:06d}" if i % 3 == 0 else f"t{i:06d}x" for i in range(100_000)]
    picked = [r.sample(names, 3) for _ in range(500)]
    units = spark.createDataFrame([(i, " and ".join(x) + " common") for i, x in enumerate(picked)], "unit_id long, text string")
    contract = spark.createDataFrame([(n, "locked") for n in names], "term string, kind string")
    begin = time.time()
    got = {(x.unit_id, x.term) for x in tm.term_hits(units, contract).select("unit_id", "term").collect()}
    assert got == {(i, t) for i, x in enumerate(picked) for t in x} and time.time() - begin < 60
