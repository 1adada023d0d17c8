"""Compression rules, importance resampling and the manifest against plain versions."""

import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiweave.llm import compression, importance, manifest, queries
from tests.llm import brute

TABLES = ("docs", "clashing")
ODD = ["", None, "Ünï cödé 1,2  x", "a b\tc\rd\x0be", "\n\n", "x" * 900 + " Y" * 3, "é" * 300, "<|$ #*&>% |"]


def as_rows(table, names):
    return sorted((tuple(r[c] for c in names) for r in table.collect()), key=repr)


@pytest.mark.parametrize("name", TABLES)
def test_counts_of_quality_rules(spark, request, rows, name):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = as_rows(compression.quality_rules(request.getfixturevalue(name)), names)
    assert got == sorted(((r[0], *brute.rules(r[1])) for r in rows), key=repr)


def test_repeats_within_a_text_only():
    r = random.Random(2)
    texts = [*ODD, *(" ".join(r.choice("abc") for _ in range(r.randint(0, 60))) for _ in range(80)), "one two three four five six\n" * 2, "one two three four five"]
    found = compression.counts(pa.array([x or "" for x in texts], pa.large_string()))
    for i, x in enumerate(texts):
        assert tuple(int(found[c][i]) for c in ("n_words", "word_chars", "n_symbols")) == brute.rules(x)[:3], x
        assert found["n_repeat_words"][i] == brute.rules(x)[4], x
        assert compression.repeated_lines((x or "").encode()) == brute.rules(x)[3]


def test_bands_reject_repeats_and_noise(spark):
    r = random.Random(4)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(4000)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    noise = lambda n: " ".join("".join(chr(r.randint(33, 126)) for _ in range(40)) for _ in range(n))
    pattern = lambda n: " ".join(f"item{i} the same again {i}" for i in range(n))
    texts = [prose(30), prose(300), prose(6000), prose(60_000), noise(60), noise(400), pattern(200), pattern(5000), prose(800) + " " + noise(300), prose(9000) + " " + noise(30), "short text of a dozen words that says nothing at all of ratios", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x.doc_id: x for x in compression.quality_rules(d).collect()}
    assert [i for i in got if got[i].kept] == [0, 1, 2, 3, 9, 10]
    assert got[11].ratio is None and got[11].base_failed and got[10].ratio > 1  # a short text does not shrink
    assert not got[8].base_failed and got[8].odd_share > compression.MOST_ODD  # only the chunks tell
    strict = compression.quality_rules(d, min_words=13, bands=((0, 0.0, 10.0),)).collect()
    assert [x.doc_id for x in strict if x.kept] == [x.doc_id for x in strict if not x.base_failed]


def test_chunks_cover_the_text():
    for size in (1, 100, 4095, 6143, 6144, 10_000, 81_920):
        spans = compression.chunk_spans(size, 4096)
        assert spans[0][0] == 0 and spans[-1][1] == size and all(a[1] == b[0] for a, b in itertools.pairwise(spans))
        assert all(2048 <= b - a < 6144 for a, b in spans) or size < 2048


@pytest.mark.parametrize("name", TABLES)
def test_resampling(spark, request, rows, name):
    items = [(1, " ".join((rows[12][1] or "").split()[:40])), (2, None), (3, "Hello, hello WORLD é")]
    aim = spark.createDataFrame(items, "item_id bigint, text string")
    got = as_rows(importance.resample(request.getfixturevalue(name), aim, percent=20), ["doc_id", "n_features", "weight", "score", "rank"])
    want = brute.resampled([(r[0], r[1]) for r in rows], [t for _, t in items], percent=20)
    assert sorted((x[:4] for x in got), key=repr) == sorted((x[:4] for x in want), key=repr)
    # repeated rows tie; either may come first
    assert sorted(x[4] for x in got if x[4]) == sorted(x[4] for x in want if x[4])
    assert {x[:4] for x in got if x[4]} == {x[:4] for x in want if x[4]}


def test_resampling_in_small_parts(spark, docs, monkeypatch):
    """Many packed rows, slices, ranges: the same rows."""
    aim = docs.limit(7)
    names = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    want = as_rows(importance.resample(docs, aim, percent=30), names)
    for part, slice_rows in ((500, 2), (1, 1)):
        monkeypatch.setattr(importance, "PART", part)
        monkeypatch.setattr(importance, "ROWS_PER_SLICE", slice_rows)
        assert as_rows(importance.resample(docs, aim, percent=30, block=999, rows_per_range=5), names) == want


def test_long_texts_are_hashed_in_slices(rows):
    data = [(r[1] or "").encode() for r in rows] + [b"x" * 700 + b" y " + b"z" * 300]
    want = importance.postings(data, importance.Shifts(), 10_000, 3)
    for words in (1, 7, 100):
        assert all((a == b).all() for a, b in zip(importance.postings(data, importance.Shifts(), 10_000, 3, words), want, strict=True))


@pytest.mark.parametrize("name", TABLES)
def test_manifest(spark, request, rows, name):
    rows = [*rows, (700, "alone", "zz", None, 3), (701, "x", None, "s", None), (702, None, "", "s", 1), (703, "y", "fr", "s", 2), (704, "z", "fr", "s", 2), (705, "z", "fr", "s", 2), (-(2**63), "min", "fr", "", 0)]
    want = brute.merkle(rows)
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    if name == "clashing":
        d = d.withColumns({c: F.lit("own") for c in ("id", "g", "key", "rank", "n", "hash", "leaf", "claimed", "path", "at", "block", "members", "node", "place")})
    tampered = manifest.leaf([F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in manifest.COLUMNS])
    claimed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, tampered)
    for how in ({}, {"most": 3, "digits": 6}):
        got = as_rows(manifest.manifest(d, claimed=claimed, **how), ["id", "leaf", "subroot", "root", "proof", "folded"])
        assert got == sorted(want, key=repr)


def test_manifest_of_other_shapes(spark, rows):
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    names = ["id", "leaf", "subroot", "root", "proof", "folded"]
    plain = [(*r[:2], None, *r[3:]) for r in rows]
    for fanout in (3, 300):
        want = brute.merkle(rows, fanout)
        got = as_rows(manifest.manifest(d, fanout=fanout), names)
        assert [x[:5] for x in got] == sorted((x[:5] for x in want), key=repr) and all(x[5] == x[3] for x in got)
    got = as_rows(manifest.manifest(d.withColumn("lang", F.lit(None).cast("string")), group_col=None), names)
    assert [x[:5] for x in got] == sorted((x[:5] for x in brute.merkle(plain)), key=repr)
    one = manifest.manifest(d.limit(1)).first()
    assert one.leaf == one.subroot == one.root == one.folded and one.proof == brute.digest("")


def test_exact_ranks_of_hot_keys(spark):
    """A third of all rows under one key, ids at both ends of the range, null ids."""
    r = random.Random(8)
    keys = [5] * 60 + [None] * 20 + [r.choice([-(2**63), 2**63 - 1, 0, r.randint(-50, 50), r.randint(-(2**60), 2**60)]) for _ in range(100)]
    t = spark.createDataFrame([("a" if i % 3 else "b", k, i) for i, k in enumerate(keys)], "g string, k long, i long").cache()
    t = t.withColumn("key", F.concat(manifest.sorted_key(F.col("k"), "long"), F.lpad(F.hex("i"), 16, "0")))
    for most, digits in ((1, 5), (1000, 2)):
        got = {x.i: (x["rank"], x.n) for x in manifest.ranks(t, "ranks-test", digits, most).collect()}
        for g in "ab":
            mine = sorted((i for i in range(len(keys)) if ("a" if i % 3 else "b") == g), key=lambda i: (keys[i] is not None, keys[i] or 0, i))
            assert [got[i] for i in mine] == [(j, len(mine)) for j in range(len(mine))]


def test_empty_tables(spark, none):
    assert compression.quality_rules(none).count() == 0
    assert importance.resample(none, none).count() == 0
    assert manifest.manifest(none).count() == 0


def test_empty_target(spark, docs, rows):
    got = as_rows(importance.resample(docs, docs.limit(0)), ["doc_id", "n_features", "weight"])
    assert got == sorted((x[:3] for x in brute.resampled([(r[0], r[1]) for r in rows], [])), key=repr)


def test_registered(spark):
    for name in ("op11_compression", "op12_importance", "op13_manifest"):
        assert name in queries.QUERIES
