"""Target-distribution importance resampling (operator 12).

Texts are bags of hashed word n-grams. A document's weight is the sum over its
n-grams of how much likelier their bucket is in the target corpus than in the
raw one, and documents are drawn without replacement by weight plus Gumbel
noise of a seed, so the drawn ones follow the target distribution.

How it runs
* Postings. Each worker turns texts into inverted postings (bucket, document,
  count), as many texts at a time as make up ``PART`` bytes, and packs those of
  a block of neighbouring buckets into one row: places in order of bucket and
  document, as differences, and counts. They are written once, with the sums
  of their buckets and with a row that tells the documents.
* Gains. Sums are added up by bucket (partial sums first). Postings are shuffled
  by block, and within a block by ``slice``, so that a bucket that every document
  has is spread over tasks; the sums of both corpora go to each slice of their
  block, come first there, and give the gains locally. A task holds the sums
  of one block and one packed row, whatever the number of documents.
* Contributions are added up within a packed row, then reduced by document.
* Drawing. Candidates are dealt out by ranges of (score, id); the number of rows
  in each range gives the exact rank of each row, without a sort in one place.

Texts are read with A-Z lower-cased, words are runs of digits, letters a-z and
everything from U+0080. Hashes of n-grams are put together from those of words,
as CRC-32 is linear, so no n-gram is ever spelled out.

Defined results
* null, empty or wordless text: no features, weight 0; never drawn if
  ``min_words`` is positive
* a null id hashes as an empty one; ties of score go to the smaller id (null
  first), rows that tie in both to the lesser place in the postings' table
* rows repeating id and text are documents each, and each gives a row
* empty target: its counts are 0; empty corpus: empty result
* other columns are never read
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.llm.common import small_batches, stored

BUCKETS = 10_000
BLOCK = 200
N = 3
SEED = "42"
MIN_WORDS = 20
PERCENT = 5
#: Bytes of text whose postings are packed together; a longer text is packed by itself.
PART = 3_000_000
#: Words whose n-grams are hashed at a time.
WORDS = 1_000_000
#: Packed rows of a block that one slice holds, about.
ROWS_PER_SLICE = 64
CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    CRC[_i] = _c
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
LETTER = np.arange(256) > 127
LETTER[48:58] = LETTER[65:91] = LETTER[97:123] = True
PACKED = "row0 bigint, width int, corpus int, block int, places binary, counts binary, sums array<bigint>, ids array<bigint>, n_words array<bigint>, n_features array<bigint>"


def after_bytes(crc: np.ndarray, data: np.ndarray) -> np.ndarray:
    """CRC register after one more byte each."""
    return CRC[(crc ^ data) & 0xFF] ^ crc >> np.uint32(8)


class Shifts:
    """crc(a + b) = shifted(crc(a), len(b)) ^ crc(b); the tables are made for lengths as they come."""

    def __init__(self):
        zero = np.arange(256, dtype=np.uint32)
        self.tables = np.stack([zero << np.uint32(8 * i) for i in range(4)])[None]  # of length 0

    def upto(self, length: int) -> None:
        while len(self.tables) <= length:
            self.tables = np.concatenate([self.tables, after_bytes(self.tables[-1], np.uint32(0))[None]])

    def joined(self, first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
        """CRC of pairs; words of over 255 bytes are shifted by 255 as often as it takes."""
        first, length = first.copy(), length.copy()
        while len(far := np.flatnonzero(length > 255)):
            first[far] = self._shifted(first[far], np.full(len(far), 255))
            length[far] -= 255
        return self._shifted(first, length) ^ second

    def _shifted(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        self.upto(int(length.max(initial=0)))
        out = self.tables[length, 0, crc & 0xFF]
        for i in range(1, 4):
            out = out ^ self.tables[length, i, crc >> np.uint32(8 * i) & 0xFF]
        return out


def word_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of words in data; ends are the ends of the texts, which cut words."""
    solid = LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = edge[0] = True
    head, tail = solid.copy(), solid.copy()
    head[1:] &= ~solid[:-1] | edge[1:-1]
    tail[:-1] &= ~solid[1:] | edge[1:-1]
    return np.flatnonzero(head), np.flatnonzero(tail) + 1


def word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, a byte of all words that are long enough at a time."""
    length = end - start
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-length, kind="stable")
    left = np.cumsum(np.bincount(length, minlength=1)[::-1])[::-1]  # words of at least so many bytes
    for j in range(int(length.max(initial=0))):
        live = order[: left[j + 1]] if j + 1 < len(left) else order[:0]
        crc[live] = after_bytes(crc[live], LOWERED[data[start[live] + j]].astype(np.uint32))
    return ~crc


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray, shifts: Shifts, n: int = N, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, CRC-32) of all runs of 1 to n words; only of those that start at the first ``own`` words."""
    own = len(start) if own is None else own
    word, length = word_crcs(data, start, end), end - start
    texts, crcs, last = [text[:own]], [word[:own]], word
    for j in range(1, n):
        spaced = ~after_bytes(~last[: len(word) - j], np.uint32(32))
        last = shifts.joined(spaced, word[j:], length[j:])
        whole = np.flatnonzero(text[: len(word) - j][:own] == text[j:][:own])
        texts.append(text[whole])
        crcs.append(last[whole])
        if len(word) <= j + 1:
            break
    return np.concatenate(texts), np.concatenate(crcs)


def narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def packed(values: np.ndarray, press) -> bytes:
    """Numbers from 0 on in as few bytes each as the greatest needs, compressed."""
    small = narrow(values)
    return bytes([small.itemsize]) + press(small.tobytes())


def unpacked(data: bytes, open_) -> np.ndarray:
    return np.frombuffer(open_(data[1:]), f"u{data[0]}")


def pieces(texts: list[bytes], most: int) -> Iterator[list[tuple[int, bytes]]]:
    """Groups of (text, bytes) of so many bytes at most; a longer text is a group by itself."""
    group, size = [], 0
    for i, x in enumerate(texts):
        if group and size + len(x) > most:
            yield group
            group, size = [], 0
        group.append((i, x))
        size += len(x)
    if group:
        yield group


def postings(group: list[bytes], shifts: Shifts, buckets: int, n: int, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted places (bucket * texts + text) and their counts, words and features of each text."""
    data = np.frombuffer(b"".join(group), np.uint8)
    ends = np.cumsum([len(x) for x in group])
    start, end = word_spans(data, ends)
    text = np.searchsorted(ends, start, side="right")
    n_features = np.zeros(len(group), np.int64)
    found = []
    for lo in range(0, len(start), words):
        near = slice(lo, lo + words + n - 1)
        some, crc = features(data, start[near], end[near], text[near], shifts, n, words)
        n_features += np.bincount(some, minlength=len(group))
        found.append(np.unique((crc % np.uint32(buckets)).astype(np.int64) * len(group) + some, return_counts=True))
    if len(found) < 2:
        places, counts = found[0] if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    else:
        places, at = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([c for _, c in found])).astype(np.int64)
    return places, counts, np.bincount(text, minlength=len(group)), n_features


def _packing(corpus: int, buckets: int, block: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        shifts, at = Shifts(), (TaskContext.get().partitionId() << 36)
        names = [x.split()[0] for x in PACKED.split(", ")]
        longs = pa.list_(pa.int64())
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), longs, longs, longs, longs]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [x or b"" for x in batch.column(1).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]
            for group in pieces(texts, PART):
                rows = []
                places, counts, n_words, n_features = postings([x for _, x in group], shifts, buckets, n)
                sums = np.bincount(places // len(group), weights=counts, minlength=buckets).astype(np.int64)
                cuts = np.searchsorted(places, np.arange(0, buckets + block, block) * len(group))
                for b in range(-(-buckets // block)):
                    lo, hi = cuts[b], cuts[b + 1]
                    if lo < hi:
                        inside = places[lo:hi] - b * block * len(group)
                        steps = np.diff(inside, prepend=0)
                        rows.append((at, len(group), corpus, b, packed(steps, press), packed(counts[lo:hi], press), sums[b * block : (b + 1) * block].tolist(), None, None, None))
                rows.append((at, len(group), corpus, -1, None, None, None, [ids[i] for i, _ in group], n_words.tolist(), n_features.tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types, strict=True)], names)
                at += len(group)

    return run


def gains(raw: np.ndarray, target: np.ndarray, all_raw: int, all_target: int, buckets: int) -> np.ndarray:
    """Of each bucket: thousandths of the log of its likelihood ratio, floored."""
    ratio = (target + 1.0) * (all_raw + float(buckets)) / ((raw + 1.0) * (all_target + float(buckets)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weighing(all_raw: int, all_target: int, buckets: int, block: int):
    """Packed rows, sums of their block before them, in; row and weight of each document in them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        now, gain = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    sums = [np.zeros(block, np.int64), np.zeros(block, np.int64)]
                    for s in r["totals"]:
                        sums[s["corpus"]][s["at"]] = s["n"]
                    now, gain = r["block"], gains(*sums, all_raw, all_target, buckets)
                    continue
                assert r["block"] == now
                places, counts = np.cumsum(unpacked(r["places"], open_), dtype=np.int64), unpacked(r["counts"], open_)
                width = r["width"]
                weight = np.zeros(width, np.int64)
                np.add.at(weight, places % width, counts.astype(np.int64) * gain[places // width])
                some = np.flatnonzero(weight)
                yield pa.RecordBatch.from_arrays([pa.array(r["row0"] + some, pa.int64()), pa.array(weight[some])], ["row", "part"])

    return run


def weigh(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS, block: int = BLOCK, n: int = N) -> DataFrame:
    """A row for each row of docs: row (its place), doc_id, n_words, n_features, weight."""
    spark = docs.sparkSession
    small_batches(spark, size=8_000_000)
    raw = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_packing(0, buckets, block, n), PACKED)
    wanted = target.select(F.lit(None).cast("long").alias("id"), F.col(target_text_col)).mapInArrow(_packing(1, buckets, block, n), PACKED)
    table, aim = stored(raw, "importance-raw"), stored(wanted, "importance-target")

    # Sums of both corpora by bucket: rows of at most 2 * buckets.
    each = table.select("corpus", "block", "sums").unionByName(aim.select("corpus", "block", "sums")).where("block >= 0")
    sums = each.select("corpus", "block", F.posexplode("sums").alias("at", "n")).groupBy("corpus", "block", "at").agg(F.sum("n").alias("n")).where("n > 0")
    sums = stored(sums, "importance-sums")
    total = {r["corpus"]: r["n"] for r in sums.groupBy("corpus").agg(F.sum("n").alias("n")).collect()}
    groups = table.where("block < 0").select("row0", "ids", "n_words", "n_features")
    slices = max(1, -(-groups.count() // ROWS_PER_SLICE))

    # Postings meet the sums of their block in each of its slices.
    lists = table.where("block >= 0").select("block", F.pmod(F.xxhash64("row0"), F.lit(slices)).cast("int").alias("slice"), F.lit(1).alias("kind"), "row0", "width", "places", "counts", F.lit(None).cast("array<struct<corpus:int,at:int,n:bigint>>").alias("totals"))
    known = sums.groupBy("block").agg(F.collect_list(F.struct("corpus", "at", "n")).alias("totals"))
    known = known.select("block", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in (("row0", "long"), ("width", "int"), ("places", "binary"), ("counts", "binary"))], "totals")
    dealt = lists.unionByName(known).repartition("block", "slice").sortWithinPartitions("block", "slice", "kind")
    parts = dealt.mapInArrow(_weighing(total.get(0, 0), total.get(1, 0), buckets, block), "row bigint, part bigint")

    own = groups.select("row0", F.posexplode(F.arrays_zip("ids", "n_words", "n_features")).alias("i", "d"))
    own = own.select((F.col("row0") + F.col("i")).alias("row"), F.lit(0).cast("long").alias("part"), "d.ids", "d.n_words", "d.n_features")
    empty = [F.lit(None).cast("long").alias(c) for c in ("ids", "n_words", "n_features")]
    out = parts.select("row", "part", *empty).unionByName(own).groupBy("row")
    return out.agg(F.max("ids").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("n_features").alias("n_features"), F.sum("part").alias("weight"))


def noise(seed: str, key: Column) -> Column:
    """Thousandths of Gumbel noise, from a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, draw: int, parts: int) -> DataFrame:
    """row and rank (from 1 on) of the draw highest scores; ties to the smaller id, then the smaller row."""
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("row")]
    dealt = stored(rows.select("score", "doc_id", "row").repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "importance-ranges")
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")).where(F.col("before") < draw)
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
    return dealt.join(F.broadcast(before), "part").select("row", rank.cast("long").alias("rank")).where(F.col("rank") <= draw)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED, rows_per_range: int = 200_000, **how) -> DataFrame:
    """A row for each row: doc_id, n_words, n_features, weight, score, rank (null where not drawn)."""
    rows = stored(weigh(docs, target, **how).withColumn("score", F.col("weight") + noise(seed, F.col("doc_id"))), "importance-scores")
    fit = rows.where(F.col("n_words") >= min_words)
    n = fit.count()
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-n // rows_per_range))
    drawn = ranked(fit, n * percent // 100, parts)
    return rows.join(drawn, "row", "left").select("doc_id", "n_words", "n_features", "weight", "score", "rank")
