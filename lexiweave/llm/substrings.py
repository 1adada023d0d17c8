"""Substring dedup: super-k-mer partitioning (operator 5).

A window is ``K`` consecutive words of a text. Its minimiser is the smallest
hash of its ``M``-word grams (the first of equals); consecutive windows with one
minimiser form a super-k-mer, which travels as one packed string to the bucket
of its minimiser, so equal windows meet there. In the bucket the windows are
sorted by their words and those equal to an earlier one (by id, then hash of
the text, then start) are marked; hashes only choose which windows are sorted.

Hot groups. A string that a batch holds twice travels once; its later copies
are marked at once. Minimisers that make up more than 1/``HEAVY`` of all
super-k-mers (at most HEAVY of them, counted over all texts) would fill a
bucket by themselves: their windows travel one by one, to buckets by the hash
of the whole window, so that only equal windows still meet.

Defined results
* null or empty text: no words; texts of fewer than K words keep all
* rows repeating id and text are one document: no row's window is earlier than
  the other's, and each row gets the same result
* kept words are joined by one space; empty table: empty result
* other columns are never read
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.llm.common import keyed, small_batches, stored
from lexiweave.llm.vector import Words, string_array

K = 20
M = 3
HEAVY = 20_000
BUCKET_BYTES = 4_000_000
LEVEL = 6
MIX = np.uint64(0x9E3779B97F4A7C15)


def super_kmers(words: Words, k: int, m: int):
    """start (word index in the batch), count of windows, minimiser and text's number of each super-k-mer."""
    n = len(words.hash)
    if n < k:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z
    grams = words.grams(m)
    size = n - k + 1
    best, place = grams[:size].copy(), np.arange(size, dtype=np.int64)
    for j in range(1, k - m + 1):
        other = grams[j : size + j]
        less = other < best
        best = np.where(less, other, best)
        place = np.where(less, np.arange(j, size + j), place)
    counts = np.diff(words.first)
    text = np.repeat(np.arange(len(counts)), counts)
    whole = text[:size] == text[k - 1 : k - 1 + size]
    new = np.ones(size, bool)
    new[1:] = (place[1:] != place[:-1]) | ~whole[:-1] | (text[1:size] != text[: size - 1])
    begin = np.flatnonzero(new & whole)
    cut = np.flatnonzero(np.append(new | ~whole, True))
    count = cut[np.searchsorted(cut, begin, "right")] - begin
    return begin, count, best[begin], text[begin]


def _heavy_counts(k: int, m: int, least: int = 3):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, minis, _ = super_kmers(Words(string_array(batch.column(0))), k, m)
            keys, counts = np.unique(minis, return_counts=True)
            keys, counts = np.append(keys[counts >= least], 0).astype(np.uint64), np.append(counts[counts >= least], len(minis))
            total = np.zeros(len(keys), bool)
            total[-1] = True
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64)), pa.array(total)], ["mini", "n", "total"])

    return run


def heavy_minimisers(docs: DataFrame, k: int, m: int, heavy: int) -> np.ndarray:
    """Sorted minimisers of more than 1/heavy of all super-k-mers, as far as batches hold three or more."""
    counts = docs.select("t").mapInArrow(_heavy_counts(k, m), "mini bigint, n bigint, total boolean").groupBy("total", "mini").agg(F.sum("n").alias("n"))
    counts = stored(counts, "minimisers")
    total = counts.where("total").first()
    if not total or not total["n"]:
        return np.zeros(0, np.uint64)
    rows = counts.where(~F.col("total") & (F.col("n") >= max(30, total["n"] // heavy))).select("mini").toArrow()
    return np.sort(rows.column("mini").to_numpy().astype(np.int64).view(np.uint64))


def _packing(k: int, m: int, buckets: int, heavy: np.ndarray):
    """Rows: bucket, strings (packed, one a line), owners (k, h, start as int64 triples); or marks (k, h, from, to) made here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=LEVEL)
        for number, batch in enumerate(batches):
            ids, hashes = np.asarray(batch.column(0).fill_null(-(2**63))), np.asarray(batch.column(1))
            words = Words(string_array(batch.column(2)))
            begin, count, minis, text = super_kmers(words, k, m)
            if not len(begin):
                continue
            hot = np.isin(minis, heavy) if len(heavy) else np.zeros(len(minis), bool)
            key = minis
            if hot.any():
                each = np.repeat(begin[hot], count[hot]) + np.concatenate([np.arange(c) for c in count[hot]])
                begin, count = np.concatenate([begin[~hot], each]), np.concatenate([count[~hot], np.ones(len(each), np.int64)])
                key = np.concatenate([minis[~hot], words.grams(k)[each]])
                text = np.concatenate([text[~hot], np.searchsorted(words.first, each, "right") - 1])
            start = begin - words.first[text]
            order = np.lexsort((start, hashes[text], ids[text]))
            begin, count, key, text, start = begin[order], count[order], key[order], text[order], start[order]
            data, lo, hi = words.data.tobytes(), words.start[begin].tolist(), words.end[begin + count + k - 2].tolist()
            where = ((key * MIX) >> np.uint64(20)) % np.uint64(buckets)
            seen: dict[bytes, int] = {}
            strings, owners, marks = {}, {}, []
            for i, (a, b, bucket) in enumerate(zip(lo, hi, where.tolist(), strict=True)):
                s = b" ".join(data[a:b].split())
                first = seen.setdefault(s, i)
                if first == i:
                    strings.setdefault(bucket, []).append(s)
                    owners.setdefault(bucket, []).append(i)
                else:
                    t, u = text[i], text[first]
                    if (ids[t], hashes[t], start[i]) != (ids[u], hashes[u], start[first]):
                        marks.append(i)
            triples = np.stack([ids[text], hashes[text], start], 1).astype(np.int64)
            out = [(b, press.compress(b"\n".join(strings[b])), press.compress(triples[owners[b]].tobytes()), None) for b in strings]
            if marks:
                ranges = np.column_stack([triples[marks], triples[marks, 2] + count[marks] + k - 1]).astype(np.int64)
                out.append(((number * 7919 + int(triples[0, 1]) % 104729) % buckets, None, None, press.compress(ranges.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), *(pa.array([x[j] for x in out], pa.binary()) for j in (1, 2, 3))], ["bucket", "strings", "owners", "marks"])

    return run


def later_windows(strings: list[bytes], owners: np.ndarray, k: int) -> list[tuple[int, int, int, int]]:
    """(k, h, from, to) word ranges of windows that also start earlier, exactly. strings: packed; owners: k, h, start of each."""
    order = sorted(range(len(strings)), key=owners.__getitem__)
    order.sort(key=strings.__getitem__)
    out, distinct, last = [], [], None
    for i in order:
        if last is not None and strings[i] == strings[last]:
            if owners[i] != owners[last]:
                out.append((*owners[i], owners[i][2] + strings[i].count(b" ") + 1))
        else:
            last = i
            distinct.append(i)
    words = Words(pa.array([strings[i].decode() for i in distinct], pa.large_string()))
    n = len(words.hash)
    if n < k:
        return out
    grams = words.grams(k)
    counts = np.diff(words.first)
    text = np.repeat(np.arange(len(counts)), counts)
    begin = np.flatnonzero(text[: n - k + 1] == text[k - 1 :])
    _, inverse, repeats = np.unique(grams[begin], return_inverse=True, return_counts=True)
    begin = begin[repeats[inverse] > 1]
    data = words.data.tobytes()
    rows = []
    for a, b, w, t in zip(words.start[begin].tolist(), words.end[begin + k - 1].tolist(), (begin - words.first[text[begin]]).tolist(), text[begin].tolist(), strict=True):
        owner = owners[distinct[t]]
        rows.append((data[a:b], owner[0], owner[1], owner[2] + w))
    rows.sort()
    marked, first = [], None
    for row in rows:
        if first is None or row[0] != first[0]:
            first = row
        elif row[1:] != first[1:]:
            marked.append(row[1:])
    marked.sort()
    for a, h, s in marked:
        if out and out[-1][0] == a and out[-1][1] == h and out[-1][2] <= s <= out[-1][3]:
            out[-1] = (a, h, out[-1][2], max(out[-1][3], s + k))
        else:
            out.append((a, h, s, s + k))
    return out


def _counting(k: int):
    def run(table: pa.Table) -> pa.Table:
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        strings, owners, ready = [], [], []
        for s, o, m in zip(*(table.column(c).to_pylist() for c in ("strings", "owners", "marks")), strict=True):
            if s is not None:
                strings += unpress.decompress(s).split(b"\n")
                owners += map(tuple, np.frombuffer(unpress.decompress(o), np.int64).reshape(-1, 3).tolist())
            if m is not None:
                ready.append(np.frombuffer(unpress.decompress(m), np.int64).reshape(-1, 4))
        found = later_windows(strings, owners, k)
        rows = np.concatenate([np.array(found, np.int64).reshape(-1, 4), *ready])
        return pa.table({"k": pa.array(rows[:, 0]), "h": pa.array(rows[:, 1]), "lo": pa.array(rows[:, 2]), "hi": pa.array(rows[:, 3])})

    return run


def _removing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, gone, kept = [], [], []
        for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = text.encode().split()
            sizes.append(len(words))
            if ranges:
                at, out = 0, []
                for r in sorted(ranges, key=lambda r: r["lo"]):
                    if r["lo"] > at:
                        out += words[at : r["lo"]]
                    at = max(at, r["hi"])
                out += words[at:]
                words = out
            gone.append(sizes[-1] - len(words))
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def repeated_ranges(docs: DataFrame, k: int = K, m: int = M, heavy: int = HEAVY, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """k, h, lo, hi: word ranges covered by windows that also start earlier. docs: k, t, h."""
    total = docs.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    buckets = max(1, total // bucket_bytes, min(48, 16 * total // bucket_bytes))
    hot = heavy_minimisers(docs, k, m, heavy)
    rows = docs.select("k", "h", "t").mapInArrow(_packing(k, m, buckets, hot), "bucket bigint, strings binary, owners binary, marks binary")
    return rows.groupBy("bucket").applyInArrow(_counting(k), "k bigint, h bigint, lo bigint, hi bigint")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, m: int = M, heavy: int = HEAVY, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """A row for each row: doc_id, n_words, n_removed, kept (text of the kept words)."""
    small_batches(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    ranges = repeated_ranges(rows, k, m, heavy, bucket_bytes).groupBy(F.col("k").alias("rk"), F.col("h").alias("rh")).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    both = rows.join(ranges, (F.coalesce(rows["k"], F.lit(-(2**63))) == ranges["rk"]) & (rows["h"] == ranges["rh"]), "left")
    return both.select("k", "t", "ranges").mapInArrow(_removing, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
