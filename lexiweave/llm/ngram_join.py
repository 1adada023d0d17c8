"""N-gram Jaccard join: blocked sparse matrix product (operator 8).

The incidence matrix has a row for each distinct set of word 5-grams (a class
of documents; copies are one row) and a column for each 5-gram. Its product
with its own transpose holds the overlaps. It is made block by block of
columns, from the columns that the bounds leave: for a similarity of ``share``
percent two sets must meet among their first n - ceil(share * n) + 1 columns of
one global order, which puts columns that many documents have last, and their
sizes must be within ``share`` of each other. Overlap counts add up over the
blocks, and pairs whose count plus the largest possible rest stays below the
least overlap for their sizes are dropped. What is left is verified on whole
sets, as exact integers.

A column with few rows (``SMALL``) yields all its pairs. One with more does not:
in a few rounds each of its rows meets only ``HUBS`` rows of the column's
largest component (at first: any), chosen by hash so that all columns of a group
choose alike; each row's best pairs by count are verified, and linked rows
become one component. In further rounds each row outside its column's largest
component proposes the one row of another component that is nearest by parity
bitmap. Only then the pairs of its rows that are still in different components
are counted, in full, together with those of the small columns, so no link
between components is lost and rows of one group of near copies never pair up.
The bitmaps bound the pairs of large columns before they are counted: sets whose
bitmaps differ in d places differ in d elements at least, so a pair whose sizes
less d are below twice the least overlap can't be a link. A bitmap has as many
places as its set has elements, or more; longer ones fold to shorter ones.

A column of more than ``TILE`` rows is cut into parts, and each pair of parts is
a column of its own, so no task holds more than two parts of one. Those that
batches show to be so hot are cut before they are shuffled.

Verification sends a pair's sets to one place once: rows go to their hub, the
end of a pair that more pairs have, a hub of many pairs to several places with
``MEET`` rows each.

Classes and columns go by hashes of 64 bits, verification by 48: two sets of a
million grams in all agree on a gram they don't share with a chance below 0.001.

Defined results
* words: A-Z lower-cased, runs of other than ASCII white space
* fewer than n words: one gram, the whole sequence; null or no words: an empty
  set, n_shingles 0, linked with nothing, its component its own id
* rows that repeat an id are one node: the links of each count for both
* a null id is a node of its own, component null; empty table: empty result
* other columns are never read
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.llm.common import components, keyed, rows_of, small_batches, stored, with_keys
from lexiweave.llm.vector import Words, mix, string_array

N = 5
SHARE = 75
COMMON = 100_000
BLOCK_BYTES = 12_000_000
BROADCAST_ROWS = 1_000_000
SMALL, TILE, MEET = 16, 8192, 64
TOGETHER = 20_000
HUBS, BEST, ROUNDS, NEAREST = 8, 2, 2, 2
BITS = 1024
MASK = np.uint64(2**48 - 1)


def sets_of(column: pa.Array, n: int = N) -> list[np.ndarray]:
    """The sorted distinct gram hashes of each text."""
    words = Words(string_array(column), lower=True)
    grams, first = words.grams(n), words.first.tolist()
    out = []
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for x in words.hash[a:b]:
                h = mix(np.array([h * np.uint64(31) + x]))[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch_of(grams: np.ndarray, least: int = BITS) -> bytes:
    """For each of so many places (a power of two times ``least``, as many as there are grams), the parity of the number of grams that fall there."""
    bits = least
    while bits < len(grams):
        bits *= 2
    odd = np.bincount((mix(grams) >> np.uint64(20)) & np.uint64(bits - 1), minlength=bits) & 1 if len(grams) else np.zeros(bits, np.int64)
    # Places go round by halves, so that folding adds the second half of the bytes to the first.
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(sketch: bytes, words: int) -> np.ndarray:
    """A bitmap as so many 64-bit words."""
    out = np.frombuffer(sketch, np.uint64)
    while len(out) > words:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def prefix_size(n: int, share: int) -> int:
    return n - -(-share * n // 100) + 1


def _describing(n: int):
    """k, h, size, class, bitmap of each text; with the first of a batch, the grams that many of its classes have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                sets = sets_of(batch.column(2), n)
                ids = [class_of(x) for x in sets]
                distinct = list(dict(zip(ids, sets, strict=True)).values())
                keys, counts = np.unique(np.concatenate(distinct) if distinct else np.zeros(0, np.uint64), return_counts=True)
                common = np.stack([keys[counts > 2].view(np.int64), counts[counts > 2]]).astype(np.int64).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array(ids, pa.int64()), pa.array([sketch_of(x) for x in sets], pa.binary()), pa.array([common] + [None] * (len(ids) - 1) if ids else [], pa.binary())],
                    ["k", "h", "size", "class", "sketch", "common"],
                )

    return run


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [np.frombuffer(x, np.int64).reshape(2, -1) for x in batch.column(0).to_pylist()]
        both = np.concatenate([np.zeros((2, 0), np.int64), *both], 1)
        keys, where = np.unique(both[0], return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(where, both[1], len(keys)).astype(np.int64))], ["gram", "n"])


def common_grams(described: DataFrame, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent grams, as far as batches hold three or more: (sorted grams, counts). They only set the order of columns."""
    rows = described.where(F.col("common").isNotNull()).select("common").mapInArrow(_common, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    got = rows.orderBy(F.desc("n"), "gram").limit(most).toArrow()
    grams, n = got.column("gram").to_numpy().astype(np.int64).view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(grams)
    return grams[order], n[order]


def prefix_of(grams: np.ndarray, share: int, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first columns of a set, in the order (count among the common, hash)."""
    size = prefix_size(len(grams), share)
    if not len(common):
        return grams[:size]
    at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
    weight = np.where(common[at] == grams, counts[at], 0)
    return grams[np.lexsort((grams, weight))[:size]]


def tiled(grams: np.ndarray, owner: np.ndarray, ids: np.ndarray, common: np.ndarray, counts: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """grams and owners, with each entry of a column known to be hot replaced by one for each pair of parts it is in."""
    if not len(common) or counts.max() <= tile:
        return grams, owner
    at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
    n = np.where(common[at] == grams, counts[at], 0)
    hot = np.flatnonzero(n > tile)
    parts = -(-n[hot] // tile)
    each = np.repeat(hot, parts)
    other = np.arange(len(each)) - np.repeat(np.cumsum(parts) - parts, parts)
    mine = (mix(ids[owner[each]].view(np.uint64)) % np.repeat(parts, parts).astype(np.uint64)).astype(np.int64)
    pair = np.minimum(mine, other) * np.repeat(parts, parts) + np.maximum(mine, other) + 1
    cold = n <= tile
    return np.concatenate([grams[cold], mix(grams[each] ^ mix(pair.astype(np.uint64)))]), np.concatenate([owner[cold], owner[each]])


def _blocking(n: int, share: int, blocks: int, common: np.ndarray, counts: np.ndarray, tile: int):
    """Rows: block, and its columns' entries of this batch: grams, owners (places in classes), classes, sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        with np.errstate(over="ignore"):
            for batch in batches:
                distinct = {class_of(x): x for x in sets_of(batch.column(0), n) if len(x)}
                if not distinct:
                    continue
                ids = np.array(list(distinct), np.int64)
                sizes = np.array([len(x) for x in distinct.values()], np.int64)
                firsts = [prefix_of(x, share, common, counts) for x in distinct.values()]
                grams, owner = tiled(np.concatenate(firsts), np.repeat(np.arange(len(ids)), [len(x) for x in firsts]), ids, common, counts, tile)
                block = (mix(grams) % np.uint64(blocks)).astype(np.int64)
                order = np.lexsort((grams, block))
                grams, owner, block = grams[order], owner[order].astype(np.uint32), block[order]
                cut = np.flatnonzero(np.diff(block)) + 1
                out = []
                for g, o, b in zip(np.split(grams, cut), np.split(owner, cut), block[np.append(0, cut)], strict=True):
                    local, place = np.unique(o, return_inverse=True)
                    out.append((int(b), press.compress(g.tobytes()), press.compress(place.astype(np.uint32).tobytes()), ids[local].tobytes(), press.compress(sizes[local].astype(np.uint32).tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), *(pa.array([x[j] for x in out], pa.binary()) for j in (1, 2, 3, 4))], ["block", "grams", "owners", "classes", "sizes"])

    return run


def fitting(grams: np.ndarray, sizes: np.ndarray, share: int) -> np.ndarray:
    """Which entries have a neighbour of a fitting size in their column. Entries are sorted by column, then size."""
    near = np.zeros(len(grams), bool)
    pair = (grams[1:] == grams[:-1]) & (100 * sizes[:-1] >= share * sizes[1:])
    near[1:] |= pair
    near[:-1] |= pair
    return near


def tiles_of(ids: np.ndarray, sizes: np.ndarray, tile: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A column's rows, cut into parts and paired part by part where they are many."""
    parts = -(-len(ids) // tile)
    if parts <= 2:
        yield ids, sizes
        return
    part = (mix(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    for i in range(parts):
        for j in range(i + 1, parts):
            some = (part == i) | (part == j)
            if some.sum() > 1:
                yield ids[some], sizes[some]


def _columns(share: int, tile: int, small: int):
    """The distinct row lists of a block's columns with two or more rows: ids, sizes (by size, then id), weight (number of
    such columns); of small columns the counted pairs: a, b, na, nb, weight."""

    def run(table: pa.Table) -> pa.Table:
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        grams, owner, ids, sizes, classes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], 0
        for g, o, c, z in zip(*(table.column(x).to_pylist() for x in ("grams", "owners", "classes", "sizes")), strict=True):
            grams.append(np.frombuffer(unpress.decompress(g), np.uint64))
            owner.append(np.frombuffer(unpress.decompress(o), np.uint32) + np.uint32(classes))
            ids.append(np.frombuffer(c, np.int64))
            sizes.append(np.frombuffer(unpress.decompress(z), np.uint32))
            classes += len(ids[-1])
        grams, owner, ids, sizes = np.concatenate(grams), np.concatenate(owner), np.concatenate(ids), np.concatenate(sizes).astype(np.int64)
        order = np.argsort(grams)
        grams, owner = grams[order], owner[order]
        same = grams[1:] == grams[:-1]
        some = np.append(False, same) | np.append(same, False) if len(grams) else np.zeros(0, bool)  # most columns have one row
        grams, ids, sizes = grams[some], ids[owner[some]], sizes[owner[some]]
        order = np.lexsort((ids, sizes, grams))
        grams, ids, sizes = grams[order], ids[order], sizes[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (ids[1:] != ids[:-1])  # a class that several batches hold
        grams, ids, sizes = grams[new], ids[new], sizes[new]
        near = fitting(grams, sizes, share)
        grams, ids, sizes = grams[near], ids[near], sizes[near]
        begin = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
        end = np.append(begin[1:], len(grams)).astype(np.int64)
        few = end - begin <= small
        # Pairs of small columns: each entry with the next, the one after that, and so on.
        last = np.repeat(np.where(few, end, 0), end - begin)
        counted = np.zeros((5, 0), np.int64)
        for step in range(1, small):
            at = np.flatnonzero(np.arange(len(grams)) + step < last)
            to = at + step
            fits = 100 * sizes[at] >= share * sizes[to]
            at, to = at[fits], to[fits]
            low = ids[at] < ids[to]
            a, b = np.where(low, at, to), np.where(low, to, at)
            counted = np.concatenate([counted, np.stack([ids[a], ids[b], sizes[a], sizes[b], np.ones(len(a), np.int64)])], 1)
        order = np.lexsort(counted[1::-1])
        counted = counted[:, order]
        first = np.flatnonzero(np.append(True, (counted[0, 1:] != counted[0, :-1]) | (counted[1, 1:] != counted[1, :-1]))) if counted.shape[1] else np.zeros(0, np.int64)
        weight = np.diff(np.append(first, counted.shape[1]))
        pairs = counted[:4, first]
        lists: Counter = Counter()
        for lo, hi in zip(begin[~few].tolist(), end[~few].tolist(), strict=True):
            for i, z in tiles_of(ids[lo:hi], sizes[lo:hi], tile):
                lists[i.tobytes() + z.tobytes()] += 1
        rows = [(np.frombuffer(x, np.int64).reshape(2, -1), w) for x, w in lists.items()]
        kind, none = pa.list_(pa.int64()), [None] * pairs.shape[1]
        out = {"ids": pa.array([*(x[0] for x, _ in rows), *none], kind), "sizes": pa.array([*(x[1] for x, _ in rows), *none], kind), "weight": pa.array(np.append([w for _, w in rows], weight).astype(np.int64))}
        for name, x in zip(("a", "b", "na", "nb"), pairs, strict=True):
            out[name] = pa.array([None] * len(rows) + x.tolist(), pa.int64())
        return pa.table(out)

    return run


def hub_pairs(members: list[tuple[int, int, int]], share: int, turn: int) -> Iterator[tuple[int, int, int, int]]:
    """Rows (id, size, root) outside the largest component with some rows of it: (row, hub, size of the row, of the hub)."""
    roots = Counter(m[2] for m in members)
    most = max(roots.values())
    order = sorted(members, key=lambda m: hash((turn, m[0])))
    if most == 1:
        hubs, rest = order[:HUBS], order
    else:
        main = min(r for r, n in roots.items() if n == most)
        hubs, rest = [m for m in order if m[2] == main][:HUBS], [m for m in order if m[2] != main]
    for x in rest:
        for y in hubs:
            if x[2] != y[2] and 100 * min(x[1], y[1]) >= share * max(x[1], y[1]):
                yield x[0], y[0], x[1], y[1]


def cross_pairs(sizes: np.ndarray, roots: np.ndarray, sketches: list[bytes], share: int, most: int = 100_000) -> Iterator[tuple[np.ndarray, ...]]:
    """All pairs (i, j) of rows in different components whose sizes and bitmaps allow a link, and how much their bitmaps
    leave beyond the least overlap; in blocks of about ``most`` tries of a short bitmap; sizes ascend."""
    ends, words, lo = np.searchsorted(sizes, 100 * sizes // share, "right"), np.array([len(x) // 8 for x in sketches]), 0
    while lo < len(sizes):
        level = int(words[lo])  # rows with bitmaps of one length, against those that are no smaller
        top = int(np.searchsorted(words, level, "right"))
        far = int(ends[lo:top].max())
        maps = np.stack([folded(x, level) for x in sketches[lo:far]])
        base, tries = lo, max(1, most * BITS // 64 // level)
        while lo < top:
            hi = min(top, lo + max(1, tries // max(1, far - lo)))
            i, j = np.arange(lo, hi)[:, None], np.arange(lo + 1, ends[hi - 1])[None, :]
            i, j = np.nonzero((j > i) & (j < ends[i]) & (roots[i] != roots[j]))
            i, j = i + lo, j + lo + 1
            both = sizes[i] + sizes[j]
            spare = both - np.bitwise_count(maps[i - base] ^ maps[j - base]).sum(1, dtype=np.int64) - 2 * -(-share * both // (100 + share))
            yield i[spare >= 0], j[spare >= 0], spare[spare >= 0]
            lo = hi


def nearest(sizes: np.ndarray, roots: np.ndarray, sketches: list[bytes], share: int) -> tuple[np.ndarray, ...]:
    """(x, y, spare): for each row x outside the largest component the row y of another one with the most to spare, if any may link."""
    best, whom = np.full(len(sizes), -1, np.int64), np.zeros(len(sizes), np.int64)
    for i, j, spare in cross_pairs(sizes, roots, sketches, share):
        x, y, s = np.append(i, j), np.append(j, i), np.append(spare, spare)
        order = np.lexsort((y, s, x))
        x, y, s = x[order], y[order], s[order]
        last = np.append(x[1:] != x[:-1], True)[: len(x)]
        x, y, s = x[last], y[last], s[last]
        more = s > best[x]
        best[x[more]], whom[x[more]] = s[more], y[more]
    names, counts = np.unique(roots, return_counts=True)
    rows = np.flatnonzero((best >= 0) & ((roots != names[np.argmax(counts)]) | (counts.max() == 1)))
    return rows, whom[rows], best[rows]


def _lists(batch: pa.RecordBatch) -> Iterator[tuple]:
    """list, weight, ids, sizes, roots of each row, a row at a time."""
    for i in range(batch.num_rows):
        yield batch.column("list")[i].as_py(), batch.column("weight")[i].as_py(), *(batch.column(x)[i].values.to_numpy() for x in ("ids", "sizes", "roots"))


def _with_bitmaps(share: int, made):
    """Rows made of lists with their bitmaps. Bitmaps come before the lists of their place; one list is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, maps = None, {}
        for batch in batches:
            bucket, salt, one = (batch.column(x).to_pylist() for x in ("bucket", "salt", "id"))
            for i, now in enumerate(zip(bucket, salt, strict=True)):
                if now != place:
                    place, maps = now, {}
                if one[i] is not None:
                    maps[one[i]] = batch.column("sketch")[i].as_py()
                else:
                    for name, weight, ids, sizes, roots in _lists(batch.slice(i, 1)):
                        yield from made(name, weight, ids, sizes, roots, [maps[x] for x in ids.tolist()])

    return run


def _nearest(share: int):
    """Pairs (a, b) of rows and their nearest, c what they have to spare; lists with mixed components."""

    def made(name, weight, ids, sizes, roots, sketches):
        x, y, spare = nearest(sizes, roots, sketches, share)
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(z) for z in (ids[x], ids[y], spare)], ["a", "b", "c"])

    return _with_bitmaps(share, made)


LISTS = "list bigint, weight bigint, ids array<bigint>, sizes array<bigint>, roots array<bigint>"


def _narrowing(share: int):
    """Lists without the rows that have no partner their bitmaps allow; they have none later either, for components only grow."""

    def made(name, weight, ids, sizes, roots, sketches):
        some = np.zeros(len(sizes), bool)
        for i, j, _ in cross_pairs(sizes, roots, sketches, share):
            some[i] = some[j] = True
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([weight]), *(pa.array([z[some]], pa.list_(pa.int64())) for z in (ids, sizes, roots))], ["list", "weight", "ids", "sizes", "roots"])

    return _with_bitmaps(share, made)


def _crossing(share: int):
    """Counted pairs across components of lists with mixed components."""

    def made(name, weight, ids, sizes, roots, sketches):
        for i, j, _ in cross_pairs(sizes, roots, sketches, share):
            if len(i):
                low = ids[i] < ids[j]
                a, b = np.where(low, i, j), np.where(low, j, i)
                yield pa.RecordBatch.from_arrays([pa.array(z) for z in (ids[a], ids[b], sizes[a], sizes[b], np.full(len(i), weight))], ["a", "b", "na", "nb", "c"])

    return _with_bitmaps(share, made)


def _hubs(share: int, turn: int):
    """Counted hub pairs of lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(counts):
            rows = [(*p, w) for p, w in counts.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(5)], ["a", "b", "na", "nb", "c"])

        counts: Counter = Counter()
        for batch in batches:
            for _, weight, ids, sizes, roots in _lists(batch):
                for p in hub_pairs(list(zip(ids.tolist(), sizes.tolist(), roots.tolist(), strict=True)), share, turn):
                    counts[p] += weight
                    if len(counts) >= 200_000:
                        yield flush(counts)
                        counts = Counter()
        if counts:
            yield flush(counts)

    return run


def bounded(pairs: DataFrame, share: int) -> DataFrame:
    """Adds the counts over blocks and drops pairs that can't reach the least overlap for their sizes."""
    pairs = pairs.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
    rest = F.greatest(F.ceil(F.col("na") * share / 100), F.ceil(F.col("nb") * share / 100)) - 1
    return pairs.where((F.col("c") + rest) * (100 + share) >= share * (F.col("na") + F.col("nb")))


def _gathering(n: int):
    """A row for each place a class has to go to: hub, place, class, grams (48 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                packed = [np.unique(x & MASK).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for x in sets_of(batch.column(1), n)]
                names, wanted = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                rows: list[tuple] = []
                size = 0
                for name, grams, places in zip(names, packed, wanted, strict=True):
                    for place in places:
                        rows.append((place["hub"], place["place"], name, grams))
                        size += len(grams)
                        if size > 16_000_000:
                            yield _places(rows)
                            rows, size = [], 0
                yield _places(rows)

    return run


def _places(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["hub", "place", "class", "grams"])


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _verifying(share: int):
    """Links among rows that come by hub and place, the hub itself first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for to, name, grams in zip(*(batch.column(x).to_pylist() for x in ("hub", "class", "grams")), strict=True):
                if name == to:
                    if hub != to:
                        hub, mine = to, _unpacked(grams)
                elif hub == to:
                    other = _unpacked(grams)
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    if 100 * both >= share * (len(mine) + len(other) - both):
                        out.append((min(to, name), max(to, name)))
                else:
                    raise ValueError(f"the set of hub {to} is missing")
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in (0, 1)], ["a", "b"])

    return run


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, share: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the share."""
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    both = pairs.select("a", "b").join(degree.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    both = both.select(F.when(F.col("da") >= F.col("db"), F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(F.col("da") >= F.col("db"), F.col("b")).otherwise(F.col("a")).alias("class"), F.greatest("da", "db").alias("d"))
    spread = F.ceil(F.col("d") / MEET).cast("long")
    rows = both.select("class", "hub", F.pmod(F.xxhash64("class"), spread).alias("place"))
    hubs = rows.select(F.col("hub").alias("class"), "hub", "place").distinct()
    wanted = rows.unionByName(hubs).groupBy("class").agg(F.collect_list(F.struct("hub", "place")).alias("places"))
    wanted = stored(wanted.join(classes.select("class", "k", "h"), "class").select("class", F.col("k").alias("wk"), F.col("h").alias("wh"), "places"), "wanted")
    few = wanted.count() <= BROADCAST_ROWS
    found = docs.join(F.broadcast(wanted) if few else wanted, docs["k"].eqNullSafe(F.col("wk")) & (docs["h"] == F.col("wh"))).select("class", "t", "places").mapInArrow(_gathering(n), "hub bigint, place bigint, class bigint, grams binary")
    met = found.repartition("hub", "place").sortWithinPartitions("hub", "place", F.col("class") != F.col("hub"))
    return met.mapInArrow(_verifying(share), "a bigint, b bigint").distinct()


def class_links(docs: DataFrame, described: DataFrame, n: int = N, share: int = SHARE, common: int = COMMON, block_bytes: int = BLOCK_BYTES, small: int = SMALL, tile: int = TILE) -> DataFrame:
    """Links (a, b) between classes that connect all that the similarity connects. docs: k, t, h."""
    classes = described.where("size > 0").groupBy("class").agg(F.min(F.struct("k", "h")).alias("m"), F.first("sketch").alias("sketch")).select("class", "m.k", "m.h", "sketch")
    classes = stored(classes, "classes")
    grams, counts = common_grams(described, common)
    total = described.agg(F.sum("size").alias("n")).first()["n"] or 0
    blocks = max(1, total * (100 - share) // 100 * 8 // block_bytes)
    entries = docs.select("t").mapInArrow(_blocking(n, share, blocks, grams, counts, tile), "block bigint, grams binary, owners binary, classes binary, sizes binary")
    columns = entries.groupBy("block").applyInArrow(_columns(share, tile, small), "ids array<bigint>, sizes array<bigint>, weight bigint, a bigint, b bigint, na bigint, nb bigint")
    columns = stored(columns.withColumn("list", F.monotonically_increasing_id()), "columns")
    lists = columns.where("ids IS NOT NULL").select("list", "weight", "ids", "sizes")
    few = columns.where("ids IS NULL").select("a", "b", "na", "nb", F.col("weight").alias("c"))
    pair = "a bigint, b bigint, na bigint, nb bigint, c bigint"

    def mixed(lists: DataFrame, roots: DataFrame) -> DataFrame:
        """The lists whose rows are in several components, with those."""
        each = lists.select("list", "weight", F.explode(F.arrays_zip("ids", "sizes")).alias("m")).select("list", "weight", F.col("m.ids").alias("id"), F.col("m.sizes").alias("size"))
        each = each.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        both = each.groupBy("list", "weight").agg(F.array_sort(F.collect_list(F.struct("size", "id", "root"))).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        return both.where("lo <> hi").select("list", "weight", F.col("m.id").alias("ids"), F.col("m.size").alias("sizes"), F.col("m.root").alias("roots"))

    def placed(lists: DataFrame, sketches: DataFrame) -> DataFrame:
        """Lists and, before them, the bitmaps of their rows. Lists with one least hash, as those of one group of copies mostly have, go to one
        place, so that a bitmap travels there once; more than ``TOGETHER`` entries of such lists go to several."""
        lists = lists.withColumn("bucket", F.array_min(F.transform("ids", lambda x: F.xxhash64(x))))
        wide = lists.groupBy("bucket").agg(F.ceil(F.sum(F.size("ids")) / TOGETHER).cast("long").alias("wide"))
        lists = lists.join(wide, "bucket").withColumn("salt", F.pmod(F.xxhash64("list"), F.col("wide"))).drop("wide")
        ids = lists.select("bucket", "salt", F.explode("ids").alias("id")).distinct()
        maps = ids.join(sketches, "id").select("bucket", "salt", "id", "sketch")
        both = lists.unionByName(maps, allowMissingColumns=True)
        return both.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", F.asc_nulls_last("id"))

    def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components."""
        for x in ("a", "b"):
            pairs = pairs.join(roots.select(F.col("id").alias(x), F.col("root").alias(f"r{x}")), x, "left").withColumn(f"r{x}", F.coalesce(f"r{x}", x))
        return pairs.where("ra <> rb").drop("ra", "rb")

    def chosen(pairs: DataFrame) -> DataFrame:
        best = Window.partitionBy("a").orderBy(F.desc("c"), "b")
        some = pairs.withColumn("r", F.row_number().over(best)).where(F.col("r") <= BEST)
        return some.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    links, roots, tried, narrow, sketches = None, None, None, None, None
    for turn in range(ROUNDS + NEAREST):
        if turn < ROUNDS:
            if roots is None:
                rows = lists.withColumn("roots", F.col("ids"))
            else:
                rows = mixed(lists, roots)
            some = rows.mapInArrow(_hubs(share, turn), pair)
            some = chosen(bounded(some.unionByName(few) if turn == 0 else some, share))
        else:
            some = chosen(placed(narrow, sketches).mapInArrow(_nearest(share), "a bigint, b bigint, c bigint").distinct())
        some = stored(some if tried is None else some.join(tried, ["a", "b"], "left_anti"), f"tried-{turn}")
        tried = some if tried is None else tried.unionByName(some)
        none = some.isEmpty()  # a table, so this is cheap, and most of a round is not
        new = some.select("a", "b") if none else stored(verified(some, docs, classes, n, share), f"links-{turn}")
        links = new if links is None else links.unionByName(new)
        if turn >= ROUNDS and (none or new.isEmpty()):
            break
        if roots is None or not none:
            roots = components(links, f"linked-{turn}")
        if turn == ROUNDS - 1:
            left = stored(mixed(lists, roots), "mixed")
            sketches = left.select(F.explode("ids").alias("id")).distinct().join(classes.select(F.col("class").alias("id"), "sketch"), "id")
            sketches = stored(sketches, "bitmaps")
            narrow = stored(placed(left, sketches).mapInArrow(_narrowing(share), LISTS), "narrow")
        elif turn >= ROUNDS:
            narrow = stored(mixed(narrow, roots), f"mixed-{turn}")
    # A pair's count is whole only over large and small columns together.
    far = apart(bounded(placed(narrow, sketches).mapInArrow(_crossing(share), pair).unionByName(few), share).select("a", "b"), roots).join(tried, ["a", "b"], "left_anti")
    more = verified(stored(far, "far"), docs, classes, n, share)
    return stored(links.unionByName(more), "all-links")


def labelled(docs: DataFrame, id_col: str, text_col: str, ids_join: bool, n: int = N, share: int = SHARE, common: int = COMMON, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """k, h, size, root of each row of docs; rows that links reach have one root, with ids_join also rows of one id."""
    small_batches(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    described = stored(rows.select("k", "h", "t").mapInArrow(_describing(n), "k bigint, h bigint, size bigint, class bigint, sketch binary, common binary"), "described")
    links = class_links(rows, described, n, share, common, block_bytes)
    if ids_join:
        nodes = described.where("size > 0").select("class", F.col("k").alias("id")).distinct()
        # Classes and ids are the nodes of one graph: an id of several rows joins their classes.
        repeated = nodes.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b").select("id", "a")
        repeated = repeated.join(nodes, "id").select("a", F.col("class").alias("b")).where("a <> b")
        links = links.unionByName(repeated)
    roots = components(links, "classes")
    mine = described.join(roots.select(F.col("id").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    return stored(mine, "labelled")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """A row for each row of docs: doc_id, text_hash, n_shingles, component_id (the smallest doc_id that links reach)."""
    mine = labelled(docs, id_col, text_col, True, **how)
    least = stored(mine.where("size > 0").groupBy("root").agg(F.min("k").alias("least")), "least")  # apart, so that a hot root's rows can be split
    out = mine.join(least, "root", "left")
    return out.select(F.col("k").alias("doc_id"), F.col("h").alias("text_hash"), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("least")).otherwise(F.col("k")).alias("component_id"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each group of near texts, that of the smallest id (none comes last), then of the smallest hash.

    Ids name no groups here: unlike texts that share an id, or have none, all stay.
    Texts without shingles are groups of their own; rows that repeat id and text leave one.
    """
    mine = labelled(docs, id_col, text_col, False, **how)
    first = mine.where("size > 0").groupBy("root").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "h")).alias("m"))
    groups = first.select("m.k", "m.h").unionByName(mine.where("size = 0").select("k", "h").distinct()).toDF("gk", "gh")
    rows = with_keys(docs, id_col, text_col)
    kept = rows.join(groups, rows["k"].eqNullSafe(groups["gk"]) & (rows["h"] == groups["gh"]), "left_semi")
    if not rows.groupBy("k", "h").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["k", "h"])
    return rows_of(kept, docs)
