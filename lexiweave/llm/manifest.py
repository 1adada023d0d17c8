"""Merkle dataset manifest: radix-ranked trie (operator 13).

Each row is a leaf, a SHA-256 of its columns. The leaves of a group (language)
are ordered by id and hashed upwards in runs of ``fanout`` to a subroot; the
subroots, ordered by group, likewise to the root. Each leaf gets its proof: the
siblings it needs to fold its hash up to the root.

Ranks. A leaf's place is its exact rank in its group, found without a sort over
all: keys (id, then hash, then row number, each as hexadecimal digits) are
counted by their leading digits; a prefix sum over the at most 16**``DIGITS``
children of a node, starting from the node's own place, gives each child's
place; children of more than ``MOST`` rows are counted again by the next
digits, and the rows of smaller ones are numbered within them.

Trie. The digits of a rank to the base ``fanout`` are the path of its leaf, so
nodes are keyed by what is left of a rank after its last digits. Each round
takes SPAN leaves (a power of fanout) that share the longest prefixes to one
row and hashes them to the node above, until one is left. Paths come down the
same way: a block of leaves meets the siblings above it in one row, so proofs
are folded where the block lies and only digests travel.

Defined results
* a null in any column is ``-`` in the leaf; null ids come first, null groups too
* ids that repeat are ordered by leaf; equal leaves stand next to each other
* a lone leaf of a group is its subroot; a lone subroot is the root
* a run of one node is hashed like any other; a proof without siblings is the
  hash of the empty text
* empty table: empty result; columns that aren't named are never read
"""

from __future__ import annotations

import hashlib
import itertools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.llm.common import small_batches, stored

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
DIGITS = 3
MOST = 100_000
#: Nodes of more than MOST rows there can be; MOST grows with the table beyond. Their table is broadcast up to so many bytes.
MOST_NODES = 200_000
MOST_BYTES = 50_000_000
SPAN = 256


def field(value: Column) -> Column:
    """Byte count, colon and value; ``-`` for null."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(x) for x in values]), 256)


def sorted_key(value: Column, kind: str) -> Column:
    """Hexadecimal digits in whose order values come: numbers by size, text by UTF-8 bytes; null first."""
    if kind == "string":
        digits = F.hex(F.encode(value, "UTF-8"))
    else:
        digits = F.lpad(F.hex(value.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.when(value.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), digits))


def ranks(rows: DataFrame, name: str, digits: int = DIGITS, most: int = MOST) -> DataFrame:
    """rows (a stored table with columns g and key, unique together) with ``rank`` (from 0 on) of key in g and ``n``, the rows of g."""
    seen = rows.agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    if not seen["n"]:
        return rows.withColumns({"rank": F.lit(0).cast("long"), "n": F.lit(0).cast("long")})
    most = max(most, seen["n"] // MOST_NODES)
    width = len(os.path.commonprefix([seen["lo"], seen["hi"]]))  # of all keys, as they lie between these two
    above = rows.groupBy("g").agg(F.count("*").alias("n")).select("g", F.substring(F.lit(seen["lo"]), 1, width).alias("parent"), F.lit(0).cast("long").alias("place"), "n")
    left, out = rows, None
    for depth in itertools.count():
        upto = width + digits
        node = F.substring("key", 1, upto)
        counts = left.groupBy("g", node.alias("node")).agg(F.count("*").alias("rows")).withColumn("parent", F.substring("node", 1, width))
        before = Window.partitionBy("g", "parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        place = F.col("place") + F.coalesce(F.sum("rows").over(before), F.lit(0))
        nodes = stored(counts.join(above, ["g", "parent"]).select("g", "node", "rows", place.alias("place"), "n"), f"{name}-nodes-{depth}")
        large = nodes.where((F.col("rows") > most) & (F.length("node") == upto))
        size = large.agg(F.sum(F.length("g") + F.length("node") + 64)).first()[0] or 0
        here = left.withColumn("node", node)
        if size:
            wide = large.select("g", "node")
            wide = F.broadcast(wide) if size <= MOST_BYTES else wide
            left = here.join(wide, ["g", "node"], "left_semi").select(rows.columns)
            here = here.join(wide, ["g", "node"], "left_anti")
        small = nodes.where((F.col("rows") <= most) | (F.length("node") < upto)).select("g", "node", "place", "n")
        number = F.row_number().over(Window.partitionBy("g", "node").orderBy("key")) - 1
        got = here.join(small.hint("merge"), ["g", "node"]).select(*rows.columns, (F.col("place") + number).alias("rank"), "n")
        out = got if out is None else out.unionByName(got)
        if not size:
            return out
        above, width = large.select("g", F.col("node").alias("parent"), "place", "n"), upto


def height(n: int, fanout: int) -> int:
    out = 0
    while n > 1:
        n, out = -(-n // fanout), out + 1
    return out


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels(hashes: list[str], count: int, fanout: int) -> list[list[str]]:
    """The nodes of a block, level by level, the given ones first; ``count`` levels above them."""
    out = [hashes]
    for _ in range(count):
        now = out[-1]
        out.append([digest("".join(now[i : i + fanout])) for i in range(0, len(now), fanout)])
    return out


def siblings(tree: list[list[str]], at: int, fanout: int) -> list[dict[str, str]]:
    """Of the node at that place of the lowest level: the others of its run, left and right of it, on each level but the top."""
    out = []
    for level in tree[:-1]:
        first = at - at % fanout
        out.append({"before": "".join(level[first:at]), "after": "".join(level[at + 1 : first + fanout])})
        at //= fanout
    return out


def folded(hashed: str, path: list[dict[str, str]]) -> str:
    for step in path:
        hashed = digest(step["before"] + hashed + step["after"])
    return hashed


PATH = "array<struct<before:string,after:string>>"
_PATH = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def _rising(fanout: int, span_levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for g, block, n, members in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                up = min(span_levels, height(n, fanout))
                out.append((g, block, -(-n // fanout**up), levels([m["hash"] for m in members], up, fanout)[-1][0]))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["g", "rank", "n", "hash"])

    return run


def _falling(fanout: int, span_levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for g, n, members, above, subroot in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                tree = levels([m["hash"] for m in members], min(span_levels, height(n, fanout)), fanout)
                for i, m in enumerate(members):
                    out.append((g, m["rank"], siblings(tree, i, fanout) + above, subroot))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, (pa.string(), pa.int64(), _PATH, pa.string()), strict=True)], ["g", "rank", "path", "subroot"])

    return run


def _proving(fanout: int, span_levels: int, root: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "leaf", "subroot", "root", "proof", "folded"]
        for batch in batches:
            for n, members, above, subroot in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                tree = levels([m["hash"] for m in members], min(span_levels, height(n, fanout)), fanout)
                paths = [siblings(tree, i, fanout) + above for i in range(len(members))]
                proofs = [digest("".join(s["before"] + s["after"] for s in p)) for p in paths]
                ends = [folded(m["claimed"], p) for m, p in zip(members, paths, strict=True)]
                columns = [pa.array([m["id"] for m in members], pa.int64()), *[pa.array(x, pa.string()) for x in ([m["hash"] for m in members], [subroot] * len(members), [root] * len(members), proofs, ends)]]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def blocks(nodes: DataFrame, span: int, *more: str) -> DataFrame:
    """One row for each span of neighbouring nodes: g, block, n (nodes of the level in g), members by rank."""
    members = F.array_sort(F.collect_list(F.struct("rank", "hash", *more))).alias("members")
    return nodes.groupBy("g", F.floor(F.col("rank") / span).alias("block")).agg(F.first("n").alias("n"), members).select("g", "block", "n", "members")


def climb(nodes: DataFrame, name: str, fanout: int, span: int) -> list[DataFrame]:
    """Node tables (g, rank, n, hash) of each round, ``nodes`` (stored) first; the last has one node a group."""
    up, rounds = height(span, fanout), [nodes]
    most = nodes.agg(F.max("n").alias("n")).first()["n"] or 0
    while most > 1:
        above = blocks(rounds[-1], span).mapInArrow(_rising(fanout, up), "g string, rank bigint, n bigint, hash string")
        rounds.append(stored(above, f"{name}-{len(rounds)}"))
        most = -(-most // span)
    return rounds


def descend(rounds: list[DataFrame], name: str, fanout: int, span: int, top: DataFrame) -> DataFrame:
    """g, rank, path, subroot of the nodes of rounds[0]; top: g and what lies above the last round's nodes (path, subroot)."""
    up = height(span, fanout)
    paths = rounds[-1].select("g", "rank").join(top, "g")
    for i in range(len(rounds) - 2, -1, -1):
        rows = blocks(rounds[i], span).join(paths.withColumnRenamed("rank", "block"), ["g", "block"]).select("g", "n", "members", "path", "subroot")
        paths = stored(rows.mapInArrow(_falling(fanout, up), f"g string, rank bigint, path {PATH}, subroot string"), f"{name}-paths-{i}")
    return paths


def span_of(fanout: int, most: int = SPAN) -> int:
    """The greatest power of fanout up to ``most``, at least fanout."""
    out = fanout
    while out * fanout <= most:
        out *= fanout
    return out


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str | None = "lang", claimed: Column | None = None, fanout: int = 2, most: int = MOST, digits: int = DIGITS) -> DataFrame:
    """A row for each row: id, leaf, subroot, root, proof (hash of its siblings, upwards), folded.

    ``claimed`` is what a row is said to hash to, its leaf by default; folded is
    what its proof makes of that, so that it equals root where the claim is right.
    """
    if fanout < 2:
        raise ValueError("fanout has to be 2 or more")
    small_batches(docs.sparkSession)
    span, cols = span_of(fanout), {c: docs[f"`{c}`"] for c in {*columns, id_col, *([group_col] if group_col else [])}}
    g = sorted_key(cols[group_col].cast("string"), "string") if group_col else F.lit("0")
    own = leaf([cols[c] for c in columns])
    rows = docs.select(g.alias("g"), cols[id_col].cast("long").alias("id"), own.alias("hash"), F.coalesce(claimed, own).alias("claimed") if claimed is not None else own.alias("claimed"), F.monotonically_increasing_id().alias("at"))
    rows = stored(rows, "manifest-leaves")
    key = F.concat(sorted_key(F.col("id"), "long"), F.col("hash"), F.lpad(F.hex("at"), 16, "0"))
    rows = stored(ranks(rows.withColumn("key", key), "manifest", digits, most).select("g", "id", "hash", "claimed", "rank", "n"), "manifest-ranks")

    # Groups are leaves of a tree of their own, whose only group is the empty name.
    rounds = climb(rows, "manifest-tree", fanout, span)
    subroots = rounds[-1].select(F.lit("").alias("g"), F.col("g").alias("key"), "hash")
    groups = stored(ranks(stored(subroots, "manifest-groups"), "manifest-groups", digits, most), "manifest-group-ranks")
    tops = climb(groups, "manifest-top", fanout, span)
    root = tops[-1].first()
    nothing = [F.array().cast(PATH).alias("path"), F.lit("").alias("subroot")]
    over = descend(tops, "manifest-top", fanout, span, tops[-1].select("g", *nothing))
    over = groups.select(F.col("key").alias("g"), "rank", F.col("hash").alias("subroot")).join(over.select("rank", "path"), "rank").select("g", "path", "subroot")

    # The blocks of leaves meet what lies above them.
    above = descend(rounds[1:] or rounds, "manifest-tree", fanout, span, over).withColumnRenamed("rank", "block")
    leaves = blocks(rows, span, "id", "claimed").join(above, ["g", "block"]).select("n", "members", "path", "subroot")
    return leaves.mapInArrow(_proving(fanout, height(span, fanout), root and root["hash"]), "id bigint, leaf string, subroot string, root string, proof string, folded string")
