"""Many terms in many texts: an Aho-Corasick automaton that every worker builds once.

The terms are what is small: they go to the workers as a broadcast whose bytes
are counted first. More than ``most_bytes`` of them are split by a hash into
shards of that size, each of which passes over the texts by itself. Texts never
meet terms by a join on words, so a word that a third of all texts have costs no
more than its hits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

MOST_BYTES = 32_000_000
#: The automaton that this worker process built last, by its shard's name.
_built: dict[str, object] = {}


def _automaton(name: str, patterns: list[str]):
    import ahocorasick

    if name not in _built:
        found = ahocorasick.Automaton()
        for n, pattern in enumerate(patterns):
            found.add_word(pattern, n)
        found.make_automaton()
        _built.clear()
        _built[name] = found
    return _built[name]


def _searching(shared, kind: pa.DataType, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, patterns, rows = shared.value
        found = _automaton(name, patterns) if rows else None
        for batch in batches:
            hits, at = [], []
            for i, text in enumerate(batch.column(width).to_pylist()):
                for n in sorted({n for _, n in found.iter(text)}) if found and text else ():
                    at += [i] * len(rows[n])
                    hits += rows[n]
            kept = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:width]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(hits, kind)], [*batch.schema.names[:width], "hit"])

    return run


def contained(units: DataFrame, terms: DataFrame, low: Callable[[Column], Column] = F.lower, text: str = "text", term: str = "term", most_bytes: int = MOST_BYTES) -> DataFrame:
    """The columns of units and of terms, for each term that a unit's text holds anywhere; both in lower case as ``low`` makes it.

    Empty and null terms stand nowhere. The names of units and terms have to differ.
    """
    spark = units.sparkSession
    rows = terms.select(low(F.col(term)).alias("_pattern"), F.struct(*terms.columns).alias("_row")).where("_pattern <> ''")
    seen = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("_pattern") + F.length(F.to_json("_row")) + 64).alias("size")).first()
    shards = max(1, min(seen["n"], -(-(seen["size"] or 0) // most_bytes)))
    kind = to_arrow_type(rows.schema["_row"].dataType)
    schema = T.StructType([*units.schema.fields]).add("hit", rows.schema["_row"].dataType)
    texts, out = units.select("*", low(F.col(text)).alias("_low")), None
    for shard in range(shards):
        part = rows if shards == 1 else rows.where(F.pmod(F.xxhash64("_pattern"), F.lit(shards)) == shard)
        by_pattern: dict[str, list] = {}
        for r in part.collect():  # a shard's bytes are bounded
            by_pattern.setdefault(r["_pattern"], []).append(r["_row"].asDict())
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, list(by_pattern), list(by_pattern.values())))
        got = texts.mapInArrow(_searching(shared, kind, len(units.columns)), schema)
        out = got if out is None else out.unionByName(got)
    return out.select(*units.columns, "hit.*")
