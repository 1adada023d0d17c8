"""What several operators share: the shared folder, range buckets, components.

Conventions of the operators in this package
* A document is a row. ``key_of`` adds a hash of its text to its id, so rows
  that repeat both id and text are one document, and rows that repeat only the
  id are several.
* Operators read only the columns they name; other columns of the input, also
  ones named like their own intermediate columns, never reach their plans.
* A null text is an empty text. Null ids are allowed and sort first.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where
    the cluster names one, else the context's, else a new local one, which only
    a master on one machine may use."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="lexiweave-")
        sc.setCheckpointDir(at)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage in a
    way that survives lost executors. The caller's cluster clears the folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexiweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 32_000_000) -> None:
    """Hold Arrow batches small, for texts may be long: so many rows and bytes at most.

    Operators run lazily, after they have returned, so these two settings of the
    session stay as they are set here. They are only ever lowered.
    """
    scale = {"": 1, "b": 1, "k": 2**10, "m": 2**20, "g": 2**30}
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        number, unit = re.fullmatch(r"(-?[0-9]+)([bkmg]?)b?", spark.conf.get(f"spark.sql.execution.arrow.{key}").lower()).groups()
        if not 0 < int(number) * scale[unit] <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns k (id), t (text, null becomes empty), h (hash of t)."""
    return docs.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))


def with_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns row (all columns of docs, whatever their names), k, h: keys as ``keyed`` makes them."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    return docs.select(row, F.col(id_col).cast("long").alias("k"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))


def rows_of(keys: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, of what ``with_keys`` made of it."""
    return keys.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def range_splits(df: DataFrame, col: str, rows_per_bucket: int, most: int = 65536) -> list[int]:
    """Split points that cut the values of col into buckets of about so many rows; at most ``most``."""
    n = df.count()
    parts = max(1, min(most, n // rows_per_bucket + 1))
    if parts == 1:
        return []
    probs = [i / parts for i in range(1, parts)]
    got = df.agg(F.percentile_approx(col, probs, 10 * parts).alias("p")).first()["p"]
    return sorted({int(x) for x in got or []})


def range_bucket(col: Column, splits: list[int]) -> Column:
    """Number of splits below col, found in two steps of about sqrt(n) comparisons; null goes to -1."""
    if not splits:
        return F.when(col.isNull(), F.lit(-1)).otherwise(F.lit(0))
    g = max(1, int(len(splits) ** 0.5))
    groups = [splits[i : i + g] for i in range(0, len(splits), g)]
    lasts = F.array(*[F.lit(x[-1]) for x in groups[:-1]]) if len(groups) > 1 else F.array().cast("array<bigint>")
    table = F.array(*[F.array(*[F.lit(x) for x in y]) for y in groups])
    coarse = F.size(F.filter(lasts, lambda s: s < col))
    fine = F.size(F.filter(F.element_at(table, coarse + 1), lambda s: s < col))
    return F.when(col.isNull(), F.lit(-1)).otherwise(coarse * g + fine)


#: Links that one task may join by itself, about 16 MB; more are joined by all.
FEW_LINKS = 1_000_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over links (a, b): id and root of each end, once all are read."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                above[max(x, y)] = min(x, y)
    ids = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(x) for x in ids], pa.int64())], ["id", "root"])


def components(links: DataFrame, name: str = "components", most_rounds: int = 60, few: int = FEW_LINKS) -> DataFrame:
    """Connected components of links (a, b): rows (id, root), root the smallest id.

    ``few`` links at most (they are counted) are joined by one task. Beyond
    that: min-label exchange with pointer jumping, each round cut by a written
    table; the rounds grow with the logarithm of a component's diameter, and a
    hub of any degree is only ever the key of a combined (min) aggregation.
    """
    one = stored(links.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).where("a <> b").distinct(), f"{name}-links")
    if one.count() <= few:
        return stored(one.coalesce(1).mapInArrow(_joined, "id bigint, root bigint"), f"{name}-roots")
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("root")), f"{name}-0")
    for i in range(1, most_rounds + 1):
        near = both.join(roots.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        now = roots.join(near, "id", "left").select("id", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = roots.select(F.col("id").alias("root"), F.col("root").alias("up"))
        now = stored(now.join(jump, "root", "left").select("id", "was", F.least("root", "up").alias("root")), f"{name}-{i}")
        if now.where("root <> was").isEmpty():
            return now.select("id", "root")
        roots = now.select("id", "root")
    raise RuntimeError("components did not settle")

