"""Document fingerprints: SpotSigs (operator 2).

A spot is a common word (anchor) followed by a content word; its signature is
the anchor and the chain of the next ``CHAIN`` content words, anchors between
them skipped. Of neighbouring anchors the last counts. A document's fingerprint
is the sorted set of its signatures, eight hex digits each. Likeness is the
Jaccard similarity of two such sets.

``near_duplicates`` compares a whole corpus: documents are dealt into
partitions by set length so that only neighbouring partitions can reach the
threshold, an inverted index holds the rarest signatures that a partner must
share (prefix of the set), and pairs that the length bound allows are verified.

Defined results
* null text: empty text; a text without any spot has one signature, of its
  whole normalised text, so equal texts have equal fingerprints, always
* likeness of two documents is 0 to 1; of equal texts 1
* rows repeating an id: ties in the order are broken by the hash of the text
* a table of one row: its next document is itself; empty table: empty result
* a class of rows without ids has no id in ``near_duplicates``'s pairs, but is in them
* other columns are never read
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.llm.common import keyed, range_bucket, range_splits

CHAIN = 2
THRESHOLD = 0.75
# Common words of four languages, the anchors.
ANCHORS = (
    "the a an and of to in is it that was for on with as by at this be are from or "
    "le la les de des du un une et en est que pour dans sur au aux par pas elle "
    "der die das und ist von zu mit den ein eine nicht auf für sich als auch im "
    "el los las del y por con para se su al lo es"
).split()


def signatures(text: Column) -> Column:
    """The sorted set of signatures of a text, as an array of strings."""
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    marked = F.regexp_replace(plain, f" ({'|'.join(ANCHORS)})(?= )", "#$1")
    marked = F.regexp_replace(marked, r"#[^# ]+(?=#)", "")
    spots = F.regexp_extract_all(marked, F.lit(r"#(?=([^# ]+ [^# ]+" + r"(?:#[^# ]+)? [^# ]+" * (CHAIN - 1) + "))"), F.lit(1))
    spots = F.when(F.size(spots) > 0, spots).otherwise(F.array(plain))
    return F.array_sort(F.array_distinct(F.transform(spots, lambda x: F.substring(F.md5(F.regexp_replace(x, r"#[^# ]+", "").cast("binary")), 1, 8))))


def fingerprint(signs: Column) -> Column:
    return F.array_join(signs, "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard; the sets' lengths alone settle it when either is wholly apart."""
    both = F.size(F.array_intersect(a, b))
    return both.cast("double") / (F.size(a) + F.size(b) - both)


def length_partition(size: Column, threshold: float = THRESHOLD) -> Column:
    """Sets whose partitions differ by more than one can't reach the threshold."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / -F.log(F.lit(threshold))).cast("int")


def with_next(docs: DataFrame, rows_per_bucket: int = 1000) -> DataFrame:
    """k, h, t and, from the next document by descending id, u (text).

    Documents are dealt into buckets by ranges of the id; each bucket also gets
    the first document of the bucket that follows, so no row needs another
    task. The texts are shuffled once.
    """
    splits = range_splits(docs.select("k"), "k", rows_per_bucket)
    dealt = docs.withColumn("bucket", range_bucket(F.col("k"), splits))
    heads = dealt.groupBy("bucket").agg(F.max(F.struct("k", "h")).alias("head"))
    # As many rows as there are buckets, 65536 at most.
    down = Window.orderBy(F.desc("bucket"))
    heads = heads.select(F.coalesce(F.lag("bucket").over(down), F.min("bucket").over(Window.orderBy(F.lit(1)))).alias("to"), F.col("head.k").alias("hk"), F.col("head.h").alias("hh"))
    guests = docs.join(F.broadcast(heads), docs["k"].eqNullSafe(heads["hk"]) & (docs["h"] == heads["hh"])).select("k", "h", "t", F.col("to").alias("bucket"), F.lit(1).alias("guest"))
    rows = dealt.withColumn("guest", F.lit(0)).unionByName(guests)
    order = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("k"), F.desc("h"))
    return rows.withColumn("u", F.lead("t").over(order)), order


def edited(text: Column, other: Column) -> Column:
    """text, its last floor(n/2) code points replaced by other's first as many (or all)."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.left(text, n - half), F.when(half > 0, F.left(other, half)).otherwise(F.lit("")))


def chain_of_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document, its edited text and both sets of signatures, and the next document's: k, t, edited, signs, edited_signs, next_signs."""
    rows, order = with_next(keyed(docs, id_col, text_col))
    rows = rows.withColumn("signs", signatures(F.col("t"))).withColumn("next_signs", F.lead("signs").over(order)).where("guest = 0")
    rows = rows.withColumn("edited", edited(F.col("t"), F.col("u")))
    return rows.select("k", "t", "edited", "signs", "next_signs").withColumn("edited_signs", signatures(F.col("edited")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b, likeness) of class representatives with likeness >= threshold, for sets of signatures.

    Equal fingerprints are one class, represented by its smallest id; see
    ``classes`` for the membership. The order by rarity uses counts over all
    classes. Each pair is verified exactly.
    """
    sets = classes(docs, id_col, text_col).groupBy(F.md5(F.col("fp").cast("binary")).alias("c")).agg(F.min("doc_id").alias("id"), F.first("signs").alias("signs"))
    sets = sets.select("c", "id", "signs", F.size("signs").alias("n"))
    sign = sets.select("c", "n", F.explode("signs").alias("s"))
    rare = sign.groupBy("s").agg(F.count("*").alias("df"))
    ranked = sign.join(rare, "s").withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy("df", "s")))
    must = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    index = ranked.where((F.col("r") <= must) & (F.col("df") > 1)).select("c", "n", "s", length_partition(F.col("n"), threshold).alias("part"))
    left = index.select(F.col("c").alias("ca"), F.col("n").alias("na"), "s", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    right = index.select(F.col("c").alias("cb"), F.col("n").alias("nb"), "s", "part")
    pairs = left.join(right, ["s", "part"]).where((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("ca") < F.col("cb")))).where(F.col("na") >= F.col("nb") * threshold).select("ca", "cb").distinct()
    pairs = pairs.join(sets.select(F.col("c").alias("ca"), F.col("id").alias("a"), F.col("signs").alias("sa")), "ca").join(sets.select(F.col("c").alias("cb"), F.col("id").alias("b"), F.col("signs").alias("sb")), "cb")
    # Least and greatest skip nulls: a pair with an id missing has it as a.
    some = F.col("a").isNotNull() & F.col("b").isNotNull()
    return pairs.select(F.when(some, F.least("a", "b")).alias("a"), F.greatest("a", "b").alias("b"), likeness(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= threshold)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (fingerprint), signs of each document."""
    rows = keyed(docs, id_col, text_col).withColumn("signs", signatures(F.col("t")))
    return rows.select(F.col("k").alias("doc_id"), fingerprint(F.col("signs")).alias("fp"), "signs")
