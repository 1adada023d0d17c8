"""Terminology: mining repeated terms, tracking, telemetry, drift and precedents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.functions import text as tx
from lexiweave.operators.matcher import contained

MOST_MINED, LEAST_UNITS, LEAST_LENGTH = 48, 2, 3
MOST_TRACKED, LEXICAL_RESERVE = 32, 8
MOST_SAMPLES, MOST_PRECEDENTS, MOST_HINTS, RADIUS = 8, 96, 8, 2
#: Mined terms come behind all tiers of the contract.
MINED_TIER = 10
METRIC_KINDS = ("fixed", "suggested", "risky", "lexical", "structural")


def tokens(units: DataFrame) -> DataFrame:
    """page_id, unit_id, pos, idx, role, token, kind of each token that may be a term."""
    words = F.regexp_extract_all("text", F.lit(f"({tx.TOKEN})"), F.lit(1))
    # The unit's shape rides in the exploded array, else it would be worked out anew for each token.
    shapes = F.array_repeat(tx.looks_like_heading(F.col("text"), F.col("role")), F.size(words))
    rows = units.select("page_id", "unit_id", "pos", "role", F.posexplode(F.arrays_zip(words.alias("token"), shapes.alias("shape"))).alias("idx", "z"))
    rows = rows.select("page_id", "unit_id", "pos", "role", "idx", "z.token", "z.shape")
    kind = F.when(tx.is_stop_word(F.lower("token")), None).when(tx.has_fixed_shape(F.col("token")), "fixed").when(tx.is_structural(F.col("token"), F.col("shape")), "structural").when(F.length("token") >= LEAST_LENGTH, "lexical")
    return rows.withColumn("kind", kind).where("kind IS NOT NULL").drop("shape")


def surfaces_text(column: str = "surfaces") -> Column:
    """Nested counts as text: most frequent first, then in byte order."""
    return F.array_join(F.transform(F.array_sort(F.transform(column, lambda x: F.struct((-x["n"]).alias("o"), x["surface"].alias("s")))), lambda x: F.concat_ws(":", x["s"], (-x["o"]).cast("string"))), "|")


def mine(units: DataFrame, least_units: int = LEAST_UNITS, most: int = MOST_MINED) -> DataFrame:
    """Terms that at least so many units of a page hold, the best ``most`` of each page.

    page_id, term (first surface), lemma, kind, trust, cnt, n_units, surfaces,
    rank. Counts are pre-aggregated by surface before the page's terms meet.
    """
    rows = tokens(units).withColumns({"key": tx.identity_of(F.col("token"), F.col("kind")), "kr": tx.rank_of(F.col("kind"))})
    # Numbers only in the first aggregation, so that it hashes; a term's few forms are summed once it is known to stay.
    at = F.col("pos").cast("long") * 2**31 + F.col("idx")
    each = rows.groupBy("page_id", "key", "unit_id", F.col("token").alias("surface")).agg(F.count("*").alias("n"), F.min(at).alias("at"), F.max("kr").alias("kr"))
    whole = each.groupBy("page_id", "key").agg(F.max("kr").alias("kr"), F.collect_list(F.struct("at", "surface", "n", "unit_id")).alias("forms"))
    whole = whole.withColumn("n_units", F.size(F.array_distinct(F.transform("forms", lambda x: x["unit_id"]))).cast("long")).where(F.col("n_units") >= least_units)
    total = lambda of: F.aggregate(of, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    names = F.array_distinct(F.transform("forms", lambda x: x["surface"]))
    summed = F.transform(names, lambda name: F.struct(name.alias("surface"), total(F.filter("forms", lambda x: x["surface"] == name)).alias("n")))
    out = whole.select("page_id", "key", F.array_min("forms")["surface"].alias("term"), total("forms").alias("cnt"), "n_units", "kr", summed.alias("surfaces"))
    kind = F.when(F.col("kr") == 4, "fixed").when(F.col("kr") == 2, "lexical").otherwise("structural")
    order = Window.partitionBy("page_id").orderBy(F.desc("kr"), F.desc("n_units"), F.desc("cnt"), F.desc(F.length("term")), F.collate("term", "UNICODE"), "term")
    out = out.withColumns({"kind": kind, "rank": F.row_number().over(order)}).where(F.col("rank") <= most)
    trust = F.when(F.col("kind") == "fixed", "AUTO").otherwise("OBSERVED")
    return out.select("page_id", "term", tx.lemma_of(F.col("term"), F.col("kind")).alias("lemma"), "kind", trust.alias("trust"), "cnt", "n_units", "surfaces", F.col("rank").cast("long").alias("rank"))


def candidate_pool(contract: DataFrame, mined: DataFrame) -> DataFrame:
    """The candidates in two layers: page_id, term, lemma, kind, ord.

    The contract's terms are every page's, so they stand once, with a null
    page_id; mined ones follow them on their page.
    """
    return pooled(contract.withColumn("page_id", F.lit(None).cast(mined.schema["page_id"].dataType)), mined)


def pooled(given: DataFrame, mined: DataFrame, *more: str) -> DataFrame:
    """Contract terms (with page_id) before mined ones, by rank. ord: tier, whether risky, place."""
    place = lambda tier, risky, at: F.struct(tier.cast("int").alias("tier"), risky.cast("int").alias("risky"), at.cast("long").alias("place")).alias("ord")
    ord_ = place(10 - tx.rank_of(F.col("kind")), F.col("kind") == "risky", F.col("pos"))
    given = given.select("page_id", "term", tx.lemma_of(F.col("term"), F.col("kind")).alias("lemma"), "kind", ord_, *more)
    return given.unionByName(mined.select("page_id", "term", "lemma", "kind", place(F.lit(MINED_TIER), F.lit(False), F.col("rank")), *more))


def observed_pool(contract: DataFrame, mined: DataFrame, most: int = MOST_TRACKED) -> DataFrame:
    """page_id, lemma, kind: a page's mined lemmas that are no contract terms, then the contract's terms in order, ``most`` in all.

    Only the contract's first ``most`` terms can have a seat, so no more than
    these meet the pages.
    """
    last = Window.partitionBy("page_id", "lemma").orderBy(F.desc("rank"))
    own = mined.withColumn("_n", F.row_number().over(last)).where("_n = 1").join(contract.select(F.col("term").alias("lemma")), "lemma", "left_anti")
    first = contract.orderBy("pos", "term").select("term", "kind").limit(most).collect()
    line = F.array(*[F.struct(F.lit(r["term"]).alias("lemma"), F.lit(r["kind"]).alias("kind")) for r in first]).cast("array<struct<lemma:string,kind:string>>")
    extra = mined.select("page_id").distinct().select("page_id", F.posexplode(line).alias("rank", "x")).select("page_id", "x.lemma", "x.kind", F.lit(1).alias("src"), F.col("rank").cast("long"))
    rows = own.select("page_id", "lemma", "kind", F.lit(0).alias("src"), F.col("rank").cast("long")).unionByName(extra)
    seat = F.row_number().over(Window.partitionBy("page_id").orderBy("src", "rank"))
    return rows.withColumn("_k", seat).where(F.col("_k") <= most).select("page_id", "lemma", "kind")


def one_of_each(hits: DataFrame) -> DataFrame:
    """Of candidates found in their pages one for each lemma, the first in the pool's order; lexical ones only where there is no other."""
    first = Window.partitionBy("page_id", F.lower("lemma"), F.col("kind") == "lexical").orderBy("ord")
    hits = hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    prior = F.max(F.when(F.col("kind") != "lexical", 1).otherwise(0)).over(Window.partitionBy("page_id", F.lower("lemma")))
    return hits.withColumn("_p", prior).where((F.col("kind") != "lexical") | (F.col("_p") == 0)).drop("_p")


def held(mined: DataFrame, units: DataFrame) -> DataFrame:
    """mined with stands: whether the term stands bounded in its page. It is looked up among the page's words, and searched
    for only where it is no single word; a page's terms meet its text once."""
    words = F.filter(F.split(F.col("body"), "[^A-Za-z0-9_]+"), lambda x: x != "")
    texts = units.groupBy("page_id").agg(F.concat_ws("\n", F.collect_list("text")).alias("body"))
    texts = texts.withColumn("exact", F.array_distinct(words)).withColumn("low", F.array_distinct(F.transform("exact", ascii_lower)))
    names = [c for c in mined.columns if c != "page_id"]

    def stands(x):
        fixed = x["kind"] == "fixed"
        looked = F.when(fixed, F.array_contains("exact", x["term"])).otherwise(F.array_contains("low", ascii_lower(x["term"])))
        return F.when(x["term"].rlike(r"^[A-Za-z0-9_]+\z"), looked).otherwise(tx.find_term(F.col("body"), x["term"], fixed).isNotNull())

    lists = mined.groupBy("page_id").agg(F.collect_list(F.struct(*names)).alias("m")).join(texts, "page_id")
    rows = lists.select("page_id", F.explode(F.transform("m", lambda x: F.struct(x.alias("x"), stands(x).alias("stands")))).alias("m"))
    return rows.select("page_id", *[F.col(f"m.x.{c}") for c in names], F.col("m.stands").alias("stands"))


def matched(contract: DataFrame, mined: DataFrame, units: DataFrame) -> DataFrame:
    """Candidates that occur in their page's units, one for each lemma, on pages that have mined terms: page_id, term, lemma, kind, ord.

    The contract's terms are found by one automaton, not tried on every page.
    """
    given = term_hits(units.select("page_id", "text"), contract, "pos").select("page_id", "term", "kind", "pos").distinct().withColumn("stands", F.lit(True))
    rows = pooled(given, held(mined, units), "stands")
    own = F.max(F.col("ord.tier") == MINED_TIER).over(Window.partitionBy("page_id"))
    return one_of_each(rows.withColumn("own", own).where(F.col("own") & F.col("stands")).drop("own", "stands"))


def tracked(hits: DataFrame, most: int = MOST_TRACKED, reserve: int = LEXICAL_RESERVE) -> DataFrame:
    """A page's observation budget: seats kept for lexical terms, free seats go to the other layer."""
    lexical = F.col("kind") == "lexical"
    layer = Window.partitionBy("page_id", lexical)
    rows = hits.withColumn("_r", F.row_number().over(layer.orderBy("ord")))
    page = Window.partitionBy("page_id")
    rows = rows.withColumns({"_l": F.count_if(lexical).over(page), "_p": F.count_if(~lexical).over(page)})
    kept = F.least(F.lit(reserve), F.col("_l"), F.lit(most))
    p_seats = F.least(F.col("_p"), F.greatest(most - kept, most - F.col("_l")))
    seats = F.when(lexical, F.greatest(kept, most - F.col("_p"))).otherwise(p_seats)
    return rows.where(F.col("_r") <= seats).drop("_r", "_l", "_p")


def ascii_lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def term_hits(units: DataFrame, contract: DataFrame, *more: str) -> DataFrame:
    """Units with each term that stands bounded in them: the unit's columns, term, kind, surface, and the contract's columns named."""
    rows = contained(units, contract.select("term", "kind", *more), ascii_lower)
    return rows.withColumn("surface", tx.find_term(F.col("text"), F.col("term"), F.col("kind") == "fixed")).where("surface IS NOT NULL")


def coverage(contract: DataFrame, units: DataFrame) -> DataFrame:
    """Of the contract's kinds: terms in all, terms found in some unit, and the others."""
    plain = contract.select("term", F.lit("any").alias("kind"))
    hits = term_hits(units.select("text"), plain).select("term").distinct().withColumn("hit", F.lit(True))
    both = contract.join(hits, "term", "left")
    return both.groupBy("kind").agg(F.count("*").alias("total"), F.count_if("hit").alias("matched"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), F.col("term")))), ",").alias("unmatched"))


def drift(units: DataFrame, contract: DataFrame) -> DataFrame:
    """The first term of each finished unit whose locked rendering its translation lacks."""
    c = contract.where((F.length("term") >= 4) & (F.coalesce("target", F.lit("")) != "") & (F.lower("term") != F.lower("target"))).select("term", "target", F.col("pos").alias("at"))
    rows = contained(units.where("state = 'done'").select("unit_id", "text", "t"), c).where(~F.contains("t", "target"))
    return rows.groupBy("unit_id").agg(F.min_by(F.struct("term", "target", F.substring("text", 1, 80).alias("excerpt")), F.struct("at", "term")).alias("m")).select("unit_id", "m.term", "m.target", "m.excerpt")


def observed(hits: DataFrame) -> DataFrame:
    """Hits with rendered (normalised) where the alignment is valid. hits: term, kind, t, raw (rendering or null)."""
    valid = F.col("raw").isNotNull() & (tx.trim(F.col("raw")) != "") & F.contains("t", "raw")
    metric = F.when(F.col("kind").isin("locked", "fixed"), "fixed").when(F.col("kind").isin("structural", "suggested", "risky"), F.col("kind")).otherwise("lexical")
    return hits.withColumns({"metric": metric, "rendered": F.when(valid, tx.trim(F.regexp_replace("raw", f"{tx.SPACE}+", " ")))})


def forms(seen: DataFrame) -> DataFrame:
    """term, kind, metric, rendered, raw, n: what all of telemetry is added up from."""
    return seen.groupBy("term", "kind", "metric", "rendered", "raw").agg(F.count("*").alias("n"))


def telemetry(seen: DataFrame) -> DataFrame:
    """Each term's expected and aligned occurrences, variants, taxonomy and consistency; of terms aligned at all."""
    return term_rows(forms(seen))


def term_rows(counted: DataFrame) -> DataFrame:
    some = F.col("rendered").isNotNull()
    variants = counted.groupBy("term", "kind", "rendered").agg(F.sum("n").alias("n"), F.count("raw").alias("raws"))
    out = variants.groupBy("term", "kind").agg(
        F.sum("n").alias("expected"), F.sum(F.when(some, F.col("n")).otherwise(0)).alias("aligned"), F.count("rendered").alias("variant_count"),
        F.collect_list(F.when(some, F.struct(F.col("rendered").alias("surface"), "n"))).alias("variants"), F.sum(F.when(some, F.col("raws"))).alias("raw_count"),
    ).where("variant_count > 0")
    return out.withColumns({"taxonomy": taxonomy(F.col("kind"), F.col("variant_count")), "consistency": consistency(F.col("kind"), F.col("variant_count"))})


def taxonomy(kind: Column, variants: Column) -> Column:
    return F.when(kind == "structural", "STRUCTURAL").when(kind.isin("locked", "fixed"), "FIXED").when(variants <= 1, "STABLE").otherwise("UNKNOWN")


def consistency(kind: Column, variants: Column) -> Column:
    return F.when(kind == "structural", "EXCLUDED").when(kind.isin("locked", "fixed") & (variants > 1), "DRIFT").when(variants > 1, "UNRESOLVED").otherwise("CONSISTENT")


def summary(seen: DataFrame) -> DataFrame:
    """One row: expected, aligned and rates, over all and without structural terms; terms by taxonomy."""
    rate = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    total = lambda of, name: F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0)).alias(name)
    semantic, some = F.col("metric") != "structural", F.col("rendered").isNotNull()
    counted = forms(seen)
    one = counted.agg(total(F.lit(True), "expected"), total(some, "aligned"), total(semantic, "semantic_expected"), total(semantic & some, "semantic_aligned"))
    one = one.withColumns({"rate": rate(F.col("aligned"), F.col("expected")), "semantic_rate": rate(F.col("semantic_aligned"), F.col("semantic_expected"))})
    terms = term_rows(counted).agg(F.count("*").alias("terms"), F.count_if(F.col("taxonomy") == "FIXED").alias("fixed"), F.count_if(F.col("consistency") == "DRIFT").alias("drift"), F.count_if(F.col("taxonomy") == "STABLE").alias("stable"), F.count_if(F.col("taxonomy") == "UNKNOWN").alias("unknown"))
    return one.join(terms, F.lit(True))


def by_metric(seen: DataFrame) -> DataFrame:
    out = seen.groupBy("metric").agg(F.count("*").alias("expected"), F.count("rendered").alias("aligned"))
    return out.withColumn("rate", F.col("aligned") / F.col("expected"))


def samples(seen: DataFrame, most: int = MOST_SAMPLES) -> DataFrame:
    """The first aligned units of each term, with the text around the term."""
    order = Window.partitionBy("term", "kind").orderBy("page_id", "pos")
    rows = seen.where("rendered IS NOT NULL").withColumn("sample", F.row_number().over(order)).where(F.col("sample") <= most)
    return rows.select("term", "kind", F.col("sample").cast("long").alias("sample"), "unit_id", "surface", "rendered", tx.context_around(F.col("text"), F.col("surface")).alias("context"))


def with_trigger(hits: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Adds trigger: up to radius words on each side of the term's first occurrence, lower-cased."""
    word = f"({tx.TOKEN})"
    at = F.regexp_instr(F.lower("text"), F.concat(F.lit(r"(?<![a-z0-9_])"), F.regexp_replace(F.lower("term"), r"([.*+?^${}()|\[\]\\])", r"\\$1"), F.lit(r"(?![a-z0-9_])")))
    before = F.regexp_extract_all(F.substring("text", F.lit(1), at - 1), F.lit(word), F.lit(1))
    after = F.regexp_extract_all(F.substring("text", at + F.length("term"), F.length("text")), F.lit(word), F.lit(1))
    inside = F.regexp_extract_all("term", F.lit(word), F.lit(1))
    take = lambda a, n: F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n)
    return hits.withColumn("trigger", F.when(at > 0, F.lower(F.array_join(F.concat(take(before, radius), inside, F.slice(after, 1, radius)), " "))))


def precedents(seen: DataFrame) -> DataFrame:
    """Renderings by (page, lemma, trigger): targets, usable if there is one only, preferred raw form, last seen."""
    ok = seen.where(F.col("rendered").isNotNull() & (F.coalesce("trigger", F.lit("")) != "") & ~F.col("kind").isin("locked", "fixed", "structural"))
    raws = ok.groupBy("page_id", F.lower("term").alias("lemma"), "trigger", "rendered", "raw").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    targets = raws.groupBy("page_id", "lemma", "trigger", "rendered").agg(F.min(F.struct((-F.col("n")).alias("o"), "raw")).alias("m"), F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"))
    out = targets.groupBy("page_id", "lemma", "trigger").agg(F.count("*").alias("targets"), F.sum("n").alias("observations"), F.min(F.struct("rendered", "m.raw")).alias("one"), F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"))
    usable = F.col("targets") == 1
    return out.select("page_id", "lemma", "trigger", "targets", "observations", usable.alias("usable"), F.when(usable, F.col("one.raw")).alias("preferred"), F.when(usable, F.col("one.rendered")).alias("target"), "first_pos", "last_pos")


def latest_precedents(rows: DataFrame, most: int = MOST_PRECEDENTS) -> DataFrame:
    w = Window.partitionBy("page_id").orderBy(F.desc("last_pos"), "lemma", "trigger")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
