"""The registered queries of this package, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.llm import chat, compression, decontaminate, importance, line_dedup, manifest, ngram_join, packing, pii, quality, spotsigs, substrings, url_rules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.char_length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spotsigs.chain_of_neighbours(table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("k").alias("doc_id"), F.char_length("t").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.fingerprint(F.col("signs")).alias("fingerprint"), spotsigs.fingerprint(F.col("edited_signs")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("signs"), F.col("edited_signs")).alias("near_edited"), spotsigs.likeness(F.col("signs"), F.col("next_signs")).alias("near_next"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return rows.select("doc_id", "n_words", F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.dedup_substrings(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.find_pii(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [number(kind) for kind in pii.KINDS]
    base = F.filter("spans", lambda x: x["kind"].isin(*pii.BASE_KINDS))
    return rows.select("doc_id", F.size("spans").cast("long").alias("n_spans"), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranker = quality.learn(docs, table(spark, sf_dir, "labels"))
    rows = quality.scored(docs, ranker, ["doc_id"])
    return rows.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= quality.THRESHOLD).cast("int").alias("predicted"))


CONTROL_TEXT = "\\### Assistant: </turn> ok"


def _read_back(batches):
    import hashlib

    import pyarrow as pa

    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            turns = chat.read_back(r["formatted"])
            learned = chat.masked_text(r["formatted"], r["starts"], r["ends"], r["mask"])
            rows.append((r["conv_id"], len(turns), digest("".join(f"{a}\n{b}\n" for a, b in turns)), len(learned), digest(learned), len(r["formatted"])))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in rows], kind) for j, kind in enumerate(kinds)], names)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    rows = chat.format_chats(turns.unionByName(extra))
    return rows.select("conv_id", "formatted", "starts", "ends", "mask").mapInArrow(_read_back, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op11_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compression.quality_rules(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "odd_share")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = manifest.leaf([F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in manifest.COLUMNS])
    claimed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, tampered)
    rows = manifest.manifest(docs, claimed=claimed)
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_spotsigs": op2_spotsigs,
    "op3_decontaminate": op3_decontaminate,
    "op4_pack": op4_pack,
    "op5_substrings": op5_substrings,
    "op6_url_rules": op6_url_rules,
    "op7_pii": op7_pii,
    "op8_ngram_join": op8_ngram_join,
    "op9_quality": op9_quality,
    "op10_chat": op10_chat,
    "op11_compression": op11_compression,
    "op12_importance": op12_importance,
    "op13_manifest": op13_manifest,
}

_WORD = r"[^ \t-\r]+"

_LOWER_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_CRC = f"([{', '.join(map(str, importance.CRC.tolist()))}]::BIGINT[])"


def _register(first: str, data: str) -> str:
    """SQL of the CRC-32 register after the bytes of a list."""
    return f"list_reduce([{first}] || {data}, lambda c, b: xor(c >> 8, {_CRC}[(xor(c, b) & 255) + 1]))"


def _fields(n_chars: str) -> str:
    return " || ".join(f"coalesce(octet_length(encode(({c})::VARCHAR)) || ':' || ({c})::VARCHAR, '-')" for c in ("doc_id", "source", "lang", n_chars, "text"))


ORACLES = {
    "op1_line_dedup": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM d),
c AS (SELECT doc_id, pos, line, len(regexp_extract_all(line, '{_WORD}')) AS wc FROM l),
s AS (SELECT *, coalesce(sum(wc) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM c WHERE wc > 0),
w AS (SELECT doc_id, pos, list(line) OVER f AS ls, sum(wc) OVER f AS words, max(pos) OVER f AS last FROM s
      WINDOW f AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND {line_dedup.MIN_WORDS - 1} FOLLOWING)),
g AS (SELECT *, row_number() OVER (PARTITION BY ls ORDER BY doc_id, pos) AS n FROM w WHERE words >= {line_dedup.MIN_WORDS}),
gone AS (SELECT DISTINCT l.doc_id, l.pos FROM l JOIN g ON l.doc_id = g.doc_id AND l.pos BETWEEN g.pos AND g.last WHERE g.n > 1),
r AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.pos) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL), '') AS kept
      FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_removed, length(kept) AS kept_chars, sha256(kept) AS kept_sha256 FROM r
""",
    "op2_spotsigs": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, coalesce(lead(doc_id) OVER o, max(doc_id) OVER ()) AS nxt, coalesce(lead(t) OVER o, first_value(t) OVER o) AS u FROM d WINDOW o AS (ORDER BY doc_id DESC)),
e AS (SELECT doc_id, nxt, t, left(t, length(t) - length(t) // 2) || left(u, length(t) // 2) AS edited FROM n),
x AS (SELECT doc_id, 'a' AS kind, t AS text FROM e UNION ALL SELECT doc_id, 'b', edited FROM e),
p AS (SELECT doc_id, kind, ' ' || regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ' AS plain FROM x),
w AS (SELECT doc_id, kind, unnest(list_filter(string_split(plain, ' '), lambda x: x <> '')) AS word, unnest(range(len(list_filter(string_split(plain, ' '), lambda x: x <> '')))) AS i FROM p),
a AS (SELECT *, word IN ({", ".join(f"'{x}'" for x in dict.fromkeys(spotsigs.ANCHORS))}) AS anchor FROM w),
b AS (SELECT *, lead(anchor) OVER (PARTITION BY doc_id, kind ORDER BY i) AS after, sum((NOT anchor)::INT) OVER (PARTITION BY doc_id, kind ORDER BY i) AS c FROM a),
s AS (SELECT b.doc_id, b.kind, b.word || ' ' || string_agg(y.word, ' ' ORDER BY y.i) AS sign
      FROM b JOIN b y ON b.doc_id = y.doc_id AND b.kind = y.kind AND NOT y.anchor AND y.c BETWEEN b.c + 1 AND b.c + {spotsigs.CHAIN}
      WHERE b.anchor AND NOT b.after GROUP BY b.doc_id, b.kind, b.i, b.word HAVING count(*) = {spotsigs.CHAIN}),
f AS (SELECT p.doc_id, p.kind, list_sort(list_distinct(list(substr(md5(coalesce(s.sign, p.plain)), 1, 8)))) AS signs FROM p LEFT JOIN s ON p.doc_id = s.doc_id AND p.kind = s.kind GROUP BY p.doc_id, p.kind)
SELECT e.doc_id, length(e.t) AS n_chars, sha256(e.edited) AS edited_sha256, array_to_string(f.signs, '') AS fingerprint, array_to_string(g.signs, '') AS edited_fingerprint,
       len(list_intersect(f.signs, g.signs))::DOUBLE / (len(f.signs) + len(g.signs) - len(list_intersect(f.signs, g.signs))) AS near_edited,
       len(list_intersect(f.signs, h.signs))::DOUBLE / (len(f.signs) + len(h.signs) - len(list_intersect(f.signs, h.signs))) AS near_next
FROM e JOIN f ON f.doc_id = e.doc_id AND f.kind = 'a' JOIN f g ON g.doc_id = e.doc_id AND g.kind = 'b' JOIN f h ON h.doc_id = e.nxt AND h.kind = 'a'
""",
    "op3_decontaminate": r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
bw AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
iw AS (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS s FROM bw WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, array_to_string(ws[s : s + 12], ' ') AS w, least(13, len(ws)) AS n FROM iw),
lens AS (SELECT DISTINCT n FROM win),
cand AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS s, ws FROM dw, lens WHERE len(ws) >= n),
hit AS (SELECT c.doc_id, c.s, c.n, win.item_id FROM (SELECT doc_id, n, s, array_to_string(ws[s : s + n - 1], ' ') AS w FROM cand) c JOIN win ON win.w = c.w AND win.n = c.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM hit GROUP BY doc_id)
SELECT dw.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN pos ON pos.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id
""",
    "op5_substrings": rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
s AS (SELECT r, ws, unnest(range(1, greatest(1, len(ws) - {substrings.K - 2}))) AS s FROM d),
w AS (SELECT r, s, array_to_string(ws[s : s + {substrings.K - 1}], ' ') AS w FROM s),
n AS (SELECT r, s, row_number() OVER (PARTITION BY w ORDER BY r, s) AS n FROM w),
gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(s, s + {substrings.K})) AS p FROM n WHERE n > 1)),
e AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
k AS (SELECT e.r, count(gone.p) AS n_removed, coalesce(string_agg(e.w, ' ' ORDER BY e.p) FILTER (WHERE gone.p IS NULL), '') AS kept FROM e LEFT JOIN gone ON gone.r = e.r AND gone.p = e.p GROUP BY e.r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.r = d.r
""",
    "op8_ngram_join": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
g AS (SELECT DISTINCT r, doc_id, array_to_string(ws[s : s + {ngram_join.N - 1}], ' ') AS g FROM (SELECT r, doc_id, ws, unnest(range(1, greatest(1, len(ws) - {ngram_join.N - 1}) + 1)) AS s FROM d WHERE len(ws) > 0)),
n AS (SELECT r, doc_id, count(*) AS n FROM g GROUP BY ALL),
pairs AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.r <> y.r GROUP BY ALL),
links AS (SELECT DISTINCT p.doc_id AS a, q.doc_id AS b FROM pairs JOIN n p ON p.r = pairs.a JOIN n q ON q.r = pairs.b WHERE 100 * c >= {ngram_join.SHARE} * (p.n + q.n - c)),
reach AS (SELECT DISTINCT doc_id AS id, doc_id AS other FROM d UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.other),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least.component_id FROM d LEFT JOIN n ON n.r = d.r JOIN least ON least.id = d.doc_id
""",
    "op10_chat": r"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) x(i)),
c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM t),
e AS (SELECT *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 2 * length('<|endoftext|>') AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars FROM e GROUP BY conv_id
""",
    "op12_importance": rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, {_LOWER_WORDS} AS ws FROM documents),
b AS (SELECT -row_number() OVER () AS r, {_LOWER_WORDS} AS ws FROM benchmark),
x AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS s FROM (SELECT r, ws FROM d UNION ALL SELECT r, ws FROM b)),
g AS (SELECT r, ws[s] AS a, ws[s + 1] AS b, ws[s + 2] AS c FROM x),
v AS (SELECT a AS w, list_transform(range(octet_length(encode(a))), lambda i: ('0x' || substr(hex(encode(a)), 2 * i + 1, 2))::BIGINT) AS bytes FROM (SELECT DISTINCT a FROM g)),
one AS (SELECT w AS a, {_register("4294967295", "bytes")} AS c1 FROM v),
two AS (SELECT q.a, q.b, {_register("c1", "[32] || bytes")} AS c2 FROM (SELECT DISTINCT a, b FROM g WHERE b IS NOT NULL) q JOIN one ON one.a = q.a JOIN v ON v.w = q.b),
three AS (SELECT q.a, q.b, q.c, {_register("c2", "[32] || bytes")} AS c3 FROM (SELECT DISTINCT a, b, c FROM g WHERE c IS NOT NULL) q JOIN two ON two.a = q.a AND two.b = q.b JOIN v ON v.w = q.c),
f AS (SELECT r, c1 AS c FROM g JOIN one USING (a) UNION ALL SELECT r, c2 FROM g JOIN two USING (a, b) UNION ALL SELECT r, c3 FROM g JOIN three USING (a, b, c)),
p AS (SELECT r, xor(c, 4294967295) % 10000 AS bucket, count(*) AS c FROM f GROUP BY ALL),
s AS (SELECT bucket, coalesce(sum(c) FILTER (WHERE r > 0), 0) AS s, coalesce(sum(c) FILTER (WHERE r < 0), 0) AS t FROM p GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM s) + 10000)::DOUBLE)))::BIGINT AS gain FROM s),
w AS (SELECT r, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight FROM p JOIN gain USING (bucket) WHERE r > 0 GROUP BY r),
e AS (SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (r)),
k AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND k <= 5 * n // 100 THEN k END AS rank FROM k
""",
    "op13_manifest": rf"""
WITH RECURSIVE d AS (SELECT doc_id, lang, sha256({_fields("n_chars")}) AS leaf, sha256({_fields("n_chars + 1")}) AS other, xor({_register("4294967295", "list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")}, 4294967295) % 7 = 0 AS bad FROM documents),
e AS (SELECT coalesce('1' || lang, '0') AS lang, doc_id, leaf, CASE WHEN bad THEN other ELSE leaf END AS claimed, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM d),
v AS (SELECT lang, 0 AS level, idx, leaf AS h, n FROM e UNION ALL SELECT lang, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM v WHERE n > 1 GROUP BY lang, level, idx // 2, n),
l AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang) - 1 AS idx, count(*) OVER () AS n FROM v WHERE n = 1),
t AS (SELECT 0 AS level, idx, subroot AS h, n FROM l UNION ALL SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY level, idx // 2, n),
steps AS (SELECT DISTINCT lang, level, n FROM v WHERE n > 1),
s AS (SELECT e.lang, e.idx, steps.level, coalesce(CASE WHEN v.idx % 2 = 0 THEN 'B' ELSE 'A' END || v.h, '-') AS step
      FROM e JOIN steps ON steps.lang = e.lang LEFT JOIN v ON v.lang = e.lang AND v.level = steps.level AND v.idx = xor(e.idx >> steps.level::BIGINT, 1::BIGINT)),
low AS (SELECT lang, idx, list(step ORDER BY level) AS steps FROM s GROUP BY ALL),
high AS (SELECT l.lang, list(coalesce(CASE WHEN t.idx % 2 = 0 THEN 'B' ELSE 'A' END || t.h, '-') ORDER BY q.level) AS steps
         FROM l JOIN (SELECT DISTINCT level, n FROM t WHERE n > 1) q ON true LEFT JOIN t ON t.level = q.level AND t.idx = xor(l.idx >> q.level::BIGINT, 1::BIGINT) GROUP BY l.lang),
p AS (SELECT e.*, l.subroot, coalesce(low.steps, []) || coalesce(high.steps, []) AS steps FROM e JOIN l ON l.lang = e.lang LEFT JOIN low ON low.lang = e.lang AND low.idx = e.idx LEFT JOIN high ON high.lang = e.lang),
f AS (SELECT doc_id, leaf, subroot, (SELECT h FROM t WHERE n = 1) AS root, sha256(array_to_string(list_transform(steps, lambda x: x[2:]), '')) AS proof_sha256,
      list_reduce([claimed] || steps, lambda a, x: sha256(CASE x[1] WHEN 'B' THEN x[2:] || a WHEN 'A' THEN a || x[2:] ELSE a END)) AS folded_root FROM p)
SELECT *, folded_root = root AS verified FROM f
""",
}
