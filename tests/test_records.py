"""Settings records, selectors, the Markdown export and control streams, on small inputs worked out by hand."""

import pytest
from pyspark.sql import functions as F

from lexiweave.operators import rules as ru
from lexiweave.operators import settings as st
from lexiweave.sources import export as ex
from lexiweave.sources import html as ht
from lexiweave.sources import pages as pg
from lexiweave.streaming import flows as fl

RECORD = f"id long, version int, m map<string,string>, accounts map<string,{st.ACCOUNT}>"


def migrated(spark, *rows):
    return {r.id: r for r in st.migrated(spark.createDataFrame(list(rows), RECORD)).collect()}


def test_steps_apply_once_and_in_order(spark):
    base, old = f"https://{st.OFFICIAL_HOST}/v1", st.RETIRED_MODELS[0]
    flat = {"providerId": "gemini", "apiBase": base, "apiKey": "k", "model": old, "skipSingleToken": "false", "wholePageTranslation": "false"}
    got = migrated(spark, (1, None, flat, None), (2, 13, flat, {}), (3, 3, {}, {"gemini": (base, "k", old), "other": (base, "k", old)}), (4, None, None, None), (5, 0, {"providerId": "x", "model": ""}, {}))
    first = got[1]
    assert first.version == 13 and first.m["model"] == st.SUCCESSOR and first.m["smartFilter"] == "false" and "skipSingleToken" not in first.m
    assert first.m["wholePageTranslation"] == "true" and first.m["semanticPrecedent"] == "false" and first.m["translationColor"] == "custom"
    assert first.accounts["gemini"].model == st.SUCCESSOR and first.accounts["gemini"].apiKey == "k"
    assert got[2].m == flat and got[2].accounts == {}  # nothing is due
    assert got[3].accounts["gemini"].model == st.SUCCESSOR and got[3].accounts["other"].model == old and "smartFilter" not in got[3].m
    assert got[4].m["autoPreflight"] == "true" and got[4].accounts == {} and got[5].accounts == {}
    again = migrated(spark, (1, first.version, first.m, first.accounts))[1]
    assert again.m == first.m and again.accounts == first.accounts


def test_own_colors_stay(spark):
    got = migrated(spark, (1, 8, {"textColorLight": "#123456"}, {}), (2, 8, {"translationColor": "custom"}, {}), (3, 8, {"accentColorDark": "#8A80FF"}, {}))
    assert got[1].m["textColorLight"] == "#123456" and "translationColor" not in got[1].m
    assert got[2].m == {"translationColor": "custom", "semanticConsistency": "true", "wholePageTranslation": "true", "semanticPrecedent": "false"}
    assert got[3].m["accentColorDark"] == st.NEW_COLORS["accentColorDark"]


def test_revision_hangs_on_what_changes_a_translation(spark):
    rule = "array(named_struct('host', 'h', 'presetId', 'p', 'background', null, 'rulesText', 'r', 'selectors', '{}'))"
    m = "map('targetLang', '{}', 'model', '{}', 'debug', '{}')"
    rows = [("a", "fr", "x", "1", "s", False), ("b", "fr", "x", "2", "t", False), ("c", "de", "x", "1", "s", False), ("d", "fr", "y", "1", "s", False), ("e", "fr", "x", "1", "s", True), ("f", "fr", "y", "1", "s", True)]
    got = {n: spark.range(1).select(st.semantic_revision(F.expr(m.format(lang, model, debug)), F.expr(rule.format(sel)), F.lit(machine)).alias("r")).first().r for n, lang, model, debug, sel, machine in rows}
    assert got["a"] == got["b"] and got["e"] == got["f"] and len({got[n] for n in "acde"}) == 4


def test_config_effects():
    assert [ru.effect_of(k) for k in ("semanticRevision", "semanticConsistency", "siteRules", "maxCharsPerChunk", "debug", "x")] == ["restart", "restart", "rescan", "next_batch", None, None]


@pytest.mark.parametrize(
    ("text", "want"),
    [("p", "P"), (".a", "P"), ("p.a.b", "P"), ("#i", "P"), ("div p", "P"), ("section > p", "P"), ("div > p", ""), ("p.c", ""), ('[data-x="1, 2"]', ""), ("[data-x]", "P"), ("[data-x^=v]", "P"), ("h1, p", "P"), ("*", "DIV SECTION P")],
)
def test_selectors(text, want):
    root = ht.parse('<div><section><p class="a b" id="i" data-x="val">x</p></section></div>')
    try:
        fits = ht.selector(text)
    except ValueError:
        fits = lambda n: False
    assert " ".join(n.tag for n in ht.ordered(root) if fits(n)) == want


def test_bad_selector_is_disabled():
    page = "<p>Some words here.</p>"
    for bad in ("p:::", "> p", "p >", "[x", "p,,q"):
        units, counts = ht.units_of(page, bad)
        assert len(units) == 1 and counts["bad-selector"] == 1, bad
    assert ht.units_of(page, "p")[0] == [] and ht.units_of(page, "")[1] == {}


def sheet(html, mark="x "):
    units = ht.units_of(html)[0]
    return ex.markdown(html, {i: mark + u[3] for i, u in enumerate(units)})


def test_markdown_lists():
    assert sheet("<ol reversed><li>Aa bb.</li><li value=5>Cc dd.</li><li>Ee ff.</li></ol>") == "3. Aa bb.\n\n   x Aa bb.\n\n5. Cc dd.\n\n   x Cc dd.\n\n4. Ee ff.\n\n   x Ee ff.\n"
    assert sheet("<ol start=9><li>Aa bb.</li><li>Cc dd.<ul><li>Ee ff.</li></ul></li></ol>") == "9. Aa bb.\n\n   x Aa bb.\n\n10. Cc dd.\n\n    x Cc dd.\n\n    - Ee ff.\n\n      x Ee ff.\n"


def test_markdown_leaves_out():
    assert sheet("") == "" and ex.markdown("<p>Some words here.</p>", {}) == "" and ex.markdown("<p>Some words here.</p>", {0: "  "}) == ""
    assert sheet("<footer><p>Foot of a page, with words.</p></footer><article><header><p>Head of the article, with some words.</p></header></article>") == "Head of the article, with some words.\n\nx Head of the article, with some words.\n"
    assert sheet("<p># one & two [three].</p>") == "\\# one &amp; two \\[three\\].\n\nx \\# one &amp; two \\[three\\].\n"


def test_markdown_tables():
    table = "<table><tbody><tr><td rowspan=9>Aa bb.</td><td>Cc dd.</td></tr></tbody><tbody><tr><td>Ee ff.</td><td>Gg | hh.</td></tr><tr><td>1</td><td>2</td></tr></tbody></table>"
    want = "|  |  |\n| --- | --- |\n| Aa bb.<br><br>x Aa bb. | Cc dd.<br><br>x Cc dd. |\n| Ee ff.<br><br>x Ee ff. | Gg \\| hh.<br><br>x Gg \\| hh. |\n"
    assert sheet(table) == want  # a span ends with its group, a row without a translation goes


def test_export_keeps_pages_without_translations(spark):
    pages = spark.createDataFrame([(1, "<p>Some words here.</p>"), (2, None), (3, "<p>Other words here.</p>")], "page_id long, html string")
    said = spark.createDataFrame([(1, 0, "t"), (1, 7, "none")], "page_id long, pos long, t string")
    assert {r.page_id: r.markdown for r in ex.exported(pages, said).collect()} == {1: "Some words here.\n\nt\n", 2: "", 3: ""}


def test_list_numbers_by_table(spark):
    rows = [(1, 1, i, None, v, True) for i, v in enumerate((None, 7, None))] + [(1, 2, i, 4, None, None) for i in range(2)] + [(2, 1, 0, None, None, None)]
    got = pg.numbered_items(spark.createDataFrame(rows, "page_id long, list long, pos long, start long, value long, reversed boolean")).collect()
    assert sorted((r.page_id, r.list, r.pos, r.number) for r in got) == [(1, 1, 0, 3), (1, 1, 1, 7), (1, 1, 2, 6), (1, 2, 0, 4), (1, 2, 1, 5), (2, 1, 0, 1)]


def streamed(spark, path, rows, schema):
    """A stream of the rows, a file for each, in order."""
    for i, row in enumerate(rows):
        spark.createDataFrame([(1, i, *row)], f"user_id long, at long, {schema}").coalesce(1).write.parquet(f"{path}/{i:03}")
    return spark.readStream.schema(f"user_id long, at long, {schema}").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(path))


def last(rows, by="seen"):
    return fl.newest(fl.drained(rows, "test", "update"), "user_id", by).first().asDict()


def test_recheck_ends_sessions_without_permission(spark, tmp_path):
    rows = [("open", "a", True), ("open", "b", False), ("request", "b", True), ("recheck", "", True), ("request", "b", True), ("request", "a", True), ("open", "a", False), ("abort", "z", True)]
    got = last(fl.sessions(streamed(spark, tmp_path, rows, "kind string, session string, allowed boolean")))
    assert got == {"user_id": 1, "seen": 8, "alive": 1, "opened": 2, "aborted": 1, "served": 2, "refused": 1}


def test_a_replaced_gate_holds_nobody(spark, tmp_path):
    rows = [("begin", 0), ("wait", 0), ("begin", 0), ("clear", 1), ("wait", 0), ("clear", 0), ("wait", 0), ("clear", 0), ("begin", 0), ("wait", 0)]
    got = last(fl.gated(streamed(spark, tmp_path, rows, "kind string, back long")))
    assert got == {"user_id": 1, "seen": 10, "generation": 3, "released": 3, "waiting": 1}


def test_model_lists(spark):
    from lexiweave.functions import scalars as sc

    cases = {
        '{"data": [{"id": "b"}, {"id": "a"}, {"id": "b"}, {"id": "text-embed"}]}': ["a", "b"],
        '{"models": [{"name": "n"}, {"model": "m"}, {"id": "", "name": "k"}, {}, {"id": " "}]}': ["k", "m", "n"],
        '["z", "whisper-1", "y"]': ["y", "z"],
        '{"data": [{"id": "tts-1"}, {"id": "clip"}]}': ["clip", "tts-1"],
        '{"data": []}': [], "{}": [], "no json": [], "": [],
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "reply string")
    got = {r.reply: r.m for r in rows.select("reply", sc.chat_models(sc.model_list(F.col("reply"))).alias("m")).collect()}
    assert got == cases | {None: []}


def test_places_take_results_of_their_own_text(spark):
    from lexiweave.operators import units as un

    nodes = spark.createDataFrame([(1, "a", True), (2, "a", True), (3, "a", True), (4, "a", True), (5, "a", False)], "unit_id long, hash string, connected boolean")
    results = spark.createDataFrame([(1, "a", "t"), (2, "old", "t"), (3, "a", None), (5, "a", "t")], "unit_id long, hash string, t string")
    assert {r.unit_id: (r.state, r.t) for r in un.rendered(nodes, results).collect()} == {1: ("done", "t"), 2: ("loading", None), 3: ("error", None), 4: ("loading", None), 5: ("detached", None)}


def test_a_request_without_permission_closes_its_session(spark):
    from lexiweave.operators import logs as lo

    rows = [("s", 1, "request", True), ("s", 2, "open", None), ("s", 3, "request", True), ("s", 4, "request", None), ("s", 5, "request", True), ("s", 6, "open", None), ("s", 7, "request", True), ("t", 8, "request", True)]
    got = lo.authorized(spark.createDataFrame(rows, "session string, at long, kind string, permitted boolean")).collect()
    assert {r["at"]: r.outcome for r in got} == {1: "session-expired", 3: "ok", 4: "no-permission", 5: "session-expired", 7: "ok", 8: "session-expired"}


def test_phases_of_pages_without_units(spark):
    from lexiweave.operators import units as un

    pages = spark.createDataFrame([(1, None), (2, False), (3, True), (4, True)], "page_id long, scanned boolean")
    units = spark.createDataFrame([(1, "done"), (4, "done"), (4, "failed")], "page_id long, state string")
    assert {r.page_id: r.phase for r in un.phases(pages, units).collect()} == {1: "idle", 2: "scanning", 3: "done", 4: "partial"}
