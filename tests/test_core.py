"""Golden cases of the library's own operators."""

import json

import pytest
from pyspark.sql import functions as F

from lexiweave.functions import formats as fm
from lexiweave.functions import scalars as sc
from lexiweave.functions import text as tx
from lexiweave.operators import provider as pr
from lexiweave.operators import rules as ru
from lexiweave.operators import terms as tm
from lexiweave.operators import units as un
from lexiweave.sources import html as ht


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"])
    return row.select(column.alias("x")).first()["x"]


UNITS = "page_id bigint, unit_id bigint, pos bigint, tag string, role string, mode string, text string"


def units(spark, *rows):
    """rows: (role, text) or (tag, role, mode, text)."""
    full = [(1, i, i, *(("H2" if r[0] == "heading" else "P", r[0], "after", r[1]) if len(r) == 2 else r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, UNITS)


@pytest.mark.parametrize(("text", "tag", "reason"), [("", "P", "empty"), ("a", "P", "too-short"), ("12 % — 3", "P", "noise"), ("https://a.example/x", "P", "url-or-email"), ("a.b@c.example", "P", "url-or-email"), ("Word", "P", "single-token"), ("Word", "H2", None), ("Word.", "P", None), ("两个字", "P", None), ("สวัสดี", "P", None), ("two words", "P", None)])
def test_text_rejection(spark, text, tag, reason):
    assert one(spark, tx.text_rejection(F.lit(text), F.lit(tag))) == reason


def test_normalize(spark):
    assert one(spark, tx.normalize(F.lit("\u00a0 a\t\r\nb \u2003 c\u3000"))) == "a b c"
    assert one(spark, tx.utf16_length(F.lit("a😀"))) == 3


@pytest.mark.parametrize(("source", "target", "language", "ok"), [("你好，世界。", "-", "English", False), ("你好，世界。", "Hello, world.", "English", True), ("你好，世界。", "你好，世界。", "English", False), ("张三", "张三", "English", True), ("abc", " ", "fr", False), ("--", "--", "fr", True), ("abc", None, "fr", False)])
def test_usable(spark, source, target, language, ok):
    assert one(spark, tx.is_usable(F.lit(source), F.lit(target).cast("string"), F.lit(language))) is ok


@pytest.mark.parametrize(("token", "fixed"), [("iPhone", True), ("Wi-Fi", True), ("H264", True), ("5G", True), ("Ogilvy", False), ("LTE", False), ("API", False), ("you'll", False)])
def test_fixed_form(spark, token, fixed):
    assert one(spark, tx.is_fixed_form(F.lit(token))) is fixed


def test_chunks(spark):
    sizes = [50, 50, 500, 20]
    u = units(spark, *(("body", "x" * n) for n in sizes))
    assert [r.chunk_id for r in un.with_chunks(u, 120, 2).orderBy("pos").collect()] == [0, 0, 1, 2]
    u = units(spark, ("body", "a"), ("body", "b"), ("heading", "c"), ("body", "d"))
    assert [r.chunk_id for r in un.with_chunks(u).orderBy("pos").collect()] == [0, 0, 1, 1]
    assert un.with_chunks(u.limit(0)).count() == 0


def test_paths(spark):
    u = units(spark, ("H1", "heading", "after", "A"), ("P", "body", "after", "x"), ("H2", "heading", "after", "B"), ("H3", "heading", "after", "C"), ("P", "body", "after", "y"), ("H2", "heading", "after", "D"), ("P", "body", "after", "z"), ("H1", "heading", "after", "E"), ("H3", "heading", "after", "F"))
    assert [r.path for r in un.with_paths(u).orderBy("pos").collect()] == ["", "A", "A", "A > B", "B > C", "A", "A > D", "", "E"]


def test_digest(spark):
    u = units(spark, ("H1", "heading", "after", "T"), ("P", "body", "after", "some text"), ("H2", "heading", "after", "S"), ("LI", "body", "append", "go https://x.example/1 there"), ("LI", "body", "append", "go https://x.example/2 there"))
    r = un.digest(u).first()
    assert r.digest == "# T\nsome text\n## S\n- go there" and not r.sampled and r.kept == r.total == 4
    many = units(spark, ("H1", "heading", "after", "T"), *(("body", f"paragraph {i} " + "x" * 40) for i in range(30)), ("H2", "heading", "after", "End"), ("body", "last one"))
    r = un.digest(many, 300).first()
    assert r.sampled and r.digest.endswith("## End\nlast one") and r.digest.count("paragraph") == 2
    r = un.digest(units(spark, ("body", "a" * 2000), ("body", "b" * 2000)), 300).first()
    assert r.chars == len(r.digest) == 300


def test_cost_and_mode(spark):
    r = un.cost(units(spark, *(("body", "x" * 100) for _ in range(20))), "page_id").first()
    assert (r.source_chars, r.input_tokens, r.output_tokens) == (2000, 3800, 840)
    reason = lambda u, **how: un.translation_mode(u, "page_id", **how).first().mode_reason
    assert reason(units(spark, ("body", "x" * 12_001))) == "within-safe-range"
    assert reason(units(spark, ("body", "x" * 17_000))) == "estimated-output-token-limit"
    assert reason(units(spark, *(("body", "xx") for _ in range(161)))) == "unit-hard-limit"
    assert reason(units(spark, ("body", "xx")), prefer_whole=False) == "user-disabled"
    assert reason(units(spark, ("body", "x" * 4501)), by_tokens=False, most_chars=4500, most_units=60) == "source-char-limit"


def test_mining(spark):
    u = units(spark, ("heading", "BOOK VIII"), ("body", "A book of iPhone cases"), ("body", "The Book, part VIII: iPhone"))
    got = {r.lemma: r for r in tm.mine(u).collect()}
    assert got["book"].kind == "lexical" and got["book"].n_units == 3 and got["iPhone"].kind == "fixed" and got["iPhone"].trust == "AUTO"


def test_tracked_seats(spark):
    rows = [(1, f"s{i}", f"s{i}", "suggested", i) for i in range(22)] + [(1, f"l{i}", f"l{i}", "lexical", 100 + i) for i in range(12)]
    hits = spark.createDataFrame(rows, "page_id bigint, term string, lemma string, kind string, ord bigint")
    got = {r["kind"]: r["count"] for r in tm.tracked(hits).groupBy("kind").count().collect()}
    assert got == {"suggested": 22, "lexical": 10}


def test_drift(spark):
    rows = [(i, t, x, "done") for i, (t, x) in enumerate([("The Widget here", "[W] ici"), ("another widget", "autre chose"), ("none", "rien")])]
    u = spark.createDataFrame(rows, "unit_id bigint, text string, t string, state string")
    c = spark.createDataFrame([(0, "widget", "[W]")], "pos int, term string, target string")
    assert [(r.unit_id, r.term) for r in tm.drift(u, c).collect()] == [(1, "widget")]


def test_rules_text():
    text = '原则: be brief\n锁定:\n  "std::vector": 向量\n  a: b\n优先: x=1, y=2\n风险词:\n  stutter: uneven frames\n不翻: foo, bar'
    got = fm.parse_rules(text)
    assert got == {"principle": "be brief", "domain": [], "hard": {"std::vector": "向量", "a": "b"}, "preferred": {"x": "1", "y": "2"}, "risky": {"stutter": "uneven frames"}, "keep": ["foo", "bar"]}
    assert fm.parse_rules(fm.write_rules(got)) == got
    assert fm.parse_rules('{"terms": {"hard": {"k": "v"}}, "do_not_translate": "a, b"}')["hard"] == {"k": "v"}
    assert fm.is_empty(fm.parse_rules("nothing here")) and fm.profile_of("```yaml\n# x\n```") is None


def test_formats():
    assert fm.first_object('x ```json\n{"a": "}"}\n``` y') == {"a": "}"} and fm.first_object('{"a": ') is None and fm.first_object(None) is None
    assert fm.comparable(' “「Ａ  b」” ') == "A b"
    assert fm.prompt_yaml({"a": [1, {"b": None}], "c d": {}, "e": []}) == 'a:\n  - 1\n  -\n    b: null\n"c d":\n  {}\ne:\n  []'


def test_merge_rules(spark):
    rows = [(1, "auto", "hard", 0, "Cat", "a"), (1, "user", "hard", 0, "Cat", "u"), (1, "auto", "preferred", 1, "Cat", "p"), (1, "auto", "risky", 2, "cat", "s"), (1, "auto", "risky", 3, "dog", "s"), (1, "user", "domain", 4, "maps", ""), (1, "auto", "domain", 5, "law", "")]
    got = ru.merged(spark.createDataFrame(rows, "page_id bigint, source string, tier string, pos int, term string, value string"))
    assert sorted((r.tier, r.term, r.value) for r in got.collect()) == [("domain", "law", ""), ("domain", "maps", ""), ("hard", "Cat", "u"), ("risky", "dog", "s")]
    assert {r.tier: r.terms for r in ru.ordered_lists(got).collect()} == {"domain": "maps,law"}


def test_errors_and_urls(spark):
    cls = lambda m, s: one(spark, sc.error_class(F.lit(m), F.lit(s)))
    assert [cls("x", 429), cls("x", 401), cls("bad JSON", 0), cls("hm", 0)] == ["rate-limit", "authentication", "invalid-response", "unclassified"]
    assert one(spark, sc.safe_url(F.lit("https://u:p@A.example/x/" + "a" * 30 + "/y?q=1#f"))) == "https://a.example/x/[id]/y"
    assert one(spark, sc.machine_target(F.lit("simplified chinese"), F.lit("deeplx"))) == "ZH"


def test_extraction():
    texts = lambda html: [u[3] for u in ht.units_of(html)[0]]
    assert texts("<p>A <a href=x>link</a> and <code>x y</code><sup>2</sup> here</p><div>Some text<pre>no no</pre>More text</div>") == ["A link and x y2 here", "Some text", "More text"]
    assert texts("<p>one line<br>two line</p>") == ["one line two line"]
    assert texts("<p>Keep <script>var a</script>this <select><option>x</select>whole</p>") == ["Keep this whole"]
    assert texts("<p translate=no>not this</p><p class=notranslate>nor this</p><p aria-hidden=true>nor that</p><p contenteditable>nor it</p><p>only this one</p>") == ["only this one"]
    assert texts("<main><p>in main here</p></main><article><p>in article here</p></article><x-box><p>in a box here</p></x-box>") == ["in main here", "in article here", "in a box here"]
    assert texts("<p>first one<p>second one<ul><li>item one here<li>item two here</ul>") == ["first one", "second one", "item one here", "item two here"]
    assert texts('<x-a><template shadowrootmode=open><p>shadow text <slot></slot></p></template>and light</x-a>') == ["shadow text", "and light"]
    assert ht.units_of("<ul><li><a>Aa bb</a><li><a>Cc dd</a><li><a>Ee ff</a></ul>")[1]["link-list"] == 3
    assert ht.units_of("")[0] == [] and ht.units_of("<" * 1000)[0] is not None and ht.units_of("<div>" * 3000 + "deep text")[0]
    grid = ht.table_grid(next(n for n in ht.ordered(ht.parse("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>")) if n.tag == "TABLE"))
    assert grid == [["a", "b"], ["", "c"]]


class Scripted:
    def __init__(self, *replies):
        self.replies = list(replies)

    def complete(self, items):
        reply = self.replies.pop(0) if self.replies else "junk"
        if isinstance(reply, Exception):
            raise reply
        return reply(items) if callable(reply) else reply


def good(items):
    return json.dumps({"items": [{"i": i, "t": "ok " + t} for i, t in items]})


def test_provider_flow():
    items = [(i, f"text {i}") for i in range(8)]
    run = pr.Run()
    done, failed = pr.translate_batch(Scripted(*["junk"] * 30), items, run)
    assert run.attempts == pr.MOST_ATTEMPTS and sorted(failed) == list(range(8)) and not done
    run = pr.Run()
    done, failed = pr.translate_batch(Scripted(lambda x: good(x[:5]), good, pr.CallError("denied", 401)), items, run)
    assert len(done) == 7 and failed == [7] and run.failure
    run = pr.Run()
    done, _ = pr.translate_batch(Scripted(pr.CallError("busy", 503, retryable=True), good), items, run)
    assert len(done) == 8 and run.reasons["retry:503"] == 1
    assert pr.parsed_reply('{"items": [{"i": 1, "t": "a"}, {"i": 1, "t": "b"}, {"i": 9, "t": "c"}, {"i": 2, "t": "d"}]}', [1, 2])[0] == {2: "d"}


def test_markers():
    items = [(11, "a\nb"), (19, "c")]
    text, prefix = pr.pack_markers(items, "context")
    assert pr.unpack_markers(text, items, prefix) == {11: "a\nb", 19: "c"}
    assert pr.unpack_markers(text.replace("UNIT_1__", "UNIT_2__"), items, prefix) is None
    assert pr.translate_machine(pr.Mock(), items, pr.Run(), "context")[0] == {11: "A\nB", 19: "C"}


def plain_queue(jobs, limit):
    """Jobs (takes, cancelled) in order: when each starts."""
    free, out = [0] * limit, []
    for takes, cancelled in jobs:
        now = min(free)
        if cancelled is not None and cancelled <= now:
            out.append(None)
        else:
            free[free.index(now)] = now + takes
            out.append(now)
    return out


def test_queues_of_every_limit(spark):
    """One to eight at once; jobs cancelled at the outset, while they wait, and when it is too late."""
    import random

    r = random.Random(6)
    queues = {q: [(r.randint(1, 9), r.choice([None, None, 0, r.randint(1, 60)])) for _ in range(40)] for q in (1, 2)}
    rows = [(q, n, *job) for q, jobs in queues.items() for n, job in enumerate(jobs)]
    frame = spark.createDataFrame(rows, "queue bigint, job bigint, takes bigint, cancelled bigint").repartition(3)
    for limit in (1, 2, 3, 5, 8, 20):
        got = {(x.queue, x.job): x.started for x in pr.queued(frame, limit).collect()}
        want = {(q, n): at for q, jobs in queues.items() for n, at in enumerate(plain_queue(jobs, min(limit, 8)))}
        assert got == want
    started = [x for x in plain_queue(queues[1], 1)]
    assert any(a is None and c for a, (_, c) in zip(started, queues[1], strict=True)) and any(a is not None and c and c > a for a, (_, c) in zip(started, queues[1], strict=True))
