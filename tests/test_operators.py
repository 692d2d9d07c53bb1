"""Operators on small literal tables."""

import datetime
import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sparquill.functions import numbers, text
from sparquill.operators import evidence, graph, retrieval, statistics
from sparquill.sources import readers, sinks
from sparquill.streaming import events as ev


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first().y


def test_tokens(spark):
    assert one(spark, "The X_1 naïve 東京都 a 猫", text.tokens) == ["the", "x_1", "na", "ve", "a", "東京", "京都", "猫"]
    assert one(spark, None, text.tokens) == [] and one(spark, "", text.tokens) == []


def test_lexical_terms(spark):
    assert one(spark, "REG-4711. and XREG-47110Z, a b-", text.lexical_terms) == ["reg-4711", "and", "xreg-47110z"]


@pytest.mark.parametrize(("url", "want"), [
    ("HTTP://User:pw@Example.COM:8080/a/b/?utm_source=x&b=2&ref=x&ref_src=y&c=#top", "http://example.com:8080/a/b?b=2&ref=x&c="),
    ("https://a.b", "https://a.b/"),
    ("https://a.b/?q=a%20b&FBCLID=1", "https://a.b/?q=a+b"),
    ("no url", "no url"),
    (None, None),
])
def test_canonical_url(spark, url, want):
    assert one(spark, url, text.canonical_url) == want


def test_html(spark):
    page = "<html><head><title> A &amp; b </title></head><body><script>x</script><p>One&lt;b&gt;</p><p>Two<br>three</p></body></html>"
    assert one(spark, page, text.html_title) == "A &amp; b"
    assert one(spark, page, text.strip_html) == "A & b One Two three"
    assert one(spark, page, text.html_lines) == "One<b>\nTwo\nthree"
    assert one(spark, "<table><tr><th>a</th><th>b</th></tr><tr></tr><tr><td>1</td><td><i>2</i></td></tr></table><table></table>", text.html_tables) == [[["a", "b"], ["1", "2"]]]


def test_redact(spark):
    assert one(spark, "api_key=abcdefgh12 https://u:p@h/ sk-abcdefghijklmnopqr known-value", lambda c: text.redact(c, ["known-value", "x"])) == "api_key=[REDACTED] https://u:[REDACTED]@h/ [REDACTED] [REDACTED]"


def test_thoughts(spark):
    for value, want in [("<think>a</think>b", ("b", "a")), ("a</think>b", ("b", "a")), ("b<think>a", ("b", "a")), ("b", ("b", "")), (None, ("", ""))]:
        assert tuple(one(spark, value, text.answer_and_thought)) == want


def test_small_text_functions(spark):
    assert one(spark, "=1+1", text.csv_guard) == "'=1+1"
    assert one(spark, "  My Feed! ", text.slug) == "my-feed" and one(spark, "!!", text.slug) == "src"
    assert one(spark, "Ａ  b。", text.claim_text) == "a b"
    assert one(spark, "a​b\x07", text.scrub) == "ab"
    assert one(spark, "<?xml version='1.0'?><rss>", text.looks_like_feed) and not one(spark, "<html><rss>", text.looks_like_feed)
    assert one(spark, "see https://a.b/c. and https://a.b/c", text.citations) == ["https://a.b/c"]


def test_numbers(spark):
    assert [one(spark, t, numbers.year) for t in ("令和6年", "平成元年", "in 1999", "none")] == [2024, 1989, 1999, None]
    assert [one(spark, t, numbers.japanese_number) for t in ("7万2千", "1,234.5", "２億", "none")] == [72000.0, 1234.5, 2e8, None]
    assert one(spark, "8/10", lambda c: numbers.lenient_score(c, 0, 10, 1)) == 8 and one(spark, "x", lambda c: numbers.lenient_score(c, 0, 10, 1)) == 1
    assert one(spark, "Tue, 03 Jun 2008 11:05:30 GMT", numbers.feed_time) == datetime.datetime(2008, 6, 3, 11, 5, 30)
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0], [1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [round(r.c, 6) for r in df.select(numbers.cosine("a", "b").alias("c")).collect()] == [0.707107, 0.0, 0.0]


def test_min_max_of_equal_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, v double")
    for flat in (0.0, 1.0):
        assert sorted((r.g, r.x) for r in df.select("g", numbers.min_max("v", ["g"], flat).alias("x")).collect()) == [("a", 0.0), ("a", 1.0), ("b", flat)]


def test_weighted_quantile_and_fusion(spark):
    df = spark.createDataFrame([("p", float(v), float(w), k) for k, (v, w) in enumerate([(1, 1), (2, 1), (10, 10)])] + [("q", 4.0, 2.0, 9), ("r", 1.0, 0.0, 10)], "g string, v double, w double, k int")
    got = {r.g: r for r in statistics.weighted_quantiles(df, ["g"], "v", "w", {"a": 0.5, "b": 0.0, "c": 1.0}, ["k"]).collect()}
    assert abs(got["p"].a - 8.5454545) < 1e-6 and got["p"].b == 1 and got["p"].c == 10 and got["q"].a == 4 and "r" not in got
    fused = {r.g: r for r in statistics.fuse(df, "g", "v", "w", "k").collect()}
    assert (fused["q"].low, fused["q"].high) == (4 / 1.5, 6.0)


def test_quantiles_are_linear(spark):
    r = random.Random(1)
    values = [round(r.gauss(0, 10), 1) for _ in range(501)]
    df = spark.createDataFrame([("g", v) for v in values] + [("h", 2.0), ("n", None)], "g string, v double")
    got = {x.g: x for x in statistics.quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.9}).collect()}
    s = sorted(values)
    for name, q in (("a", 0.25), ("b", 0.9)):
        k = q * 500
        want = s[int(k)] + (s[min(500, int(k) + 1)] - s[int(k)]) * (k - int(k))
        assert abs(got["g"][name] - want) < 1e-9
    assert got["h"].a == got["h"].b == 2.0


def test_spearman_of_ties_and_constants(spark):
    df = spark.createDataFrame([("a", float(k % 3), float(-(k % 3))) for k in range(9)] + [("b", 1.0, float(k)) for k in range(4)], "g string, x double, y double")
    got = {r.g: r.spearman for r in statistics.spearman(df, ["g"], "x", "y").collect()}
    assert math.isclose(got["a"], -1) and got["b"] == 0


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "cat dog"), (2, "cat cat bird"), (3, "fish"), (4, None)], "doc_id long, text string").where("text IS NOT NULL")
    found = {r.id: r.score for r in retrieval.bm25(docs, spark.createDataFrame([(7, "cat cat")], "item_id long, text string")).collect()}
    idf = math.log(1 + 1.5 / 2.5)
    assert found == {k: round(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 2)), 6) for k, tf, n in ((1, 1, 2), (2, 2, 3))}


def test_vector_top_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    r = random.Random(2)
    rows = [(k, [r.gauss(0, 1) for _ in range(4)]) for k in range(40)] + [(99, None), (98, [0.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = retrieval.vector_top(df, df.where("vec_id < 8"), 3).collect()
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / ((sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5 or 1)
    for q in range(8):
        want = sorted(((-round(cos(rows[q][1], v), 6), k) for k, v in rows if k != q and v), key=lambda x: x)[:3]
        assert [(-x.similarity, x.id) for x in sorted((x for x in found if x.question == q), key=lambda x: x["rank"])] == want
    assert retrieval.vector_top(df, df.limit(0), 3).count() == 0


def test_guaranteed(spark):
    rows = [(k, "big" if k < 30 else f"s{k % 5}", k if k % 4 else None) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, source string, ts long")
    found = [(r.source, r.id) for r in retrieval.guaranteed(df, "source", "ts", "id", 2, 14).collect()]
    assert len(found) == 14 and {s for s, _ in found} == {"big", *(f"s{k}" for k in range(5))}
    tight = [r.source for r in retrieval.guaranteed(df, "source", "ts", "id", 2, 7).collect()]
    assert len(set(tight[:6])) == 6


def test_graph(spark):
    edges = graph.undirected(spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 3), (5, 6), (6, 7), (5, 7), (7, 8), (8, 9), (9, 10), (8, 10)], "src long, dst long"))
    assert {(r.src, r.dst): r.weight for r in edges.collect()}[1, 2] == 2.0
    assert {r.node: r.component for r in graph.components(edges).collect()} == {1: 1, 2: 1, 3: 1, **{k: 5 for k in range(5, 11)}}
    assert {r.node: r.hops for r in graph.reach(edges, spark.createDataFrame([(5,)], "seed long"), 2).collect()} == {5: 0, 6: 1, 7: 1, 8: 2}
    named = {r.node: r.community for r in graph.communities(edges).collect()}
    assert named[1] == named[2] == named[3] and named[5] == named[6] == named[7] and named[8] == named[9] == named[10]
    order = {r.name: r.size for r in graph.community_order(graph.communities(edges)).collect()}
    assert order["C1"] >= order["C2"]


def test_pagerank(spark):
    links = [(1, 2), (1, 2), (1, 3), (2, 3), (3, 1), (4, 3), (3, 5)]
    found = {r.node: r["rank"] for r in graph.pagerank(spark.createDataFrame(links, "src long, dst long"), rounds=60).collect()}
    rank = {k: 0.2 for k in range(1, 6)}
    for _ in range(60):
        new = {k: 0.15 / 5 + 0.85 * rank[5] / 5 for k in rank}
        for a, b in links:
            new[b] += 0.85 * rank[a] / sum(x == a for x, _ in links)
        rank = new
    assert all(abs(found[k] - rank[k]) < 1e-6 for k in rank)


def test_claims(spark):
    rows = [("a", "e1", 1, 1), ("a", "e2", 1, 0), ("b", "e1", 1, 1), ("b", "e2", 2, 1), ("c", "e1", 1, 0), ("d", "e1", None, 2)]
    found = {r.c: r.verdict for r in evidence.compare(spark.createDataFrame(rows, "c string, e string, v int, n int"), "c", "e", "v", "n", 2).collect()}
    assert found == {"a": "agreement", "b": "conflict", "c": "unsupported", "d": "partial"}


def test_skyline_keeps_equal_points(spark):
    pts = [(1, 5.0), (2, 4.0), (2, 4.0), (2, 3.0), (3, 1.0), (0, 5.0), (3, None)]
    found = sorted((r.a, r.b) for r in evidence.skyline(spark.createDataFrame(pts, "a int, b double"), "a", "b").collect())
    assert found == [(1, 5.0), (2, 4.0), (2, 4.0), (3, 1.0)]


def test_readers(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"rev": 3, "docs": [{"id": "a", "title": "A", "text": "x"}]}')
    (tmp_path / "bad.json").write_text("{nope")
    assert [tuple(r) for r in readers.corpus(spark, str(tmp_path / "*.json")).collect()] == [(3, "a", "A", "x")]
    (tmp_path / "x.jsonl").write_text('{"id": "1", "v": 1}\nnope\n{"id": "2", "v": 5}\n{"id": "1", "v": 9}\n')
    assert {r.id: r.v for r in readers.archive(spark, str(tmp_path / "x.jsonl"), "id string, v int").collect()} == {"1": 9, "2": 5}
    (tmp_path / "n.md").write_text("# Title\nbody")
    assert tuple(readers.markdown_files(spark, str(tmp_path / "*.md")).first()) == ("sample-n", "Title", "# Title\nbody")
    with pytest.raises(ValueError):
        readers.index(spark, str(tmp_path), "../x")


def test_feeds(spark):
    rss = "<rss><channel><item><title><![CDATA[A &amp; b]]></title><link>https://a.b/1</link><description>&lt;p&gt;Hi&lt;/p&gt;</description><pubDate>Tue, 03 Jun 2008 11:05:30 GMT</pubDate></item><item><title></title><link>https://a.b/2</link></item></channel></rss>"
    atom = '<a:feed xmlns:a="x"><a:entry><a:title>T</a:title><a:link href="https://a.b/3"/><a:updated>2024-01-02T03:04:05Z</a:updated></a:entry></a:feed>'
    found = readers.feed_articles(spark.createDataFrame([("s", rss), ("t", atom), ("u", None)], "source string, value string")).orderBy("source").collect()
    assert [(r.source, r.title, r.link, r.summary) for r in found] == [("s", "A & b", "https://a.b/1", "Hi"), ("t", "T", "https://a.b/3", "")]
    assert len(found[0].id) == 12 and found[0].published.year == 2008 and found[1].published.year == 2024


def test_graphml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text('<graphml><key id="d0" for="node" attr.name="entity_type"/><key id="d1" for="edge" attr.name="weight"/><graph><node id="&quot;A&quot;"><data key="d0">"ORG"</data></node><node id="B"></node><edge source="A" target="B"><data key="d1">2.5</data></edge></graph></graphml>')
    nodes, edges = readers.graphml(spark, str(tmp_path / "g.graphml"))
    assert {r.id: r.type for r in nodes.collect()} == {"A": "ORG", "B": ""}
    assert [tuple(r)[:3] for r in edges.collect()] == [("A", "B", 2)]


def test_blocks(spark):
    doc = spark.createDataFrame([(1, "# One\ntext\nmore\n| a | b |\n| 1 | 2 |\n## Two\n\nend")], "id int, text string")
    found = [(r.type, r.level, r.content) for r in readers.markdown_blocks(doc, "id", "text").orderBy("block").collect()]
    assert found == [("Title", 1, "One"), ("Text", 0, "text\nmore"), ("Table", 0, "| a | b |\n| 1 | 2 |"), ("Title", 2, "Two"), ("Text", 0, "end")]
    long = spark.createDataFrame([(1, "ab\n" * 100 + "x" * 50), (2, None), (3, "")], "id int, text string")
    parts = readers.segments(long, "id", "text", 64).orderBy("segment").collect()
    assert "".join(r.content for r in parts) == "ab\n" * 100 + "x" * 50 and parts[0].content.endswith("\n")


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, 0), ("b", 2, 1)], "id string, v int, at int")
    new = spark.createDataFrame([("b", 9, 0), ("c", 3, 1), ("c", 4, 2)], "id string, v int, at int")
    assert {r.id: r.v for r in sinks.upsert(old, new, "id", "at").collect()} == {"a": 1, "b": 9, "c": 4}
    assert {r.id for r in sinks.unseen(old, new, "id").collect()} == {"c"}
    assert {r.id: r.v for r in sinks.override(old, new.where("id = 'b'"), "id").collect()} == {"a": 1, "b": 9}
    times = spark.createDataFrame([(1, 0, 5), (2, 9, 1), (3, None, None)], "id int, p int, q int")
    assert [r.id for r in sinks.capped(times, [F.col("p"), F.col("q")], 2, "id").collect()] == [2, 1]
    sinks.write_csv(spark.createDataFrame([("=x", 1)], "a string, b int"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().a == "'=x"


def test_stream_fold_equals_batch(spark, tmp_path):
    rows = [Row(key=k % 3, seq=s, kind=kind, value=v) for k, s, kind, v in [(0, 1, "view", 1.0), (0, 3, "click", None), (0, 2, "error", 7.0), (0, 3, "click", None), (1, 5, "view", 2.0), (1, 4, "late", 3.0)]]
    spark.createDataFrame(rows, "key long, seq long, kind string, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ev.fold_stream(spark.readStream.schema("key long, seq long, kind string, value double").parquet(str(tmp_path / "in")))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = stream.writeStream.format("memory").queryName("folded").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.key: (r.last_seq, r.status, r.last_value, r.events) for r in spark.table("folded").collect()}
    assert got == {0: (3, "click", 7.0, 3), 1: (5, "view", 2.0, 2)}


def test_state_of_a_stream_is_bounded(spark, tmp_path):
    kind = "key long, seq long, kind string, value double"
    for k in range(3):  # three batches of shuffled, partly replayed events
        rows = [(0, (7 * s) % 60 + 40 * k, f"e{(7 * s) % 60 + 40 * k}", float(s)) for s in range(60)]
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = ev.fold_stream(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), keep=30)
    q = stream.writeStream.format("memory").queryName("bounded").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("bounded").collect()
    assert len(got) == 3 and max(r.held for r in got) == 30
    last = max(got, key=lambda r: r.last_seq)
    assert (last.last_seq, last.status) == (139, "e139")


def test_append_new_is_idempotent(spark, tmp_path):
    batch = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string")
    for _ in range(2):
        ev.append_new(batch, str(tmp_path / "t"), "id")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_violations_and_breakers(spark):
    rows = [(1, k, s) for k, s in enumerate(["created", "running", "completed", "running"])]
    bad = ev.violations(spark.createDataFrame(rows, "job int, k int, status string"), "job", ["k"], "status", ev.JOB_TRANSITIONS)
    assert {(r.before, r.after) for r in bad.collect()} == {("created", "running"), ("completed", "running")}
    flags = spark.createDataFrame([(1, k, f) for k, f in enumerate("xxx.xx.xxxx")], "e int, k int, f string")
    assert tuple(ev.breakers(flags, "e", ["k"], F.col("f") == "x").first()) == (1, 2, 4)


def test_keys_and_guards(spark):
    assert [one(spark, t, text.entity_key) for t in ("株式会社 ＡＢＣ Inc.", "株式会社", "Acme Corp")] == ["abc", "株式会社", "acme"]
    good, bad = ["https://a.com/x", "http://8.8.8.8/"], ["ftp://a.com", "http://localhost/", "http://10.1.2.3/", "http://0x7f000001/", "http://2130706433/", "http://u@a.com/", "http://[::1]/", "http://a/", "http://127.1/", "http://x.internal/", None]
    assert all(one(spark, u, text.public_url) for u in good) and not any(one(spark, u, text.public_url) for u in bad)


def test_reports(spark):
    report = "# A\ntext [S1] [S9]\n## Sources\n[1] One: https://a.b/1\n- [2] Two https://a.b/2\n[3] Again: https://a.b/1\n## After\n[4] x https://a.b/4"
    assert [(r.n, r.title, r.url) for r in one(spark, report, text.numbered_sources)] == [(1, "One", "https://a.b/1"), (2, "Two", "https://a.b/2")]
    found = one(spark, report, lambda c: text.unknown_citations(c, F.array(F.lit("S1"))))
    assert found.removed == ["S9"] and "[S9]" not in found.text and "[S1]" in found.text
    page = "発行者：統計局\n定義: 全世帯\n本文 12"
    said = one(spark, page, text.described)
    assert said.publisher == "統計局" and said.definition == "全世帯" and said.revision is None
    masked = one(spark, page, text.mask_lines)
    assert len(masked) == len(page) and masked.endswith("本文 12") and "統計局" not in masked
