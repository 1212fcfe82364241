"""Operators on pages and conversations."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tabulith.llm import html_extract as h
from tabulith.llm.chat import best_paths, format_trees, linear, read_back
from tabulith.llm.common import Scratch
from tabulith.llm.warc import payload_of, read_records, write_archive


@pytest.fixture(scope="module")
def trees(spark):
    return h.fit(spark)


def test_blocks_and_character_references():
    _, runs = h.parse("<p>a &amp; b<p>c<b>d</b>\n e<br>f<!-- x --><div>g<script>var a = '<p>no</p>';</script></div>tail &lt;p&gt;")
    assert [t for _, t in runs] == ["a & b", "cd e f", "g", "tail <p>"]


@pytest.mark.parametrize("rest", ["<body><p>a text</p>", "<p>a text</p>", "<noscript><link href=x></noscript><div>a text</div>", "<noscript><img src=x>no</noscript>\n<p>a text",
                                  "<noscript><body><p>a text", "<template><div>no</div></template><p>a text", "a text", "<img src=x>a text", "</head><body>a text"])
def test_a_head_without_an_end_tag_ends_at_the_first_content(rest):
    _, runs = h.parse("<html><head><meta charset=utf-8>\n<title>no</title><style>no</style>" + rest)
    assert [t for _, t in runs] == ["a text"]


@pytest.mark.parametrize("html, blocks", [("one<hr>two", ["one", "two"]), ("<dialog>d</dialog>e<legend>l</legend>m", ["d", "e", "l", "m"]), ("<p>a<hr/>b</p>c", ["a", "b", "c"]),
                                          ("<menu><li>x<li>y</menu>z", ["x", "y", "z"]), ("<search>s</search>t<dir>u</dir>v", ["s", "t", "u", "v"])])
def test_blocks_don_t_fuse(html, blocks):
    assert [t for _, t in h.parse(html)[1]] == blocks


def test_text_of_a_page_without_an_end_of_head(trees):
    page = "<html><head><title>T</title>{}<body><article><h1>Title here</h1><p>Some text, and more of it. And yet more.</p></article></body></html>"
    open_head, closed = h.main_texts([page.format(""), page.format("</head>")], trees)
    assert open_head == closed == "Title here\nSome text, and more of it. And yet more."


@pytest.mark.parametrize("page", ["", "<", "<<<>>", "<p", "<script>", "<p class='", "</p></div>", "<!--", "a < b > c", "<b><i><p>x</b></i>", "&#0;&#x110000;&bogus;", "<div>" * 3000])
def test_broken_pages_are_parsed(page, trees):
    assert isinstance(h.main_texts([page], trees)[0], str)


def test_held_out_layouts(trees):
    rng, right, total = random.Random(77), 0, 0
    for _ in range(120):
        root, runs = h.parse(h._layout(rng))
        nodes, x = h.features(root)
        kept = h.decode(nodes, trees.log_odds(x))
        right += sum((id(n) in kept) == ("mainword" in t) for n, t in runs)
        total += len(runs)
    assert right / total > 0.97


def test_nothing_is_kept_below_what_is_left_out(trees):
    rng = random.Random(78)
    for _ in range(30):
        root, _ = h.parse(h._layout(rng))
        nodes, x = h.features(root)
        kept = h.decode(nodes, trees.log_odds(x))
        assert all(n.parent is None or id(n.parent) in kept for n in nodes if id(n) in kept)


def test_extraction_of_awkward_rows(spark, trees):
    page = "<html><body><nav><a href=/>menu</a></nav><article><h1>Title here</h1><p>Some  text,\n and more of it. And yet more.</p></article><footer>legal</footer></body></html>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "", ""), (3, "x", "<p>" + "long text. " * 50_000 + "</p>")]
    got = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")), trees=trees).collect()
    by = {(r.page_id, r.url): r.text for r in got}
    assert len(got) == 5 and by[(1, "u")] == "Title here\nSome text, and more of it. And yet more." and by[(2, None)] == "" and by[(None, "")] == ""
    assert len(by[(3, "x")]) == 50_000 * 11 - 1


def test_archive_round_trip(spark, tmp_path):
    rows = [(5, "http://b", "same"), (3, "http://a\r\nx", "same"), (9, None, "same"), (4, "http://c", None), (7, "http://d", ""), (8, "http://é", "é" * 9), (8, "http://é", "é" * 9), (None, "n", "same")]
    path = str(tmp_path / "archive")
    write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("bytes", F.lit(1)), path)
    got = read_records(spark, path).collect()
    assert len(got) == 8 and all(r.verified for r in got)
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert kinds == {3: ("response", None), 5: ("revisit", 3), 9: ("revisit", 3), 4: ("response", None), 7: ("revisit", 4), 8: ("response", None), None: ("revisit", 3)}
    for r in got:
        html = {8: "é" * 9, 4: "", 7: ""}.get(r.page_id, "same").encode()
        assert r.payload_digest == base64.b32encode(hashlib.sha1(html).digest()).decode() and r.payload_bytes == len(html)
        assert bytes(r.record).startswith(b"WARC/1.1\r\n") and bytes(r.record).endswith(b"\r\n\r\n" + html + b"\r\n\r\n")
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    lost = str(tmp_path / "lost")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{lost}/headers")
    spark.read.parquet(f"{path}/payloads").filter("octet_length(payload) != 4").write.parquet(f"{lost}/payloads")
    assert sorted((r.page_id or 0, r.verified) for r in read_records(spark, lost).collect()) == [
        (0, False), (3, False), (4, True), (5, False), (7, True), (8, True), (8, True), (9, False)]


def test_hot_payloads_are_dealt_and_not_broadcast(spark, tmp_path):
    rows = [(i, f"u{i}", "hot " * 50 if i % 3 == 0 else f"page {i}") for i in range(1500)]
    write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "a"))
    records = read_records(spark, str(tmp_path / "a"))
    assert sorted((r.page_id, bytes(r.body).decode()) for r in records.select("page_id", payload_of(F.col("record"), F.col("header_bytes")).alias("body")).collect()) == [
        (i, h) for i, _, h in rows]
    assert "_part" in records._jdf.queryExecution().optimizedPlan().toString()


def test_conversations_come_back_from_their_format(spark):
    rows = [(1, 0, "system", "be <b>ri&ef</b>"), (1, 1, "user", "<|turn|>user\nhi<|end|>\n"), (1, 2, "assistant", "[INST] &lt; &amp; ]"), (1, 3, "user", None), (1, 4, "assistant", "é👍\n"),
            (2, 0, None, ""), (3, 1, "assistant", "b"), (3, 0, "as\nsistant", "a"), (3, 1, "assistant", "b"), (None, 0, "user", "x")]
    out = read_back(format_trees(*linear(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()
    by = {r.tree: r for r in out}
    assert [tuple(t) for t in by[1].turns] == [(r or "", t or "") for c, _, r, t in rows[:5]] and by[1].learned == ["[INST] &lt; &amp; ]", "é👍\n"]
    assert [tuple(t) for t in by[2].turns] == [("", "")] and [tuple(t) for t in by[3].turns] == [("as\nsistant", "a"), ("assistant", "b"), ("assistant", "b")] and by[3].learned == ["b", "b"]  # equal rows are turns each
    assert by[None].learned == [] and len(out) == 4


def test_best_branches_of_a_tree(spark):
    replies = [("t", "a", None, 0.0), ("t", "b", "a", 1.0), ("t", "c", "a", 5.0), ("t", "d", "c", 2.0), ("t", "e", "c", 4.0), ("t", "f", "e", None), ("u", "x", "gone", 1.0),
               ("v", "p", "q", 1.0), ("v", "q", "p", 1.0)]
    df = spark.createDataFrame(replies, "tree string, msg string, parent string, score double")
    paths = {}
    for r in best_paths(df, Scratch(spark, "t"), per_tree=9).orderBy(F.desc("up")).collect():
        paths.setdefault((r.tree, r["path"]), []).append(r.msg)
    assert paths == {("t", 1): ["a", "c", "d"], ("t", 2): ["a", "c", "e", "f"], ("t", 3): ["a", "b"], ("u", 1): ["x"]}
    texts = df.select("tree", "msg", F.lit("assistant").alias("role"), F.upper("msg").alias("text"))
    assert [r.learned for r in read_back(format_trees(texts, df)).orderBy("tree").collect()] == [["A", "C", "D"], ["X"]]


def test_long_chains_take_few_rounds(spark):
    df = spark.range(300).select(F.lit(1).alias("tree"), F.col("id").alias("msg"), (F.col("id") - 1).alias("parent"), F.lit(1.0).alias("score"))
    path = best_paths(df, Scratch(spark, "t")).collect()
    assert sorted(r.msg for r in path) == list(range(300)) and {r.msg: r.up for r in path}[0] == 299


def test_parsing_is_linear_in_broken_pages():
    import time

    from tabulith.llm.html_extract import parse
    for page in ("<a " * 350_000, "<b>" * 40_000 + "</i>" * 40_000, '<a "' * 250_000 + ">", "<!" * 200_000, "<script " * 100_000 + "<p>x"):
        began = time.time()
        parse(page)
        assert time.time() - began < 5
    assert [t for _, t in parse("<p>Euler: <math><mi>e</mi></math> holds.</p><object>fallback</object>")[1]] == ["Euler: e holds.", "fallback"]


def test_records_are_put_together_with_their_payloads(spark, tmp_path):
    rows = [(1, "http://a/\u0420\u0420", "x\r\n\r\ny"), (2, None, "x\r\n\r\ny"), (3, "u", None), (None, "u", "z")]
    write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = {r.page_id: bytes(r.body) for r in read_records(spark, str(tmp_path / "w")).select("page_id", payload_of(F.col("record"), F.col("header_bytes")).alias("body")).collect()}
    assert got == {i: (h or "").encode() for i, _, h in rows}
    write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none"))
    assert read_records(spark, str(tmp_path / "none")).count() == 0
