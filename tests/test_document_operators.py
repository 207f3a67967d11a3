"""Search, edits, comments, changes, Markdown, JSON and styles on small documents."""

from __future__ import annotations

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.operators import comments, edits, markdown_export, markdown_import, packages, revisions, richjson, styles, text
from vellum.operators.search import Query, find, find_regex, search

RUN = "doc_id long, story string, para_ord int, inline_pos int, run_pos int, container string, text string, bold boolean, italic boolean, strike boolean, underline string, style string, font string, size string, color string"
PARA = "doc_id long, story string, para_ord int, style string, ilvl int, num_id int, alignment string"


@pytest.fixture
def make(spark):
    def f(*paragraphs):
        """Paragraphs as lists of run texts, or (style, run texts), or runs as (container, text) pairs."""
        paras, runs = [], []
        for i, p in enumerate(paragraphs):
            style, pieces = p if isinstance(p, tuple) else ("", p)
            paras.append((1, "body", i, style, None, None, None))
            for k, r in enumerate(pieces):
                container, piece = r if isinstance(r, tuple) else ("run", r)
                runs.append((1, "body", i, k, 0, container, piece, None, None, None, None, None, None, None, None))
        return spark.createDataFrame(paras, PARA), spark.createDataFrame(runs, RUN)

    return f


def n(q):
    return q.results().count()


def test_search(make):
    p, r = make(["Hello World"], ["Hello Again"])
    assert n(search(p, r, "Hello")) == 2 and n(search(p, r, "hello").case_sensitive()) == 0
    p, r = make(["Hel", "lo Wor", "ld"])
    found = search(p, r, "Hello World").results().collect()
    assert [(x.n_runs, x.text, x.first_start, x.last_end) for x in found] == [(3, "Hello World", 0, 2)]
    p, r = make(("Heading1", ["Title"]), ["Title"])
    assert n(search(p, r, "Title").in_style("Heading1")) == 1
    p, r = make(["foo"], ["foo"], ["foo"])
    assert n(search(p, r, "foo").nth(1)) == 1 and n(search(p, r, "foo").first()) == 1 and n(search(p, r, "foo").nth(-1)) == 3
    p, r = make(["aaaa"])
    assert [x.start for x in search(p, r, "aa").results().orderBy("start").collect()] == [0, 1, 2]
    p, r = make(["Error 404 and 500"])
    assert find_regex(p, r, r"\d{3}").count() == 2
    p, r = make(["a", ("ins", "X"), "b"])
    assert n(search(p, r, "ab")) == 1 and n(search(p, r, "aXb").include_inserted()) == 1


def body(runs):
    return text.story_text(text.paragraph_text(runs.select("doc_id", "story", "para_ord").distinct(), runs).withColumnRenamed("para_ord", "block_pos")).first().text


def test_replace(make):
    p, r = make(["draft"], ["draft"])
    runs, counts = edits.replace_text(search(p, r, "draft"), "final")
    assert body(runs) == "final\nfinal" and counts.first().n == 2
    p, r = make(["foo", "bar"])
    assert body(edits.replace_text(search(p, r, "foobar"), "baz")[0]) == "baz"
    p, r = make(["foo foo"])
    runs, counts = edits.replace_text(search(p, r, "foo"), "")
    assert body(runs) == " " and counts.first().n == 2
    p, r = make(["aaa"])
    assert body(edits.replace_text(search(p, r, "aa"), "b")[0]) == "ba"


def test_replace_markdown(make):
    p, r = make(["see old ", "text here"])
    r = r.withColumn("italic", F.lit(True))
    runs, _ = edits.replace_markdown(search(p, r, "old text"), "**strong** point")
    got = [(x.text, x.bold, x.italic) for x in runs.orderBy("inline_pos", "run_pos").collect()]
    assert got == [("see ", None, True), ("strong", True, True), (" point", None, True), (" here", None, True)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.text("ab", max_size=4), min_size=1, max_size=4), min_size=1, max_size=3), st.text("ab", min_size=1, max_size=3))
def test_replace_against_a_model(spark, paragraphs, needle):
    runs = spark.createDataFrame([(1, "body", i, k, 0, "run", t, *[None] * 8) for i, p in enumerate(paragraphs) for k, t in enumerate(p)], RUN)
    paras = spark.createDataFrame([(1, "body", i, "", None, None, None) for i in range(len(paragraphs))], PARA)
    want = ["".join(p) for p in paragraphs]
    q = Query(paras, runs, needle).case_sensitive()
    assert q.results().count() == sum(len(re.findall(f"(?={needle})", x)) for x in want)
    out = {x.para_ord: x.text for x in text.paragraph_text(paras, edits.replace_text(q, "<>")[0]).collect()}
    assert [out[i] for i in range(len(want))] == [x.replace(needle, "<>") for x in want]


def test_comments(spark, make):
    p, r = make(["find me here"], ["not this"], ["tail"])
    texts = text.paragraph_text(p, r)
    c = spark.createDataFrame([(1, 0, 0, "A", None, None, "found it"), (1, 1, 1, "B", None, None, "other"), (1, 2, 5, "C", None, None, "wide")], "doc_id long, comment_pos int, comment_id int, author string, date_str string, initials string, text string")
    m = spark.createDataFrame([(1, "body", a, b, k, i) for a, b, k, i in ((0, 0, "commentRangeStart", 0), (0, 2, "commentRangeEnd", 0), (1, 0, "commentRangeStart", 1), (1, 2, "commentRangeEnd", 1), (0, 3, "commentRangeStart", 5), (1, 5, "commentRangeEnd", 5))], "doc_id long, story string, para_ord int, inline_pos int, kind string, ref_id int")
    assert [x.text for x in comments.comments_for_text(c, m, texts, "find me").orderBy("rank").collect()] == ["found it", "wide"]
    assert comments.next_id(c).first().next_id == 6
    anchors = spark.createDataFrame([(1, 0, 0, 0, "x"), (1, 2, 0, 0, "y"), (2, 0, 0, 0, "z")], "doc_id long, para_ord int, first int, last int, text string")
    added, marks = comments.add_comments(c, anchors)
    assert {(x.doc_id, x.comment_id, x.author) for x in added.where("text in ('x', 'y', 'z')").collect()} == {(1, 6, "Unknown"), (1, 7, "Unknown"), (2, 0, "Unknown")}
    assert marks.count() == 9
    left, inlines = comments.remove_comments(c, m, c.where("comment_id = 0"))
    assert left.count() == 2 and inlines.count() == 4


CHANGE = "doc_id long, story string, para_ord int, inline_pos int, kind string, ref_id int, author string, date_str string, text string, del_text string"


def shown(inlines):
    return [(x.kind, x.text, x.del_text) for x in inlines.orderBy("para_ord", "inline_pos").collect()]


def test_revisions(spark):
    rows = [(1, "body", 0, 0, "run", None, None, None, "a ", ""), (1, "body", 0, 1, "del", 1, "A", None, "", "old"), (1, "body", 0, 2, "ins", 2, "A", None, "new", ""), (1, "body", 1, 0, "ins", 3, "A", None, "lone", "")]
    t = spark.createDataFrame(rows, CHANGE)
    assert shown(revisions.accept(t)) == [("run", "a ", ""), ("run", "new", ""), ("run", "lone", "")]
    assert shown(revisions.reject(t)) == [("run", "a ", ""), ("run", "old", "")]
    assert shown(revisions.remove(t)) == [("run", "a ", "")]
    one = t.where("ref_id = 1")
    assert shown(revisions.accept(t, one))[:2] == [("run", "a ", ""), ("ins", "new", "")]
    assert shown(revisions.accept(t, one, keep_paired_insert=False))[:2] == [("run", "a ", ""), ("ins", "lone", "")]
    out = revisions.override(t, t.where("ref_id = 2"), "newer", "F").where("text = 'newer'").first()
    assert (out.author, out.ref_id) == ("F", 4)
    assert revisions.next_revision_id(t).first().next_id == 4
    which = spark.createDataFrame([(1, "body", 0, 0, 0)], "doc_id long, story string, para_ord int, first int, last int")
    assert shown(revisions.add_revisions(t, which, "b "))[:3] == [("del", "", "a "), ("ins", "b ", ""), ("del", "", "old")]
    assert [x.rank for x in revisions.revisions(t).orderBy("rank").collect()] == [0, 1, 2]


def md(spark, source):
    return spark.createDataFrame([(1, source)], "doc_id long, md string")


def test_markdown_import(spark):
    rows = markdown_import.paragraphs(md(spark, "# Hello World\n> quote\n- Item\n2. two\n#tag\n####### x\n```\ncode *x*\n```\n***\na\nb\n\nc")).orderBy("para_ord").collect()
    assert [(r.style, r.text) for r in rows] == [("Heading1", "Hello World"), ("Quote", "quote"), ("ListBullet", "• Item"), ("ListNumber", "2. two"), ("", "#tag ####### x"), ("", "code *x*"), ("", ""), ("", "a b"), ("", "c")]
    cells = markdown_import.table_cells(md(spark, "| a | b |\n|---|---|\n| 1 |\n\n| z |")).orderBy("table_ord", "row_idx", "col_idx").collect()
    assert [(r.table_ord, r.row_idx, r.col_idx, r.text) for r in cells] == [(0, 0, 0, "a"), (0, 0, 1, "b"), (0, 1, 0, "1"), (0, 1, 1, ""), (1, 0, 0, "z")]
    _, runs, _ = markdown_import.import_markdown(md(spark, "```\nx\n```\n***bold italic*** [t](u)"))
    got = [(r.text, r.bold, r.italic, r.font, r.link) for r in runs.orderBy("para_ord", "run_pos").collect()]
    assert got == [("x", False, False, "Courier New", None), ("bold italic", True, True, None, None), (" ", False, False, None, None), ("t", False, False, None, "u")]


@pytest.mark.parametrize(
    ("source", "want"),
    [("a **b** c", ["a ", "b", " c"]), ("**x*", ["**x", "*"]), ("*x", ["*x"]), ("[a", ["[a"]), ("[a]b", ["[a]", "b"]), ("~~q~", ["~~q", "~"]), ("***ab**", ["***ab", "**"]), ("`a", ["`a"]), ("[a](b", ["a"]), ("", [])],
)
def test_inline_marks(source, want):
    assert [r.text for r in markdown_import.inline_runs(source)] == want


@settings(max_examples=200, deadline=None)
@given(st.text("ab*~`[]()", max_size=14))
def test_inline_marks_end(source):
    runs = markdown_import.inline_runs(source)
    assert sum(len(r.text) for r in runs) <= len(source)


def test_markdown_export(spark, make):
    p, r = make(("Heading2", ["T"]), ("Quote", ["q"]), ["b", ("del", "gone"), ("hyperlink", "l")])
    r = r.withColumn("bold", F.col("text") == "b").withColumn("url", F.when(F.col("container") == "hyperlink", "http://x"))
    out = markdown_export.paragraphs_markdown(p, r).orderBy("para_ord").collect()
    assert [x.md for x in out] == ["## T", "> q", "**b**[l](http://x)"]
    cells = spark.createDataFrame([(1, 0, i, j, 0, t) for i, j, t in ((0, 0, "H1"), (0, 1, "Header"), (1, 0, "A"), (1, 1, ""), (1, 2, "x"))], "doc_id long, table_ord int, row_idx int, col_idx int, para_idx int, md string")
    table = markdown_export.table_markdown(markdown_export.cell_markdown(cells)).first().md
    assert table == "| H1  | Header |\n| --- | ------ |\n| A   |        | x   |"


def test_rich_json(spark, make):
    source = {"type": "doc", "attrs": {"title": "T"}, "content": [{"type": "heading", "attrs": {"level": 9}, "content": [{"type": "text", "text": "x", "marks": [{"type": "textStyle", "attrs": {"color": "#ff0000", "fontSize": "18pt", "fontFamily": "Arial"}}]}]}, {"type": "table", "content": [{"type": "table_row", "content": [{"type": "table_cell"}, {"type": "table_header", "attrs": {"colspan": 2}}]}]}, {"type": "bullet_list", "content": [{"type": "list_item", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "i"}]}]}]}, {"type": "nonsense"}]}
    rows = richjson.import_json(spark.createDataFrame([(1, json.dumps(source)), (2, "not json"), (3, None)], "doc_id long, json string")).orderBy("doc_id").collect()
    one = rows[0]
    assert [(p.style, p.in_table) for p in one.paragraphs] == [("Heading6", False), (None, True), (None, True), ("ListBullet", False)]
    assert (one.runs[0].font, one.runs[0].size, one.runs[0].color) == ("Arial", "36", "FF0000")
    assert (len(one.tables), one.cells[1].grid_span, one.properties[0].title) == (1, 2, "T")
    assert not rows[1].paragraphs and not rows[2].paragraphs
    p, r = make(("Heading1", ["a", "b"]), ("Quote", ["q"]), [])
    r = r.withColumn("bold", F.col("text") == "b")
    nodes = [json.loads(x.node) for x in richjson.paragraph_nodes(p, r, camel_case=False).orderBy("para_ord").collect()]
    assert nodes[0] == {"type": "heading", "attrs": {"level": 1}, "content": [{"type": "text", "text": "a"}, {"type": "text", "marks": [{"type": "strong"}], "text": "b"}]}
    assert nodes[1]["type"] == "blockquote" and nodes[2] == {"type": "paragraph"}


def test_styles(spark):
    own = styles.built_in(spark).where("style_id = 'Normal'").withColumn("doc_id", F.lit(1))
    wanted = spark.createDataFrame([(1, "Quote"), (1, "Normal"), (1, "Nope")], "doc_id int, style_id string")
    out = styles.ensured(own, wanted)
    assert [r.style_id for r in out.orderBy("style_pos").collect()] == ["Normal", "Quote"]
    out = styles.with_properties(out, "Quote", size_pt=12.5, color="112233")
    assert styles.by_name(out, "Quote").first().size_half_pt == "25"
    with pytest.raises(ValueError, match="id"):
        styles.added(out, wanted, "", "x")
    with pytest.raises(ValueError, match="no such"):
        styles.with_properties(out, "Quote", nonsense=1)
    assert styles.added(out, wanted, "Mine", "mine").where("style_id = 'Mine'").first().style_pos == 2


def test_case_is_mapped_character_for_character(spark):
    """Capitals that get longer or depend on their place in lower case don't move offsets."""
    text = "İİ the CAT Σ, ΟΔΟΣ the"
    paragraphs = spark.createDataFrame([(1, "body", 0, None)], "doc_id long, story string, para_ord int, style string")
    runs = spark.createDataFrame([(1, "body", 0, 0, 0, "run", text)], "doc_id long, story string, para_ord int, inline_pos int, run_pos int, container string, text string")
    for needle, want in (("THE", ["the", "the"]), ("cat", ["CAT"]), ("οδοσ", ["ΟΔΟΣ"]), ("i", ["İ", "İ"])):
        assert [r.text for r in find(paragraphs, runs, needle).orderBy("start").collect()] == want


def test_matches_as_markdown_and_json(spark):
    paragraphs = spark.createDataFrame([(1, "body", 0, None)], "doc_id long, story string, para_ord int, style string")
    schema = "doc_id long, story string, para_ord int, inline_pos int, run_pos int, container string, text string, bold boolean, italic boolean, strike boolean, underline string, style string, font string, size string, color string"
    plain = (None, None, None, None)
    runs = spark.createDataFrame([(1, "body", 0, 0, 0, "run", "one two", True, None, None, None, *plain), (1, "body", 0, 1, 0, "run", " three", None, True, None, None, *plain)], schema)
    query = search(paragraphs, runs, "two three")
    assert [r.md for r in query.markdown().collect()] == ["**two*** three*"]
    (found,) = query.rich_json().collect()
    tree = json.loads(found.json)
    assert tree["type"] == "paragraph" and [n["text"] for n in tree["content"]] == ["two", " three"] and tree["content"][0]["marks"] == [{"type": "bold"}]
    (one,) = search(paragraphs, runs, "one").rich_json().collect()
    assert json.loads(one.json)["text"] == "one"
    comments = spark.createDataFrame([], "doc_id long, comment_pos int, comment_id int, author string, date_str string, initials string, text string")
    made, markers = query.add_comment(comments, "see", author="me")
    assert [(r.comment_id, r.author, r.text) for r in made.collect()] == [(0, "me", "see")] and markers.count() == 3
    inlines = runs.select("doc_id", "story", "para_ord", "inline_pos", F.lit("run").alias("kind"), F.lit(None).cast("int").alias("ref_id"), "text", F.lit("").alias("del_text"), F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("date_str"))
    out = query.add_revision(inlines, "2 3").orderBy("inline_pos").collect()
    assert [(r.kind, r.text, r.del_text) for r in out] == [("del", "", "one two"), ("del", "", " three"), ("ins", "2 3", "")]


def test_trees_that_are_refused(spark):
    deep = '{"type":"blockquote","content":[' * 400 + "]}" * 400
    nested = {"type": "bulletList", "content": []}
    for _ in range(300):
        nested = {"type": "bulletList", "content": [{"type": "listItem", "content": [nested]}]}
    texts = [json.dumps({"type": "doc", "content": ["x"]}), json.dumps({"type": "doc", "content": 7}), "[" * 200_000, json.dumps(nested), json.dumps({"type": "paragraph", "content": [{"type": "text", "text": 5}]}), "7", "{", None, deep]
    rows = richjson.import_json(spark.createDataFrame(list(enumerate(texts)), "doc_id long, json string")).orderBy("doc_id").collect()
    assert [r.error for r in rows[:8]] == ["malformed", "malformed", "nesting_depth", "nesting_depth", "malformed", "malformed", "json", None]
    assert all(not r.paragraphs for r in rows[:8])


def test_source_rels(spark):
    found = spark.createDataFrame([("word/document.xml",), ("",), ("a.xml",)], "p string").select(packages.source_rels(F.col("p")).alias("r"))
    assert [r.r for r in found.collect()] == ["word/_rels/document.xml.rels", "_rels/.rels", "_rels/a.xml.rels"]


def test_paragraphs_are_never_broadcast(spark, tmp_path):
    """Spark takes the exploded lines of a file to be as large as the file, so its own choice may send a whole corpus through the driver."""
    md(spark, "# a\n\n```\n*x*\n\n```\n*y*").write.parquet(f"{tmp_path}/md")
    paras, runs, _ = markdown_import.import_markdown(spark.read.parquet(f"{tmp_path}/md"))
    none = F.lit(None).cast("string")
    body = paras.select("doc_id", F.lit("body").alias("story"), "para_ord", "style", none.cast("int").alias("ilvl"), none.cast("int").alias("num_id"))
    placed = runs.select("doc_id", F.lit("body").alias("story"), "para_ord", F.col("run_pos").alias("inline_pos"), F.lit(0).alias("run_pos"), F.lit("run").alias("container"), "text", "bold", "italic", "strike", "font", none.alias("style"))
    exported = markdown_export.paragraphs_markdown(body, placed)
    for found in (exported, text.paragraph_text(body, placed)):
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert [x.md for x in exported.orderBy("para_ord").collect()] == ["# a", "`*x*`", "", "*y*"]
