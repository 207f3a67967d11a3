"""Additions and set values on small documents."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vellum.operators import building, text
from vellum.sources import documents
from vellum.sources.wordml import TABLES


@pytest.fixture(scope="module")
def corpus(spark):
    """Document 1: a paragraph 'ab' of two runs, a table of 3 x 2 whose cell (1, 0) holds a table of 2 x 1, a paragraph. Document 2: one empty paragraph."""
    frame = lambda name, rows: spark.createDataFrame([tuple(r.get(f.name) for f in schema(spark, name).fields) for r in rows], schema(spark, name))
    paras = [(0, [0], False)] + [(1 + i * 2 + j, [1, i, j, 0], True) for i in range(3) for j in range(2)] + [(7 + i, [1, 1, 0, 1, i, 0, 0], True) for i in range(2)] + [(9, [2], False)]
    paragraphs = [{"doc_id": 1, "story": "body", "para_ord": p, "block_path": path, "in_table": t} for p, path, t in paras] + [{"doc_id": 2, "story": "body", "para_ord": 0, "block_path": [0], "in_table": False}]
    at = [(0, 0, "a"), (0, 1, "b")] + [(p, 0, f"c{p}") for p in range(1, 10)]
    runs = [{"doc_id": 1, "story": "body", "para_ord": p, "inline_pos": k, "run_pos": 0, "container": "run", "text": t, "del_text": "", "content": [("text", t, None, None)]} for p, k, t in at]
    inlines = [{"doc_id": 1, "story": "body", "para_ord": p, "inline_pos": k, "kind": "run"} for p, k, _ in at]
    tables = [{"doc_id": 1, "story": "body", "table_ord": 0, "block_path": [1], "n_rows": 3, "n_cols": 2}, {"doc_id": 1, "story": "body", "table_ord": 1, "block_path": [1, 1, 0, 1], "n_rows": 2, "n_cols": 1}]
    cells = [{"doc_id": 1, "story": "body", "table_ord": 0, "row_idx": i, "col_idx": j} for i in range(3) for j in range(2)] + [{"doc_id": 1, "story": "body", "table_ord": 1, "row_idx": i, "col_idx": 0} for i in range(2)]
    rels = [{"doc_id": 1, "source_path": "word/document.xml", "rel_pos": 0, "rel_id": "rId4", "rel_type": "x", "target": "y", "external": False}]
    given = {"paragraphs": paragraphs, "inlines": inlines, "runs": runs, "tables": tables, "cells": cells, "rels": rels, "properties": [{"doc_id": 1, "title": "old", "creator": "me"}]}
    return {name: frame(name, rows) for name, rows in given.items()}


def schema(spark, name):
    from pyspark.sql.types import StructType

    return StructType.fromDDL("doc_id long, " + TABLES[name])


def rows(spark, ddl, *values):
    return spark.createDataFrame(list(values), ddl)


def texts(corpus, paragraphs=None, runs=None):
    found = text.paragraph_text(paragraphs if paragraphs is not None else corpus["paragraphs"], runs if runs is not None else corpus["runs"])
    return {(x.doc_id, x.para_ord): x.text for x in found.collect()}


def test_paragraphs_and_clear(spark, corpus):
    new = rows(spark, "doc_id long, story string, k int, style string", (1, "body", 5, "Quote"), (1, "body", 2, None), (3, "body", 0, "x"))
    found = building.add_paragraphs(corpus["paragraphs"], corpus["tables"], new)
    assert [(x.doc_id, x.para_ord, x.block_path, x.style) for x in found.where("para_ord > 9 or doc_id = 3").orderBy("doc_id", "para_ord").collect()] == [(1, 10, [3], None), (1, 11, [4], "Quote"), (3, 0, [0], "x")]
    left = building.cleared(corpus, rows(spark, "doc_id long", (1,), (9,)))
    assert [left[t].count() for t in ("paragraphs", "inlines", "runs", "tables", "cells", "properties")] == [1, 0, 0, 0, 0, 1]


def test_tables(spark, corpus):
    p, t, c = building.add_table(corpus["paragraphs"], corpus["tables"], corpus["cells"], rows(spark, "doc_id long", (1,), (2,)), 2, 3)
    assert sorted((x.doc_id, x.table_ord, x.block_path[0], x.n_rows, x.n_cols) for x in t.where("n_cols = 3").collect()) == [(1, 2, 3, 2, 3), (2, 0, 1, 2, 3)]
    assert c.where("doc_id = 2").count() == 6 and p.where("doc_id = 2").count() == 7 and p.where("doc_id = 1").select("para_ord").distinct().count() == 16
    again = building.add_table(p, t, c, rows(spark, "doc_id long", (2,)), 0, 3)
    assert again[1].where("doc_id = 2 and table_ord = 1").first().n_cols == 0 and again[0].count() == p.count()
    more = building.add_rows(corpus["tables"], rows(spark, "doc_id long, story string, table_ord int, n int", (1, "body", 0, 2), (1, "body", 7, 1)))
    assert sorted(x.n_rows for x in more.collect()) == [2, 5]
    at = rows(spark, "doc_id long, story string, table_ord int, row_idx int", (1, "body", 0, 0), (1, "body", 0, 4), (1, "body", 0, 9))
    p, t, c = building.add_cells(corpus["paragraphs"], more, corpus["cells"], at)
    assert sorted((x.row_idx, x.col_idx) for x in c.where("table_ord = 0").collect())[:3] == [(0, 0), (0, 1), (0, 2)] and c.where("row_idx = 4").first().col_idx == 0 and c.where("row_idx = 9").count() == 0
    assert t.where("table_ord = 0").first().n_cols == 3 and sorted(x.block_path for x in p.where("para_ord > 9").collect()) == [[1, 0, 2, 0], [1, 4, 0, 0]]
    assert building.set_table_style(corpus["tables"], at, "Grid").where("style = 'Grid'").first().table_ord == 0


def test_remove_rows(spark, corpus):
    at = lambda *x: rows(spark, "doc_id long, story string, table_ord int, row_idx int", *((1, "body", a, b) for a, b in x))
    left = building.remove_rows(corpus, at((0, 1), (0, 9)))
    assert [left["tables"].count(), left["cells"].count(), left["paragraphs"].where("doc_id = 1").count(), left["runs"].count()] == [1, 4, 6, 7]
    assert left["tables"].first().n_rows == 2 and sorted(x.block_path for x in left["paragraphs"].where("in_table").collect()) == [[1, 0, 0, 0], [1, 0, 1, 0], [1, 1, 0, 0], [1, 1, 1, 0]]
    assert left["cells"].agg(F.max("row_idx")).first()[0] == 1
    left = building.remove_rows(corpus, at((0, 0), (1, 0), (1, 0)))
    assert {x.table_ord: (x.n_rows, x.block_path) for x in left["tables"].collect()} == {0: (2, [1]), 1: (1, [1, 0, 0, 1])}
    assert left["paragraphs"].where("para_ord = 8").first().block_path == [1, 0, 0, 1, 0, 0, 0] and left["paragraphs"].where("para_ord = 7").count() == 0
    left = building.remove_rows(corpus, at((0, 0), (0, 1), (0, 2)))
    assert (left["tables"].count(), left["tables"].first().n_rows, left["tables"].first().n_cols, left["cells"].count()) == (1, 0, 0, 0)


def test_runs_and_links(spark, corpus):
    new = rows(spark, "doc_id long, story string, para_ord int, k int, text string, bold boolean", (1, "body", 0, 1, "d", True), (1, "body", 0, 0, "c", None), (2, "body", 0, 0, None, None))
    inlines, runs = building.add_runs(corpus["inlines"], corpus["runs"], new)
    assert texts(corpus, runs=runs)[1, 0] == "abcd" and runs.where("bold").first().text == "d" and inlines.where("doc_id = 2").first().inline_pos == 0
    links = rows(spark, "doc_id long, story string, para_ord int, k int, url string, text string", (1, "body", 9, 0, "http://x", "X"), (1, "body", 0, 0, "http://x", "Y"), (2, "body", 0, 0, "u", "U"))
    inlines, runs, rels = building.add_hyperlinks(corpus["inlines"], corpus["runs"], corpus["rels"], links)
    assert sorted((x.doc_id, x.para_ord, x.inline_pos, x.rel_id) for x in inlines.where("kind = 'hyperlink'").collect()) == [(1, 0, 2, "rId5"), (1, 9, 1, "rId6"), (2, 0, 0, "rId1")]
    assert texts(corpus, runs=runs)[1, 9] == "c9X" and sorted(x.target for x in rels.where("external").collect()) == ["http://x", "http://x", "u"]
    key = rows(spark, "doc_id long, story string, para_ord int, inline_pos int, run_pos int, text string", (1, "body", 0, 1, 0, "new"), (1, "body", 0, 8, 0, "none"))
    runs = building.add_content(corpus["runs"], key, "tab")
    assert texts(corpus, runs=runs)[1, 0] == "ab\t"
    runs = building.add_content(building.add_content(runs, key, "page_break"), key, "line_break")
    assert [tuple(x)[:3] for x in runs.where("para_ord = 0 and inline_pos = 1").first().content] == [("text", "b", None), ("tab", None, None), ("break", None, "page"), ("break", None, None)]
    runs = building.set_run_text(runs, key)
    assert texts(corpus, runs=runs)[1, 0] == "anew" and len(runs.where("text = 'new'").first().content) == 1 and runs.count() == corpus["runs"].count()


def test_set_markdown(spark, corpus):
    new = rows(spark, "doc_id long, story string, para_ord int, text string", (1, "body", 0, "x **y** [z](http://q) `w`"), (2, "body", 0, None))
    inlines, runs, rels = building.set_markdown(corpus["inlines"], corpus["runs"], corpus["rels"], new)
    found = runs.where("para_ord = 0").orderBy("inline_pos").collect()
    assert [(x.text, x.bold, x.container, x.font) for x in found] == [("x ", None, "run", None), ("y", True, "run", None), (" ", None, "run", None), ("z", None, "hyperlink", None), (" ", None, "run", None), ("w", None, "run", "Courier New")]
    assert rels.where("external").first().target == "http://q" and inlines.where("rel_id = 'rId5'").first().inline_pos == 3


def test_values(spark, corpus):
    new = rows(spark, "doc_id long, title string, creator string", (1, "new", None), (2, "t", "c"))
    assert sorted((x.doc_id, x.title, x.creator) for x in building.set_properties(corpus["properties"], new).collect()) == [(1, "new", "me"), (2, "t", "c")]
    assert building.set_alignment(corpus["paragraphs"], new.limit(0).select("doc_id", F.lit("body").alias("story"), F.lit(0).alias("para_ord")), "center").where("alignment is not null").count() == 0
    assert building.set_alignment(corpus["paragraphs"], corpus["paragraphs"].where("para_ord = 0"), "center").where("alignment = 'center'").count() == 2


def test_round_trip(spark, corpus):
    """Additions survive writing and reading of packages."""
    p, t, c = building.add_table(corpus["paragraphs"], corpus["tables"], corpus["cells"], rows(spark, "doc_id long", (1,)), 1, 2)
    inlines, runs = building.add_runs(corpus["inlines"], corpus["runs"], rows(spark, "doc_id long, story string, para_ord int, k int, text string", (1, "body", 10, 0, "cell"), (1, "body", 9, 0, "!")))
    packed = documents.packages({"paragraphs": p, "tables": t, "cells": c, "inlines": inlines, "runs": runs})
    back = documents.parse(packed, ["paragraphs", "runs", "tables"], mode="FAILFAST")
    found = {x.para_ord: x.text for x in text.paragraph_text(back.paragraphs, back.runs).where("doc_id = 1").collect()}
    assert sorted(found.values()) == sorted(["ab", *(f"c{i}" for i in range(1, 9)), "c9!", "cell", ""])
    assert sorted((x.n_rows, x.n_cols) for x in back.tables.collect()) == [(1, 2), (2, 1), (3, 2)]
