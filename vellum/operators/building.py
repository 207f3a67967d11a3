"""Additions to documents: paragraphs, runs, links, tables, rows and cells; and values set on what is there.

Each operator takes tables of a corpus (``sources.wordml.TABLES`` with ``doc_id``) and rows that say where and what,
for any number of documents at once; what is added goes to the end of its home, several in the order of ``k``.
Defined results: null texts are empty; rows that name no paragraph, run, table or row of the corpus change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.names import REL_HYPERLINK
from .markdown_import import inline_tokens
from .text import PARA, RUN_ORDER

RUN = (*PARA, *RUN_ORDER)
#: What a run's content gets, and the text that it shows.
CONTENT = {"page_break": ("break", "page", "\n"), "line_break": ("break", None, "\n"), "tab": ("tab", None, "\t")}


def _added(table: DataFrame, new: DataFrame) -> DataFrame:
    """table and new rows, null where those lack a column."""
    columns = [(F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema.fields]
    return table.unionByName(new.select(*columns))


def _changed(table: DataFrame, at: DataFrame, keys: tuple[str, ...], values: dict) -> DataFrame:
    """table with new values in the rows whose keys ``at`` holds; values may use its other columns, prefixed by ``__``."""
    marks = at.select(*keys, *(F.col(c).alias(f"__{c}") for c in at.columns if c not in keys)).dropDuplicates(list(keys)).withColumn("__hit", F.lit(True))
    both = table.join(marks, list(keys), "left")
    return both.select(*(F.when(F.col("__hit"), values[c]).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c) if c in values else F.col(c) for c in table.columns))


def _place(new: DataFrame, home: DataFrame, position: str, keys: tuple[str, ...]) -> DataFrame:
    """new rows with the positions after the last of home's."""
    last = home.groupBy(*keys).agg(F.max(position).alias("__last"))
    w = Window.partitionBy(*keys).orderBy("k")
    return new.join(last, list(keys), "left").withColumn(position, (F.coalesce("__last", F.lit(-1)) + F.row_number().over(w)).cast("int")).drop("__last")


def cleared(tables: dict[str, DataFrame], documents: DataFrame, story: str = "body") -> dict[str, DataFrame]:
    """The tables without a story's paragraphs and tables, in these documents (doc_id); sections and all else stay."""
    gone = documents.select("doc_id").distinct().withColumn("story", F.lit(story))
    return {name: t.join(gone, ["doc_id", "story"], "left_anti").select(*t.columns) if "story" in t.columns else t for name, t in tables.items()}


def _block_numbers(paragraphs: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, story, block: the number of the last block."""
    blocks = paragraphs.select("doc_id", "story", "block_path").unionByName(tables.select("doc_id", "story", "block_path"))
    return blocks.groupBy("doc_id", "story").agg(F.max(F.col("block_path")[0]).alias("block"))


def add_paragraphs(paragraphs: DataFrame, tables: DataFrame, new: DataFrame) -> DataFrame:
    """paragraphs and, at the end of their stories, new ones (doc_id, story, k, and style, alignment, ... as wanted)."""
    w = Window.partitionBy("doc_id", "story").orderBy("k")
    placed = _place(new, paragraphs, "para_ord", ("doc_id", "story")).join(_block_numbers(paragraphs, tables), ["doc_id", "story"], "left")
    path = F.array((F.coalesce("block", F.lit(-1)) + F.row_number().over(w)).cast("int"))
    return _added(paragraphs, placed.withColumn("block_path", path).withColumn("in_table", F.lit(False)))


def add_table(paragraphs: DataFrame, tables: DataFrame, cells: DataFrame, documents: DataFrame, rows: int, cols: int, story: str = "body") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paragraphs, tables, cells) with one more table of empty paragraphs at the end of a story of each document (doc_id)."""
    at = documents.select("doc_id").distinct().withColumn("story", F.lit(story)).withColumn("k", F.lit(0))
    block = _block_numbers(paragraphs, tables).withColumn("block", F.col("block") + 1)
    last = paragraphs.groupBy("doc_id", "story").agg(F.max("para_ord").alias("__para"))
    table = _place(at, tables, "table_ord", ("doc_id", "story")).join(block, ["doc_id", "story"], "left").join(last, ["doc_id", "story"], "left")
    table = table.withColumn("block", F.coalesce("block", F.lit(0))).withColumn("block_path", F.array("block")).withColumn("n_rows", F.lit(rows)).withColumn("n_cols", F.lit(cols if rows else 0))
    spots = [F.struct(F.lit(i).alias("row_idx"), F.lit(j).alias("col_idx"), F.lit(i * cols + j).alias("__n")) for i in range(rows) for j in range(cols)]
    if not spots:
        return paragraphs, _added(tables, table), cells
    each = table.withColumn("__s", F.explode(F.array(*spots))).select("doc_id", "story", "table_ord", "block", "__para", "__s.*")
    inside = each.withColumn("para_ord", F.coalesce("__para", F.lit(-1)) + 1 + F.col("__n")).withColumn("block_path", F.array("block", "row_idx", "col_idx", F.lit(0))).withColumn("in_table", F.lit(True))
    return _added(paragraphs, inside), _added(tables, table), _added(cells, each)


def add_rows(tables: DataFrame, at: DataFrame) -> DataFrame:
    """tables with n empty rows more for those of ``at`` (doc_id, story, table_ord, n)."""
    return _changed(tables, at, ("doc_id", "story", "table_ord"), {"n_rows": F.col("n_rows") + F.col("__n")})


def add_cells(paragraphs: DataFrame, tables: DataFrame, cells: DataFrame, at: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paragraphs, tables, cells) with a cell, of one empty paragraph, at the end of each row of ``at`` (doc_id, story, table_ord, row_idx).

    ``n_cols`` is the width of a table's first row.
    """
    keys = ["doc_id", "story", "table_ord"]
    wanted = at.select(*keys, "row_idx").distinct().join(tables.select(*keys, "n_rows", F.col("block_path").alias("__path")), keys).where("row_idx >= 0 and row_idx < n_rows")
    placed = _place(wanted.withColumn("k", F.lit(0)), cells, "col_idx", (*keys, "row_idx"))
    inside = placed.withColumn("block_path", F.concat("__path", F.array(F.col("row_idx").cast("int"), F.col("col_idx"), F.lit(0)))).withColumn("in_table", F.lit(True)).withColumn("k", F.struct("table_ord", "row_idx"))
    first = placed.where("row_idx = 0").select(*keys)
    return _added(paragraphs, _place(inside, paragraphs, "para_ord", ("doc_id", "story"))), _changed(tables, first, tuple(keys), {"n_cols": F.col("n_cols") + 1}), _added(cells, placed)


def remove_rows(tables: dict[str, DataFrame], at: DataFrame) -> dict[str, DataFrame]:
    """The tables of a corpus without the table rows of ``at`` (doc_id, story, table_ord, row_idx) and all inside them; later rows move up.

    Takes and returns paragraphs, tables, cells and, where given, inlines and runs. A document's removed rows meet
    its paragraphs as one list. Paragraphs and tables keep their numbers.
    """
    home, keys = ["doc_id", "story"], ["doc_id", "story", "table_ord"]
    named = at.select(*keys, "row_idx").distinct().join(tables["tables"].select(*keys, "n_rows", "block_path"), keys).where("row_idx >= 0 and row_idx < n_rows")
    gone = named.groupBy(*home).agg(F.collect_list(F.struct(F.col("block_path").alias("path"), F.col("row_idx").cast("int").alias("row"))).alias("__gone"))
    inside = F.exists("__gone", lambda g: (F.size("block_path") > F.size(g["path"])) & (F.slice("block_path", 1, F.size(g["path"])) == g["path"]) & (F.get("block_path", F.size(g["path"])) == g["row"]))
    moved = F.transform("block_path", lambda x, i: x - F.size(F.filter("__gone", lambda g: (F.size(g["path"]) == i) & (F.slice("block_path", 1, i) == g["path"]) & (g["row"] < x))))

    def kept(t: DataFrame) -> DataFrame:
        both = t.join(gone, home, "left").where(F.col("__gone").isNull() | ~inside)
        return both.withColumn("block_path", F.when(F.col("__gone").isNull(), F.col("block_path")).otherwise(moved)).select(*t.columns)

    less = named.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col("row_idx").cast("int"))).alias("__rows"))
    paragraphs, left = kept(tables["paragraphs"]), kept(tables["tables"])
    cells = tables["cells"].join(left.select(*keys), keys, "left_semi").join(less, keys, "left")
    cells = cells.where(F.col("__rows").isNull() | ~F.array_contains("__rows", F.col("row_idx").cast("int")))
    cells = cells.withColumn("row_idx", F.when(F.col("__rows").isNull(), F.col("row_idx")).otherwise(F.col("row_idx") - F.size(F.filter("__rows", lambda r: r < F.col("row_idx")))).cast("int")).select(*tables["cells"].columns)
    width = cells.where("row_idx = 0").groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("__w"))
    left = left.join(less, keys, "left").join(width, keys, "left")
    left = left.withColumn("n_rows", F.when(F.col("__rows").isNull(), F.col("n_rows")).otherwise(F.col("n_rows") - F.size("__rows"))).withColumn("n_cols", F.when(F.col("__rows").isNull(), F.col("n_cols")).otherwise(F.coalesce("__w", F.lit(0))))
    out = tables | {"paragraphs": paragraphs, "tables": left.select(*tables["tables"].columns), "cells": cells}
    for name in ("inlines", "runs"):
        if name in tables:
            out[name] = tables[name].join(paragraphs.select(*PARA), list(PARA), "left_semi")
    return out


def _text_content(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("value"), F.lit(None).cast("string").alias("break_type"), F.lit(None).cast("int").alias("ref_id")))


def _run_rows(new: DataFrame, container: str) -> DataFrame:
    return new.withColumn("run_pos", F.lit(0)).withColumn("container", F.lit(container)).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("del_text", F.lit("")).withColumn("content", _text_content(F.col("text")))


def add_runs(inlines: DataFrame, runs: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inlines, runs) with new runs (doc_id, story, para_ord, k, text, and properties as wanted) at the ends of their paragraphs."""
    placed = _place(new, inlines, "inline_pos", PARA)
    return _added(inlines, placed.withColumn("kind", F.lit("run"))), _added(runs, _run_rows(placed, "run"))


def _relationships(rels: DataFrame, links: DataFrame, source: str, order: list[str]) -> DataFrame:
    """links with the rel_id and rel_pos of a new relationship each, after those of their document's source."""
    number = F.regexp_extract("rel_id", "^rId([0-9]+)$", 1).try_cast("long")
    last = rels.where(F.col("source_path") == source).groupBy("doc_id").agg(F.max(number).alias("__id"), F.max("rel_pos").alias("__pos"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    numbered = links.join(last, "doc_id", "left").withColumn("__n", n)
    return numbered.withColumn("rel_id", F.concat(F.lit("rId"), (F.coalesce("__id", F.lit(0)) + F.col("__n")).cast("string"))).withColumn("rel_pos", F.coalesce("__pos", F.lit(-1)) + F.col("__n")).drop("__id", "__pos", "__n")


def _link_rels(rels: DataFrame, links: DataFrame, source: str) -> DataFrame:
    return _added(rels, links.withColumn("source_path", F.lit(source)).withColumn("rel_type", F.lit(REL_HYPERLINK)).withColumn("target", F.col("url")).withColumn("external", F.lit(True)))


def add_hyperlinks(inlines: DataFrame, runs: DataFrame, rels: DataFrame, new: DataFrame, source: str = "word/document.xml") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inlines, runs, rels) with links (doc_id, story, para_ord, k, url, text) at the ends of their paragraphs; each is a relationship of its own."""
    placed = _relationships(rels, _place(new, inlines, "inline_pos", PARA), source, ["story", "para_ord", "inline_pos"])
    return _added(inlines, placed.withColumn("kind", F.lit("hyperlink"))), _added(runs, _run_rows(placed, "hyperlink")), _link_rels(rels, placed, source)


def set_markdown(inlines: DataFrame, runs: DataFrame, rels: DataFrame, new: DataFrame, source: str = "word/document.xml") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inlines, runs, rels) with the content of paragraphs replaced by inline Markdown (doc_id, story, para_ord, text); links become relationships."""
    tokens = inline_tokens(new.select(*PARA, F.coalesce("text", F.lit("")).alias("text"))).drop("text").withColumnRenamed("run_text", "text").withColumnRenamed("run_pos", "inline_pos")
    tokens = tokens.withColumn("font", F.when(F.col("code"), "Courier New")).withColumn("url", F.col("link"))
    for c in ("bold", "italic", "strike"):
        tokens = tokens.withColumn(c, F.when(F.col(c), True))
    links = _relationships(rels, tokens.where("link is not null"), source, ["story", "para_ord", "inline_pos"])
    plain, at = tokens.where("link is null"), new.select(*PARA).distinct()
    kept_inlines, kept_runs = (t.join(at, list(PARA), "left_anti").select(*t.columns) for t in (inlines, runs))
    inlines = _added(_added(kept_inlines, plain.withColumn("kind", F.lit("run"))), links.withColumn("kind", F.lit("hyperlink")))
    return inlines, _added(_added(kept_runs, _run_rows(plain, "run")), _run_rows(links, "hyperlink")), _link_rels(rels, links, source)


def set_run_text(runs: DataFrame, new: DataFrame) -> DataFrame:
    """runs with the texts of ``new`` (a run's keys and text) as all their content: tabs and breaks go."""
    text = F.coalesce(F.col("__text"), F.lit(""))
    return _changed(runs, new.select(*RUN, "text"), RUN, {"text": text, "del_text": F.lit(""), "content": _text_content(text)})


def add_content(runs: DataFrame, at: DataFrame, what: str) -> DataFrame:
    """runs with a page_break, line_break or tab at the end of those of ``at`` (a run's keys)."""
    kind, break_type, shown = CONTENT[what]
    more = F.array(F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(break_type).cast("string").alias("break_type"), F.lit(None).cast("int").alias("ref_id")))
    values = {"text": F.concat(F.coalesce("text", F.lit("")), F.lit(shown))}
    if "content" in runs.columns:
        values["content"] = F.concat(F.coalesce("content", F.array().cast(runs.schema["content"].dataType)), more.cast(runs.schema["content"].dataType))
    return _changed(runs, at.select(*RUN), RUN, values)


def set_alignment(paragraphs: DataFrame, at: DataFrame, alignment: str) -> DataFrame:
    """paragraphs with an alignment in those of ``at`` (doc_id, story, para_ord)."""
    return _changed(paragraphs, at.select(*PARA), PARA, {"alignment": F.lit(alignment)})


def set_table_style(tables: DataFrame, at: DataFrame, style: str) -> DataFrame:
    """tables with a style in those of ``at`` (doc_id, story, table_ord)."""
    keys = ("doc_id", "story", "table_ord")
    return _changed(tables, at.select(*keys), keys, {"style": F.lit(style)})


def set_properties(properties: DataFrame, new: DataFrame) -> DataFrame:
    """properties with the columns of ``new`` (doc_id and any of title, creator, description, ...) in its documents; null leaves a value, a document without properties gets some."""
    given = [c for c in new.columns if c != "doc_id"]
    marks = new.select("doc_id", *(F.col(c).alias(f"__{c}") for c in given)).dropDuplicates(["doc_id"])
    both = properties.join(marks, "doc_id", "full")
    return both.select(*(F.coalesce(f"__{c}", c).alias(c) if c in given else F.col(c) for c in properties.columns))
