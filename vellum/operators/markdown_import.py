"""Markdown as paragraphs, runs and tables: lines are classified and grouped by windows, inline marks are scanned from left to right."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = "^[0-9]+\\. "


def lines_of(documents: DataFrame, text: str = "md") -> DataFrame:
    """doc_id, line_no, line."""
    return documents.select("doc_id", F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))


def classified(lines: DataFrame) -> DataFrame:
    """lines with ``kind``: fence, code, rule, heading, quote, bullet, number, table, blank or text; the first that holds."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    fence = F.col("line").startswith("```")
    inside = F.sum(fence.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)) % 2 == 1
    trimmed = F.trim("line")
    kind = (
        F.when(fence, "fence").when(F.coalesce(inside, F.lit(False)), "code").when(trimmed.rlike("^(-{3,}|\\*{3,}|_{3,})$"), "rule").when(F.col("line").rlike("^#{1,6}( |$)"), "heading").when(F.col("line").startswith(">"), "quote")
        .when(F.col("line").rlike("^[-*+] "), "bullet").when(F.col("line").rlike(DIGITS), "number").when(trimmed.startswith("|"), "table").when(trimmed == "", "blank").otherwise("text")
    )
    return lines.withColumn("kind", kind)


def _groups(rows: DataFrame) -> DataFrame:
    """Lines of one block share ``first_line``: neighbouring text or table lines; every other line is a block."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    starts = (F.lag("kind").over(w) != F.col("kind")) | F.lag("kind").over(w).isNull() | ~F.col("kind").isin("text", "table")
    return rows.withColumn("first_line", F.max(F.when(starts, F.col("line_no"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def style_of(kind: Column, line: Column) -> Column:
    level = F.length(F.regexp_extract(line, "^(#{1,6})", 1))
    return F.when(kind == "heading", F.concat(F.lit("Heading"), level.cast("string"))).when(kind == "quote", "Quote").when(kind == "bullet", "ListBullet").when(kind == "number", "ListNumber").otherwise("")


def line_text(kind: Column, line: Column) -> Column:
    """The text of a block line: marks stripped, bullets as a dot, numbers kept."""
    return (
        F.when(kind == "heading", F.trim(F.regexp_replace(line, "^#{1,6}", ""))).when(kind == "quote", F.trim(F.substring(line, 2, 1 << 30))).when(kind == "bullet", F.concat(F.lit("• "), F.substring(line, 3, 1 << 30))).when(kind == "rule", "").otherwise(line)
    )


def paragraphs(documents: DataFrame, text: str = "md") -> DataFrame:
    """doc_id, para_ord, kind, style, text of all paragraphs outside tables; neighbouring text lines are joined by a space."""
    rows = _groups(classified(lines_of(documents, text))).where(~F.col("kind").isin("fence", "blank", "table"))
    each = rows.select("doc_id", "first_line", "line_no", "kind", style_of(F.col("kind"), F.col("line")).alias("style"), line_text(F.col("kind"), F.col("line")).alias("text"))
    merged = each.groupBy("doc_id", "first_line").agg(F.min("kind").alias("kind"), F.min("style").alias("style"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("text"))
    w = Window.partitionBy("doc_id").orderBy("first_line")
    return merged.withColumn("para_ord", F.row_number().over(w) - 1).select("doc_id", "para_ord", "first_line", "kind", "style", "text")


def table_cells(documents: DataFrame, text: str = "md") -> DataFrame:
    """doc_id, table_ord, row_idx, col_idx, text: separator rows dropped, short rows padded, cells trimmed."""
    rows = _groups(classified(lines_of(documents, text))).where("kind = 'table'")
    inner = F.regexp_replace(F.regexp_replace(F.trim("line"), "^\\|", ""), "\\|$", "")
    parts = F.transform(F.split(inner, "\\|", -1), lambda c: F.trim(c))
    split = rows.select("doc_id", "first_line", "line_no", parts.alias("parts")).where(~F.forall("parts", lambda c: c.rlike("^:?-+:?$")))
    table = Window.partitionBy("doc_id").orderBy("first_line")
    inside = Window.partitionBy("doc_id", "first_line")
    placed = split.withColumn("table_ord", F.dense_rank().over(table) - 1).withColumn("row_idx", F.row_number().over(inside.orderBy("line_no")) - 1).withColumn("width", F.max(F.size("parts")).over(inside))
    cell = F.posexplode(F.transform(F.sequence(F.lit(1), "width"), lambda i: F.coalesce(F.try_element_at("parts", i), F.lit(""))))
    return placed.select("doc_id", "table_ord", "row_idx", cell.alias("col_idx", "text"))


@dataclass
class Inline:
    text: str
    bold: bool = False
    italic: bool = False
    strike: bool = False
    code: bool = False
    link: str | None = None


#: Delimiters, longest first where one begins with another, and what they set.
_MARKS = (("`", {"code": True}), ("~~", {"strike": True}), ("***", {"bold": True, "italic": True}), ("**", {"bold": True}), ("*", {"italic": True}))


def inline_runs(text: str) -> list[Inline]:
    """Runs of one line's inline marks: the first closing delimiter ends a mark, marks do not nest, an open one is literal text.

    After an open delimiter of n characters the last n - 1 characters of the text are scanned again.
    """
    out: list[Inline] = []
    plain, at = "", 0
    while at < len(text):
        mark = next(((d, on) for d, on in _MARKS if text.startswith(d, at)), None)
        if mark is None and text[at] != "[":
            plain += text[at]
            at += 1
            continue
        if plain:
            out.append(Inline(plain))
            plain = ""
        if mark is None:
            at = _link(text, at, out)
            continue
        delimiter, on = mark
        start = at + len(delimiter)
        end = text.find(delimiter, start)
        if end >= 0:
            out.append(Inline(text[start:end], **on))
            at = end + len(delimiter)
        else:
            at = max(start, len(text) - len(delimiter) + 1)
            out.append(Inline(delimiter + text[start:at]))
    if plain:
        out.append(Inline(plain))
    return out


def _link(text: str, at: int, out: list[Inline]) -> int:
    close = text.find("]", at + 1)
    if close < 0:
        out.append(Inline(text[at:]))
        return len(text)
    label = text[at + 1 : close]
    if not text.startswith("(", close + 1):
        out.append(Inline(text[at : close + 1]))
        return close + 1
    end = text.find(")", close + 2)
    end = len(text) if end < 0 else end
    out.append(Inline(label, link=text[close + 2 : end]))
    return min(end + 1, len(text))


TOKENS = pa.list_(pa.struct([("text", pa.string()), ("bold", pa.bool_()), ("italic", pa.bool_()), ("strike", pa.bool_()), ("code", pa.bool_()), ("link", pa.string())]))


def _tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        literal = batch.column("literal").to_pylist() if "literal" in batch.schema.names else [False] * batch.num_rows
        found = [[vars(r) for r in ([Inline(x, code=True)] if code else inline_runs(x or ""))] for x, code in zip(batch.column("text").to_pylist(), literal, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, TOKENS)], names=[*batch.schema.names, "tokens"])


def inline_tokens(rows: DataFrame) -> DataFrame:
    """rows (with ``text``) and, for each run of their inline marks: run_pos, run_text, bold, italic, strike, code, link. Where rows have a true ``literal``, the text is one run of code."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", tokens array<struct<text:string,bold:boolean,italic:boolean,strike:boolean,code:boolean,link:string>>"
    found = rows.mapInArrow(_tokens, schema)
    return found.select(*rows.columns, F.posexplode("tokens").alias("run_pos", "t")).select(*rows.columns, "run_pos", F.col("t.text").alias("run_text"), "t.bold", "t.italic", "t.strike", "t.code", "t.link")


def import_markdown(documents: DataFrame, text: str = "md") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paragraphs, runs, cells) of Markdown documents; runs carry font Courier New for code, and the link's target."""
    paras = paragraphs(documents, text)
    marked = inline_tokens(paras.select("doc_id", "para_ord", "text", (F.col("kind") == "code").alias("literal")))
    runs = marked.select("doc_id", "para_ord", "run_pos", F.col("run_text").alias("text"), "bold", "italic", "strike", F.when(F.col("code"), "Courier New").alias("font"), "link")
    return paras, runs, table_cells(documents, text)


def insert_after(blocks: DataFrame, new: DataFrame, at: DataFrame) -> DataFrame:
    """blocks with new ones (doc_id, block_pos, ...) after the position ``at`` (doc_id, after) of their document, or at its end where none is given; positions renumbered."""
    placed = new.join(at, "doc_id", "left").withColumn("__k", F.struct(F.coalesce(F.col("after").cast("long"), F.lit(1 << 40)), F.lit(1), F.col("block_pos").cast("long"))).drop("after")
    old = blocks.withColumn("__k", F.struct(F.col("block_pos").cast("long"), F.lit(0), F.lit(0).cast("long")))
    both = old.unionByName(placed)
    return both.withColumn("block_pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("__k")) - 1).drop("__k")
