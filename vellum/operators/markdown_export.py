"""Markdown of paragraphs, tables, stories and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markup import is_code, link_markdown, paragraph_markdown, run_markdown
from .comments import footnotes
from .text import PARA, RUN_ORDER, joined


def runs_markdown(runs: DataFrame) -> DataFrame:
    """runs with ``md``; links need ``url`` on linked runs."""
    md = run_markdown(F.col("text"), F.col("bold"), F.col("italic"), F.col("strike"), is_code(F.col("style"), F.col("font")))
    return runs.withColumn("md", md)


def paragraphs_markdown(paragraphs: DataFrame, runs: DataFrame) -> DataFrame:
    """paragraphs (style, ilvl, num_id) with ``md``: direct, inserted and linked runs; deletions are left out. runs may have ``url``."""
    shown = runs_markdown(runs).where("container != 'del'")
    if "url" not in runs.columns:
        shown = shown.withColumn("url", F.lit(None).cast("string"))
    # the runs of one link are one link
    inline = shown.groupBy(*PARA, "inline_pos").agg(joined(F.col("md"), ["run_pos"]).alias("md"), F.max("url").alias("url"), F.max(F.col("container")).alias("container"))
    whole = inline.withColumn("md", F.when(F.col("container") == "hyperlink", link_markdown(F.col("md"), F.col("url"))).otherwise(F.col("md"))).groupBy(*PARA).agg(joined(F.col("md"), ["inline_pos"]).alias("__md"))
    out = paragraphs.hint("merge").join(whole, list(PARA), "left")  # never broadcast: see text.paragraph_text
    return out.withColumn("md", paragraph_markdown(F.coalesce("__md", F.lit("")), F.col("style"), F.col("ilvl"), F.col("num_id"))).drop("__md")


def table_markdown(cells: DataFrame) -> DataFrame:
    """doc_id, table_ord, md of cells (doc_id, table_ord, row_idx, col_idx, md): padded to the header cell's width, three at least."""
    heads = cells.where("row_idx = 0").select("doc_id", "table_ord", "col_idx", F.greatest(F.length("md"), F.lit(3)).alias("width"))
    padded = cells.join(heads, ["doc_id", "table_ord", "col_idx"], "left").withColumn("width", F.coalesce("width", F.lit(3)))
    cell = F.when(F.length("md") < F.col("width"), F.rpad("md", F.col("width"), F.lit(" "))).otherwise(F.col("md"))
    lines = padded.withColumn("cell", cell).groupBy("doc_id", "table_ord", "row_idx").agg(joined(F.col("cell"), ["col_idx"], " | ").alias("body"), joined(F.repeat(F.lit("-"), F.col("width")), ["col_idx"], " | ").alias("rule"))
    line = lambda c: F.concat(F.lit("| "), c, F.lit(" |"))
    md = F.when(F.col("row_idx") == 0, F.concat(line(F.col("body")), F.lit("\n"), line(F.col("rule")))).otherwise(line(F.col("body")))
    return lines.withColumn("md", md).groupBy("doc_id", "table_ord").agg(joined(F.col("md"), ["row_idx"], "\n").alias("md"))


def cell_markdown(cell_paragraphs: DataFrame) -> DataFrame:
    """doc_id, table_ord, row_idx, col_idx, md: non-empty paragraphs (para_idx, md) joined by a space."""
    return cell_paragraphs.groupBy("doc_id", "table_ord", "row_idx", "col_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("md") != "", F.struct("para_idx", "md")))), lambda x: x["md"]), " ").alias("md"))


def document_markdown(blocks: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """doc_id, md of blocks (doc_id, block_pos, md) separated by blank lines; comments follow as footnotes."""
    body = blocks.groupBy("doc_id").agg(joined(F.col("md"), ["block_pos"], "\n\n").alias("md"))
    if comments is None:
        return body
    notes = footnotes(comments).select("doc_id", F.col("text").alias("__notes"))
    return body.join(notes, "doc_id", "left").select("doc_id", F.when(F.col("__notes").isNull(), F.col("md")).otherwise(F.concat("md", F.lit("\n\n"), "__notes")).alias("md"))


__all__ = ["RUN_ORDER", "cell_markdown", "document_markdown", "paragraphs_markdown", "runs_markdown", "table_markdown"]
