"""Text projections: ordered concatenation of runs, paragraphs, cells and stories.

Tables are those of ``sources.wordml.TABLES``. Every aggregate is ordered by explicit positions, never by arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARA = ("doc_id", "story", "para_ord")
RUN_ORDER = ("inline_pos", "run_pos")


def joined(value: Column, order: list[str] | tuple[str, ...], separator: str = "") -> Column:
    """An aggregate: the values in order, with a separator between them."""
    rows = F.array_sort(F.collect_list(F.struct(*(F.col(c) for c in order), F.coalesce(value, F.lit("")).alias("__v"))))
    return F.array_join(F.transform(rows, lambda r: r["__v"]), separator)


def content_text(content: Column) -> Column:
    """The text of a run's content: text, a tab for tabs, a line end for breaks, nothing for all else."""
    return F.array_join(F.transform(content, lambda x: F.when(x["kind"] == "text", F.coalesce(x["value"], F.lit(""))).when(x["kind"] == "tab", "\t").when(x["kind"] == "break", "\n").otherwise("")), "")


def deleted_text(content: Column) -> Column:
    return F.array_join(F.transform(F.filter(content, lambda x: x["kind"] == "delText"), lambda x: F.coalesce(x["value"], F.lit(""))), "")


def paragraph_text(paragraphs: DataFrame, runs: DataFrame) -> DataFrame:
    """paragraphs with ``text``: direct, inserted and linked runs; deleted ones are left out.

    Both sides grow with the corpus, and Spark takes exploded rows to be as large as the file before: neither is broadcast.
    """
    texts = runs.where("container != 'del'").groupBy(*PARA).agg(joined(F.col("text"), RUN_ORDER).alias("text"))
    return paragraphs.hint("merge").join(texts, list(PARA), "left").withColumn("text", F.coalesce("text", F.lit("")))


def cell_text(cells: DataFrame) -> DataFrame:
    """One text per cell (doc_id, table_ord, row_idx, col_idx): its paragraphs without a separator."""
    return cells.groupBy("doc_id", "table_ord", "row_idx", "col_idx").agg(joined(F.col("text"), ["para_idx"]).alias("text"))


def table_text(cell_texts: DataFrame) -> DataFrame:
    """One text per table: cells with tabs, rows with line ends."""
    rows = cell_texts.groupBy("doc_id", "table_ord", "row_idx").agg(joined(F.col("text"), ["col_idx"], "\t").alias("text"))
    return rows.groupBy("doc_id", "table_ord").agg(joined(F.col("text"), ["row_idx"], "\n").alias("text"))


def table_shape(cell_texts: DataFrame) -> DataFrame:
    """Rows, and columns of the first row."""
    return cell_texts.groupBy("doc_id", "table_ord").agg((F.max("row_idx") + 1).alias("n_rows"), F.sum((F.col("row_idx") == 0).cast("long")).alias("n_cols"))


def story_text(blocks: DataFrame) -> DataFrame:
    """One text per story of blocks (doc_id, story, block_pos, text): blocks with line ends, empty ones too."""
    return blocks.groupBy("doc_id", "story").agg(joined(F.col("text"), ["block_pos"], "\n").alias("text"))


def document_text(body: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """doc_id, text of the body story (doc_id, text); with comments (doc_id, comment_pos, text) the non-empty ones follow, a line each."""
    if comments is None:
        return body.select("doc_id", "text")
    notes = comments.where("text != ''").groupBy("doc_id").agg(joined(F.col("text"), ["comment_pos"], "\n").alias("__notes"))
    whole = F.when(F.col("__notes").isNull(), F.col("text")).when(F.col("text") == "", F.col("__notes")).otherwise(F.concat("text", F.lit("\n"), "__notes"))
    return body.join(notes, "doc_id", "left").select("doc_id", whole.alias("text"))
