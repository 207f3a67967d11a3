"""Comments: anchored ranges, lookup by text, adding and removing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import PARA


def ranges(inlines: DataFrame) -> DataFrame:
    """doc_id, ref_id, first and last paragraph, and the place of the end marker. A repeated start marker keeps the last before the end."""
    starts = inlines.where("kind = 'commentRangeStart'").groupBy("doc_id", "ref_id").agg(F.max(F.struct("para_ord", "inline_pos")).alias("s"))
    ends = inlines.where("kind = 'commentRangeEnd'").groupBy("doc_id", "ref_id").agg(F.min(F.struct("para_ord", "inline_pos")).alias("e"))
    return starts.join(ends, ["doc_id", "ref_id"]).where("s <= e").select("doc_id", "ref_id", F.col("s.para_ord").alias("first"), F.col("e.para_ord").alias("last"), F.col("e").alias("end"))


def comments_for_text(comments: DataFrame, inlines: DataFrame, paragraph_texts: DataFrame, needle: str) -> DataFrame:
    """Comments whose paragraphs, from the one of the start marker to that of the end marker, together hold the text (case counts). In the order of end markers."""
    r = ranges(inlines)
    texts = paragraph_texts.select("doc_id", "para_ord", "text")
    inside = r.withColumn("para_ord", F.explode(F.sequence("first", "last"))).join(texts, ["doc_id", "para_ord"])
    whole = inside.groupBy("doc_id", "ref_id", "end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_ord", "text"))), lambda x: x["text"]), "").alias("__text"))
    hit = whole.where(F.col("__text").contains(needle))
    w = Window.partitionBy("doc_id").orderBy("end", "ref_id")
    return comments.join(hit.select("doc_id", F.col("ref_id").alias("comment_id"), "end"), ["doc_id", "comment_id"]).withColumn("rank", F.row_number().over(w.orderBy("end", "comment_id"))).drop("end")


def next_id(table: DataFrame, column: str = "comment_id") -> DataFrame:
    """doc_id and the next free id: one more than the largest."""
    return table.groupBy("doc_id").agg((F.coalesce(F.max(column), F.lit(-1)) + 1).alias("next_id"))


def add_comments(comments: DataFrame, anchors: DataFrame, author: str = "Unknown", date: str | None = None, initials: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(comments, new markers) with a comment for each anchor: doc_id, para_ord, first and last inline position, text.

    Several anchors of a document get consecutive ids after its largest. New markers stand at half positions
    (before the first and after the last inline) and are renumbered by ``renumbered``.
    """
    largest = comments.groupBy("doc_id").agg(F.max("comment_id").alias("__max"), F.max("comment_pos").alias("__pos"))
    w = Window.partitionBy("doc_id").orderBy("para_ord", "first", "last", "text")
    numbered = anchors.join(largest, "doc_id", "left").withColumn("__k", F.row_number().over(w))
    new = numbered.select("doc_id", (F.coalesce("__pos", F.lit(-1)) + F.col("__k")).cast("int").alias("comment_pos"), (F.coalesce("__max", F.lit(-1)) + F.col("__k")).cast("int").alias("comment_id"), F.lit(author).alias("author"), F.lit(date).alias("date_str"), F.lit(initials).alias("initials"), "text", "para_ord", "first", "last")
    marker = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.alias("at"))
    markers = new.select("doc_id", "para_ord", F.col("comment_id").alias("ref_id"), F.explode(F.array(marker("commentRangeStart", F.col("first") - 0.5), marker("commentRangeEnd", F.col("last") + 0.25), marker("commentReference", F.col("last") + 0.5))).alias("m")).select("doc_id", "para_ord", "ref_id", "m.kind", F.col("m.at").alias("inline_pos"))
    return comments.unionByName(new.select(*comments.columns)), markers


def remove_comments(comments: DataFrame, inlines: DataFrame, which: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(comments, inlines) without the comments of which (doc_id, comment_id) and their markers and references."""
    left = comments.join(which.select("doc_id", "comment_id"), ["doc_id", "comment_id"], "left_anti")
    marks = inlines.where(F.col("kind").isin("commentRangeStart", "commentRangeEnd", "commentReference")).join(which.select("doc_id", F.col("comment_id").alias("ref_id")), ["doc_id", "ref_id"], "left_semi").select(*PARA, "inline_pos", "kind")
    return left, inlines.join(marks, [*PARA, "inline_pos", "kind"], "left_anti")


def renumbered(inlines: DataFrame, *keys: str) -> DataFrame:
    """inline_pos as 0, 1 ... in each paragraph, in its present order."""
    w = Window.partitionBy(*(keys or PARA)).orderBy("inline_pos")
    return inlines.withColumn("inline_pos", F.row_number().over(w) - 1)


def footnotes(comments: DataFrame) -> DataFrame:
    """doc_id, text: the comments as ``[^i]: author: text``, a line each, in their order."""
    w = Window.partitionBy("doc_id").orderBy("comment_pos")
    line: Column = F.concat(F.lit("[^"), F.row_number().over(w).cast("string"), F.lit("]: "), F.col("author"), F.lit(": "), F.col("text"))
    listed = comments.select("doc_id", "comment_pos", line.alias("line"))
    return listed.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("comment_pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
