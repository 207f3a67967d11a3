"""Styles: the built-in ones, lookup, adding, and setting their properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = ("style_id", "name", "type", "is_default", "based_on", "next", "font", "size_half_pt", "color", "bold", "italic", "keep_next", "keep_lines", "space_before", "space_after", "outline_level", "indent_left", "indent_right")
SCHEMA = "style_id string, name string, type string, is_default boolean, based_on string, next string, font string, size_half_pt string, color string, bold boolean, italic boolean, keep_next boolean, keep_lines boolean, space_before string, space_after string, outline_level int, indent_left string, indent_right string"

#: The built-in styles in their order (fixed values).
BUILT_IN = (
    {"style_id": "Normal", "name": "Normal", "type": "paragraph", "is_default": True},
    {"style_id": "DefaultParagraphFont", "name": "Default Paragraph Font", "type": "character", "is_default": True},
    {"style_id": "TableNormal", "name": "Normal Table", "type": "table", "is_default": True},
    {"style_id": "NoList", "name": "No List", "type": "numbering", "is_default": True},
    {"style_id": "Heading1", "name": "heading 1", "size_half_pt": "32", "color": "2F5496", "space_before": "240", "outline_level": 0},
    {"style_id": "Heading2", "name": "heading 2", "size_half_pt": "26", "color": "2F5496", "space_before": "40", "outline_level": 1},
    {"style_id": "Heading3", "name": "heading 3", "size_half_pt": "24", "color": "1F3763", "space_before": "40", "outline_level": 2},
    {"style_id": "Heading4", "name": "heading 4", "size_half_pt": "22", "color": "2F5496", "italic": True, "space_before": "40", "outline_level": 3},
    {"style_id": "Heading5", "name": "heading 5", "size_half_pt": "22", "color": "2F5496", "space_before": "40", "outline_level": 4},
    {"style_id": "Heading6", "name": "heading 6", "size_half_pt": "22", "color": "1F3763", "italic": True, "space_before": "40", "outline_level": 5},
    {"style_id": "Title", "name": "Title", "type": "paragraph", "based_on": "Normal", "next": "Normal", "font": "Calibri Light", "size_half_pt": "56", "space_after": "0"},
    {"style_id": "Subtitle", "name": "Subtitle", "type": "paragraph", "based_on": "Normal", "next": "Normal", "color": "5A5A5A"},
    {"style_id": "ListParagraph", "name": "List Paragraph", "type": "paragraph", "based_on": "Normal", "indent_left": "720"},
    {"style_id": "Quote", "name": "Quote", "type": "paragraph", "based_on": "Normal", "next": "Normal", "italic": True, "color": "404040", "indent_left": "720", "indent_right": "720", "space_before": "200"},
    {"style_id": "IntenseQuote", "name": "Intense Quote", "type": "paragraph", "based_on": "Normal", "next": "Normal", "bold": True, "color": "2F5496", "indent_left": "720", "indent_right": "720", "space_before": "200"},
    {"style_id": "NoSpacing", "name": "No Spacing", "type": "paragraph", "based_on": "Normal", "space_after": "0"},
    {"style_id": "Strong", "name": "Strong", "type": "character", "bold": True},
    {"style_id": "Emphasis", "name": "Emphasis", "type": "character", "italic": True},
)
#: What all built-in headings have (fixed values).
HEADING = {"type": "paragraph", "based_on": "Normal", "next": "Normal", "font": "Calibri Light", "keep_next": True, "keep_lines": True, "space_after": "0"}


def built_in_rows() -> list[dict]:
    return [(HEADING | s if "type" not in s else s) | {"style_pos": i} for i, s in enumerate(BUILT_IN)]


def built_in(spark: SparkSession) -> DataFrame:
    """The 18 built-in styles with their order as style_pos."""
    rows = [tuple(s.get(c) for c in COLUMNS) + (s["style_pos"],) for s in built_in_rows()]
    return spark.createDataFrame(rows, SCHEMA + ", style_pos int")


def ensured(styles: DataFrame, wanted: DataFrame) -> DataFrame:
    """styles with the wanted (doc_id, style_id) built-in ones that their document lacks; unknown ids add nothing."""
    known = F.broadcast(built_in(styles.sparkSession))  # 18 rows
    missing = wanted.select("doc_id", "style_id").distinct().join(styles, ["doc_id", "style_id"], "left_anti").join(known.withColumnRenamed("style_pos", "__order"), "style_id")
    last = styles.groupBy("doc_id").agg(F.max("style_pos").alias("__last"))
    w = Window.partitionBy("doc_id").orderBy("__order")
    new = missing.join(last, "doc_id", "left").withColumn("style_pos", (F.coalesce("__last", F.lit(-1)) + F.row_number().over(w)).cast("int"))
    return styles.unionByName(new.select(*styles.columns))


def lookup(styles: DataFrame, column: str, value: str) -> DataFrame:
    """The first style of each document whose id (or name) is the value; case counts."""
    w = Window.partitionBy("doc_id").orderBy("style_pos")
    return styles.where(F.col(column) == value).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def by_id(styles: DataFrame, style_id: str) -> DataFrame:
    return lookup(styles, "style_id", style_id)


def by_name(styles: DataFrame, name: str) -> DataFrame:
    return lookup(styles, "name", name)


def added(styles: DataFrame, documents: DataFrame, style_id: str, name: str, type_: str = "paragraph") -> DataFrame:
    """styles with one more for each document (doc_id); an empty id is refused, a repeated one is not."""
    if not style_id:
        raise ValueError("a style needs an id")
    last = styles.groupBy("doc_id").agg(F.max("style_pos").alias("__last"))
    values = {"style_id": F.lit(style_id), "name": F.lit(name), "type": F.lit(type_), "is_default": F.lit(False), "style_pos": (F.coalesce("__last", F.lit(-1)) + 1).cast("int")}
    new = documents.select("doc_id").distinct().join(last, "doc_id", "left")
    return styles.unionByName(new.select(*(F.col("doc_id") if f.name == "doc_id" else values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in styles.schema)))


#: Settable properties and their columns.
SETTABLE = {"based_on", "next", "font", "size_half_pt", "color", "bold", "italic", "alignment", "space_before", "space_after", "line", "line_rule", "outline_level", "keep_next", "keep_lines", "indent_left", "indent_right"}


def with_properties(styles: DataFrame, style_id: str, **values) -> DataFrame:
    """styles with properties of one id set; size_pt sets half points."""
    if "size_pt" in values:
        values["size_half_pt"] = f"{2 * values.pop('size_pt'):g}"
    if unknown := set(values) - SETTABLE:
        raise ValueError(f"no such properties: {sorted(unknown)}")
    for c, v in values.items():
        old = F.col(c) if c in styles.columns else F.lit(None)
        styles = styles.withColumn(c, F.when(F.col("style_id") == style_id, F.lit(v)).otherwise(old))
    return styles
