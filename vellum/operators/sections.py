"""Page layout of a document's one body section, and its headers and footers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import twips_to_emu

MARGINS = ("top", "right", "bottom", "left", "header", "footer", "gutter")


def layout(sections: DataFrame) -> DataFrame:
    """One row per section: page size and margins in EMU, orientation, columns, break type, with their defaults."""
    size = [twips_to_emu(F.col(c)).alias(f"{c}_emu") for c in ("page_w", "page_h")]
    margins = [twips_to_emu(F.col(f"margin_{m}")).alias(f"margin_{m}_emu") for m in MARGINS if f"margin_{m}" in sections.columns]
    return sections.select("doc_id", *size, F.coalesce("orient", F.lit("portrait")).alias("orient"), *margins, F.coalesce(F.col("columns").try_cast("int"), F.lit(1)).alias("columns"), F.coalesce("break_type", F.lit("nextPage")).alias("break_type"))


def with_layout(sections: DataFrame, page_size_emu: tuple[int, int] | None = None, orient: str | None = None, margins_emu: dict[str, int] | None = None, columns: int | None = None, break_type: str | None = None) -> DataFrame:
    """sections with the given values set; lengths go to whole twips, and the orientation never swaps the sides."""
    values: dict[str, str] = {}
    if page_size_emu:
        values |= {"page_w": str(page_size_emu[0] // 635), "page_h": str(page_size_emu[1] // 635)}
    if orient:
        values["orient"] = orient
    values |= {f"margin_{k}": str(v // 635) for k, v in (margins_emu or {}).items()}
    if columns is not None:
        values["columns"] = str(columns)
    if break_type:
        values["break_type"] = break_type
    for c, v in values.items():
        sections = sections.withColumn(c, F.lit(v))
    return sections


def with_hdrftr(hdrftr: DataFrame, documents: DataFrame, is_header: bool, variant: str = "default") -> DataFrame:
    """hdrftr with one more header or footer for each document; part numbers go on after the largest of the kind."""
    if variant not in ("default", "first", "even"):
        raise ValueError(f"variant: {variant}")
    word = "header" if is_header else "footer"
    number = F.regexp_extract("part_path", word + "([0-9]+)\\.xml$", 1).try_cast("int")
    last = hdrftr.where(F.col("is_header") == is_header).groupBy("doc_id").agg(F.max(number).alias("__n"))
    ids = hdrftr.groupBy("doc_id").agg(F.max(F.regexp_extract("rel_id", "^rId([0-9]+)$", 1).try_cast("int")).alias("__r"))
    new = documents.select("doc_id").distinct().join(last, "doc_id", "left").join(ids, "doc_id", "left")
    return hdrftr.unionByName(new.select("doc_id", F.concat(F.lit(f"word/{word}"), (F.coalesce("__n", F.lit(0)) + 1).cast("string"), F.lit(".xml")).alias("part_path"), F.concat(F.lit("rId"), (F.coalesce("__r", F.lit(0)) + 1).cast("string")).alias("rel_id"), F.lit(is_header).alias("is_header"), F.lit(variant).alias("variant")))


def variants(hdrftr: DataFrame, references: DataFrame) -> DataFrame:
    """hdrftr with the variant that the section's references (doc_id, rel_id, variant) give, default without one."""
    w = Window.partitionBy("doc_id", "rel_id").orderBy("ref_pos")
    first = references.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("doc_id", "rel_id", F.col("variant").alias("__v"))
    return hdrftr.drop("variant").join(first, ["doc_id", "rel_id"], "left").withColumn("variant", F.coalesce("__v", F.lit("default"))).drop("__v")
