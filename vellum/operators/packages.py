"""Package rules as relational predicates: security checks of archive entries, content types, relationships."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Extensions of parts that are binary whatever their content type (fixed values).
BINARY_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "bmp", "tiff", "emf", "wmf")


@dataclass(frozen=True)
class Limits:
    """What a package may hold (default values are fixed)."""

    total: int = 500 << 20
    part: int = 100 << 20
    entries: int = 10_000
    ratio: int = 100


def cleaned(path: Column) -> Column:
    """A path without empty and single-dot segments; parent segments take back what stands before them."""
    step = lambda out, s: F.when((s == "") | (s == "."), out).when((s == "..") & (F.size(out) > 0) & (F.element_at(out, -1) != ".."), F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def unsafe_path(path: Column) -> Column:
    return F.contains(path, F.lit("\x00")) | F.contains(path, F.lit("\\")) | path.startswith("/") | cleaned(path).startswith("..") | F.array_contains(F.split(path, "/"), "..")


def first_fault(entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, check, entry_pos of the first rule that an archive's entries (doc_id, entry_pos, path, compressed, uncompressed) break, or no row.

    The number of entries comes first; then, entry by entry: path, duplicate (in any case), ratio, size, total.
    """
    whole, so_far = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("entry_pos").rowsBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy("doc_id", F.lower("path")).orderBy("entry_pos")
    checked = entries.withColumn("check", F.when(F.count(F.lit(1)).over(whole) > limits.entries, "file_count").when(unsafe_path(F.col("path")), "path_traversal").when(F.row_number().over(same) > 1, "duplicate_entry").when(F.expr("uncompressed div greatest(compressed, 1)") > limits.ratio, "zip_bomb").when(F.col("uncompressed") > limits.part, "part_size").when(F.sum("uncompressed").over(so_far) > limits.total, "total_size"))
    return checked.where("check is not null").groupBy("doc_id").agg(F.min(F.struct("entry_pos", "check")).alias("f")).select("doc_id", "f.check", "f.entry_pos")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./]*)$", 1))


def content_type(path: Column, overrides: Column, defaults: Column) -> Column:
    """The override of the path, with or without a leading slash; else the extension's default; else empty."""
    bare = F.regexp_replace(path, "^/", "")
    return F.coalesce(F.try_element_at(overrides, F.concat(F.lit("/"), bare)), F.try_element_at(overrides, bare), F.try_element_at(defaults, extension(path)), F.lit(""))


def is_binary(path: Column, type_: Column) -> Column:
    return F.contains(type_, F.lit("image")) | extension(path).isin(*BINARY_EXTENSIONS)


def is_rels(path: Column) -> Column:
    return path.rlike("_rels/[^/]*\\.rels$")


def rels_source(path: Column) -> Column:
    """The part whose relationships a rels part holds; empty for the package's."""
    return F.regexp_replace(path, "_rels/([^/]*)\\.rels$", "$1")


def source_rels(path: Column) -> Column:
    """The rels part of a part; of the package, for an empty path."""
    return F.when(path == "", "_rels/.rels").otherwise(F.regexp_replace(path, "([^/]+)$", "_rels/$1.rels"))


def resolved(source: Column, target: Column) -> Column:
    """A target relative to its source's folder; an absolute one from the root."""
    folder = F.regexp_extract(source, "^(.*/)?[^/]*$", 1)
    return F.when(target.startswith("/"), cleaned(target)).otherwise(cleaned(F.concat(folder, target)))


def first_of_type(rels: DataFrame, type_: str) -> DataFrame:
    """The first relationship of a type for each source."""
    w = Window.partitionBy("doc_id", "source_path").orderBy("rel_pos")
    return rels.where(F.col("rel_type") == type_).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def next_rel_id(rels: DataFrame) -> DataFrame:
    """doc_id, source_path, next_id: rId and one more than the largest number."""
    number = F.regexp_extract("rel_id", "^rId([0-9]+)$", 1).try_cast("long")
    return rels.groupBy("doc_id", "source_path").agg(F.concat(F.lit("rId"), (F.coalesce(F.max(number), F.lit(0)) + 1).cast("string")).alias("next_id"))


def hyperlink_urls(links: DataFrame, rels: DataFrame) -> DataFrame:
    """links (doc_id, rel_id, anchor) with url: the anchor without an id, the relationship's target, or empty. Of repeated ids the last counts."""
    target = rels.where(F.col("rel_type").endswith("/hyperlink")).groupBy("doc_id", "rel_id").agg(F.max_by("target", "rel_pos").alias("__target"))
    out = links.join(target, ["doc_id", "rel_id"], "left")
    return out.withColumn("url", F.when(F.coalesce("rel_id", F.lit("")) == "", F.coalesce("anchor", F.lit(""))).otherwise(F.coalesce("__target", F.lit("")))).drop("__target")


def upserted(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """table with the rows of new in place of those with the same keys."""
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new)
