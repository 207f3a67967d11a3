"""Rich-text JSON (node trees of an editor): export natively as JSON text, import by walking each tree once."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.markup import QUOTES, heading_level
from ..functions.richjson import ALIASES, export_name, marks
from ..sources.wordml import FIELDS, TABLES
from .text import PARA, RUN_ORDER

#: Nesting that an import follows.
MAX_DEPTH = 256


def run_nodes(runs: DataFrame, camel_case: bool = True) -> DataFrame:
    """Runs with text as JSON text nodes (column ``node``); links need ``url``, whose mark comes last."""
    own = marks(F.col("bold"), F.col("italic"), F.col("underline"), F.col("strike"), F.col("style"), F.col("font"), F.col("size"), F.col("color"), camel_case)
    if "url" in runs.columns:
        href = F.when(F.coalesce("url", F.lit("")) != "", F.create_map(F.lit("href"), F.col("url")))
        own = F.when(F.col("container") == "hyperlink", F.concat(own, F.array(F.struct(F.lit("link").alias("type"), href.alias("attrs"))))).otherwise(own)
    node = F.to_json(F.struct(F.lit("text").alias("type"), F.when(F.size(own) > 0, own).alias("marks"), F.col("text").alias("text")))
    hard = F.to_json(F.struct(export_name(F.lit("hardBreak"), camel_case).alias("type")))
    breaks = F.size(F.filter("content", lambda x: (x["kind"] == "break") & x["break_type"].isNull())) if "content" in runs.columns else F.lit(0)
    nodes = F.concat(F.when(F.col("text") != "", F.array(node)).otherwise(F.array().cast("array<string>")), F.array_repeat(hard, F.greatest(F.coalesce(breaks, F.lit(0)), F.lit(0))))
    return runs.withColumn("nodes", nodes)


def _list(nodes) -> F:
    return F.concat(F.lit("["), F.array_join(nodes, ","), F.lit("]"))


def paragraph_nodes(paragraphs: DataFrame, runs: DataFrame, camel_case: bool = True) -> DataFrame:
    """paragraphs with ``node``: a heading, a quotation around a paragraph, or a paragraph, with alignment and other styles as attributes."""
    shown = run_nodes(runs.where("container != 'del'"), camel_case)
    content = shown.groupBy(*PARA).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(*RUN_ORDER, "nodes"))), lambda x: x["nodes"])).alias("__nodes"))
    joined = paragraphs.join(content, list(PARA), "left").withColumn("__nodes", F.coalesce("__nodes", F.array().cast("array<string>")))
    style = F.coalesce("style", F.lit(""))
    level = heading_level(style)
    align = F.when(F.col("alignment") == "both", "justify").otherwise(F.col("alignment"))
    quote = style.isin(*QUOTES)
    attrs = F.to_json(F.struct(F.when(level > 0, level).alias("level"), F.when(align != "", align).alias("textAlign"), F.when((style != "") & (level == 0) & ~quote, style).alias("styleId")))
    kind = F.when(level > 0, "heading").otherwise("paragraph")
    inner = F.concat(F.lit('{"type":"'), kind, F.lit('"'), F.when(attrs == "{}", "").otherwise(F.concat(F.lit(',"attrs":'), attrs)), F.when(F.size("__nodes") == 0, "").otherwise(F.concat(F.lit(',"content":'), _list(F.col("__nodes")))), F.lit("}"))
    return joined.withColumn("node", F.when(quote, F.concat(F.lit('{"type":"blockquote","content":['), inner, F.lit("]}"))).otherwise(inner)).drop("__nodes")


def table_nodes(cells: DataFrame, cell_paragraph_nodes: DataFrame, camel_case: bool = True) -> DataFrame:
    """doc_id, table_ord, node. cells: table_ord, row_idx, col_idx, grid_span, fill; paragraph nodes: the same keys, para_idx, node. The first row holds header cells; rowspan is always 1."""
    keys = ["doc_id", "table_ord", "row_idx", "col_idx"]
    inside = cell_paragraph_nodes.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "node"))), lambda x: x["node"]).alias("__n"))
    attrs = F.to_json(F.struct(F.coalesce("grid_span", F.lit(1)).alias("colspan"), F.lit(1).alias("rowspan"), F.when(F.coalesce("fill", F.lit("")) != "", F.concat(F.lit("#"), "fill")).alias("background")))
    name = F.when(F.col("row_idx") == 0, export_name(F.lit("tableHeader"), camel_case)).otherwise(export_name(F.lit("tableCell"), camel_case))
    cell = F.concat(F.lit('{"type":"'), name, F.lit('","attrs":'), attrs, F.lit(',"content":'), _list(F.coalesce("__n", F.array().cast("array<string>"))), F.lit("}"))
    rows = cells.join(inside, keys, "left").withColumn("__c", cell).groupBy("doc_id", "table_ord", "row_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "__c"))), lambda x: x["__c"]).alias("__cells"))
    row = F.concat(F.lit('{"type":"'), export_name(F.lit("tableRow"), camel_case), F.lit('","content":'), _list(F.col("__cells")), F.lit("}"))
    whole = rows.withColumn("__row", row).groupBy("doc_id", "table_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "__row"))), lambda x: x["__row"]).alias("__rows"))
    return whole.select("doc_id", "table_ord", F.concat(F.lit('{"type":"table","content":'), _list(F.col("__rows")), F.lit("}")).alias("node"))


def document_nodes(blocks: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
    """doc_id, json of blocks (doc_id, block_pos, node); attributes: doc_id and a struct ``attrs`` (title, author, description, page settings)."""
    body = blocks.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("block_pos", "node"))), lambda x: x["node"]).alias("__n"))
    head = F.lit('{"type":"doc"')
    if attributes is not None:
        body = body.join(attributes.select("doc_id", F.to_json("attrs").alias("__a")), "doc_id", "left")
        head = F.concat(head, F.when(F.coalesce("__a", F.lit("{}")) == "{}", "").otherwise(F.concat(F.lit(',"attrs":'), "__a")))
    return body.select("doc_id", F.concat(head, F.lit(',"content":'), _list(F.col("__n")), F.lit("}")).alias("json"))


IMPORTED = ("paragraphs", "inlines", "runs", "tables", "cells", "properties")


class _Walk:
    """Rows of one tree."""

    def __init__(self):
        self.rows: dict[str, list[dict]] = {t: [] for t in IMPORTED}
        self.paras = self.tables = -1
        self.blocks: dict[tuple[int, ...], int] = {}

    def add(self, table: str, **row) -> None:
        self.rows[table].append({f: row.get(f) for f in FIELDS[table]})

    def next_path(self, home: tuple[int, ...]) -> list[int]:
        k = self.blocks[home] = self.blocks.get(home, -1) + 1
        return [*home, k]

    def paragraph(self, home: tuple[int, ...], style: str | None = None, alignment: str | None = None) -> int:
        self.paras += 1
        self.add("paragraphs", story="body", para_ord=self.paras, block_path=self.next_path(home), in_table=bool(home), style=style, alignment=alignment)
        self.inline = -1
        return self.paras

    def run(self, text: str, marks: list[dict] = (), content: list[dict] | None = None, link: str | None = None) -> None:
        self.inline += 1
        place = {"story": "body", "para_ord": self.paras, "inline_pos": self.inline}
        props: dict = {}
        for m in marks:
            name, attrs = kind_of(m), attrs_of(m)
            if name in ("bold", "italic", "strike"):
                props[name] = True
            elif name == "underline":
                props["underline"] = "single"
            elif name == "code":
                props["font"] = "Courier New"
            elif name == "link":
                link = str(attrs.get("href") or "")
            elif name == "textStyle":
                if attrs.get("color"):
                    props["color"] = str(attrs["color"]).removeprefix("#").upper()
                if attrs.get("fontFamily"):
                    props["font"] = str(attrs["fontFamily"])
                if attrs.get("fontSize"):
                    props["size"] = half_points(str(attrs["fontSize"]))
        container = "run" if link is None else "hyperlink"
        self.add("inlines", **place, kind=container, anchor=link)
        self.add("runs", **place, run_pos=0, container=container, text=text, del_text="", content=content or [{"kind": "text", "value": text, "break_type": None, "ref_id": None}], **props)

    def line_break(self, kind: str | None = None) -> None:
        self.run("\n", content=[{"kind": "break", "value": None, "break_type": kind, "ref_id": None}])

    def inlines(self, nodes: list[dict]) -> None:
        for n in nodes:
            name = kind_of(n)
            if name == "text" and n.get("text"):
                self.run(text_of(n), inside_of(n, "marks"))
            elif name == "hardBreak":
                self.line_break()
            elif name == "image":
                self.run(str(attrs_of(n).get("alt") or "[image]"))

    def styled(self, node: dict, home: tuple[int, ...], style: str | None = None) -> None:
        attrs = attrs_of(node)
        if kind_of(node) == "heading":
            style = style or f"Heading{min(max(integer(attrs.get('level'), 1), 1), 6)}"
        align = attrs.get("textAlign")
        named = style or attrs.get("styleId")
        self.paragraph(home, named and str(named), "both" if align == "justify" else align and str(align))
        self.inlines(inside_of(node))

    def node(self, node: dict, home: tuple[int, ...] = (), depth: int = 0) -> None:
        if depth > MAX_DEPTH:
            raise Refused("nesting_depth")
        name, inside = kind_of(node), inside_of(node)
        if name in ("paragraph", "heading"):
            self.styled(node, home)
        elif name == "blockquote":
            for n in inside:
                self.styled(n, home, "Quote")
        elif name == "codeBlock":
            for n in inside:
                if kind_of(n) == "text" and n.get("text"):
                    self.paragraph(home)
                    self.run(text_of(n), [{"type": "code"}])
        elif name in ("bulletList", "orderedList", "taskList"):
            self.list(node, home, depth)
        elif name == "table":
            self.table(node, home, depth)
        elif name == "horizontalRule":
            self.paragraph(home)
        elif name in ("pageBreak", "hardBreak"):
            self.paragraph(home)
            self.line_break("page" if name == "pageBreak" else None)

    def list(self, node: dict, home: tuple[int, ...], depth: int) -> None:
        """Items one after the other, whatever their nesting; paragraphs without a style get the list's."""
        style = "ListNumber" if kind_of(node) == "orderedList" else "ListBullet"
        if depth > MAX_DEPTH:
            raise Refused("nesting_depth")
        for item in inside_of(node):
            for n in inside_of(item):
                if kind_of(n) in ("bulletList", "orderedList", "taskList"):
                    self.list(n, home, depth + 1)
                else:
                    own = attrs_of(n).get("styleId") if kind_of(n) == "paragraph" else None
                    self.styled(n, home, own or (None if kind_of(n) == "heading" else style))

    def table(self, node: dict, home: tuple[int, ...], depth: int) -> None:
        self.tables += 1
        no, path = self.tables, self.next_path(home)
        rows = [r for r in inside_of(node) if kind_of(r) == "tableRow"]
        cells = [[c for c in inside_of(r) if kind_of(c) in ("tableCell", "tableHeader")] for r in rows]
        self.add("tables", story="body", table_ord=no, block_path=path, n_rows=len(rows), n_cols=len(cells[0]) if cells else 0)
        for i, row in enumerate(cells):
            for j, c in enumerate(row):
                attrs = attrs_of(c)
                span, back = integer(attrs.get("colspan"), 1), attrs.get("background")
                self.add("cells", story="body", table_ord=no, row_idx=i, col_idx=j, grid_span=span if span > 1 else None, fill=back.removeprefix("#") if isinstance(back, str) and back else None)
                inside = (*path, i, j)
                for n in inside_of(c):
                    if kind_of(n) in ("paragraph", "heading"):
                        self.styled(n, inside)
                if inside not in self.blocks:
                    self.paragraph(inside)


class Refused(ValueError):
    """A document whose tree can't be read; the message names the rule."""


def kind_of(node: dict) -> str:
    if not isinstance(node, dict):
        raise Refused("malformed")
    name = node.get("type") or ""
    if not isinstance(name, str):
        raise Refused("malformed")
    return ALIASES.get(name, name)


def inside_of(node: dict, key: str = "content") -> list:
    """The nodes or marks inside a node."""
    found = node.get(key) if isinstance(node, dict) else None
    if found is None:
        return []
    if not isinstance(found, list) or not all(isinstance(x, dict) for x in found):
        raise Refused("malformed")
    return found


def attrs_of(node: dict) -> dict:
    found = node.get("attrs") or {}
    if not isinstance(found, dict):
        raise Refused("malformed")
    return found


def text_of(node: dict) -> str:
    if not isinstance(node["text"], str):
        raise Refused("malformed")
    return node["text"]


def integer(x, default: int) -> int:
    try:
        return int(float(x))
    except (TypeError, ValueError, OverflowError):
        return default


def half_points(label: str) -> str:
    bare = label.removesuffix("pt").removesuffix("px")
    try:
        return str(int(float(bare) * 2))
    except (ValueError, OverflowError):
        return label


def import_rows(text: str | None) -> dict[str, list[dict] | str | None]:
    """The rows of one JSON document and, as ``error``, why it has none: json, malformed or nesting_depth. A root that is no doc counts as its one node; null has no rows and no error."""
    if text is None:
        return {**_Walk().rows, "error": None}
    walk = _Walk()
    try:
        root = json.loads(text)
        if kind_of(root) == "doc":
            attrs = attrs_of(root)
            if any(attrs.get(k) for k in ("title", "author", "description")):
                walk.add("properties", **{c: attrs[k] and str(attrs[k]) for c, k in (("title", "title"), ("creator", "author"), ("description", "description")) if k in attrs})
            for n in inside_of(root):
                walk.node(n)
        else:
            walk.node(root)
    except Refused as e:
        return {**_Walk().rows, "error": str(e)}
    except RecursionError:
        return {**_Walk().rows, "error": "nesting_depth"}
    except ValueError:
        return {**_Walk().rows, "error": "json"}
    return {**walk.rows, "error": None}


def _import(schema: StructType):
    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = [{"doc_id": d, **import_rows(x)} for d, x in zip(batch.column("doc_id").to_pylist(), batch.column("json").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return f


def import_json(documents: DataFrame) -> DataFrame:
    """One row of nested tables (as the package reader's) and ``error`` for each document (doc_id, json); a document with an error has no rows."""
    nested = ", ".join(f"{t} array<struct<{', '.join(f.replace(' ', ':', 1) for f in TABLES[t].split(', '))}>>" for t in IMPORTED)
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, {nested}, error string"
    return documents.select("doc_id", "json").mapInArrow(_import(StructType.fromDDL(schema)), schema)
