"""A word-processing package as flat rows, and rows as a package.

``flatten`` walks each story once, in order, and gives every paragraph, inline, run, table and cell its place:
block_path is the path of block, row, cell and block numbers from the story's root. ``build`` is its inverse.
Elements are told apart by local name; what is not modelled is kept as XML in ``raw``.
"""

from __future__ import annotations

import re
from xml.etree import ElementTree as ET

from . import names
from .package import Package, PackageError, parse_xml

for _prefix, _uri in names.NAMESPACES.items():
    ET.register_namespace(_prefix, _uri)

#: Fields of each table of a parsed document, with their Spark types.
TABLES = {
    "paragraphs": "story string, para_ord int, block_path array<int>, in_table boolean, style string, alignment string, ilvl int, num_id int, raw string",
    "inlines": "story string, para_ord int, inline_pos int, kind string, ref_id int, rel_id string, anchor string, author string, date_str string, raw string",
    "runs": "story string, para_ord int, inline_pos int, run_pos int, container string, text string, del_text string, content array<struct<kind:string,value:string,break_type:string,ref_id:int>>, bold boolean, italic boolean, strike boolean, underline string, style string, font string, size string, color string, raw string",
    "tables": "story string, table_ord int, block_path array<int>, style string, n_rows int, n_cols int",
    "cells": "story string, table_ord int, row_idx int, col_idx int, width string, grid_span int, v_merge string, fill string",
    "comments": "comment_pos int, comment_id int, author string, date_str string, initials string, text string",
    "styles": "style_pos int, style_id string, type string, name string, based_on string, next string, is_default boolean, raw string",
    "sections": "page_w string, page_h string, orient string, margin_top string, margin_right string, margin_bottom string, margin_left string, margin_header string, margin_footer string, margin_gutter string, columns string, break_type string",
    "hdrftr": "part_path string, rel_id string, is_header boolean, variant string",
    "properties": "title string, creator string, description string, subject string, created string, modified string, last_modified_by string, keywords string, category string",
    "rels": "source_path string, rel_pos int, rel_id string, rel_type string, target string, external boolean",
    "parts": "part_path string, content_type string, is_binary boolean, content binary",
}
FIELDS = {t: [f.strip().split(" ")[0] for f in _split.split(", ")] for t, _split in TABLES.items()}
MARGINS = ("top", "right", "bottom", "left", "header", "footer", "gutter")


def local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def attr(e: ET.Element | None, name: str, default=None):
    """An attribute by local name."""
    if e is None:
        return default
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), default)


def child(e: ET.Element | None, name: str) -> ET.Element | None:
    return None if e is None else next((x for x in e if local(x) == name), None)


#: Characters that XML can't hold, and the font that marks the symbols they are written as.
_NOT_XML = re.compile("([\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff])")
CODE_POINT = "Code Point"


def number(text: str | None, default: int | None = 0) -> int | None:
    try:
        return int(text)
    except (TypeError, ValueError):
        return default


def toggle(e: ET.Element | None) -> bool | None:
    return None if e is None else attr(e, "val", "true") not in ("0", "false")


def raw(e: ET.Element) -> str:
    return ET.tostring(e, encoding="unicode").replace("\r", "&#13;")


class Flat:
    def __init__(self):
        self.rows: dict[str, list[dict]] = {t: [] for t in TABLES}
        self.paras: dict[str, int] = {}
        self.table_no: dict[str, int] = {}

    def add(self, table: str, **row) -> None:
        self.rows[table].append({f: row.get(f) for f in FIELDS[table]})

    def blocks(self, parent: ET.Element, story: str, path: tuple[int, ...] = (), in_table: bool = False) -> None:
        k = 0
        for e in parent:
            kind = local(e)
            if kind in ("sectPr", "tcPr"):
                continue
            if kind == "p":
                self.paragraph(e, story, (*path, k), in_table)
            elif kind == "tbl":
                self.table(e, story, (*path, k))
            k += 1

    def table(self, e: ET.Element, story: str, path: tuple[int, ...]) -> None:
        no = self.table_no[story] = self.table_no.get(story, -1) + 1
        rows = [r for r in e if local(r) == "tr"]
        cells = [[c for c in r if local(c) == "tc"] for r in rows]
        self.add("tables", story=story, table_ord=no, block_path=list(path), style=attr(child(child(e, "tblPr"), "tblStyle"), "val"), n_rows=len(rows), n_cols=len(cells[0]) if cells else 0)
        for i, row in enumerate(cells):
            for j, c in enumerate(row):
                p = child(c, "tcPr")
                merge = child(p, "vMerge")
                self.add("cells", story=story, table_ord=no, row_idx=i, col_idx=j, width=attr(child(p, "tcW"), "w"), grid_span=number(attr(child(p, "gridSpan"), "val"), None), v_merge=None if merge is None else attr(merge, "val", "continue"), fill=attr(child(p, "shd"), "fill"))
                self.blocks(c, story, (*path, i, j), True)

    def paragraph(self, e: ET.Element, story: str, path: tuple[int, ...], in_table: bool) -> None:
        at = self.paras[story] = self.paras.get(story, -1) + 1
        props = child(e, "pPr")
        numbers = child(props, "numPr")
        rest = [x for x in props if local(x) not in ("pStyle", "jc", "numPr")] if props is not None else []
        self.add("paragraphs", story=story, para_ord=at, block_path=list(path), in_table=in_table, style=attr(child(props, "pStyle"), "val"), alignment=attr(child(props, "jc"), "val"), ilvl=None if numbers is None else number(attr(child(numbers, "ilvl"), "val")), num_id=None if numbers is None else number(attr(child(numbers, "numId"), "val"), None), raw="".join(map(raw, rest)) or None)
        k = 0
        for x in e:
            kind = local(x)
            if kind == "pPr":
                continue
            common = {"story": story, "para_ord": at, "inline_pos": k}
            if kind == "r":
                self.add("inlines", **common, kind="run")
                self.run(x, common, 0, "run")
            elif kind in ("hyperlink", "ins", "del"):
                self.add("inlines", **common, kind=kind, ref_id=None if kind == "hyperlink" else number(attr(x, "id")), rel_id=attr(x, "id") if kind == "hyperlink" else None, anchor=attr(x, "anchor"), author=attr(x, "author"), date_str=attr(x, "date"))
                for i, r in enumerate(y for y in x if local(y) == "r"):
                    self.run(r, common, i, kind)
            elif kind in ("commentRangeStart", "commentRangeEnd"):
                self.add("inlines", **common, kind=kind, ref_id=number(attr(x, "id")))
            else:
                self.add("inlines", **common, kind="raw", raw=raw(x))
            k += 1

    def run(self, e: ET.Element, common: dict, pos: int, container: str) -> None:
        props, content = child(e, "rPr"), []
        for x in e:
            kind = local(x)
            value = break_type = ref = None
            if kind == "rPr":
                continue
            if kind in ("t", "delText"):
                value, kind = x.text or "", "text" if kind == "t" else kind
            elif kind in ("br", "cr"):
                kind, break_type = "break", attr(x, "type")
            elif kind == "commentReference":
                ref = number(attr(x, "id"))
            elif kind == "sym" and attr(x, "font") == CODE_POINT and re.fullmatch("[0-9A-F]{4}", attr(x, "char") or ""):
                value, kind = chr(int(attr(x, "char"), 16)), "delText" if container == "del" else "text"
            elif kind not in ("tab", "annotationRef"):
                kind, value = "raw", raw(x)
            content.append({"kind": kind, "value": value, "break_type": break_type, "ref_id": ref})
        fonts, known = child(props, "rFonts"), ("b", "i", "strike", "u", "rStyle", "rFonts", "sz", "szCs", "color")
        rest = [x for x in props if local(x) not in known] if props is not None else []
        text = "".join({"text": x["value"], "tab": "\t", "break": "\n"}.get(x["kind"]) or "" for x in content)
        self.add(
            "runs", **common, run_pos=pos, container=container, text=text, del_text="".join(x["value"] for x in content if x["kind"] == "delText"), content=content, bold=toggle(child(props, "b")), italic=toggle(child(props, "i")), strike=toggle(child(props, "strike")),
            underline=attr(child(props, "u"), "val"), style=attr(child(props, "rStyle"), "val"), font=attr(fonts, "ascii", attr(fonts, "hAnsi")), size=attr(child(props, "sz"), "val"), color=attr(child(props, "color"), "val"), raw="".join(map(raw, rest)) or None,
        )


def flatten(package: Package, parts: bool = False) -> tuple[dict[str, list[dict]], list[str]]:
    """The rows of every table, and warnings for optional parts that could not be read."""
    flat, warnings = Flat(), []
    main = package.target("", names.REL_DOCUMENT)
    if main is None or main not in package.parts:
        raise PackageError("invalid_document", "no main part")
    body = child(parse_xml(package.parts[main]), "body")
    if body is None:
        raise PackageError("invalid_document", "no body")
    flat.blocks(body, "body")
    section = child(body, "sectPr")

    def optional(path: str | None, f) -> None:
        if path is None or path not in package.parts:
            return
        try:
            f(parse_xml(package.parts[path]))
        except PackageError as e:
            warnings.append(f"{path}: {e}")

    def styles(root):
        for i, s in enumerate(x for x in root if local(x) == "style"):
            flat.add("styles", style_pos=i, style_id=attr(s, "styleId"), type=attr(s, "type"), name=attr(child(s, "name"), "val"), based_on=attr(child(s, "basedOn"), "val"), next=attr(child(s, "next"), "val"), is_default=attr(s, "default", "0") not in ("0", "false"), raw=raw(s))

    def comments(root):
        for i, c in enumerate(x for x in root if local(x) == "comment"):
            story = f"comment:{attr(c, 'id')}"
            flat.blocks(c, story)
            texts: dict[int, str] = {}
            for p in flat.rows["paragraphs"]:
                if p["story"] == story and len(p["block_path"]) == 1:
                    texts[p["para_ord"]] = ""
            for r in flat.rows["runs"]:
                if r["story"] == story and r["para_ord"] in texts and r["container"] != "del":
                    texts[r["para_ord"]] += r["text"]
            flat.add("comments", comment_pos=i, comment_id=number(attr(c, "id")), author=attr(c, "author"), date_str=attr(c, "date"), initials=attr(c, "initials"), text="\n".join(texts.values()))

    def properties(root):
        own = {local(x): x.text or "" for x in root}
        flat.add("properties", **{f: own.get({"last_modified_by": "lastModifiedBy"}.get(f, f), "") for f in FIELDS["properties"]})

    optional(package.target(main, names.REL_STYLES), styles)
    optional(package.target(main, names.REL_COMMENTS), comments)
    optional(package.target("", names.REL_CORE), properties)
    references = {attr(x, "id"): attr(x, "type", "default") for x in (section if section is not None else []) if local(x) in ("headerReference", "footerReference")}
    for r in package.rels.get(main, []):
        if r["rel_type"] in (names.REL_HEADER, names.REL_FOOTER) and not r["external"]:
            path = Package(rels={main: [r]}).target(main, r["rel_type"])
            flat.add("hdrftr", part_path=path, rel_id=r["rel_id"], is_header=r["rel_type"] == names.REL_HEADER, variant=references.get(r["rel_id"], "default"))
            optional(path, lambda root, p=path: flat.blocks(root, p.rpartition("/")[2].removesuffix(".xml")))
    if section is not None:
        size, margins, cols = child(section, "pgSz"), child(section, "pgMar"), child(section, "cols")
        flat.add("sections", page_w=attr(size, "w"), page_h=attr(size, "h"), orient=attr(size, "orient"), columns=attr(cols, "num"), break_type=attr(child(section, "type"), "val"), **{f"margin_{m}": attr(margins, m) for m in MARGINS})
    else:
        flat.add("sections")
    for source, rels in package.rels.items():
        for i, r in enumerate(rels):
            flat.add("rels", source_path=source, rel_pos=i, **r)
    if parts:
        for path, data in package.parts.items():
            flat.add("parts", part_path=path, content_type=package.content_type(path), is_binary=package.is_binary(path), content=data)
    return flat.rows, warnings


def q(name: str) -> str:
    return f"{{{names.W}}}{name}"


def _element(parent: ET.Element, name: str, **attributes) -> ET.Element:
    return ET.SubElement(parent, q(name), {q(k): str(v) for k, v in attributes.items() if v is not None})


def _kept(parent: ET.Element, xml: str | None) -> None:
    if xml:
        declared = " ".join(f'xmlns:{p}="{u}"' for p, u in names.NAMESPACES.items())
        parent.extend(ET.fromstring(f"<x {declared}>{xml}</x>"))


def _run(parent: ET.Element, r: dict) -> None:
    e = _element(parent, "r")
    props = ET.Element(q("rPr"))
    if r.get("style"):
        _element(props, "rStyle", val=r["style"])
    if r.get("font"):
        _element(props, "rFonts", ascii=r["font"], hAnsi=r["font"])
    for name, key in (("b", "bold"), ("i", "italic"), ("strike", "strike")):
        if r.get(key) is not None:
            _element(props, name, **({} if r[key] else {"val": "false"}))
    for name, key in (("color", "color"), ("sz", "size"), ("u", "underline")):
        if r.get(key):
            _element(props, name, val=r[key])
    _kept(props, r.get("raw"))
    if len(props):
        e.append(props)
    deleted = r.get("container") == "del"
    content = r.get("content")
    if content is None:
        content = [{"kind": "delText" if deleted else "text", "value": (r.get("del_text") if deleted else r.get("text")) or ""}]
    for x in content:
        kind = x["kind"]
        if kind in ("text", "delText"):
            for i, piece in enumerate(_NOT_XML.split(x["value"])):
                if i % 2:
                    _element(e, "sym", font=CODE_POINT, char=f"{ord(piece):04X}")
                elif piece or not x["value"]:
                    t = _element(e, "t" if kind == "text" else kind)
                    t.text = piece
                    t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
        elif kind == "break":
            _element(e, "br", type=x.get("break_type"))
        elif kind == "commentReference":
            _element(e, kind, id=x.get("ref_id"))
        elif kind == "raw":
            _kept(e, x["value"])
        else:
            _element(e, kind)


def _blocks(parent: ET.Element, story: str, rows: dict[str, list[dict]]) -> None:
    """The story's blocks under parent, nested as their paths say."""
    own = lambda t: [x for x in rows.get(t) or [] if x["story"] == story]
    inlines: dict[int, list[dict]] = {}
    runs: dict[tuple[int, int], list[dict]] = {}
    for x in own("inlines"):
        inlines.setdefault(x["para_ord"], []).append(x)
    for x in own("runs"):
        runs.setdefault((x["para_ord"], x["inline_pos"]), []).append(x)
    cells: dict[int, list[dict]] = {}
    for x in own("cells"):
        cells.setdefault(x["table_ord"], []).append(x)
    homes: dict[tuple[int, ...], ET.Element] = {(): parent}
    blocks = [(tuple(p["block_path"]), "p", p) for p in own("paragraphs")] + [(tuple(t["block_path"]), "tbl", t) for t in own("tables")]
    for path, kind, x in sorted(blocks, key=lambda b: b[0]):
        home = homes[path[:-1]]
        if kind == "p":
            e = _element(home, "p")
            props = ET.Element(q("pPr"))
            if x.get("style"):
                _element(props, "pStyle", val=x["style"])
            if x.get("num_id") is not None:
                n = _element(props, "numPr")
                _element(n, "ilvl", val=x.get("ilvl") or 0)
                _element(n, "numId", val=x["num_id"])
            _kept(props, x.get("raw"))
            if x.get("alignment"):
                _element(props, "jc", val=x["alignment"])
            if len(props):
                e.append(props)
            for i in sorted(inlines.get(x["para_ord"], []), key=lambda i: i["inline_pos"]):
                to, k = e, i["kind"]
                if k == "hyperlink":
                    to = _element(e, k, anchor=i.get("anchor"))
                    if i.get("rel_id"):
                        to.set(f"{{{names.R}}}id", i["rel_id"])
                elif k in ("ins", "del"):
                    to = _element(e, k, id=i.get("ref_id"), author=i.get("author"), date=i.get("date_str"))
                elif k in ("commentRangeStart", "commentRangeEnd"):
                    _element(e, k, id=i.get("ref_id"))
                elif k == "commentReference":
                    _run(e, {"content": [{"kind": k, "ref_id": i.get("ref_id")}]})
                elif k == "raw":
                    _kept(e, i.get("raw"))
                for r in sorted(runs.get((x["para_ord"], i["inline_pos"]), []), key=lambda r: r["run_pos"]):
                    _run(to, r)
        else:
            e = _element(home, "tbl")
            props = _element(e, "tblPr")
            if x.get("style"):
                _element(props, "tblStyle", val=x["style"])
            grid = _element(e, "tblGrid")
            for _ in range(x.get("n_cols") or 0):
                _element(grid, "gridCol")
            for row in range(x.get("n_rows") or 0):
                tr = _element(e, "tr")
                for c in sorted((c for c in cells.get(x["table_ord"], []) if c["row_idx"] == row), key=lambda c: c["col_idx"]):
                    tc = _element(tr, "tc")
                    p = _element(tc, "tcPr")
                    if c.get("width"):
                        _element(p, "tcW", w=c["width"], type="dxa")
                    if c.get("grid_span"):
                        _element(p, "gridSpan", val=c["grid_span"])
                    if c.get("v_merge"):
                        _element(p, "vMerge", val=c["v_merge"])
                    if c.get("fill"):
                        _element(p, "shd", val="clear", fill=c["fill"])
                    homes[(*path, row, c["col_idx"])] = tc


def _xml(root: ET.Element) -> bytes:
    # a parser reads a bare carriage return as a line end
    return b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + ET.tostring(root, encoding="utf-8").replace(b"\r", b"&#13;")


def build(rows: dict[str, list[dict]]) -> bytes:
    """A package of the rows of one document; missing tables are empty."""
    p = Package(defaults={"rels": names.TYPE_RELS, "xml": "application/xml"})
    p.relate("", names.REL_DOCUMENT, names.PART_DOCUMENT)
    main = names.PART_DOCUMENT
    p.rels[main] = [{k: r[k] for k in ("rel_id", "rel_type", "target", "external")} for r in sorted(rows.get("rels") or [], key=lambda r: r["rel_pos"]) if r["source_path"] == main and r["rel_type"] not in (names.REL_STYLES, names.REL_COMMENTS)]
    root = ET.Element(q("document"))
    body = _element(root, "body")
    _blocks(body, "body", rows)
    section = next(iter(rows.get("sections") or []), None) or {}
    s = _element(body, "sectPr")
    for h in rows.get("hdrftr") or []:
        story = h["part_path"].rpartition("/")[2].removesuffix(".xml")
        part = ET.Element(q("hdr" if h["is_header"] else "ftr"))
        _blocks(part, story, rows)
        p.add(h["part_path"], names.TYPE_HEADER if h["is_header"] else names.TYPE_FOOTER, _xml(part))
        if h["rel_id"] not in {r["rel_id"] for r in p.rels[main]}:
            p.rels[main].append({"rel_id": h["rel_id"], "rel_type": names.REL_HEADER if h["is_header"] else names.REL_FOOTER, "target": h["part_path"].removeprefix("word/"), "external": False})
        _element(s, "headerReference" if h["is_header"] else "footerReference", type=h["variant"]).set(f"{{{names.R}}}id", h["rel_id"])
    if section.get("break_type"):
        _element(s, "type", val=section["break_type"])
    if section.get("page_w") or section.get("page_h"):
        _element(s, "pgSz", w=section.get("page_w"), h=section.get("page_h"), orient=section.get("orient"))
    if any(section.get(f"margin_{m}") for m in MARGINS):
        _element(s, "pgMar", **{m: section.get(f"margin_{m}") for m in MARGINS})
    if section.get("columns"):
        _element(s, "cols", num=section["columns"])
    if rows.get("styles"):
        root_ = ET.Element(q("styles"))
        for x in sorted(rows["styles"], key=lambda x: x["style_pos"]):
            if x.get("raw"):
                _kept(root_, x["raw"])
                continue
            e = _element(root_, "style", type=x["type"], styleId=x["style_id"], default="1" if x.get("is_default") else None)
            _element(e, "name", val=x["name"])
            for name, key in (("basedOn", "based_on"), ("next", "next")):
                if x.get(key):
                    _element(e, name, val=x[key])
        p.add(names.PART_STYLES, names.TYPE_STYLES, _xml(root_))
        p.relate(main, names.REL_STYLES, "styles.xml")
    if rows.get("comments"):
        root_ = ET.Element(q("comments"))
        for c in sorted(rows["comments"], key=lambda c: c["comment_pos"]):
            e = _element(root_, "comment", id=c["comment_id"], author=c.get("author"), date=c.get("date_str"), initials=c.get("initials"))
            story = f"comment:{c['comment_id']}"
            if any(x["story"] == story for x in rows.get("paragraphs") or []):
                _blocks(e, story, rows)
            else:
                for line in (c.get("text") or "").split("\n"):
                    _run(_element(e, "p"), {"text": line})
        p.add(names.PART_COMMENTS, names.TYPE_COMMENTS, _xml(root_))
        p.relate(main, names.REL_COMMENTS, "comments.xml")
    if props := next(iter(rows.get("properties") or []), None):
        homes = {"title": "dc", "creator": "dc", "description": "dc", "subject": "dc", "created": "dcterms", "modified": "dcterms"}
        core = ET.Element(f"{{{names.NAMESPACES['cp']}}}coreProperties")
        for f in FIELDS["properties"]:
            if props.get(f):
                ET.SubElement(core, f"{{{names.NAMESPACES[homes.get(f, 'cp')]}}}{ {'last_modified_by': 'lastModifiedBy'}.get(f, f) }").text = props[f]
        p.add(names.PART_CORE, names.TYPE_CORE, _xml(core))
        p.relate("", names.REL_CORE, names.PART_CORE)
    for x in rows.get("parts") or []:  # parts that no table models
        if x["part_path"] not in p.parts and x.get("is_binary") and x.get("content"):
            p.add(x["part_path"], x["content_type"], bytes(x["content"]))
    p.parts[main] = _xml(root)
    p.overrides["/" + main] = names.TYPE_DOCUMENT
    from .package import write_package

    return write_package(p)
