"""Archives: guarded reading of entries, XML with guards, content types and relationships; and writing."""

from __future__ import annotations

import io
import posixpath
import zipfile
from dataclasses import dataclass, field
from xml.etree import ElementTree as ET
from xml.parsers import expat

from ..operators.packages import BINARY_EXTENSIONS, Limits
from . import names

#: Limits of any XML part (fixed values).
MAX_DEPTH, MAX_TOKENS = 256, 10_000_000


class PackageError(Exception):
    """A package that is refused; ``check`` names the rule."""

    def __init__(self, check: str, detail: str = ""):
        super().__init__(f"{check}: {detail}")
        self.check, self.detail = check, detail


def parse_xml(data: bytes, max_depth: int = MAX_DEPTH, max_tokens: int = MAX_TOKENS) -> ET.Element:
    """The element tree of a part without document type, too deep nesting or too many tokens."""
    builder, depth, tokens = ET.TreeBuilder(), 0, 0
    parser = expat.ParserCreate(namespace_separator="}")

    def count():
        nonlocal tokens
        tokens += 1
        if tokens > max_tokens:
            raise PackageError("token_limit", str(max_tokens))

    def name(x: str) -> str:
        return "{" + x if "}" in x else x

    def start(tag, attributes):
        nonlocal depth
        count()
        depth += 1
        if depth > max_depth:
            raise PackageError("nesting_depth", str(max_depth))
        builder.start(name(tag), {name(k): v for k, v in attributes.items()})

    def end(tag):
        nonlocal depth
        count()
        depth -= 1
        builder.end(name(tag))

    def text(x):
        count()
        builder.data(x)

    def doctype(*_):
        raise PackageError("xxe", "document type declaration")

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = start, end, text, doctype
    parser.buffer_text = True
    try:
        parser.Parse(data, True)
    except (expat.ExpatError, LookupError, ValueError) as e:  # the last two: encodings that are unknown or have several bytes a character
        raise PackageError("xml", str(e)) from e
    return builder.close()


def check_path(path: str) -> bool:
    return not ("\x00" in path or "\\" in path or path.startswith("/") or posixpath.normpath(path).startswith("..") or ".." in path.split("/"))


def check_entries(infos: list[zipfile.ZipInfo], limits: Limits) -> None:
    """Raises for the first entry that breaks a rule, before anything is inflated."""
    if len(infos) > limits.entries:
        raise PackageError("file_count", str(len(infos)))
    seen, total = set(), 0
    for x in infos:
        raw = x.orig_filename
        if not check_path(raw):
            raise PackageError("path_traversal", raw)
        if raw.lower() in seen:
            raise PackageError("duplicate_entry", raw)
        seen.add(raw.lower())
        if x.file_size // max(x.compress_size, 1) > limits.ratio:
            raise PackageError("zip_bomb", raw)
        if x.file_size > limits.part:
            raise PackageError("part_size", raw)
        total += x.file_size
        if total > limits.total:
            raise PackageError("total_size", str(total))


@dataclass
class Package:
    parts: dict[str, bytes] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)
    overrides: dict[str, str] = field(default_factory=dict)
    rels: dict[str, list[dict]] = field(default_factory=dict)

    def content_type(self, path: str) -> str:
        ext = posixpath.splitext(path)[1].lstrip(".").lower()
        return self.overrides.get("/" + path) or self.overrides.get(path) or self.defaults.get(ext, "")

    def is_binary(self, path: str) -> bool:
        return "image" in self.content_type(path) or posixpath.splitext(path)[1].lstrip(".").lower() in BINARY_EXTENSIONS

    def target(self, source: str, type_: str) -> str | None:
        """The part that the source's first relationship of a type leads to."""
        found = next((r for r in self.rels.get(source, []) if r["rel_type"] == type_ and not r["external"]), None)
        if found is None:
            return None
        t = found["target"]
        return posixpath.normpath(t.lstrip("/") if t.startswith("/") else posixpath.join(posixpath.dirname(source), t))

    def add(self, path: str, type_: str, data: bytes) -> None:
        self.parts[path] = data
        self.overrides["/" + path] = type_

    def relate(self, source: str, type_: str, target: str, external: bool = False) -> str:
        own = self.rels.setdefault(source, [])
        numbers = [int(r["rel_id"][3:]) for r in own if r["rel_id"].startswith("rId") and r["rel_id"][3:].isdigit()]
        rel_id = f"rId{max(numbers, default=0) + 1}"
        own.append({"rel_id": rel_id, "rel_type": type_, "target": target, "external": external})
        return rel_id


def rels_path(source: str) -> str:
    folder, name = posixpath.split(source)
    return posixpath.join(folder, "_rels", f"{name}.rels")


def _rels_source(path: str) -> str:
    folder, name = posixpath.split(path)
    return posixpath.join(posixpath.dirname(folder), name.removesuffix(".rels"))


def open_package(data: bytes, limits: Limits = Limits(), binary: bool = False) -> Package:
    """A package's parts; binary ones (images) are inflated only if asked for."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, NotImplementedError, ValueError, OSError) as e:
        raise PackageError("zip_read", str(e)) from e
    infos = archive.infolist()
    check_entries(infos, limits)
    out = Package()
    by_name = {x.filename: x for x in infos if not x.is_dir()}

    def read(path: str) -> bytes:
        try:
            return archive.read(by_name[path])
        except (zipfile.BadZipFile, NotImplementedError, RuntimeError, OSError) as e:
            raise PackageError("zip_read", f"{path}: {e}") from e
        except Exception as e:  # zlib.error has no common base
            raise PackageError("zip_read", f"{path}: {e}") from e

    if "[Content_Types].xml" in by_name:
        for x in parse_xml(read("[Content_Types].xml")):
            kind = x.tag.rpartition("}")[2]
            if kind == "Default":
                out.defaults[x.get("Extension", "").lower()] = x.get("ContentType", "")
            elif kind == "Override":
                out.overrides[x.get("PartName", "")] = x.get("ContentType", "")
    for path in by_name:
        if path == "[Content_Types].xml":
            continue
        folder, name = posixpath.split(path)
        if posixpath.basename(folder) == "_rels" and name.endswith(".rels"):
            out.rels[_rels_source(path)] = [{"rel_id": x.get("Id", ""), "rel_type": x.get("Type", ""), "target": x.get("Target", ""), "external": x.get("TargetMode", "") == "External"} for x in parse_xml(read(path))]
        elif binary or not out.is_binary(path):
            out.parts[path] = read(path)
        else:
            out.parts[path] = b""
    return out


def write_package(p: Package) -> bytes:
    """The archive's bytes, entries in a fixed order with fixed dates.

    Entries that deflate by more than a reader takes by default (``Limits.ratio``), such as those of one line repeated, are stored as they are.
    """

    def escaped(x: str) -> str:
        return x.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")

    entries: dict[str, bytes] = {}
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    types = "".join(f'<Default Extension="{escaped(k)}" ContentType="{escaped(v)}"/>' for k, v in sorted(p.defaults.items())) + "".join(f'<Override PartName="{escaped(k)}" ContentType="{escaped(v)}"/>' for k, v in sorted(p.overrides.items()))
    entries["[Content_Types].xml"] = f'{head}<Types xmlns="{names.CONTENT_TYPES}">{types}</Types>'.encode()
    for source, rels in sorted(p.rels.items()):
        rows = "".join(f'<Relationship Id="{escaped(r["rel_id"])}" Type="{escaped(r["rel_type"])}" Target="{escaped(r["target"])}"' + ' TargetMode="External"' * r["external"] + "/>" for r in rels)
        entries[rels_path(source)] = f'{head}<Relationships xmlns="{names.PACKAGE_RELS}">{rows}</Relationships>'.encode()
    entries |= dict(sorted(p.parts.items()))
    data, dense = _archive(entries, set())
    return _archive(entries, dense)[0] if dense else data


def _archive(entries: dict[str, bytes], stored: set[str]) -> tuple[bytes, set[str]]:
    """The archive's bytes, and the entries whose ratio is beyond the default limit."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for path, data in entries.items():
            z.writestr(zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_STORED if path in stored else zipfile.ZIP_DEFLATED)
        dense = {x.filename for x in z.infolist() if x.file_size // max(x.compress_size, 1) > Limits().ratio}
    return buffer.getvalue(), dense
