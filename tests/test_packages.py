"""Packages: guards, reading, writing, streaming."""

from __future__ import annotations

import io
import zipfile

import pytest

from vellum.operators.packages import Limits
from vellum.sources import documents, names
from vellum.sources.package import PackageError, open_package, parse_xml
from vellum.sources.wordml import build, flatten
from vellum.streaming.ingest import ingest

TYPES = f'<Types xmlns="{names.CONTENT_TYPES}"><Default Extension="xml" ContentType="application/xml"/></Types>'
RELS = f'<Relationships xmlns="{names.PACKAGE_RELS}"><Relationship Id="rId1" Type="{names.REL_DOCUMENT}" Target="/word/document.xml"/></Relationships>'
BODY = (
    f'<w:document xmlns:w="{names.W}" xmlns:r="{names.R}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:commentRangeStart w:id="1"/><w:r><w:rPr><w:b/><w:i w:val="0"/><w:sz w:val="36"/></w:rPr><w:t>Hello</w:t><w:tab/><w:br/></w:r><w:commentRangeEnd w:id="1"/></w:p>'
    '<w:p><w:ins w:id="3" w:author="A"><w:r><w:t>new</w:t></w:r></w:ins><w:del w:id="4"><w:r><w:delText>old</w:delText></w:r></w:del><w:hyperlink w:anchor="x"><w:r><w:t>link</w:t></w:r></w:hyperlink><w:bookmarkStart w:id="9"/></w:p>'
    '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl><w:p/></w:tc><w:tc><w:tcPr><w:gridSpan w:val="2"/><w:shd w:fill="00FF00"/></w:tcPr><w:p/></w:tc></w:tr></w:tbl><w:sectPr><w:pgSz w:w="12240" w:h="15840"/></w:sectPr></w:body></w:document>'
)


def archive(*entries, compression=zipfile.ZIP_STORED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", compression) as z:
        for path, data in entries:
            z.writestr(path, data)
    return out.getvalue()


MINIMAL = archive(("[Content_Types].xml", TYPES), ("_rels/.rels", RELS), ("word/document.xml", BODY))


@pytest.mark.parametrize(
    ("data", "limits", "check"),
    [
        (archive(("../evil.txt", "x")), Limits(), "path_traversal"),
        (archive(*((f"a{i}", "") for i in range(51))), Limits(entries=20), "file_count"),
        (archive(("a", "x" * 1025)), Limits(part=1024), "part_size"),
        (archive(("Word/Document.xml", ""), ("word/document.xml", "")), Limits(), "duplicate_entry"),
        (archive(("a", "x" * 100_000), compression=zipfile.ZIP_DEFLATED), Limits(), "zip_bomb"),
        (archive(*((f"a{i}", "x" * 512) for i in range(5))), Limits(total=1024), "total_size"),
        (archive(("[Content_Types].xml", "<!DOCTYPE a []><a/>")), Limits(), "xxe"),
        (b"no zip", Limits(), "zip_read"),
        (b"", Limits(), "zip_read"),
    ],
)
def test_guards(data, limits, check):
    with pytest.raises(PackageError) as e:
        open_package(data, limits)
    assert e.value.check == check


def test_xml_guards():
    with pytest.raises(PackageError, match="nesting_depth"):
        parse_xml(b"<a>" * 300 + b"</a>" * 300)
    with pytest.raises(PackageError, match="token_limit"):
        parse_xml(b"<a><b/><b/></a>", max_tokens=3)


def test_flatten():
    rows, warnings = flatten(open_package(MINIMAL))
    assert not warnings
    assert [(p["block_path"], p["style"], p["in_table"]) for p in rows["paragraphs"]] == [([0], "Heading1", False), ([1], None, False), ([2, 0, 0, 0], None, True), ([2, 0, 0, 1, 0, 0, 0], None, True), ([2, 0, 0, 2], None, True), ([2, 0, 1, 0], None, True)]
    assert [i["kind"] for i in rows["inlines"]][:7] == ["commentRangeStart", "run", "commentRangeEnd", "ins", "del", "hyperlink", "raw"]
    first = rows["runs"][0]
    assert (first["text"], first["bold"], first["italic"], first["strike"], first["size"]) == ("Hello\t\n", True, False, None, "36")
    assert rows["runs"][2]["del_text"] == "old" and rows["runs"][2]["text"] == ""
    assert [(t["block_path"], t["n_rows"], t["n_cols"]) for t in rows["tables"]] == [([2], 1, 2), ([2, 0, 0, 1], 1, 1)]
    assert rows["cells"][-1]["grid_span"] == 2 and rows["cells"][-1]["fill"] == "00FF00"
    again, _ = flatten(open_package(build(rows)))
    assert all(again[t] == rows[t] for t in ("paragraphs", "inlines", "runs", "tables", "cells", "sections"))


def test_read_and_write(spark, tmp_path):
    files = spark.createDataFrame([("a", bytearray(MINIMAL)), ("b", bytearray(b"broken")), ("c", None)], "doc_id string, content binary")
    corpus = documents.parse(files)
    errors = {r.doc_id: r.error for r in corpus.documents.collect()}
    assert errors["a"] is None and errors["b"].check == errors["c"].check == "zip_read"
    assert corpus.runs.count() == 5
    with pytest.raises(Exception, match="zip_read"):
        documents.parse(files, mode="FAILFAST").runs.collect()
    tables = {t: corpus.table(t) for t in ("paragraphs", "inlines", "runs", "tables", "cells", "sections")}
    saved = documents.save(documents.packages(tables), str(tmp_path / "out")).collect()
    assert [r.doc_id for r in saved] == ["a"]
    again = documents.read(spark, str(tmp_path / "out"))
    assert sorted(r.text for r in again.runs.collect()) == sorted(r.text for r in corpus.runs.collect())


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.docx").write_bytes(MINIMAL)
    (source / "b.docx").write_bytes(b"broken")
    for _ in range(2):  # a second run finds nothing new
        ingest(spark, str(source), str(tmp_path / "out"), str(tmp_path / "state"), ["runs"]).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/runs")).count() == 5
    assert [r.error.check for r in spark.read.parquet(str(tmp_path / "out/errors")).collect()] == ["zip_read"]


def test_documents_of_one_name_are_apart(spark, tmp_path):
    rows = [("x/a.docx", bytearray(b"1")), ("y/a.docx", bytearray(b"2"))]
    saved = documents.save(spark.createDataFrame(rows, "doc_id string, content binary"), str(tmp_path / "out")).collect()
    assert {open(r.path, "rb").read() for r in saved} == {b"1", b"2"}


@pytest.mark.parametrize("encoding", ["shift_jis", "nonsense"])
def test_encodings_that_cannot_be_read(encoding):
    with pytest.raises(PackageError):
        parse_xml(f'<?xml version="1.0" encoding="{encoding}"?><a/>'.encode())


@pytest.mark.parametrize("line", ["hello world. x\n" * 8000, "a\x00b\x01\x0b\x1f\ufffe\uffffc", "a\rb\r\nc", "\x02", ""])
def test_what_is_written_can_be_read(line):
    paragraphs = [{"story": "body", "para_ord": i, "block_path": [i]} for i in range(line.count("\n") + 1)]
    runs = [{"story": "body", "para_ord": i, "inline_pos": 0, "run_pos": 0, "container": "run", "text": x} for i, x in enumerate(line.split("\n"))]
    gone = {"story": "body", "para_ord": 0, "inline_pos": 1, "run_pos": 0, "container": "del", "del_text": "\x03"}
    inlines = [{"story": "body", "para_ord": r["para_ord"], "inline_pos": r["inline_pos"], "kind": r["container"]} for r in [*runs, gone]]
    found, _ = flatten(open_package(build({"paragraphs": paragraphs, "inlines": inlines, "runs": [*runs, gone]})))
    assert "\n".join(r["text"] for r in found["runs"] if r["container"] == "run") == line
    assert [r["del_text"] for r in found["runs"] if r["container"] == "del"] == ["\x03"]
    again, _ = flatten(open_package(build(found)))
    assert again["runs"] == found["runs"]
