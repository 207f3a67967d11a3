"""Namespaces, relationship types, content types and part names of word-processing packages (fixed values)."""

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
NAMESPACES = {
    "w": W,
    "r": R,
    "wp": "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing",
    "a": "http://schemas.openxmlformats.org/drawingml/2006/main",
    "pic": "http://schemas.openxmlformats.org/drawingml/2006/picture",
    "mc": "http://schemas.openxmlformats.org/markup-compatibility/2006",
    "cp": "http://schemas.openxmlformats.org/package/2006/metadata/core-properties",
    "dc": "http://purl.org/dc/elements/1.1/",
    "dcterms": "http://purl.org/dc/terms/",
    "xsi": "http://www.w3.org/2001/XMLSchema-instance",
    "w14": "http://schemas.microsoft.com/office/word/2010/wordml",
}
PACKAGE_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
CONTENT_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"

REL_DOCUMENT = f"{R}/officeDocument"
REL_STYLES = f"{R}/styles"
REL_COMMENTS = f"{R}/comments"
REL_HYPERLINK = f"{R}/hyperlink"
REL_HEADER = f"{R}/header"
REL_FOOTER = f"{R}/footer"
REL_CORE = "http://schemas.openxmlformats.org/package/2006/relationships/metadata/core-properties"

_WORD = "application/vnd.openxmlformats-officedocument.wordprocessingml."
TYPE_DOCUMENT = f"{_WORD}document.main+xml"
TYPE_STYLES = f"{_WORD}styles+xml"
TYPE_COMMENTS = f"{_WORD}comments+xml"
TYPE_HEADER = f"{_WORD}header+xml"
TYPE_FOOTER = f"{_WORD}footer+xml"
TYPE_CORE = "application/vnd.openxmlformats-package.core-properties+xml"
TYPE_RELS = "application/vnd.openxmlformats-package.relationships+xml"

PART_DOCUMENT = "word/document.xml"
PART_STYLES = "word/styles.xml"
PART_COMMENTS = "word/comments.xml"
PART_CORE = "docProps/core.xml"
