"""Names and marks of the rich-text JSON form as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .markup import _true, is_code
from .units import size_label

#: Node and mark names of the two conventions (fixed values).
ALIASES = {
    "strong": "bold", "em": "italic", "ordered_list": "orderedList", "bullet_list": "bulletList", "list_item": "listItem", "code_block": "codeBlock", "hard_break": "hardBreak", "horizontal_rule": "horizontalRule", "table_row": "tableRow",
    "table_cell": "tableCell", "table_header": "tableHeader", "task_list": "taskList", "task_item": "taskItem", "page_break": "pageBreak", "section_break": "sectionBreak",
}
VANILLA = {v: k for k, v in ALIASES.items()}


def _mapped(table: dict[str, str], name: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.element_at(pairs, name), name)


def normal_name(name: Column) -> Column:
    return _mapped(ALIASES, name)


def export_name(name: Column, camel_case: bool) -> Column:
    return name if camel_case else _mapped(VANILLA, name)


def marks(bold: Column, italic: Column, underline: Column, strike: Column, style: Column, font: Column, size: Column, color: Column, camel_case: bool = True) -> Column:
    """The marks of a run in fixed order; code stands alone. Each is a struct of type and attributes."""
    none = F.lit(None).cast("map<string,string>")
    mark = lambda name, attrs=none: F.struct(export_name(F.lit(name), camel_case).alias("type"), attrs.alias("attrs"))
    attrs = F.map_filter(F.map_from_arrays(F.array(F.lit("color"), F.lit("fontSize"), F.lit("fontFamily")), F.array(F.concat(F.lit("#"), color), size_label(size), font)), lambda _, v: v.isNotNull())
    listed = F.array(
        F.when(_true(bold), mark("bold")), F.when(_true(italic), mark("italic")), F.when(_true(underline != "none"), mark("underline")), F.when(_true(strike), mark("strike")), F.when(color.isNotNull() | size.isNotNull() | font.isNotNull(), mark("textStyle", attrs))
    )
    return F.when(is_code(style, font), F.array(mark("code"))).otherwise(F.filter(listed, lambda m: m.isNotNull()))
