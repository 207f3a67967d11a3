"""Markdown of runs and paragraphs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fonts and the character style that mark code (fixed values).
CODE_FONTS = ("Courier New", "Consolas")
CODE_STYLE = "CodeChar"
#: Paragraph styles of quotations (fixed values).
QUOTES = ("Quote", "BlockQuote", "Blockquote", "IntenseQuote")


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_code(style: Column, font: Column) -> Column:
    return _true(style == CODE_STYLE) | _true(font.isin(*CODE_FONTS))


def run_markdown(text: Column, bold: Column, italic: Column, strike: Column, code: Column) -> Column:
    """Code excludes all else; emphasis inside, strike outside; empty text stays empty."""
    mark = F.when(_true(bold) & _true(italic), "***").when(_true(bold), "**").when(_true(italic), "*").otherwise("")
    cross = F.when(_true(strike), "~~").otherwise("")
    return F.when(text == "", "").when(_true(code), F.concat(F.lit("`"), text, F.lit("`"))).otherwise(F.concat(cross, mark, text, mark, cross))


def heading_level(style: Column) -> Column:
    """1 for Title, n for Heading1 to Heading9, else 0."""
    return F.when(style == "Title", 1).otherwise(F.coalesce(F.regexp_extract(style, "^Heading([1-9])$", 1).try_cast("int"), F.lit(0)))


def style_heading_level(style_id: Column, name: Column) -> Column:
    """As heading_level, or else by the style's name in any case."""
    low = F.lower(F.trim(name))
    by_name = F.when(low == "title", 1).otherwise(F.coalesce(F.regexp_extract(low, "^heading ([1-9])$", 1).try_cast("int"), F.lit(0)))
    by_id = heading_level(style_id)
    return F.when(by_id > 0, by_id).otherwise(F.coalesce(by_name, F.lit(0)))


def paragraph_markdown(text: Column, style: Column, ilvl: Column, num_id: Column) -> Column:
    """Heading, quotation, list item or plain, the first that holds. An even list number is an ordered list."""
    level = heading_level(F.coalesce(style, F.lit("")))
    bullet = F.when(num_id % 2 == 0, "1. ").otherwise("- ")
    return (
        F.when(level > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text))
        .when(_true(style.isin(*QUOTES)), F.concat(F.lit("> "), text))
        .when(num_id.isNotNull(), F.concat(F.repeat(F.lit("  "), F.coalesce(ilvl, F.lit(0))), bullet, text))
        .otherwise(text)
    )


def link_markdown(text: Column, url: Column) -> Column:
    return F.when(F.coalesce(url, F.lit("")) == "", text).otherwise(F.concat(F.lit("["), text, F.lit("]("), url, F.lit(")")))
