"""Lengths, colours and the small conversions of document markup, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: EMU of one unit (fixed values).
EMU = {"inch": 914400, "cm": 360000, "pt": 12700, "twip": 635}


def to_emu(value: Column, unit: str) -> Column:
    """A length in EMU, truncated toward zero."""
    return (value * F.lit(EMU[unit])).cast("long")


def from_emu(emu: Column, unit: str) -> Column:
    """EMU in another unit; whole twips, all else as double."""
    return F.expr("int(0)").cast("long") + F.call_function("div", emu, F.lit(EMU[unit])) if unit == "twip" else emu / F.lit(float(EMU[unit]))


def twips_to_emu(text: Column) -> Column:
    """Twips kept as text in EMU; what is no number counts as 0."""
    return F.coalesce(text.try_cast("long"), F.lit(0)) * EMU["twip"]


def hex_of(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("%02X%02X%02X", r.cast("int"), g.cast("int"), b.cast("int"))


def rgb_of(text: Column) -> Column:
    """A struct r, g, b of six hexadecimal digits with or without #; null for anything else."""
    digits = F.regexp_replace(text, "^#", "")
    part = lambda k: F.conv(F.substring(digits, k, 2), 16, 10).cast("int")
    return F.when(digits.rlike("^[0-9A-Fa-f]{6}$"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def toggle(value: Column, present: Column) -> Column:
    """Tri-state: null without the element; true unless its value is 0 or false."""
    return F.when(present, ~F.coalesce(value, F.lit("true")).isin("0", "false"))


def half_points(size: Column) -> Column:
    """Points of a size in half points; null if it is no number."""
    return size.try_cast("double") / 2


def timestamp(text: Column) -> Column:
    return F.try_to_timestamp(text)


def twips_to_points(twips: Column) -> Column:
    return twips / F.lit(20.0)


def points_to_twips(points: Column) -> Column:
    return (points * 20).cast("int")


def size_label(half: Column) -> Column:
    """Half points as ``12pt`` or ``12.5pt``; what is no number stays as it is."""
    n = half.try_cast("double") / 2
    return F.when(n.isNull(), half).when(n == F.floor(n), F.concat(n.cast("long").cast("string"), F.lit("pt"))).otherwise(F.concat(F.format_string("%.1f", n), F.lit("pt")))


def label_size(label: Column) -> Column:
    """Half points of ``12pt`` or ``12px``; what is no number stays as it is."""
    n = F.regexp_replace(label, "(pt|px)$", "").try_cast("double")
    return F.when(n.isNull(), label).otherwise((n * 2).cast("int").cast("string"))
