"""Batch edits of matches. Replacements take leftmost matches that don't overlap, right to left within a paragraph, so that no offset goes stale."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import Query
from .text import PARA, RUN_ORDER

#: Run properties that a merge combines: true if any is, or the first that is set.
ANY_TRUE = ("bold", "italic", "strike")
FIRST_SET = ("underline", "font", "size", "color")


def leftmost(results: DataFrame) -> DataFrame:
    """Of overlapping matches in a paragraph the leftmost; a fold over each paragraph's sorted matches."""
    rows = F.array_sort(F.collect_list(F.struct("start", "end")))
    step = lambda kept, m: F.when((F.size(kept) == 0) | (F.element_at(kept, -1)["end"] <= m["start"]), F.concat(kept, F.array(m))).otherwise(kept)
    kept = results.groupBy(*PARA).agg(F.aggregate(rows, F.array().cast("array<struct<start:int,end:int>>"), step).alias("__m"))
    return kept.select(*PARA, F.explode("__m").alias("__x")).select(*PARA, "__x.start", "__x.end")


def _pieces(text: str, start: int, edits: list[tuple[int, int, bool]], new: str) -> str:
    """One run's text after the paragraph's edits: (start, end, whether this run gets the new text)."""
    for a, b, owns in sorted(edits, reverse=True):
        lo, hi = max(a - start, 0), min(b - start, len(text))
        text = text[:lo] + (new if owns else "") + text[hi:]
    return text


def replace_text(query: Query, new: str) -> tuple[DataFrame, DataFrame]:
    """(runs with the new text, doc_id and n of replacements). The first run of a match gets the new text; the runs between become empty, the last keeps its rest."""
    chosen = leftmost(query.results())
    w = Window.partitionBy(*PARA).orderBy(*RUN_ORDER)
    runs = query.runs.withColumn("__searched", F.col("container") == "run")
    length = F.when(F.col("__searched"), F.length("text")).otherwise(0)
    placed = runs.withColumn("__e", F.sum(length).over(w)).withColumn("__s", F.col("__e") - length)
    edits = chosen.groupBy(*PARA).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__edits"))
    both = placed.join(edits, list(PARA), "left")
    mine = F.filter("__edits", lambda m: F.col("__searched") & (m["end"] > F.col("__s")) & (m["start"] < F.col("__e")))
    flagged = F.transform(mine, lambda m: F.struct(m["start"].alias("a"), m["end"].alias("b"), (m["start"] >= F.col("__s")).alias("owns")))

    @F.pandas_udf("string")
    def edited(text: pd.Series, start: pd.Series, edits: pd.Series) -> pd.Series:
        return pd.Series([t if e is None or not len(e) else _pieces(t, int(s), [(x["a"], x["b"], x["owns"]) for x in e], new) for t, s, e in zip(text, start, edits, strict=True)], dtype=object)

    changed = both.withColumn("__mine", flagged).withColumn("text", F.when(F.size("__mine") > 0, edited("text", "__s", "__mine")).otherwise(F.col("text")))
    return changed.select(*query.runs.columns), chosen.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def merged_properties(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The merged properties of each group of runs, in run order; null for those that no run sets."""
    any_true = [F.when(F.max(F.coalesce(F.col(c), F.lit(False))), True).alias(c) for c in ANY_TRUE]
    ordered = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(*RUN_ORDER, F.col(c))))[c].alias(c)
    return runs.groupBy(*keys).agg(*any_true, *(ordered(c) for c in FIRST_SET))


def replace_formatted(query: Query, new: str) -> tuple[DataFrame, DataFrame]:
    """As replace_text; the first run of a match over several runs also gets the merged properties of all of them."""
    results = query.results().where("n_runs > 1")
    touched = results.select(*PARA, "match_no", F.posexplode("run_places").alias("__k", "__p")).select(*PARA, "match_no", "__k", "__p.inline_pos", "__p.run_pos")
    merged = merged_properties(touched.join(query.runs, [*PARA, *RUN_ORDER]), [*PARA, "match_no"])
    firsts = touched.where("__k = 0").groupBy(*PARA, *RUN_ORDER).agg(F.min("match_no").alias("match_no")).join(merged, [*PARA, "match_no"])
    names = [*ANY_TRUE, *FIRST_SET]
    renamed = firsts.select(*PARA, *RUN_ORDER, *(F.col(c).alias(f"__{c}") for c in names), F.lit(True).alias("__hit"))
    runs, counts = replace_text(query, new)
    out = runs.join(renamed, [*PARA, *RUN_ORDER], "left")
    for c in names:
        out = out.withColumn(c, F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)))
    return out.select(*runs.columns), counts


def replace_markdown(query: Query, markdown: str) -> tuple[DataFrame, DataFrame]:
    """Matches become the runs of an inline Markdown text: rest of the first run, new runs with the merged properties and their own, rest of the last run. Links become plain text."""
    from .markdown_import import inline_runs

    new = inline_runs(markdown)
    marker = f"\ue000{uuid.uuid4().hex}\ue001"  # no text holds it
    runs, counts = replace_formatted(query, marker)
    pieces = F.split("text", marker, -1)
    tokens = F.array(*(F.struct(F.lit(t.text).alias("text"), F.lit(t.bold).alias("bold"), F.lit(t.italic).alias("italic"), F.lit(t.strike).alias("strike"), F.lit(t.code).alias("code")) for t in new)) if new else F.array().cast("array<struct<text:string,bold:boolean,italic:boolean,strike:boolean,code:boolean>>")
    plain = lambda x: F.struct(x.alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit(False).alias("strike"), F.lit(False).alias("code"))
    parts = F.aggregate(F.slice(pieces, 2, F.size(pieces)), F.array(plain(F.element_at(pieces, 1))), lambda a, p: F.concat(a, tokens, F.array(plain(p))))
    split = runs.withColumn("__parts", F.when(F.col("text").contains(marker), F.filter(parts, lambda p: p["text"] != "")).otherwise(F.array(plain(F.col("text")))))
    spread = split.select("*", F.posexplode("__parts").alias("__k", "__p"))
    either = lambda c: F.when(F.col(f"__p.{c}"), True).otherwise(F.col(c)).alias(c)
    w2 = Window.partitionBy(*PARA, "inline_pos").orderBy("run_pos", "__k")
    out = spread.withColumn("__n", F.row_number().over(w2) - 1)
    columns = []
    for c in runs.columns:
        if c == "text":
            columns.append(F.col("__p.text").alias("text"))
        elif c in ("bold", "italic", "strike"):
            columns.append(either(c))
        elif c == "font":
            columns.append(F.when(F.col("__p.code"), "Courier New").otherwise(F.col("font")).alias("font"))
        elif c == "run_pos":
            columns.append(F.col("__n").alias("run_pos"))
        else:
            columns.append(F.col(c))
    return out.select(*columns), counts


def set_property(query: Query, column: str, value) -> tuple[DataFrame, DataFrame]:
    """Whole runs of matches get a property; n counts each match's runs, a run of two matches twice."""
    places = query.results().select(*PARA, F.explode("run_places").alias("__p")).select(*PARA, "__p.inline_pos", "__p.run_pos")
    counts = places.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    hit = places.distinct().withColumn("__hit", F.lit(True))
    out = query.runs.join(hit, [*PARA, *RUN_ORDER], "left").withColumn(column, F.when(F.col("__hit"), F.lit(value)).otherwise(F.col(column)))
    return out.select(*query.runs.columns), counts


def set_style(query: Query, style: str) -> tuple[DataFrame, DataFrame]:
    """Paragraphs with matches get a style; n counts paragraphs."""
    hit = query.results().select(*PARA).distinct().withColumn("__hit", F.lit(True))
    out = query.paragraphs.join(hit, list(PARA), "left").withColumn("style", F.when(F.col("__hit"), F.lit(style)).otherwise(F.col("style")))
    return out.select(*query.paragraphs.columns), hit.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
