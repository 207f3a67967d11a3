"""Search over paragraphs: literal or pattern, style, case, first and nth, matches mapped to runs.

A match lies in one paragraph's direct runs, glued together; text inside insertions and links is not seen
(``include_inserted`` adds it). Literal matches may overlap, pattern matches don't. Offsets count characters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markup import is_code, run_markdown
from .text import PARA, RUN_ORDER, joined

SPAN = "array<struct<start:int,end:int>>"


#: Capitals whose lower case has two characters or depends on what follows, and one character for each.
CAPITALS, SMALL = "İΣ", "iσ"


def lowered(text):
    """Column: lower case, character for character, so that offsets stay."""
    return F.lower(F.translate(text, CAPITALS, SMALL))


def lowered_literal(needle: str) -> str:
    return needle.translate(str.maketrans(CAPITALS, SMALL)).lower()


def literal_starts(text, needle: str, case_sensitive: bool = False):
    """Column: the number of overlapping occurrences, by lookahead; no generator and no lambda over characters."""
    if not needle:
        return F.lit(0)
    low = text if case_sensitive else lowered(text)
    pattern = "(?=(" + _quoted(needle if case_sensitive else lowered_literal(needle)) + "))"
    return F.size(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)))


def _quoted(needle: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in needle)


def run_spans(runs: DataFrame, include_inserted: bool = False) -> DataFrame:
    """Searched runs with ``start`` and ``end`` in their paragraph's searched text."""
    kinds = ["run", "ins", "hyperlink"] if include_inserted else ["run"]
    w = Window.partitionBy(*PARA).orderBy(*RUN_ORDER)
    end = F.sum(F.length("text")).over(w)
    return runs.where(F.col("container").isin(kinds)).withColumn("end", end.cast("int")).withColumn("start", (F.col("end") - F.length("text")).cast("int"))


@dataclass(frozen=True)
class Query:
    """A search that is put together step by step and run by a terminal method."""

    paragraphs: DataFrame
    runs: DataFrame
    needle: str
    is_pattern: bool = False
    case: bool = False
    style: str = ""
    which: int | None = None
    inserted: bool = False

    def case_sensitive(self, on: bool = True) -> Query:
        return replace(self, case=on)

    def in_style(self, style: str) -> Query:
        return replace(self, style=style)

    def first(self) -> Query:
        return replace(self, which=0)

    def nth(self, n: int) -> Query:
        return replace(self, which=n if n >= 0 else None)

    def include_inserted(self) -> Query:
        return replace(self, inserted=True)

    def texts(self) -> DataFrame:
        """The searched text of each paragraph of the wanted style; the style filter stands before all else."""
        keep = self.paragraphs.where(F.coalesce("style", F.lit("")) == self.style) if self.style else self.paragraphs
        kinds = ["run", "ins", "hyperlink"] if self.inserted else ["run"]
        text = self.runs.where(F.col("container").isin(kinds)).groupBy(*PARA).agg(joined(F.col("text"), RUN_ORDER).alias("text"))
        return keep.select(*PARA).join(text, list(PARA))

    def hits(self) -> DataFrame:
        """doc_id, story, para_ord, start, end of every match."""
        return matches(self.texts(), self.needle, self.is_pattern, self.case)

    def pieces(self) -> DataFrame:
        """The runs of every match with the part of their text that is in it: match_no, run_no, all columns of a run."""
        r = self.results().select(*PARA, "match_no", "n_runs", "first_start", "last_end", F.posexplode("run_places").alias("run_no", "__p")).select("*", "__p.inline_pos", "__p.run_pos").drop("__p")
        start = F.when(F.col("run_no") == 0, F.col("first_start")).otherwise(0)
        end = F.when(F.col("run_no") == F.col("n_runs") - 1, F.col("last_end")).otherwise(F.length("text"))
        both = r.join(self.runs, [*PARA, *RUN_ORDER]).withColumn("text", F.substring(F.col("text"), start + 1, end - start))
        return both.select("match_no", "run_no", *self.runs.columns)

    def markdown(self) -> DataFrame:
        """doc_id, match_no, md: each match as Markdown, with the emphasis of its runs."""
        md = run_markdown(F.col("text"), F.col("bold"), F.col("italic"), F.col("strike"), is_code(F.col("style"), F.col("font")))
        listed = F.array_sort(F.collect_list(F.struct("run_no", md.alias("md"))))
        return self.pieces().groupBy("doc_id", "match_no").agg(F.array_join(F.transform(listed, lambda x: x["md"]), "").alias("md"))

    def rich_json(self) -> DataFrame:
        """doc_id, match_no, json: a text node of a match in one run, else a paragraph of text nodes."""
        from .richjson import run_nodes

        nodes = run_nodes(self.pieces().where("text <> ''").drop("content")).withColumn("node", F.element_at("nodes", 1))
        listed = nodes.groupBy("doc_id", "match_no").agg(F.array_sort(F.collect_list(F.struct("run_no", "node"))).alias("l"))
        joined_ = F.array_join(F.transform("l", lambda x: x["node"]), ",")
        return listed.select("doc_id", "match_no", F.when(F.size("l") == 1, joined_).otherwise(F.concat(F.lit('{"type":"paragraph","content":['), joined_, F.lit("]}"))).alias("json"))

    def anchors(self, text: str | None = None) -> DataFrame:
        """doc_id, story, para_ord, first and last inline position of every match, as ``add_comments`` and ``add_revisions`` take them."""
        places = self.results().select(*PARA, "match_no", F.element_at("run_places", 1)["inline_pos"].alias("first"), F.element_at("run_places", -1)["inline_pos"].alias("last"))
        return places if text is None else places.withColumn("text", F.lit(text))

    def add_comment(self, comments: DataFrame, text: str, **options) -> tuple[DataFrame, DataFrame]:
        """(comments, new markers): a comment on every match."""
        from .comments import add_comments

        return add_comments(comments, self.anchors(text), **options)

    def add_revision(self, inlines: DataFrame, text: str, **options) -> DataFrame:
        """inlines with every match's runs deleted and a new text inserted; of matches that share a run, the first."""
        from .revisions import add_revisions

        spread = self.anchors().withColumn("__i", F.explode(F.sequence("first", "last")))
        w = Window.partitionBy(*PARA, "__i")
        apart = spread.withColumn("__least", F.min("match_no").over(w)).groupBy(*PARA, "match_no", "first", "last").agg(F.max(F.col("__least") < F.col("match_no")).alias("__meets")).where("not __meets")
        once = apart.groupBy(*PARA).agg(F.min(F.struct("first", "last")).alias("a")).select(*PARA, "a.first", "a.last")  # one change of a paragraph at a time
        return add_revisions(inlines, once, text, **options)

    def results(self) -> DataFrame:
        """Numbered matches with the runs they touch: match_no, n_runs, first_start, last_end, text, and the runs' places.

        A match that touches no run is not a result. first_start is in the first run, last_end in the last.
        """
        spans = run_spans(self.runs, self.inserted).select(*PARA, *RUN_ORDER, F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("text").alias("__t"))
        touched = self.hits().join(spans, list(PARA)).where("__e > start and __s < end")
        piece = F.substring(F.col("__t"), F.greatest(F.col("start") - F.col("__s"), F.lit(0)) + 1, F.least(F.col("end"), F.col("__e")) - F.greatest(F.col("start"), F.col("__s")))
        places = F.array_sort(F.collect_list(F.struct(*RUN_ORDER, F.col("__s"), F.col("__e"))))
        found = touched.groupBy(*PARA, "start", "end").agg(places.alias("__runs"), joined(piece, RUN_ORDER).alias("text"))
        w = Window.partitionBy("doc_id").orderBy("story", "para_ord", "start", "end")
        numbered = found.select(*PARA, "start", "end", "text", F.size("__runs").alias("n_runs"), (F.col("start") - F.element_at("__runs", 1)["__s"]).alias("first_start"), (F.col("end") - F.element_at("__runs", -1)["__s"]).alias("last_end"), F.transform("__runs", lambda r: F.struct(r["inline_pos"].alias("inline_pos"), r["run_pos"].alias("run_pos"))).alias("run_places"))
        numbered = numbered.withColumn("match_no", F.row_number().over(w) - 1)
        return numbered if self.which is None else numbered.where(F.col("match_no") == self.which)


def matches(texts: DataFrame, needle: str, is_pattern: bool = False, case_sensitive: bool = False) -> DataFrame:
    """The places of a literal (overlapping) or a pattern in texts (doc_id, story, para_ord, text)."""
    if is_pattern:
        expression = re.compile(needle)

        @F.pandas_udf(SPAN)
        def found(text: pd.Series) -> pd.Series:
            return text.map(lambda x: [{"start": m.start(), "end": m.end()} for m in expression.finditer(x or "")])

        spans = found(F.col("text"))
        texts = texts.where(F.col("text").isNotNull())
    else:
        low = F.col("text") if case_sensitive else lowered(F.col("text"))
        word = needle if case_sensitive else lowered_literal(needle)
        # split at every start: the lengths of the pieces between lookahead matches are the places
        n = len(word)
        parts = F.split(low, "(?=" + _quoted(word) + ")", -1)
        ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda a, p: a + F.length(p)))
        starts = F.filter(F.concat(F.array(F.lit(0)), ends), lambda s: F.substring(low, s + 1, F.lit(n)) == word)
        spans = F.transform(F.array_distinct(starts), lambda s: F.struct(s.cast("int").alias("start"), (s + n).cast("int").alias("end")))
        texts = texts.where(low.contains(word))
    listed = texts.select(*PARA, spans.alias("__spans"))
    return listed.select(*PARA, F.explode("__spans").alias("__m")).select(*PARA, "__m.start", "__m.end")


def search(paragraphs: DataFrame, runs: DataFrame, needle: str) -> Query:
    return Query(paragraphs, runs, needle)


def find(paragraphs: DataFrame, runs: DataFrame, needle: str) -> DataFrame:
    return search(paragraphs, runs, needle).results()


def find_regex(paragraphs: DataFrame, runs: DataFrame, pattern: str) -> DataFrame:
    return Query(paragraphs, runs, pattern, is_pattern=True).results()
