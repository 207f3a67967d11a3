"""Tracked changes. A change's partner is the insertion or deletion right beside it; pairs are fixed on the order as given, then all decisions apply together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markup import is_code, run_markdown
from .comments import renumbered
from .text import PARA


def with_partners(inlines: DataFrame) -> DataFrame:
    """inlines with partner_pos: of an insertion the deletion just before, of a deletion the insertion just after, else null."""
    w = Window.partitionBy(*PARA).orderBy("inline_pos")
    before, after = F.lag("kind").over(w), F.lead("kind").over(w)
    at = F.when((F.col("kind") == "ins") & (before == "del"), F.lag("inline_pos").over(w)).when((F.col("kind") == "del") & (after == "ins"), F.lead("inline_pos").over(w))
    return inlines.withColumn("partner_pos", at)


def revisions(inlines: DataFrame) -> DataFrame:
    """The changes in document order."""
    w = Window.partitionBy("doc_id").orderBy("para_ord", "inline_pos")
    return inlines.where("kind in ('ins', 'del')").withColumn("rank", F.row_number().over(w) - 1)


def original_text(kind, text, deleted):
    return F.when(kind == "del", deleted).otherwise("")


def proposed_text(kind, text, deleted):
    return F.when(kind == "ins", text).otherwise("")


def revision_markdown(inlines: DataFrame, runs: DataFrame, story: str = "body") -> DataFrame:
    """doc_id, ref_id, kind, original, proposed: the changed runs as Markdown. Of a deletion the deleted text (or else its plain text) is the original, of an insertion its text is the proposal; the other is empty."""
    changed = inlines.where((F.col("kind").isin("ins", "del")) & (F.col("story") == story)).select(*PARA, "inline_pos", "kind", "ref_id")
    gone = F.when(F.coalesce("del_text", F.lit("")) != "", F.col("del_text")).otherwise(F.coalesce("text", F.lit("")))
    text = F.when(F.col("kind") == "del", gone).otherwise(F.coalesce("text", F.lit("")))
    md = run_markdown(text, F.col("bold"), F.col("italic"), F.col("strike"), is_code(F.col("style"), F.col("font")))
    both = changed.join(runs, [*PARA, "inline_pos"], "left")
    listed = F.array_sort(F.collect_list(F.struct("para_ord", "inline_pos", "run_pos", md.alias("md"))))
    whole = both.groupBy("doc_id", "ref_id", "kind").agg(F.array_join(F.transform(listed, lambda x: x["md"]), "").alias("md"))
    return whole.select("doc_id", "ref_id", "kind", F.when(F.col("kind") == "del", F.col("md")).otherwise("").alias("original"), F.when(F.col("kind") == "ins", F.col("md")).otherwise("").alias("proposed"))


def revisions_for_text(inlines: DataFrame, needle: str) -> DataFrame:
    """Insertions whose text holds the needle (case counts)."""
    return inlines.where((F.col("kind") == "ins") & F.col("text").contains(needle))


def next_revision_id(inlines: DataFrame) -> DataFrame:
    return inlines.groupBy("doc_id").agg((F.coalesce(F.max(F.when(F.col("kind").isin("ins", "del"), F.col("ref_id"))), F.lit(-1)) + 1).alias("next_id"))


def _chosen(inlines: DataFrame, which: DataFrame | None) -> DataFrame:
    """inlines with partners, and whether the change itself (``mine``) or its partner (``by_partner``) is chosen."""
    paired = with_partners(inlines)
    if which is None:
        mine = paired.withColumn("mine", F.col("kind").isin("ins", "del"))
    else:
        keys = which.select("doc_id", "ref_id").distinct().withColumn("__y", F.lit(True))
        mine = paired.join(keys, ["doc_id", "ref_id"], "left").withColumn("mine", F.coalesce("__y", F.lit(False)) & F.col("kind").isin("ins", "del")).drop("__y")
    w = Window.partitionBy(*PARA).orderBy("inline_pos")
    beside = F.when(F.col("kind") == "del", F.lead("mine").over(w)).when(F.col("kind") == "ins", F.lag("mine").over(w))
    return mine.withColumn("by_partner", F.col("partner_pos").isNotNull() & F.coalesce(beside, F.lit(False)))


def accept(inlines: DataFrame, which: DataFrame | None = None, keep_paired_insert: bool = True) -> DataFrame:
    """Insertions become plain, their paired deletions go, and chosen deletions go.

    keep_paired_insert: an insertion paired with a chosen deletion stays (as a change); otherwise it goes, too.
    """
    c = _chosen(inlines, which)
    gone = (F.col("kind") == "del") & (F.col("mine") | F.col("by_partner"))
    if not keep_paired_insert:
        gone = gone | ((F.col("kind") == "ins") & F.col("by_partner") & ~F.col("mine"))
    plain = F.when((F.col("kind") == "ins") & F.col("mine"), "run").otherwise(F.col("kind"))
    return renumbered(c.where(~gone).withColumn("kind", plain).select(*inlines.columns))


def reject(inlines: DataFrame, which: DataFrame | None = None) -> DataFrame:
    """Chosen insertions go and their paired deletions become plain again; so do chosen deletions, whose paired insertions go."""
    c = _chosen(inlines, which)
    gone = (F.col("kind") == "ins") & (F.col("mine") | F.col("by_partner"))
    back = (F.col("kind") == "del") & (F.col("mine") | F.col("by_partner"))
    out = c.where(~gone).withColumn("text", F.when(back, F.col("del_text")).otherwise(F.col("text"))).withColumn("del_text", F.when(back, F.lit("")).otherwise(F.col("del_text"))).withColumn("kind", F.when(back, "run").otherwise(F.col("kind")))
    return renumbered(out.select(*inlines.columns))


def remove(inlines: DataFrame, which: DataFrame | None = None) -> DataFrame:
    """Chosen changes and their partners go, without being accepted or rejected."""
    c = _chosen(inlines, which)
    return renumbered(c.where(~(F.col("mine") | F.col("by_partner"))).select(*inlines.columns))


def override(inlines: DataFrame, which: DataFrame, text: str, author: str = "Unknown", date: str | None = None) -> DataFrame:
    """Chosen insertions get a new text, author, date and id (consecutive after the document's largest); deletions are refused."""
    largest = next_revision_id(inlines)
    keys = which.select("doc_id", "ref_id").distinct().withColumn("__y", F.lit(True))
    c = inlines.join(keys, ["doc_id", "ref_id"], "left").join(largest, "doc_id", "left")
    hit = F.coalesce("__y", F.lit(False)) & (F.col("kind") == "ins")
    k = F.sum(hit.cast("int")).over(Window.partitionBy("doc_id").orderBy("para_ord", "inline_pos").rowsBetween(Window.unboundedPreceding, 0))
    out = c.withColumn("__k", k).withColumn("__hit", hit)
    out = out.withColumn("text", F.when(F.col("__hit"), F.lit(text)).otherwise(F.col("text"))).withColumn("author", F.when(F.col("__hit"), F.lit(author)).otherwise(F.col("author"))).withColumn("date_str", F.when(F.col("__hit"), F.lit(date)).otherwise(F.col("date_str"))).withColumn("ref_id", F.when(F.col("__hit"), F.col("next_id") + F.col("__k") - 1).otherwise(F.col("ref_id")).cast("int"))
    return out.select(*inlines.columns)


def add_revisions(inlines: DataFrame, which: DataFrame, text: str, author: str = "Unknown", date: str | None = None) -> DataFrame:
    """Chosen plain runs (doc_id, story, para_ord, first, last) become a deletion followed by an insertion of a new text.

    The deletion's id is the document's next, the insertion's one more. Markers between the runs stay.
    """
    w = Window.partitionBy("doc_id").orderBy("para_ord", "first")
    chosen = which.join(next_revision_id(inlines), "doc_id").withColumn("__id", F.col("next_id") + 2 * (F.row_number().over(w) - 1)).drop("next_id")
    c = inlines.join(chosen, list(PARA), "left").withColumn("__in", F.coalesce((F.col("kind") == "run") & F.col("inline_pos").between(F.col("first"), F.col("last")), F.lit(False)))
    old = c.withColumn("del_text", F.when(F.col("__in"), F.col("text")).otherwise(F.col("del_text"))).withColumn("text", F.when(F.col("__in"), F.lit("")).otherwise(F.col("text"))).withColumn("kind", F.when(F.col("__in"), "del").otherwise(F.col("kind"))).withColumn("ref_id", F.when(F.col("__in"), F.col("__id")).otherwise(F.col("ref_id")).cast("int")).withColumn("author", F.when(F.col("__in"), F.lit(author)).otherwise(F.col("author"))).withColumn("date_str", F.when(F.col("__in"), F.lit(date)).otherwise(F.col("date_str")))
    new = {"inline_pos": F.col("last") + 0.5, "kind": F.lit("ins"), "ref_id": (F.col("__id") + 1).cast("int"), "text": F.lit(text), "del_text": F.lit(""), "author": F.lit(author), "date_str": F.lit(date)}
    added = chosen.select(*(new[x].alias(x) if x in new else F.col(x) if x in PARA else F.lit(None).cast(inlines.schema[x].dataType).alias(x) for x in inlines.columns))
    return renumbered(old.select(*inlines.columns).withColumn("inline_pos", F.col("inline_pos").cast("double")).unionByName(added.withColumn("inline_pos", F.col("inline_pos").cast("double")))).withColumn("inline_pos", F.col("inline_pos").cast("int"))
