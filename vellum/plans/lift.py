"""The driver's tables as document tables, natively; and the same as SQL, for the oracles.

documents: a document is a row, a paragraph a line (the first a heading), a run a sentence piece.
orders and lineitem: a document with one table per order. conversations: a document per conversation, a
paragraph per turn with a tracked change. labels: comments. Properties come from positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.wordml import TABLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("para_ord", "text"))
    listed = F.col("para_ord") % 5 == 4
    return lines.select("doc_id", F.lit("body").alias("story"), "para_ord", F.when(F.col("para_ord") == 0, "Heading1").when(F.col("para_ord") % 7 == 6, "Quote").otherwise("").alias("style"), F.lit(None).cast("string").alias("alignment"), F.when(listed, F.col("para_ord") % 3).alias("ilvl"), F.when(listed, F.col("para_ord") % 4 + 1).alias("num_id"), "text")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = paragraphs(spark, sf_dir).select("doc_id", "story", "para_ord", F.split("text", "\\. ", -1).alias("p")).select("doc_id", "story", "para_ord", F.size("p").alias("n"), F.posexplode("p").alias("inline_pos", "piece"))
    p = F.col("inline_pos")
    return pieces.select(
        "doc_id", "story", "para_ord", "inline_pos", F.lit(0).alias("run_pos"), F.lit("run").alias("container"), F.when(p < F.col("n") - 1, F.concat("piece", F.lit(". "))).otherwise(F.col("piece")).alias("text"), (p % 2 == 1).alias("bold"), (p % 3 == 2).alias("italic"), (p % 5 == 4).alias("strike"),
        F.when(p % 8 == 7, "single").alias("underline"), F.lit(None).cast("string").alias("style"), F.when(p % 7 == 6, "Consolas").alias("font"), F.when(p % 4 == 3, "24").alias("size"), F.when(p % 6 == 5, "FF0000").alias("color"),
    )


PARAS_SQL = """
paras as (select doc_id, i - 1 as para_ord, line as text, case when i = 1 then 'Heading1' when (i - 1) % 7 = 6 then 'Quote' else '' end as style, case when (i - 1) % 5 = 4 then (i - 1) % 3 end as ilvl, case when (i - 1) % 5 = 4 then (i - 1) % 4 + 1 end as num_id
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents))"""
RUNS_SQL = (
    PARAS_SQL
    + """,
runs as (select doc_id, para_ord, p, text, p % 2 = 1 as bold, p % 3 = 2 as italic, p % 5 = 4 as strike, case when p % 8 = 7 then 'single' end as underline, case when p % 7 = 6 then 'Consolas' end as font, case when p % 4 = 3 then '24' end as size, case when p % 6 = 5 then 'FF0000' end as color
  from (select doc_id, para_ord, r - 1 as p, piece || case when r < n then '. ' else '' end as text
    from (select doc_id, para_ord, len(string_split(text, '. ')) as n, unnest(string_split(text, '. ')) as piece, generate_subscripts(string_split(text, '. '), 1) as r from paras)))"""
)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table per order: a header row, then a row per line item."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    body = items.withColumn("row_idx", F.row_number().over(w)).select(F.col("l_orderkey").alias("doc_id"), "row_idx", F.array(F.concat(F.lit("part "), F.col("l_partkey").cast("string")), F.col("l_suppkey").cast("string")).alias("c"))
    head = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("row_idx"), F.array(F.col("o_orderpriority"), F.lit("id")).alias("c"))
    return head.unionByName(body).select("doc_id", F.lit(0).alias("table_ord"), "row_idx", F.posexplode("c").alias("col_idx", "text")).withColumn("para_idx", F.lit(0))


CELLS_SQL = """
rws as (select o_orderkey as doc_id, 0 as row_idx, o_orderpriority as c0, 'id' as c1 from orders
  union all select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey), 'part ' || l_partkey, cast(l_suppkey as varchar) from lineitem)"""


def inlines(runs: DataFrame) -> DataFrame:
    """The inlines of lifted runs, one each."""
    none = [F.lit(None).cast("string").alias(c) for c in ("rel_id", "anchor", "author", "date_str", "raw")]
    return runs.select("doc_id", "story", "para_ord", "inline_pos", F.lit("run").alias("kind"), F.lit(None).cast("int").alias("ref_id"), *none)


def empty(spark: SparkSession, name: str) -> DataFrame:
    """A document table without rows."""
    return spark.createDataFrame([], f"doc_id long, {TABLES[name]}")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two comments for each labelled document, the second empty unless it is toxic."""
    rows = table(spark, sf_dir, "labels").select("doc_id", F.posexplode(F.array(F.concat(F.lit("quality "), F.col("quality").cast("string")), F.when(F.col("toxic") == 1, "toxic").otherwise(""))).alias("comment_pos", "text"))
    return rows.select("doc_id", "comment_pos", (F.col("comment_pos") * 3).alias("comment_id"), F.when(F.col("comment_pos") == 0, "rater").otherwise("filter").alias("author"), F.lit(None).cast("string").alias("date_str"), F.lit(None).cast("string").alias("initials"), "text")


COMMENTS_SQL = """
comments as (select doc_id, 0 as comment_pos, 0 as comment_id, 'rater' as author, 'quality ' || quality as text from labels
  union all select doc_id, 1, 3, 'filter', case when toxic = 1 then 'toxic' else '' end from labels)"""


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment 0 spans the first two paragraphs, comment 3 the third alone."""
    spot = lambda kind, ref, para, at: F.struct(F.lit(kind).alias("kind"), F.lit(ref).alias("ref_id"), F.lit(para).alias("para_ord"), F.lit(at).alias("inline_pos"))
    spots = F.array(spot("commentRangeStart", 0, 0, 0), spot("commentRangeEnd", 0, 1, 9), spot("commentRangeStart", 3, 2, 0), spot("commentRangeEnd", 3, 2, 9))
    return table(spark, sf_dir, "labels").select("doc_id", F.explode(spots).alias("m")).select("doc_id", F.lit("body").alias("story"), "m.para_ord", "m.inline_pos", "m.kind", "m.ref_id")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inlines of conversations: in even turns a run, a deletion (the role) and an insertion (the text); in odd ones insertion, run, deletion."""
    t = table(spark, sf_dir, "conversations")
    one = lambda kind, text, deleted, ref: F.struct(F.lit(kind).alias("kind"), text.alias("text"), deleted.alias("del_text"), ref.cast("int").alias("ref_id"))
    run = one("run", F.lit("say: "), F.lit(""), F.lit(None))
    gone, new = one("del", F.lit(""), F.col("role"), F.col("turn") * 2), one("ins", F.col("text"), F.lit(""), F.col("turn") * 2 + 1)
    listed = F.when(F.col("turn") % 2 == 0, F.array(run, gone, new)).otherwise(F.array(new, run, gone))
    return t.select(F.col("conv_id").alias("doc_id"), F.lit("body").alias("story"), F.col("turn").cast("int").alias("para_ord"), F.posexplode(listed).alias("inline_pos", "i")).select("doc_id", "story", "para_ord", "inline_pos", "i.kind", "i.ref_id", F.lit("a").alias("author"), F.lit(None).cast("string").alias("date_str"), "i.text", "i.del_text")


CHANGES_SQL = """
changes as (select conv_id as doc_id, turn as para_ord, k as inline_pos, kind, ref_id, text, del_text from (
  select conv_id, turn, case when turn % 2 = 0 then 0 else 1 end as k, 'run' as kind, null as ref_id, 'say: ' as text, '' as del_text from conversations
  union all select conv_id, turn, case when turn % 2 = 0 then 1 else 2 end, 'del', turn * 2, '', role from conversations
  union all select conv_id, turn, case when turn % 2 = 0 then 2 else 0 end, 'ins', turn * 2 + 1, text, '' from conversations))"""


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown document per part: heading, prose of two lines, rule, quote, lists, fence, table."""
    p = table(spark, sf_dir, "part")
    lines = ["# ", F.col("p_name"), "\n\nplain **", F.col("p_brand"), "** of\nsize *", F.col("p_size").cast("string"), "* and `", F.col("p_type"), "`\n---\n> ", F.col("p_type"), "\n- ", F.col("p_name"), "\n12. ", F.col("p_brand"), "\n```\n# not a heading\n```\n#tag ~~", F.col("p_type"), "~~\n| id | name |\n|---|:-:|\n| ", F.col("p_partkey").cast("string"), " | ", F.col("p_name"), " |\n| short |\n"]
    return p.select(F.col("p_partkey").alias("doc_id"), F.concat(*(F.lit(x) if isinstance(x, str) else x for x in lines)).alias("md"))


MD_SQL = """
md as (select p_partkey as doc_id, '# ' || p_name || chr(10) || chr(10) || 'plain **' || p_brand || '** of' || chr(10) || 'size *' || p_size || '* and `' || p_type || '`' || chr(10) || '---' || chr(10) || '> ' || p_type || chr(10) || '- ' || p_name || chr(10) || '12. ' || p_brand || chr(10) || '```' || chr(10) || '# not a heading' || chr(10) || '```' || chr(10) || '#tag ~~' || p_type || '~~' || chr(10) || '| id | name |' || chr(10) || '|---|:-:|' || chr(10) || '| ' || p_partkey || ' | ' || p_name || ' |' || chr(10) || '| short |' || chr(10) as md from part),
lns as (select doc_id, i - 1 as line_no, line from (select doc_id, unnest(string_split(md, chr(10))) as line, generate_subscripts(string_split(md, chr(10)), 1) as i from md)),
kinds as (select doc_id, line_no, line, case when starts_with(line, '```') then 'fence' when coalesce(sum(case when starts_with(line, '```') then 1 else 0 end) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) % 2 = 1 then 'code' when regexp_matches(trim(line), '^(-{3,}|\\*{3,}|_{3,})$') then 'rule' when regexp_matches(line, '^#{1,6}( |$)') then 'heading' when starts_with(line, '>') then 'quote' when regexp_matches(line, '^[-*+] ') then 'bullet' when regexp_matches(line, '^[0-9]+\\. ') then 'number' when starts_with(trim(line), '|') then 'table' when trim(line) = '' then 'blank' else 'text' end as kind from lns)"""
