"""Every query of the document engine, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup, richjson, units
from ..operators import comments as notes
from ..operators import building, edits, markdown_export, markdown_import, packages, revisions, sections, styles, text
from ..operators import richjson as trees
from ..operators.search import Query, literal_starts, search
from ..sources import documents as files
from . import lift

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _long(name: str) -> Column:
    return F.col(name).cast("long").alias(name)


def md5(c: str | Column) -> Column:
    return F.md5(F.col(c) if isinstance(c, str) else c)


# --- navigation and text


@query(f"with {lift.PARAS_SQL} select doc_id, para_ord, style, length(text) as n_chars from paras")
def para_flatten(spark, sf):
    return lift.paragraphs(spark, sf).select("doc_id", _long("para_ord"), "style", F.length("text").cast("long").alias("n_chars"))


@query(f"with {lift.RUNS_SQL} select doc_id, para_ord, md5(string_agg(text, '' order by p)) as text_md5 from runs group by doc_id, para_ord")
def para_text(spark, sf):
    return text.paragraph_text(lift.paragraphs(spark, sf).drop("text"), lift.runs(spark, sf)).select("doc_id", _long("para_ord"), md5("text").alias("text_md5"))


@query("select doc_id, md5(text) as text_md5 from documents")
def doc_text(spark, sf):
    blocks = lift.paragraphs(spark, sf).withColumnRenamed("para_ord", "block_pos")
    return text.document_text(text.story_text(blocks)).select("doc_id", md5("text").alias("text_md5"))


@query(f"with {lift.COMMENTS_SQL} select d.doc_id, md5(d.text || coalesce(c.notes, '')) as text_md5 from documents d left join (select doc_id, string_agg(chr(10) || text, '' order by comment_pos) as notes from comments where text <> '' group by doc_id) c on c.doc_id = d.doc_id")
def doc_text_with_comments(spark, sf):
    body = lift.table(spark, sf, "documents").select("doc_id", "text")
    return text.document_text(body, lift.comments(spark, sf)).select("doc_id", md5("text").alias("text_md5"))


@query(f"with {lift.CELLS_SQL} select doc_id, string_agg(c0 || chr(9) || c1, chr(10) order by row_idx) as text from rws group by doc_id")
def table_text(spark, sf):
    return text.table_text(text.cell_text(lift.cells(spark, sf))).select("doc_id", "text")


@query(f"with {lift.CELLS_SQL} select doc_id, max(row_idx) + 1 as n_rows, 2 as n_cols from rws group by doc_id")
def table_shape(spark, sf):
    return text.table_shape(text.cell_text(lift.cells(spark, sf))).select("doc_id", _long("n_rows"), _long("n_cols"))


@query(f"with {lift.CELLS_SQL} select doc_id, c0 as text from rws where row_idx = 1")
def cell_lookup(spark, sf):
    return text.cell_text(lift.cells(spark, sf)).where("table_ord = 0 and row_idx = 1 and col_idx = 0").select("doc_id", "text")


# --- search


def _counts(spark, sf, needle: str, case: bool = False, style: str = ""):
    paras = lift.paragraphs(spark, sf)
    if style:
        paras = paras.where(F.col("style") == style)
    return paras.groupBy("doc_id").agg(F.sum(literal_starts(F.col("text"), needle, case)).cast("long").alias("n"))


@query("select doc_id, sum((length(line) - length(replace(line, 'the', ''))) // 3)::bigint as n from (select doc_id, lower(unnest(string_split(text, chr(10)))) as line from documents) group by doc_id")
def find_ci(spark, sf):
    return _counts(spark, sf, "the")


@query("select doc_id, sum((length(line) - length(replace(line, 'The', ''))) // 3)::bigint as n from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) group by doc_id")
def find_cs(spark, sf):
    return _counts(spark, sf, "The", case=True)


@query(f"with {lift.PARAS_SQL} select doc_id, sum((length(text) - length(replace(lower(text), 'en', ''))) // 2)::bigint as n from paras where style = 'Heading1' group by doc_id")
def find_in_style(spark, sf):
    return _counts(spark, sf, "en", style="Heading1")


@query(f"with {lift.PARAS_SQL} select doc_id, sum(len(list_filter(range(1, length(text)), lambda i: substr(lower(text), i, 2) = 'ee')))::bigint as n from paras group by doc_id")
def find_overlap_count(spark, sf):
    return _counts(spark, sf, "ee")


def _query(spark, sf, needle: str, **kw) -> Query:
    return Query(lift.paragraphs(spark, sf), lift.runs(spark, sf), needle, **kw)


@query(f"with {lift.PARAS_SQL} select doc_id, sum(len(regexp_extract_all(text, 'th[aeio]+')))::bigint as n from paras group by doc_id having n > 0")
def find_regex(spark, sf):
    return _query(spark, sf, "th[aeio]+", is_pattern=True).hits().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


_SPANS = f"""with {lift.RUNS_SQL},
parts as (select doc_id, para_ord, string_split(lower(text), '%(needle)s') as s from paras),
hits as (select doc_id, para_ord, list_sum([length(x) for x in s[1:k]]) + (k - 1) * %(n)d as start from (select doc_id, para_ord, s, unnest(range(1, len(s))) as k from parts where len(s) > 1)),
spans as (select doc_id, para_ord, p, text, sum(length(text)) over w - length(text) as s, sum(length(text)) over w as e from runs window w as (partition by doc_id, para_ord order by p rows between unbounded preceding and current row)),
touched as (select h.doc_id, h.para_ord, h.start, min(s) as first_s, max(s) as last_s, count(*) as n_runs, string_agg(substr(text, cast(greatest(h.start - s, 0) + 1 as bigint), cast(least(h.start + %(n)d, e) - greatest(h.start, s) as bigint)), '' order by p) as text
  from hits h join spans p on p.doc_id = h.doc_id and p.para_ord = h.para_ord and e > h.start and s < h.start + %(n)d group by h.doc_id, h.para_ord, h.start),
numbered as (select *, row_number() over (partition by doc_id order by para_ord, start) - 1 as match_no from touched)
"""


def _spans(needle: str) -> str:
    return _SPANS.replace("%(needle)s", needle).replace("%(n)d", str(len(needle)))


def _found(df: DataFrame) -> DataFrame:
    return df.select("doc_id", _long("para_ord"), _long("start"), "text")


@query(_spans("tion") + "select doc_id, para_ord, start::bigint as start, text from numbered where match_no = 0")
def find_first(spark, sf):
    return _found(_query(spark, sf, "tion").first().results())


@query(_spans("tion") + "select doc_id, para_ord, start::bigint as start, text from numbered where match_no = 2")
def find_nth(spark, sf):
    return _found(_query(spark, sf, "tion").nth(2).results())


_RUN_MD = "case when text = '' then '' when font = 'Consolas' then '`' || text || '`' else case when strike then '~~' else '' end || case when bold and italic then '***' when bold then '**' when italic then '*' else '' end || text || case when bold and italic then '***' when bold then '**' when italic then '*' else '' end || case when strike then '~~' else '' end end"


@query(_spans("n. t") + "select doc_id, para_ord, start::bigint as start, text, n_runs, (start - first_s)::bigint as first_start, (start + 4 - last_s)::bigint as last_end, match_no from numbered")
def match_spans(spark, sf):
    r = search(lift.paragraphs(spark, sf), lift.runs(spark, sf), "n. t").results()
    return r.select("doc_id", _long("para_ord"), _long("start"), "text", _long("n_runs"), _long("first_start"), _long("last_end"), _long("match_no"))


@query(_spans("n. t") + ", part as (select n.doc_id, n.match_no, r.p, r.bold, r.italic, r.strike, r.font, substr(r.text, (greatest(n.start - r.s, 0) + 1)::bigint, (least(n.start + 4, r.s + length(r.text)) - greatest(n.start, r.s))::bigint) as text from numbered n join (select *, coalesce(sum(length(text)) over (partition by doc_id, para_ord order by p rows between unbounded preceding and 1 preceding), 0) as s from runs) r on r.doc_id = n.doc_id and r.para_ord = n.para_ord and r.s + length(r.text) > n.start and r.s < n.start + 4) select doc_id, match_no, string_agg(" + _RUN_MD + ", '' order by p) as md from part group by doc_id, match_no")
def match_markdown(spark, sf):
    """Matches as Markdown, with the emphasis of the runs that they touch."""
    return search(lift.paragraphs(spark, sf), lift.runs(spark, sf), "n. t").markdown().select("doc_id", _long("match_no"), "md")


@query(f"with {lift.PARAS_SQL}, {lift.COMMENTS_SQL}, w as (select doc_id, 0 as comment_id, string_agg(text, '' order by para_ord) as t, max(para_ord) as last from paras where para_ord <= 1 group by doc_id having max(para_ord) = 1 union all select doc_id, 3, text, 2 from paras where para_ord = 2) select c.doc_id, c.comment_id, c.text from comments c join w on w.doc_id = c.doc_id and w.comment_id = c.comment_id where contains(w.t, 'the ')")
def comments_for_text(spark, sf):
    paras = lift.paragraphs(spark, sf)
    there = paras.groupBy("doc_id").agg(F.max("para_ord").alias("last"))
    marks = lift.markers(spark, sf).join(there, "doc_id").where("para_ord <= last").drop("last")
    return notes.comments_for_text(lift.comments(spark, sf), marks, paras, "the ").select("doc_id", _long("comment_id"), "text")


@query("select conv_id as doc_id, turn as para_ord, md5(text) as text_md5 from conversations where contains(text, 'the')")
def revisions_for_text(spark, sf):
    return revisions.revisions_for_text(lift.changes(spark, sf), "the").select("doc_id", _long("para_ord"), md5("text").alias("text_md5"))


# --- Markdown

_PARA_MD = f"pmd as (select p.doc_id, p.para_ord, p.num_id, case when p.style = 'Heading1' then '# ' when p.style = 'Quote' then '> ' when p.num_id is not null then repeat('  ', p.ilvl::int) || case when p.num_id % 2 = 0 then '1. ' else '- ' end else '' end || r.md as md from paras p join (select doc_id, para_ord, string_agg({_RUN_MD}, '' order by p) as md from runs group by doc_id, para_ord) r on r.doc_id = p.doc_id and r.para_ord = p.para_ord)"


@query(f"with {lift.RUNS_SQL} select doc_id, para_ord, p as inline_pos, md5({_RUN_MD}) as md_md5 from runs")
def run_markdown(spark, sf):
    return markdown_export.runs_markdown(lift.runs(spark, sf)).select("doc_id", _long("para_ord"), _long("inline_pos"), md5("md").alias("md_md5"))


def _paras_md(spark, sf) -> DataFrame:
    return markdown_export.paragraphs_markdown(lift.paragraphs(spark, sf).drop("text"), lift.runs(spark, sf))


@query(f"with {lift.RUNS_SQL}, {_PARA_MD} select doc_id, para_ord, md5(md) as md_md5 from pmd")
def para_markdown(spark, sf):
    return _paras_md(spark, sf).select("doc_id", _long("para_ord"), md5("md").alias("md_md5"))


@query(f"with {lift.RUNS_SQL}, {_PARA_MD} select doc_id, para_ord, num_id, md5(md) as md_md5 from pmd where num_id is not null")
def list_markdown(spark, sf):
    return _paras_md(spark, sf).where("num_id is not null").select("doc_id", _long("para_ord"), _long("num_id"), md5("md").alias("md_md5"))


@query(f"with {lift.CELLS_SQL}, w as (select doc_id, greatest(length(c0), 3) as w0, 3 as w1 from rws where row_idx = 0), l as (select r.doc_id, r.row_idx, '| ' || case when length(c0) < w0 then rpad(c0, w0::int, ' ') else c0 end || ' | ' || case when length(c1) < 3 then rpad(c1, 3, ' ') else c1 end || ' |' || case when r.row_idx = 0 then chr(10) || '| ' || repeat('-', w0::int) || ' | --- |' else '' end as line from rws r join w on w.doc_id = r.doc_id) select doc_id, string_agg(line, chr(10) order by row_idx) as md from l group by doc_id")
def table_markdown(spark, sf):
    cells = markdown_export.cell_markdown(lift.cells(spark, sf).withColumnRenamed("text", "md"))
    return markdown_export.table_markdown(cells).select("doc_id", "md")


@query(f"with {lift.RUNS_SQL}, {_PARA_MD}, {lift.COMMENTS_SQL}, n as (select doc_id, string_agg('[^' || (comment_pos + 1) || ']: ' || author || ': ' || text, chr(10) order by comment_pos) as t from comments group by doc_id) select b.doc_id, md5(b.md || case when n.t is null then '' else chr(10) || chr(10) || n.t end) as md_md5 from (select doc_id, string_agg(md, chr(10) || chr(10) order by para_ord) as md from pmd group by doc_id) b left join n on n.doc_id = b.doc_id")
def doc_markdown_footnotes(spark, sf):
    blocks = _paras_md(spark, sf).withColumnRenamed("para_ord", "block_pos")
    return markdown_export.document_markdown(blocks, lift.comments(spark, sf)).select("doc_id", md5("md").alias("md_md5"))


@query(f"with {lift.MD_SQL} select doc_id, line_no, kind from kinds")
def md_classify_lines(spark, sf):
    return markdown_import.classified(markdown_import.lines_of(lift.markdown(spark, sf))).select("doc_id", _long("line_no"), "kind")


@query("select p_partkey as doc_id, i as para_ord, style, text from (select p_partkey, unnest([0, 1, 2, 3, 4, 5, 6, 7]) as i, unnest(['Heading1', '', '', 'Quote', 'ListBullet', 'ListNumber', '', '']) as style, unnest([p_name, 'plain **' || p_brand || '** of size *' || p_size || '* and `' || p_type || '`', '', p_type, '• ' || p_name, '12. ' || p_brand, '# not a heading', '#tag ~~' || p_type || '~~']) as text from part)")
def md_paragraph_merge(spark, sf):
    return markdown_import.paragraphs(lift.markdown(spark, sf)).select("doc_id", _long("para_ord"), "style", "text")


@query("select p_partkey as doc_id, r as row_idx, c as col_idx, text from (select p_partkey, unnest([0, 0, 1, 1, 2, 2]) as r, unnest([0, 1, 0, 1, 0, 1]) as c, unnest(['id', 'name', p_partkey::varchar, p_name, 'short', '']) as text from part)")
def md_table_parse(spark, sf):
    return markdown_import.table_cells(lift.markdown(spark, sf)).select("doc_id", _long("row_idx"), _long("col_idx"), "text")


@query("select doc_id, para_ord, k as run_pos, text, kind from (select p_partkey as doc_id, 0 as para_ord, 0 as k, p_name as text, '' as kind from part union all select p_partkey, 1, unnest([0, 1, 2, 3, 4, 5]), unnest(['plain ', p_brand, ' of size ', p_size::varchar, ' and ', p_type]), unnest(['', 'bold', '', 'italic', '', 'code']) from part union all select p_partkey, unnest([3, 4, 5, 6, 7, 7]), unnest([0, 0, 0, 0, 0, 1]), unnest([p_type, '• ' || p_name, '12. ' || p_brand, '# not a heading', '#tag ', p_type]), unnest(['', '', '', 'code', '', 'strike']) from part)")
def md_inline_tokens(spark, sf):
    """The tokens of all paragraphs; a line of code is one token, an empty paragraph none."""
    paras = markdown_import.paragraphs(lift.markdown(spark, sf))
    marked = markdown_import.inline_tokens(paras.where("kind != 'code'").select("doc_id", "para_ord", "text"))
    kind = F.when(F.col("bold"), "bold").when(F.col("italic"), "italic").when(F.col("strike"), "strike").when(F.col("code"), "code").otherwise("")
    literal = paras.where("kind = 'code'").select("doc_id", _long("para_ord"), F.lit(0).cast("long").alias("run_pos"), "text", F.lit("code").alias("kind"))
    return marked.select("doc_id", _long("para_ord"), _long("run_pos"), F.col("run_text").alias("text"), kind.alias("kind")).unionByName(literal)


# --- rich JSON


@query(f"with {lift.RUNS_SQL} select doc_id, para_ord, p as inline_pos, case when font = 'Consolas' then 'code' else array_to_string(list_filter([case when bold then 'bold' end, case when italic then 'italic' end, case when underline is not null then 'underline' end, case when strike then 'strike' end, case when size is not null or color is not null then 'textStyle' end], lambda x: x is not null), ',') end as marks from runs")
def pm_marks(spark, sf):
    m = richjson.marks(*(F.col(c) for c in ("bold", "italic", "underline", "strike", "style", "font", "size", "color")))
    return lift.runs(spark, sf).select("doc_id", _long("para_ord"), _long("inline_pos"), F.array_join(F.transform(m, lambda x: x["type"]), ",").alias("marks"))


@query(f"with {lift.PARAS_SQL} select doc_id, 1::bigint as level, text from paras where style = 'Heading1'")
def pm_heading_nodes(spark, sf):
    nodes = trees.paragraph_nodes(lift.paragraphs(spark, sf).drop("text"), lift.runs(spark, sf))
    parsed = F.from_json("node", "type string, attrs struct<level: long>, content array<struct<text: string>>")
    return nodes.withColumn("n", parsed).where("n.type = 'heading'").select("doc_id", F.col("n.attrs.level").alias("level"), F.coalesce(F.array_join("n.content.text", ""), F.lit("")).alias("text"))


@query(f"with {lift.PARAS_SQL} select doc_id, para_ord, style, md5(text) as text_md5 from paras")
def pm_round_trip(spark, sf):
    """Paragraphs exported as JSON documents and imported again."""
    nodes = trees.paragraph_nodes(lift.paragraphs(spark, sf).drop("text"), lift.runs(spark, sf)).withColumnRenamed("para_ord", "block_pos")
    parsed = trees.import_json(trees.document_nodes(nodes)).select("doc_id", "paragraphs", "runs")
    paras = parsed.select("doc_id", F.explode("paragraphs").alias("p")).select("doc_id", "p.*")
    runs = parsed.select("doc_id", F.explode("runs").alias("r")).select("doc_id", "r.*")
    return text.paragraph_text(paras, runs).select("doc_id", _long("para_ord"), F.coalesce("style", F.lit("")).alias("style"), md5("text").alias("text_md5"))


# --- edits


@query(f"with {lift.PARAS_SQL} select doc_id, md5(string_agg(replace(text, 'tion', 'TION!'), chr(10) order by para_ord)) as text_md5 from paras group by doc_id")
def replace_text(spark, sf):
    runs, _ = edits.replace_text(_query(spark, sf, "tion").case_sensitive(), "TION!")
    paras = text.paragraph_text(lift.paragraphs(spark, sf).drop("text"), runs)
    return text.story_text(paras.withColumnRenamed("para_ord", "block_pos")).select("doc_id", md5("text").alias("text_md5"))


@query(f"with {lift.RUNS_SQL} select doc_id, para_ord, bool_or(bold) as bold, bool_or(italic) as italic, bool_or(strike) as strike, first(underline order by p) filter (where underline is not null) as underline, first(font order by p) filter (where font is not null) as font, first(size order by p) filter (where size is not null) as size, first(color order by p) filter (where color is not null) as color from runs group by doc_id, para_ord")
def merged_props(spark, sf):
    merged = edits.merged_properties(lift.runs(spark, sf), ["doc_id", "para_ord"])
    return merged.select("doc_id", _long("para_ord"), *(F.coalesce(c, F.lit(False)).alias(c) for c in edits.ANY_TRUE), *edits.FIRST_SET)


@query(_spans("n. t") + ", big as (select doc_id, para_ord, start, min(p) as p, bool_or(bold) as bold from (select h.doc_id, h.para_ord, h.start, s.p, r.bold from hits h join spans s on s.doc_id = h.doc_id and s.para_ord = h.para_ord and s.e > h.start and s.s < h.start + 4 join runs r on r.doc_id = s.doc_id and r.para_ord = s.para_ord and r.p = s.p) group by doc_id, para_ord, start having count(*) > 1) select r.doc_id, sum(case when r.bold or coalesce(b.bold, false) then 1 else 0 end)::bigint as n_bold, sum(length(r.text))::bigint + coalesce((select -3 * count(*) from hits h where h.doc_id = r.doc_id), 0)::bigint as n_chars from runs r left join (select doc_id, para_ord, p, bool_or(bold) as bold from big group by doc_id, para_ord, p) b on b.doc_id = r.doc_id and b.para_ord = r.para_ord and b.p = r.p group by r.doc_id")
def replace_formatted(spark, sf):
    runs, _ = edits.replace_formatted(_query(spark, sf, "n. t"), "#")
    return runs.groupBy("doc_id").agg(F.sum(F.coalesce("bold", F.lit(False)).cast("long")).alias("n_bold"), F.sum(F.length("text").cast("long")).alias("n_chars"))


@query(_spans("n. t") + "select doc_id, sum(n_runs)::bigint as n from touched group by doc_id")
def set_bold_count(spark, sf):
    return edits.set_property(_query(spark, sf, "n. t"), "bold", True)[1]


@query(f"with {lift.PARAS_SQL} select doc_id, count(*) as n from paras where contains(lower(text), 'tion') group by doc_id")
def set_style_count(spark, sf):
    return edits.set_style(_query(spark, sf, "tion"), "Quote")[1]


# --- comments and tracked changes


@query("select doc_id, 4::bigint as next_id from labels")
def next_comment_id(spark, sf):
    return notes.next_id(lift.comments(spark, sf)).select("doc_id", _long("next_id"))


@query(f"with {lift.COMMENTS_SQL} select doc_id, comment_id, author, text from comments union all select doc_id, 4, 'Unknown', 'seen' from labels")
def add_comment(spark, sf):
    anchors = lift.table(spark, sf, "labels").select("doc_id", F.lit(0).alias("para_ord"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit("seen").alias("text"))
    return notes.add_comments(lift.comments(spark, sf), anchors)[0].select("doc_id", _long("comment_id"), "author", "text")


@query(f"with {lift.COMMENTS_SQL} select doc_id, comment_id, text from comments where text <> 'toxic'")
def remove_comment(spark, sf):
    c = lift.comments(spark, sf)
    return notes.remove_comments(c, lift.markers(spark, sf), c.where("text = 'toxic'"))[0].select("doc_id", _long("comment_id"), "text")


@query("select conv_id as doc_id, turn as para_ord, unnest([1, 2]) as inline_pos, unnest(['del', 'ins']) as kind, unnest([2, 1]) as partner_pos from conversations where turn % 2 = 0")
def revision_partners(spark, sf):
    return revisions.with_partners(lift.changes(spark, sf)).where("partner_pos is not null").select("doc_id", _long("para_ord"), _long("inline_pos"), "kind", _long("partner_pos"))


def _texts(df: DataFrame) -> DataFrame:
    return df.groupBy("doc_id", "para_ord").agg(text.joined(F.col("text"), ["inline_pos"]).alias("t"), F.count(F.lit(1)).alias("n_inlines")).select("doc_id", _long("para_ord"), md5("t").alias("text_md5"), "n_inlines")


@query("select conv_id as doc_id, turn as para_ord, md5(case when turn % 2 = 0 then 'say: ' || text else text || 'say: ' end) as text_md5, 2::bigint as n_inlines from conversations")
def accept_revisions(spark, sf):
    return _texts(revisions.accept(lift.changes(spark, sf)))


@query("select conv_id as doc_id, turn as para_ord, md5('say: ' || role) as text_md5, 2::bigint as n_inlines from conversations")
def reject_revisions(spark, sf):
    return _texts(revisions.reject(lift.changes(spark, sf)))


@query("select conv_id as doc_id, turn as para_ord, md5('say: ') as text_md5, 1::bigint as n_inlines from conversations")
def remove_revisions(spark, sf):
    return _texts(revisions.remove(lift.changes(spark, sf)))


@query("select conv_id as doc_id, turn as para_ord, 'fixed' as text, (max(turn) over (partition by conv_id) * 2 + 1 + row_number() over (partition by conv_id order by turn))::bigint as ref_id from conversations")
def override_revisions(spark, sf):
    c = lift.changes(spark, sf)
    out = revisions.override(c, c.where("kind = 'ins'"), "fixed", "F")
    return out.where("kind = 'ins'").select("doc_id", _long("para_ord"), "text", _long("ref_id"))


@query("select conv_id as doc_id, turn as para_ord, md5('say: ' || case when turn % 2 = 0 then text else '' end) as dummy_md5 from conversations where false union all select conv_id, turn, md5('better') from conversations")
def add_revision(spark, sf):
    c = lift.changes(spark, sf).where("kind = 'run'")
    which = c.select("doc_id", "story", "para_ord", F.col("inline_pos").alias("first"), F.col("inline_pos").alias("last"))
    return revisions.add_revisions(c, which, "better").where("kind = 'ins'").select("doc_id", _long("para_ord"), md5("text").alias("dummy_md5"))


# --- relationships, styles, units, packages


@query("select page_id as doc_id, 'rId1' as rel_id, coalesce(url, '') as url from pages union all select page_id, '', '#top' from pages union all select page_id, 'rId9', '' from pages")
def hyperlink_urls(spark, sf):
    pages = lift.table(spark, sf, "pages")
    rels = pages.select(F.col("page_id").alias("doc_id"), F.lit(0).alias("rel_pos"), F.lit("rId1").alias("rel_id"), F.lit("http://schemas.openxmlformats.org/officeDocument/2006/relationships/hyperlink").alias("rel_type"), F.col("url").alias("target"))
    links = pages.select(F.col("page_id").alias("doc_id"), F.explode(F.array(F.struct(F.lit("rId1").alias("rel_id"), F.lit(None).cast("string").alias("anchor")), F.struct(F.lit("").alias("rel_id"), F.lit("#top").alias("anchor")), F.struct(F.lit("rId9").alias("rel_id"), F.lit(None).cast("string").alias("anchor")))).alias("l")).select("doc_id", "l.*")
    return packages.hyperlink_urls(links, rels).select("doc_id", "rel_id", "url")


@query("select o_custkey as doc_id, 'rId' || (count(*) + 1) as next_id from orders group by o_custkey")
def next_rel_id(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rels = lift.table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit("word/document.xml").alias("source_path"), F.concat(F.lit("rId"), F.row_number().over(w).cast("string")).alias("rel_id"))
    return packages.next_rel_id(rels).select("doc_id", "next_id")


@query("select c_custkey::bigint as doc_id, case when c_custkey % 12 = 0 then 1 when c_custkey % 12 between 1 and 9 then c_custkey % 12 when c_custkey % 12 = 10 then 3 else 0 end::bigint as level from customer")
def style_heading_level(spark, sf):
    k = F.col("c_custkey") % 12
    ids = F.when(k == 0, "Title").when(k.between(1, 9), F.concat(F.lit("Heading"), k.cast("string"))).otherwise("Other")
    names = F.when(k == 10, " Heading 3 ").otherwise("plain")
    return lift.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("doc_id"), markup.style_heading_level(ids, names).cast("long").alias("level"))


@query("select 'Quote' as style_id, 'Quote' as name, '404040' as color, 13::bigint as style_pos union all select 'Heading4', 'heading 4', '2F5496', 7")
def style_lookup(spark, sf):
    own = styles.built_in(spark).withColumn("doc_id", F.lit(0))
    return styles.by_id(own, "Quote").unionByName(styles.by_name(own, "heading 4")).select("style_id", "name", "color", _long("style_pos"))


@query("select c_custkey::bigint as doc_id, unnest(['Normal', 'Quote', 'Title']) as style_id, unnest([0, 2, 1]) as style_pos from customer")
def builtin_ensure(spark, sf):
    docs = lift.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("doc_id"))
    own = docs.crossJoin(F.broadcast(styles.built_in(spark).where("style_id = 'Normal'")))  # one row
    wanted = docs.select("doc_id", F.explode(F.array(*(F.lit(x) for x in ("Normal", "Quote", "Title", "NoSuchStyle")))).alias("style_id"))
    return styles.ensured(own, wanted).select("doc_id", "style_id", _long("style_pos"))


@query("select p_partkey as doc_id, cast(trunc(p_size * 914400) as bigint) as inch, p_size::bigint * 360000 as cm, p_size::bigint * 12700 as pt, p_size::bigint * 635 as twip, p_size * 1000 / 914400.0::double as inches, (p_size * 1000 // 635)::bigint as twips, case when p_size % 2 = 0 then (p_size // 2) || 'pt' else (p_size // 2) || '.5pt' end as label from part")
def units_convert(spark, sf):
    s = F.col("p_size")
    return lift.table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), *(units.to_emu(s, u).alias(u) for u in ("inch", "cm", "pt", "twip")), units.from_emu(s * 1000, "inch").alias("inches"), units.from_emu(s * 1000, "twip").alias("twips"), units.size_label(s.cast("string")).alias("label"))


@query("select p_partkey as doc_id, format('{:02X}{:02X}{:02X}', p_size, p_size * 3, 255 - p_size) as hex, p_size::bigint as r, (p_size * 3)::bigint as g, (255 - p_size)::bigint as b from part")
def color_hex(spark, sf):
    hexed = lift.table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), units.hex_of(F.col("p_size"), F.col("p_size") * 3, 255 - F.col("p_size")).alias("hex"))
    rgb = units.rgb_of(F.concat(F.lit("#"), F.col("hex")))
    return hexed.select("doc_id", "hex", *(rgb[c].cast("long").alias(c) for c in "rgb"))


@query("select c_custkey::bigint as doc_id, 12240::bigint * 635 as page_w_emu, 0::bigint as page_h_emu, c_custkey::bigint * 100 * 635 as margin_top_emu, 'portrait' as orient, 1::bigint as columns, 'nextPage' as break_type from customer")
def section_margins(spark, sf):
    none = F.lit(None).cast("string")
    own = lift.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("doc_id"), F.lit("12240").alias("page_w"), F.lit("wide").alias("page_h"), (F.col("c_custkey") * 100).cast("string").alias("margin_top"), none.alias("orient"), none.alias("columns"), none.alias("break_type"))
    return sections.layout(own).select("doc_id", "page_w_emu", "page_h_emu", "margin_top_emu", "orient", _long("columns"), "break_type")


def _entries(spark, sf) -> DataFrame:
    """An archive per order: an entry per line item, some with faults."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    items = lift.table(spark, sf, "lineitem").withColumn("k", F.row_number().over(w))
    k = F.col("k")
    path = F.when((F.col("l_orderkey") % 11 == 3) & (k == 2), "../evil.txt").when((F.col("l_orderkey") % 7 == 2) & (k == 3), "WORD/Part1.xml").otherwise(F.concat(F.lit("word/part"), k.cast("string"), F.lit(".xml")))
    return items.select(F.col("l_orderkey").alias("doc_id"), k.alias("entry_pos"), path.alias("path"), (F.col("l_quantity") * 10).cast("long").alias("compressed"), (F.col("l_extendedprice")).cast("long").alias("uncompressed"))


_ENTRIES = "e as (select l_orderkey as doc_id, k as entry_pos, case when l_orderkey % 11 = 3 and k = 2 then '../evil.txt' when l_orderkey % 7 = 2 and k = 3 then 'WORD/Part1.xml' else 'word/part' || k || '.xml' end as path, cast(trunc(l_quantity * 10) as bigint) as compressed, cast(trunc(l_extendedprice) as bigint) as uncompressed from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as k from lineitem))"


@query(f"with {_ENTRIES}, c as (select *, case when contains(path, '..') then 'path_traversal' when row_number() over (partition by doc_id, lower(path) order by entry_pos) > 1 then 'duplicate_entry' when uncompressed // greatest(compressed, 1) > 150 then 'zip_bomb' when uncompressed > 90000 then 'part_size' when sum(uncompressed) over (partition by doc_id order by entry_pos rows between unbounded preceding and current row) > 200000 then 'total_size' end as chk from e) select doc_id, chk as check_name, entry_pos::bigint as entry_pos from c where chk is not null qualify row_number() over (partition by doc_id order by entry_pos) = 1")
def opc_first_fault(spark, sf):
    found = packages.first_fault(_entries(spark, sf), packages.Limits(total=200_000, part=90_000, ratio=150))
    return found.select("doc_id", F.col("check").alias("check_name"), _long("entry_pos"))


@query("select doc_id, path, path in ('a/../../b', '/abs.xml', 'a\\b', '..', 'a/../b', '..foo') as unsafe from (select c_custkey::bigint as doc_id, unnest(['word/document.xml', 'a/../../b', '/abs.xml', 'a\\b', '..', 'a/../b', '..foo', 'a/..b', './x']) as path from customer)")
def opc_path_check(spark, sf):
    paths = F.explode(F.array(*(F.lit(x) for x in ("word/document.xml", "a/../../b", "/abs.xml", "a\\b", "..", "a/../b", "..foo", "a/..b", "./x"))))
    return lift.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("doc_id"), paths.alias("path")).withColumn("unsafe", packages.unsafe_path(F.col("path")))


@query(f"with {_ENTRIES} select doc_id, lower(path) as path, count(*) as n from e group by doc_id, lower(path) having count(*) > 1")
def opc_duplicates(spark, sf):
    return _entries(spark, sf).groupBy("doc_id", F.lower("path").alias("path")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"with {_ENTRIES} select doc_id, entry_pos, sum(uncompressed) over (partition by doc_id order by entry_pos rows between unbounded preceding and current row)::bigint as total from e")
def opc_running_total(spark, sf):
    w = Window.partitionBy("doc_id").orderBy("entry_pos").rowsBetween(Window.unboundedPreceding, 0)
    return _entries(spark, sf).select("doc_id", _long("entry_pos"), F.sum("uncompressed").over(w).alias("total"))


@query("select c_custkey::bigint as doc_id, unnest(['word/document.xml', 'word/other.XML', 'media/a.png', 'media/b']) as path, unnest(['main', 'application/xml', 'image/png', '']) as type, unnest([false, false, true, false]) as is_binary from customer")
def content_type_resolve(spark, sf):
    overrides, defaults = F.create_map(F.lit("/word/document.xml"), F.lit("main")), F.create_map(F.lit("xml"), F.lit("application/xml"), F.lit("png"), F.lit("image/png"))
    rows = lift.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("doc_id"), F.explode(F.array(*(F.lit(x) for x in ("word/document.xml", "word/other.XML", "media/a.png", "media/b")))).alias("path"))
    return rows.withColumn("type", packages.content_type(F.col("path"), overrides, defaults)).withColumn("is_binary", packages.is_binary(F.col("path"), F.col("type")))


@query(f"with {lift.PARAS_SQL} select doc_id, para_ord, style, md5(text) as text_md5 from paras")
def docx_round_trip(spark, sf):
    """Every document written as a package and read back."""
    paras = lift.paragraphs(spark, sf).withColumn("block_path", F.array("para_ord"))
    runs = lift.runs(spark, sf)
    inlines = runs.select("doc_id", "story", "para_ord", "inline_pos", F.lit("run").alias("kind"))
    corpus = files.parse(files.packages({"paragraphs": paras, "inlines": inlines, "runs": runs}), ["paragraphs", "runs"], mode="FAILFAST").stored(files.shared_folder(spark, "corpus"))
    return text.paragraph_text(corpus.paragraphs, corpus.runs).select("doc_id", _long("para_ord"), F.coalesce("style", F.lit("")).alias("style"), md5("text").alias("text_md5"))


@query("select p_partkey as doc_id, md5('# ' || p_name || chr(10) || chr(10) || 'plain **' || p_brand || '** of size *' || p_size || '* and `' || p_type || '`' || chr(10) || chr(10) || chr(10) || chr(10) || '> ' || p_type || chr(10) || chr(10) || '• ' || p_name || chr(10) || chr(10) || '12. ' || p_brand || chr(10) || chr(10) || '`# not a heading`' || chr(10) || chr(10) || '#tag ~~' || p_type || '~~') as md_md5 from part")
def md_import_export(spark, sf):
    """Markdown imported to paragraphs and runs and exported again (tables aside)."""
    paras, runs, _ = markdown_import.import_markdown(lift.markdown(spark, sf))
    body = paras.select("doc_id", F.lit("body").alias("story"), "para_ord", "style", F.lit(None).cast("int").alias("ilvl"), F.lit(None).cast("int").alias("num_id"))
    placed = runs.select("doc_id", F.lit("body").alias("story"), "para_ord", F.col("run_pos").alias("inline_pos"), F.lit(0).alias("run_pos"), F.lit("run").alias("container"), "text", "bold", "italic", "strike", "font", F.lit(None).cast("string").alias("style"))
    md = markdown_export.paragraphs_markdown(body, placed).withColumnRenamed("para_ord", "block_pos")
    return markdown_export.document_markdown(md).select("doc_id", md5("md").alias("md_md5"))


# --- additions and set values


@query("select doc_id, unnest(range(n + 2)) as para_ord, n + 2 as n_paras from (select doc_id, len(string_split(text, chr(10))) as n from documents)")
def add_paragraphs(spark, sf):
    paras = lift.paragraphs(spark, sf).withColumn("block_path", F.array("para_ord"))
    new = paras.select("doc_id", "story").distinct().withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    found = building.add_paragraphs(paras, lift.empty(spark, "tables"), new)
    return found.select("doc_id", _long("para_ord"), F.count(F.lit(1)).over(Window.partitionBy("doc_id")).alias("n_paras"))


@query("select doc_id, n::bigint as block, unnest([0, 0, 0, 1, 1, 1])::bigint as row_idx, unnest([0, 1, 2, 0, 1, 2])::bigint as col_idx, n + unnest([0, 1, 2, 3, 4, 5])::bigint as para_ord from (select doc_id, len(string_split(text, chr(10))) as n from documents)")
def add_table(spark, sf):
    paras = lift.paragraphs(spark, sf).withColumn("block_path", F.array("para_ord")).withColumn("in_table", F.lit(False))
    found, _, _ = building.add_table(paras, lift.empty(spark, "tables"), lift.empty(spark, "cells"), paras.select("doc_id"), 2, 3)
    at = lambda k, name: F.col("block_path")[k].cast("long").alias(name)
    return found.where("in_table").select("doc_id", at(0, "block"), at(1, "row_idx"), at(2, "col_idx"), _long("para_ord"))


def _order_tables(spark, sf) -> dict[str, DataFrame]:
    """The tables of orders, each the first block of its document."""
    cells = lift.cells(spark, sf).withColumn("story", F.lit("body"))
    paras = cells.withColumn("para_ord", (F.col("row_idx") * 2 + F.col("col_idx")).cast("int")).withColumn("block_path", F.array(F.lit(0), "row_idx", "col_idx", F.lit(0)))
    tables = cells.groupBy("doc_id", "story", "table_ord").agg((F.max("row_idx") + 1).alias("n_rows"), F.lit(2).alias("n_cols")).withColumn("block_path", F.array(F.lit(0)))
    return {"paragraphs": paras.select("doc_id", "story", "para_ord", "block_path", "text", F.lit(True).alias("in_table")), "tables": tables, "cells": cells.select("doc_id", "story", "table_ord", "row_idx", "col_idx")}


@query(f"with {lift.CELLS_SQL}, left_ as (select *, row_number() over (partition by doc_id order by row_idx) - 1 as now, count(*) over (partition by doc_id) as n_rows from rws where row_idx % 3 <> 1) select doc_id, now as row_idx, n_rows, unnest([0, 1])::bigint as col_idx, unnest([c0, c1]) as text from left_")
def remove_rows(spark, sf):
    own = _order_tables(spark, sf)
    left = building.remove_rows(own, own["cells"].where("row_idx % 3 = 1").select("doc_id", "story", "table_ord", "row_idx"))
    paras = left["paragraphs"].select("doc_id", F.col("block_path")[1].alias("row_idx"), F.col("block_path")[2].alias("col_idx"), "text")
    return left["cells"].join(paras, ["doc_id", "row_idx", "col_idx"]).join(left["tables"].select("doc_id", "n_rows"), "doc_id").select("doc_id", _long("row_idx"), _long("col_idx"), _long("n_rows"), "text")


@query(f"with {lift.CELLS_SQL}, r as (select doc_id, max(row_idx) + 1 as n from rws group by doc_id) select doc_id, n + 1 as n_rows, 3::bigint as n_cols, (n * 3 + 1)::bigint as n_cells from r")
def add_rows_and_cells(spark, sf):
    """A row more in every table, then a cell more in each of its rows; the new row has that one cell."""
    own = _order_tables(spark, sf)
    more = building.add_rows(own["tables"], own["tables"].select("doc_id", "story", "table_ord", F.lit(1).alias("n")))
    at = more.select("doc_id", "story", "table_ord", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row_idx"))
    paras, tables, cells = building.add_cells(own["paragraphs"], more, own["cells"], at)
    n = paras.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_paras")).join(cells.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_cells")), "doc_id").where("n_paras = n_cells")
    return tables.join(n, "doc_id").select("doc_id", _long("n_rows"), _long("n_cols"), "n_cells")


@query("select doc_id, count(*) as n_paras from (select doc_id, lang, unnest(string_split(text, chr(10))) from documents) where lang is distinct from 'en' group by doc_id")
def body_clear(spark, sf):
    """The bodies of English documents are cleared."""
    english = lift.table(spark, sf, "documents").where("lang = 'en'").select("doc_id")
    left = building.cleared({"paragraphs": lift.paragraphs(spark, sf)}, english)
    return left["paragraphs"].groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_paras"))


@query(f"with {lift.RUNS_SQL} select doc_id, para_ord, md5(string_agg(text, '' order by p) || ' and so on') as text_md5 from runs group by doc_id, para_ord")
def add_runs(spark, sf):
    """Two runs at the end of every paragraph."""
    paras, runs = lift.paragraphs(spark, sf), lift.runs(spark, sf)
    new = paras.select("doc_id", "story", "para_ord", F.posexplode(F.array(F.lit(" and"), F.lit(" so on"))).alias("k", "text"))
    _, more = building.add_runs(lift.inlines(runs), runs, new)
    return text.paragraph_text(paras.drop("text"), more).select("doc_id", _long("para_ord"), md5("text").alias("text_md5"))


@query(f"with {lift.RUNS_SQL} select doc_id, para_ord, count(*) as inline_pos, 'rId' || row_number() over (partition by doc_id order by para_ord) as rel_id, 'https://example.org/' || para_ord as target, md5(string_agg(text, '' order by p) || 'more') as text_md5 from runs group by doc_id, para_ord")
def add_hyperlinks(spark, sf):
    """A link at the end of every paragraph."""
    paras, runs = lift.paragraphs(spark, sf), lift.runs(spark, sf)
    new = paras.select("doc_id", "story", "para_ord", F.lit(0).alias("k"), F.concat(F.lit("https://example.org/"), F.col("para_ord").cast("string")).alias("url"), F.lit("more").alias("text"))
    inlines, more, rels = building.add_hyperlinks(lift.inlines(runs), runs, lift.empty(spark, "rels"), new)
    links = inlines.where("kind = 'hyperlink'").select("doc_id", "story", "para_ord", "inline_pos", "rel_id")
    shown = text.paragraph_text(paras.drop("text"), more).join(links, ["doc_id", "story", "para_ord"]).join(rels.select("doc_id", "rel_id", "target"), ["doc_id", "rel_id"])
    return shown.select("doc_id", _long("para_ord"), _long("inline_pos"), "rel_id", "target", md5("text").alias("text_md5"))


@query(f"with {lift.RUNS_SQL} select doc_id, para_ord, md5(string_agg(case when p = 0 then 'first' when p % 2 = 1 then text || chr(9) || chr(10) else text end, '' order by p)) as text_md5 from runs group by doc_id, para_ord")
def set_run_text(spark, sf):
    """First runs get another text; every second run a tab and a line break."""
    paras, runs = lift.paragraphs(spark, sf), lift.runs(spark, sf)
    other = building.set_run_text(runs.withColumn("del_text", F.lit("")).withColumn("content", F.lit(None).cast(lift.empty(spark, "runs").schema["content"].dataType)), runs.where("inline_pos = 0").withColumn("text", F.lit("first")))
    second = runs.where("inline_pos % 2 = 1")
    other = building.add_content(building.add_content(other, second, "tab"), second, "line_break")
    return text.paragraph_text(paras.drop("text"), other).select("doc_id", _long("para_ord"), md5("text").alias("text_md5"))


@query("select p_partkey as doc_id, unnest([0, 1, 2])::bigint as inline_pos, unnest([p_brand, ' is ', p_name]) as text, unnest([true, null, null]) as bold, unnest([null, null, 'https://example.org/' || p_partkey]) as target from part")
def set_markdown(spark, sf):
    """Paragraphs whose content becomes inline Markdown with a link."""
    p = lift.table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("body").alias("story"), F.lit(0).alias("para_ord"), F.concat(F.lit("**"), "p_brand", F.lit("** is ["), "p_name", F.lit("](https://example.org/"), F.col("p_partkey").cast("string"), F.lit(")")).alias("text"))
    inlines, runs, rels = building.set_markdown(lift.empty(spark, "inlines"), lift.empty(spark, "runs"), lift.empty(spark, "rels"), p)
    shown = runs.join(inlines.select("doc_id", "inline_pos", "rel_id"), ["doc_id", "inline_pos"]).join(rels.select("doc_id", "rel_id", "target"), ["doc_id", "rel_id"], "left")
    return shown.select("doc_id", _long("inline_pos"), "text", "bold", "target")


@query("select doc_id, case when lang = 'en' then 'New ' || doc_id else lang end as title, case when lang = 'en' then 'me' else source end as creator from documents")
def set_properties(spark, sf):
    docs = lift.table(spark, sf, "documents")
    own = docs.select("doc_id", F.col("lang").alias("title"), F.col("source").alias("creator"))
    new = docs.where("lang = 'en'").select("doc_id", F.concat(F.lit("New "), F.col("doc_id").cast("string")).alias("title"), F.lit("me").alias("creator"))
    return building.set_properties(own, new)
