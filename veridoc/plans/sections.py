"""Queries of sections cut at headings of any kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import first_rule_sql, quoted
from ..operators import sections as op
from ..operators.sections import KINDS, LEADERS, LONGEST, NUMBERED, PAGES, RUN
from ..sources.tables import read

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_TITLE = "concat(upper(left(p_name, 1)), substr(p_name, 2), ' of ', lower(p_type), ' parts')"
_LINE = f"""CASE (l_partkey * 31 + l_orderkey * 7 + l_linenumber) % 17
 WHEN 0 THEN concat('ZX-', p_size, '-ATT0', l_linenumber, ' - ', upper(p_name)) WHEN 1 THEN concat('Appendix ', p_size, ' – ', {_TITLE}) WHEN 2 THEN concat('Table B', l_linenumber, '.', p_size, ': ', {_TITLE})
 WHEN 3 THEN concat('Figure ', p_size, ' -  ', {_TITLE}) WHEN 4 THEN concat(l_linenumber, '. ', {_TITLE}) WHEN 5 THEN concat(l_linenumber, '. ', {_TITLE}, ' ..... ', p_size) WHEN 6 THEN concat('Annex B - ', {_TITLE}, ' ', p_size)
 WHEN 7 THEN '   ' WHEN 8 THEN 'Appendix A: General' WHEN 9 THEN concat('Table ', p_size, ' shows the ', p_name) ELSE concat('The ', p_name, ' weighs ', p_size, ' kg.') END"""
_PAGES = f"""SELECT l_suppkey AS doc_id, year(l_shipdate) * 12 + month(l_shipdate) AS page, string_agg({_LINE}, chr(10) ORDER BY l_orderkey, l_linenumber, l_partkey) AS text FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
 UNION ALL SELECT -1 - doc_id, 1, text FROM documents"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of suppliers' parts by month, and the documents as pages of their own, as lines with their titles."""
    l = read(spark, sf, "lineitem").join(read(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    made = l.selectExpr("l_suppkey AS doc_id", "year(l_shipdate) * 12 + month(l_shipdate) AS page", "l_orderkey", "l_linenumber", "l_partkey", f"{_LINE} AS text")
    in_order = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "text")))
    made = made.groupBy("doc_id", "page").agg(F.array_join(F.transform(in_order, lambda x: x["text"]), "\n").alias("text"))
    d = read(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("doc_id"), F.lit(1).alias("page"), "text")
    return op.title_lines(made.unionByName(d))


_FLAT = "trim(regexp_replace(translate(raw, '–—', '--'), '[ \t\r]+', ' ', 'g'))"
_ORDER = "(PARTITION BY doc_id ORDER BY page, line, title ROWS UNBOUNDED PRECEDING)"
_ENTRY = f"(leaders OR regexp_matches(title, '{NUMBERED}'))"
_TITLED = f"""p AS ({_PAGES}), r AS (SELECT doc_id, page, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS raw FROM p),
a AS (SELECT doc_id, page, line, {_FLAT} AS title, regexp_matches(raw, {quoted(LEADERS)}) AS leaders FROM r WHERE {_FLAT} <> ''),
b AS (SELECT *, CASE WHEN length(title) <= {LONGEST} THEN {first_rule_sql("title", KINDS)} END AS kind FROM a),
n AS (SELECT doc_id, title, count(DISTINCT page) >= {PAGES} AS running FROM b WHERE kind IS NOT NULL GROUP BY doc_id, title),
c AS (SELECT b.*, coalesce(running, FALSE) AS running, kind IS NOT NULL AND NOT {_ENTRY} AND NOT coalesce(running, FALSE) AS alike FROM b LEFT JOIN n USING (doc_id, title)),
d AS (SELECT *, sum((NOT alike AND NOT running)::INT) OVER {_ORDER} AS island FROM c), e AS (SELECT *, sum(alike::INT) OVER (PARTITION BY doc_id, island) AS n_run FROM d),
f AS (SELECT *, max((alike AND n_run < {RUN} AND kind IN ('coded', 'worded'))::INT) OVER {_ORDER} AS attached FROM e),
t AS (SELECT doc_id, page, line, title, kind, CASE WHEN kind IS NULL THEN NULL WHEN {_ENTRY} THEN 'contents entry' WHEN running THEN 'running' WHEN n_run >= {RUN} THEN 'contents run' WHEN kind = 'item' AND attached = 0 THEN 'item of a list' END AS reason FROM f)"""
_CUT = f"""{_TITLED}, u AS (SELECT *, kind IS NOT NULL AND reason IS NULL AS heads FROM t),
v AS (SELECT *, sum(heads::INT) OVER {_ORDER} AS section, last_value(CASE WHEN heads AND kind IN ('coded', 'worded') THEN title END IGNORE NULLS) OVER {_ORDER} AS attachment FROM u)"""


@query(f"WITH {_TITLED} SELECT doc_id, page, line, title, kind, reason FROM t WHERE reason IS NOT NULL")
def dropped_titles(spark, sf):
    """Lines that look like titles and cut nothing, each with why: contents, running lines, lists."""
    return _lines(spark, sf).filter("reason is not null")


@query(f"""WITH {_CUT}, s AS (SELECT doc_id, section, max(CASE WHEN heads THEN title END) AS heading, max(CASE WHEN heads THEN kind END) AS kind, max(attachment) AS attachment, min(page) AS page_start, max(page) AS own_end, count(*) AS n_lines FROM v GROUP BY doc_id, section)
SELECT doc_id, section, heading, kind, CASE WHEN kind NOT IN ('coded', 'worded') THEN attachment END AS parent, page_start, coalesce(lead(page_start) OVER (PARTITION BY doc_id ORDER BY section), own_end) AS page_end, n_lines, coalesce(kind NOT IN ('table', 'figure'), FALSE) AS citable FROM s""")
def refined_sections(spark, sf):
    """Sections of every document, cut at attachments, captions and items, with the pages they span."""
    return op.refined_sections(_lines(spark, sf))


@query(f"WITH {_CUT} SELECT doc_id, section, md5(string_agg(title, chr(10) ORDER BY page, line, title)) AS digest FROM v GROUP BY doc_id, section")
def section_digests(spark, sf):
    """Digests of the sections' texts."""
    return op.section_texts(_lines(spark, sf)).select("doc_id", "section", F.md5("text").alias("digest"))
