"""Queries of the whole quality gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import quoted
from ..operators import gate as op
from ..operators.gate import BARS, EDGE, HEADERS, LABEL, LEAST_TAGS, LETTERS, MEASURE, NUMERIC, REQUIREMENT, SHORT_LINE, TAG, VALUE, VOWEL
from ..sources.tables import read

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_SHAPE = """CASE p_partkey % 14 WHEN 0 THEN concat('Approved Color/s : ', p_name, ' (RAL ', p_size, ')') WHEN 1 THEN concat('P-', 100 + p_size, 'A P-', 100 + p_size, 'B E-', 200 + p_size) WHEN 2 THEN concat(p_size, chr(10), '12.5', chr(10), '3', chr(10), '4', chr(10), '5', chr(10), '6', chr(10), '7', chr(10), '8%')
 WHEN 3 THEN concat('Table ', p_size, chr(10), '1.0', chr(10), '2.5', chr(10), '3.5') WHEN 4 THEN concat(p_size, ' 30.0 30.0 30.0 31.0 32.0') WHEN 5 THEN concat('| ', p_name, ' | ', p_size, ' |', chr(10), '| ', p_type, ' | 7 |') WHEN 6 THEN concat('x', p_size, ' ... ', p_size)
 WHEN 7 THEN concat('the ', p_name, ' weighs ', p_size, ' to 75 kilograms in all') WHEN 8 THEN concat(p_size, ' Set ', p_size, ' Dry ', p_type) WHEN 9 THEN '  ' WHEN 10 THEN 'هذا النص مكتوب باللغة العربية وليس مدعوما' WHEN 11 THEN concat('Nuts ', p_size, 'x shall A194') WHEN 12 THEN concat(p_name, ' only') ELSE concat(p_name, ' : ', p_type, chr(10), 'Size : ', p_size) END"""
_ALL = f"SELECT doc_id, text FROM documents UNION ALL SELECT -1 - p_partkey, {_SHAPE} FROM part"


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, and parts as short texts of fourteen shapes."""
    return read(spark, sf, "documents").select("doc_id", "text").unionByName(read(spark, sf, "part").selectExpr("-1 - p_partkey AS doc_id", f"{_SHAPE} AS text"))


def _white(x: str) -> str:
    return f"[w FOR w IN string_split_regex({x}, '[ \t\r\n]+') IF w <> '']"


def _bare(x: str) -> str:
    return f"regexp_replace({x}, {quoted(f'^{EDGE}|{EDGE}$')}, '', 'g')"


def _is_word(bare: str) -> str:
    return f"(length({bare}) >= 2 AND regexp_matches({bare}, {quoted(LETTERS)}) AND regexp_matches(lower({bare}), '{VOWEL}'))"


def _is_cell(x: str) -> str:
    return f"(regexp_matches({x}, '{NUMERIC}') AND NOT regexp_matches({x}, '[.,]$'))"


_CLASS = f"""CASE WHEN {_is_word("bare")} THEN CASE WHEN regexp_matches(raw, '^\\p{{Ll}}') THEN CASE WHEN length(bare) >= 3 THEN 'w' ELSE 'x' END WHEN length(bare) >= 3 THEN 'W' ELSE 'X' END
 WHEN {_is_cell("raw")} AND regexp_matches(bare, '{MEASURE}') THEN 'b' WHEN regexp_matches(bare, '{MEASURE}') THEN 'm' WHEN {_is_cell("raw")} THEN 'n' WHEN regexp_matches(bare, '{TAG}') THEN 't' WHEN bare = '' THEN 'e' ELSE 'o' END"""


def _worded(x: str) -> str:
    return f"len([w FOR w IN {_white(x)} IF {_is_word(_bare('w'))}]) > 0"


_ASSESSED = f"""x AS ({_ALL}), t AS (SELECT doc_id, coalesce(text, '') AS text FROM x), tk AS (SELECT doc_id, raw, {_bare("raw")} AS bare, pos FROM (SELECT doc_id, unnest({_white("text")}) AS raw, unnest(range(0, len({_white("text")}))) AS pos FROM t)),
cd AS (SELECT doc_id, string_agg({_CLASS}, '' ORDER BY pos) AS code FROM tk GROUP BY doc_id),
ln AS (SELECT * FROM (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '[\t\r]', ' ', 'g')) AS l, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM t) WHERE l <> ''),
lv AS (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn, trim(split_part(l, ':', 1)) AS label, trim(regexp_replace(l, '^[^:]*:', '')) AS value FROM ln),
lc AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE {_is_cell("l")}) AS cells, count(*) FILTER (WHERE length(l) <= {SHORT_LINE}) AS short, coalesce(bool_or(rn <= {HEADERS} AND length(l) <= {SHORT_LINE} AND NOT regexp_matches(l, '[0-9]')), FALSE) AS header,
 count(*) FILTER (WHERE CASE WHEN regexp_matches(l, '{BARS}') THEN regexp_matches(l, '[\\p{{L}}0-9]') ELSE contains(l, ':') AND value <> '' AND length(label) <= 80 AND (label = '' OR {_worded("label")}) AND (regexp_matches(value, '[0-9]') OR {_worded("value")}) END) AS rows FROM lv GROUP BY doc_id),
s AS (SELECT doc_id, text, coalesce(code, '') AS code, coalesce(list_max([length(y) FOR y IN string_split_regex(regexp_replace(coalesce(code, ''), '[mb]([wx])', '\\1', 'g'), '[^wWxX]+')]), 0) AS clause, coalesce(n_lines, 0) AS n_lines, coalesce(rows, 0) AS rows, coalesce(cells, 0) AS cells, coalesce(short, 0) AS short,
 coalesce(header, FALSE) OR regexp_matches(text, {quoted(LABEL)}) AS named, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\\x{{0600}}-\\x{{06FF}}\\x{{0750}}-\\x{{077F}}\\x{{08A0}}-\\x{{08FF}}\\x{{FB50}}-\\x{{FDFF}}\\x{{FE70}}-\\x{{FEFF}}]', '', 'g')) AS arabic FROM t LEFT JOIN cd USING (doc_id) LEFT JOIN lc USING (doc_id)),
c AS (SELECT *, length(code) AS n, length(regexp_replace(code, '[^bn]', '', 'g')) AS numbers, length(regexp_replace(code, '[^t]', '', 'g')) AS tags, length(regexp_replace(code, 'e', '', 'g')) AS solid FROM s),
k AS (SELECT doc_id, clause, CASE WHEN n = 0 THEN 'empty' WHEN letters >= 20 AND arabic > 0.5 * letters THEN 'unsupported script' WHEN clause >= CASE WHEN n <= 12 THEN 3 ELSE 6 END THEN 'prose' WHEN rows >= 2 AND rows >= 0.6 * n_lines THEN 'rows of data'
 WHEN short >= 0.6 * n_lines AND cells >= 3 AND named THEN 'named columns' WHEN short >= 0.9 * n_lines AND cells >= 0.55 * n_lines AND n_lines >= 8 THEN 'dense columns' WHEN numbers >= 6 AND numbers >= 0.7 * n THEN 'row of numbers'
 WHEN regexp_matches(code, '[wW]') AND (rows > 0 OR regexp_matches(text, {quoted(REQUIREMENT)}) OR regexp_matches(text, {quoted(VALUE)})) THEN 'data' WHEN tags >= {LEAST_TAGS} AND tags >= 0.8 * solid THEN 'tags' ELSE 'no clause' END AS kind FROM c),
g AS (SELECT doc_id, kind, clause, kind NOT IN ('empty', 'unsupported script', 'no clause') AS ok, CASE WHEN kind IN ('empty', 'unsupported script', 'no clause') THEN kind END AS reason FROM k)"""


@query(f"WITH {_ASSESSED} SELECT * FROM g")
def text_assessments(spark, sf):
    """What every text is kept for, or why it is left out, by all rules of the gate."""
    return op.assessed(_texts(spark, sf))


@query(f"WITH {_ASSESSED} SELECT kind, ok, count(*) AS n, max(clause) AS longest FROM g GROUP BY kind, ok")
def assessment_ledger(spark, sf):
    """Texts kept and left out by rule, with the longest clause of each."""
    return op.assessed(_texts(spark, sf)).groupBy("kind", "ok").agg(F.count(F.lit(1)).alias("n"), F.max("clause").alias("longest"))
