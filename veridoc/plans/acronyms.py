"""Queries of acronyms by scope: what each scope defines, and its questions reworded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import acronyms as op
from ..operators.acronyms import ACRONYM, FEWEST, LEADING, LONGEST, MOST, ROW_WORD, SHORTEST, SKIPPABLE, WORD
from ..sources.shared import kept
from ..sources.tables import read

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_NAME = "concat(upper(left(p_name, 1)), upper(left(split_part(p_name, ' ', 2), 1)), upper(left(p_type, 1)))"
_SPELT = "concat(p_name, ' ', lower(p_type))"
_DEFINED = f"""CASE p_partkey % 6 WHEN 0 THEN concat('Note that its ', {_SPELT}, ' (', {_NAME}, ') is fixed.') WHEN 1 THEN concat('The ', {_NAME}, ' (', {_SPELT}, ') is fixed.')
 WHEN 2 THEN concat('Abbreviations ', {_NAME}, ' ', {_SPELT}, ' CPS coating procedure specification') WHEN 3 THEN concat('the ', p_name, ' of the ', lower(p_type), ' (', {_NAME}, ')')
 WHEN 4 THEN concat('a heat-treated ', p_name, ' (HT', left({_NAME}, 2), ')') ELSE concat('the ', {_SPELT}, ' (', left({_NAME}, 1), 'Q', left({_NAME}, 1), ')') END"""
_ASKED = f"CASE p_partkey % 3 WHEN 0 THEN concat('What is the ', {_NAME}, '?') WHEN 1 THEN concat('Which limit does the ', upper(p_name), ' ', lower(p_type), ' have, and the CPS?') ELSE concat('Is ', {_SPELT}, ' a coating-procedure specification (', {_NAME}, ')?') END"
_TEXTS = f"SELECT doc_id, source AS scope, text FROM documents UNION ALL SELECT -1 - p_partkey, p_brand, {_DEFINED} FROM part"


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _is(x: str) -> str:
    return f"(regexp_matches({x}, '{ACRONYM}') AND length({x}) BETWEEN {SHORTEST} AND {LONGEST})"


_KNOWN = f"""x AS ({_TEXTS}), l AS (SELECT doc_id, scope, [w FOR w IN string_split_regex(regexp_replace(text, '([()])', ' \\1 ', 'g'), '[ \t\r\n]+') IF w <> ''] AS t FROM x WHERE regexp_matches(text, '[A-Z][A-Z0-9]')),
w AS (SELECT doc_id, scope, unnest(t) AS tok, unnest(range(1, len(t) + 1)) AS pos FROM l),
c AS (SELECT doc_id, scope, pos, tok AS acronym, list(tok) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {MOST + 1} PRECEDING AND 1 PRECEDING) AS before, coalesce(list(tok) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {MOST + 2} FOLLOWING), []) AS after FROM w QUALIFY {_is("tok")}),
e AS (SELECT *, CASE WHEN before[-1] = '(' AND after[1] = ')' THEN 1 WHEN after[1] = '(' THEN 2 ELSE 3 END AS form FROM c),
k AS (SELECT doc_id, scope, pos, acronym, size, before[len(before) - size:len(before) - 1] AS words, '{WORD}' AS shape FROM e, range({FEWEST}, {MOST + 1}) r(size) WHERE form = 1 AND len(before) > size
 UNION ALL SELECT doc_id, scope, pos, acronym, 0, after[2:list_position(after, ')') - 1], '{WORD}' FROM e WHERE form = 2 AND list_position(after, ')') BETWEEN {FEWEST + 2} AND {MOST + 2}
 UNION ALL SELECT doc_id, scope, pos, acronym, 0, after[1:n], '{ROW_WORD}' FROM (SELECT *, coalesce(nullif(list_position([regexp_matches(a, '{ROW_WORD}') FOR a IN after], FALSE), 0) - 1, len(after)) AS n FROM e WHERE form = 3) WHERE n BETWEEN {FEWEST} AND {MOST} AND (n = len(after) OR {_is("after[n + 1]")})),
f AS (SELECT *, regexp_replace(lower(array_to_string(words, ' ')), '{LEADING}', '') AS expansion FROM k WHERE len([a FOR a IN words IF NOT regexp_matches(a, shape)]) = 0),
h AS (SELECT *, [a FOR a IN string_split_regex(expansion, '[ -]+') IF a <> ''] AS parts FROM f),
v AS (SELECT * FROM h WHERE len(parts) <= {MOST} AND regexp_matches(array_to_string([CASE WHEN a IN ({_listed(SKIPPABLE)}) THEN '-' ELSE '' END || upper(left(a, 1)) FOR a IN parts], ''), '^' || regexp_replace(regexp_replace(acronym, '[-/]', '', 'g'), '(.)', '(?:-[A-Z])*-?\\1', 'g') || '(?:-[A-Z])*$')),
d AS (SELECT DISTINCT doc_id, scope, acronym, arg_min(expansion, size) OVER (PARTITION BY doc_id, pos) AS expansion FROM v),
known AS (SELECT scope, acronym, expansion, count(*) AS n_docs FROM d GROUP BY scope, acronym, expansion)"""


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select("doc_id", F.col("source").alias("scope"), "text")
    return d.unionByName(read(spark, sf, "part").selectExpr("-1 - p_partkey AS doc_id", "p_brand AS scope", f"{_DEFINED} AS text"))


@query(f"WITH {_KNOWN} SELECT * FROM known")
def scope_acronyms(spark, sf):
    """What the acronyms of each scope stand for, read from bracketed forms of both orders and from rows."""
    return op.harvest(_texts(spark, sf))


_FLAT = lambda x: f"array_to_string([a FOR a IN string_split_regex(lower({x}), '[ -]+') IF a <> ''], ' ')"


def _swapped(which: str) -> str:
    return f"""(SELECT w.question_id, string_agg(CASE WHEN h.start IS NULL THEN w.tok WHEN h.start = w.pos THEN regexp_extract(w.tok, '^[^A-Za-z0-9]*') || h.other || regexp_extract(z.tok, '[^A-Za-z0-9]*$') END, ' ' ORDER BY w.pos) AS made
 FROM qw w LEFT JOIN {which} h ON h.question_id = w.question_id AND w.pos BETWEEN h.start AND h.start + h.size - 1 LEFT JOIN qw z ON z.question_id = w.question_id AND z.pos = h.start + h.size - 1 GROUP BY w.question_id)"""


@query(f"""WITH {_KNOWN}, q AS (SELECT p_partkey AS question_id, p_brand AS scope, string_split({_ASKED}, ' ') AS t FROM part),
qw AS (SELECT question_id, scope, unnest(t) AS tok, unnest(range(1, len(t) + 1)) AS pos FROM q), qb AS (SELECT *, regexp_replace(tok, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g') AS bare FROM qw),
g AS (SELECT b.question_id, b.scope, b.pos AS start, r.size, string_agg(o.bare, ' ' ORDER BY o.pos) AS gram FROM qb b, range(1, {MOST + 1}) r(size), qb o WHERE o.question_id = b.question_id AND o.pos BETWEEN b.pos AND b.pos + r.size - 1 GROUP BY ALL HAVING count(*) = r.size),
names AS (SELECT g.question_id, start, size, other, meanings FROM g JOIN (SELECT scope, acronym, min(expansion) AS other, count(*) AS meanings FROM known GROUP BY scope, acronym) m ON g.scope = m.scope AND g.gram = m.acronym WHERE size = 1),
every AS (SELECT g.question_id, start, size, other FROM g JOIN (SELECT scope, {_FLAT("expansion")} AS gram, min(acronym) AS other FROM known GROUP BY ALL) m ON g.scope = m.scope AND {_FLAT("g.gram")} = m.gram WHERE m.gram LIKE '% %'),
phrases AS (SELECT * FROM every h WHERE NOT EXISTS (SELECT 1 FROM every o WHERE o.question_id = h.question_id AND o.start < h.start + h.size AND h.start < o.start + o.size AND (o.size > h.size OR (o.size = h.size AND o.start < h.start))))
SELECT question_id, CASE WHEN n.question_id IS NOT NULL THEN s.made END AS spelled, CASE WHEN p.question_id IS NOT NULL THEN a.made END AS abbreviated, n.meanings AS n_meanings FROM {_swapped("names")} s JOIN {_swapped("phrases")} a USING (question_id)
 LEFT JOIN (SELECT question_id, max(meanings) AS meanings FROM names GROUP BY question_id) n USING (question_id) LEFT JOIN (SELECT DISTINCT question_id FROM phrases) p USING (question_id) WHERE n.question_id IS NOT NULL OR p.question_id IS NOT NULL""")
def acronym_rewordings(spark, sf):
    """Questions spelled out and abbreviated by the acronyms of their own scope."""
    asked = read(spark, sf, "part").selectExpr("p_partkey AS question_id", "p_brand AS scope", f"{_ASKED} AS text")
    return op.reworded(asked, kept(op.harvest(_texts(spark, sf)), "acronyms"))
