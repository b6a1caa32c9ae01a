"""Queries of families of standards, over standards and pages that parts and order lines give rise to."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.rules import quoted
from ..operators import families
from ..sources.derived import STATEMENT
from ..sources.tables import read

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


ASKED = """CASE p_partkey % 7 WHEN 0 THEN concat('what do our ', p_name, 's standards say about vibration limits?') WHEN 1 THEN concat('What do the company ', split_part(p_name, ' ', 2), 'ing specifications have on design pressures')
 WHEN 2 THEN concat('list ', lower(p_type), ' standards for ', p_name) WHEN 3 THEN concat('which ', p_name, ' specs say anything on flange classes.') WHEN 4 THEN concat('do the standards speak about ', p_name)
 WHEN 5 THEN concat('does STD-', p_size, ' as one of the ', p_name, ' standards speak about rust') ELSE concat('show ', split_part(p_name, ' ', 2), 's standards regarding set pressure and lugs') END"""
STANDARD = "concat('STD-', p_size, '-', p_partkey % 5) AS designation, concat('Covers ', p_name, 's in ', lower(p_type), ' work') AS scope"


def _stem(w: str) -> str:
    x = f"regexp_replace(lower({w}), '[^a-z0-9]', '', 'g')"
    first = (
        f"CASE WHEN {x} LIKE '%ings' AND length({x}) >= 7 THEN left({x}, length({x}) - 4) WHEN {x} LIKE '%ing' AND length({x}) >= 6 THEN left({x}, length({x}) - 3) "
        f"WHEN {x} LIKE '%ies' AND length({x}) >= 5 THEN left({x}, length({x}) - 3) || 'y' WHEN {x} LIKE '%ed' AND length({x}) >= 5 THEN left({x}, length({x}) - 2) "
        f"WHEN regexp_matches({x}, '(sses|shes|ches|xes|zes|ses)$') AND length({x}) > 4 THEN left({x}, length({x}) - 2) WHEN {x} LIKE '%s' AND {x} NOT LIKE '%ss' AND length({x}) > 3 THEN left({x}, length({x}) - 1) ELSE {x} END"
    )
    return f"[CASE WHEN f LIKE '%e' AND length(f) > 3 THEN left(f, length(f) - 1) ELSE f END FOR f IN [{first}]][1]"


def _stems(text: str) -> str:
    return f"list_sort(list_distinct(list_transform([w FOR w IN regexp_extract_all({text}, '[A-Za-z0-9]+') IF length(w) >= 3], lambda w: {_stem('w')})))"


def _in(words) -> str:
    return ", ".join(map(quoted, words))


_NOUN, _BEHIND = quoted(families.NOUN), quoted(families.BEHIND)


@query(f"""WITH q AS (SELECT p_partkey AS q_id, {ASKED} AS question FROM part), st AS (SELECT p_partkey AS doc_id, {STANDARD} FROM part), pg AS (SELECT row_number() OVER () AS id, l_partkey AS doc_id, {STATEMENT} AS text FROM lineitem),
a AS (SELECT q_id, question, lower(regexp_extract(question, {_BEHIND}, 2)) AS prep, trim(regexp_extract(question, {_BEHIND}, 1)) AS mid, regexp_replace(regexp_extract(question, {_BEHIND}, 3), '^[ ,.?!:;]+|[ ,.?!:;]+$', '', 'g') AS topic,
 list_transform(list_reverse(regexp_extract_all(string_split_regex(question, {_NOUN})[1], '[A-Za-z][A-Za-z-]*')), lambda w: lower(w)) AS low FROM q WHERE len(regexp_extract_all(question, {_NOUN})) = 1 AND regexp_matches(question, {_BEHIND}) AND NOT regexp_matches(question, {quoted(families.TYPED)})),
b AS (SELECT *, coalesce(list_position(list_transform(low, lambda w: w IN ({_in(families.BREAK)})), TRUE), 0) AS stop FROM a WHERE NOT (prep = 'for' AND mid = '') AND regexp_matches(topic, '[A-Za-z]{{3,}}')),
c AS (SELECT *, [w FOR w IN low[1 : least(3, CASE WHEN stop > 0 THEN stop - 1 ELSE len(low) END)] IF w NOT IN ({_in(families.GENERIC)}) AND length(w) >= 3] AS named FROM b),
x AS (SELECT q_id, {_stems("array_to_string(named, ' ')")} AS d, {_stems("topic")} AS t FROM c WHERE len(named) > 0),
sets AS (SELECT DISTINCT d AS s FROM x UNION SELECT DISTINCT t FROM x), ss AS (SELECT st.doc_id, {_stems("scope")} AS g FROM st), ps AS (SELECT id, doc_id, {_stems("text")} AS g FROM pg),
sc AS (SELECT s AS d, doc_id FROM sets JOIN ss ON len(s) > 0 AND list_has_all(g, s)), ph AS (SELECT s, doc_id, count(*) AS n FROM sets JOIN ps ON len(s) > 0 AND list_has_all(g, s) GROUP BY s, doc_id),
ql AS (SELECT d, doc_id FROM sc UNION SELECT s, doc_id FROM ph), u AS (SELECT DISTINCT d, t FROM x),
g AS (SELECT u.d, u.t, designation AS family, count(*) AS n_documents, sum(CASE WHEN tp.n IS NULL THEN 0 ELSE least(tp.n, {families.PROBE}) END)::BIGINT AS topic, count(sc.doc_id) AS scope, sum(coalesce(dp.n, 0))::BIGINT AS search
 FROM u JOIN ql ON ql.d = u.d JOIN st ON st.doc_id = ql.doc_id LEFT JOIN sc ON sc.d = u.d AND sc.doc_id = ql.doc_id LEFT JOIN ph dp ON dp.s = u.d AND dp.doc_id = ql.doc_id LEFT JOIN ph tp ON tp.s = u.t AND tp.doc_id = ql.doc_id GROUP BY u.d, u.t, designation),
r AS (SELECT *, row_number() OVER (PARTITION BY d, t ORDER BY topic DESC, scope DESC, search DESC, lower(family), family) AS rank FROM g)
SELECT q_id, family, n_documents, topic, scope, search, rank FROM x JOIN r USING (d, t) WHERE rank <= {families.LISTED}""")
def standard_families(spark: SparkSession, sf: str):
    """The families of standards that a question names in general words, by stems, over all standards and all of their pages."""
    part = read(spark, sf, "part")
    standards = part.selectExpr("p_partkey AS doc_id", *(STANDARD.replace(", concat('Covers", "\0concat('Covers").split("\0")))
    pages = read(spark, sf, "lineitem").selectExpr("l_partkey AS doc_id", f"{STATEMENT} AS text")
    return families.families(part.selectExpr("p_partkey AS q_id", f"{ASKED} AS question"), standards, pages)
