"""Queries of rule tables with terms, of a ledger that has to add up, of risks in registers, and of what answers rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import quoted
from ..functions.text import STOPWORDS
from ..operators import assess, evaluation
from ..sources.derived import STATEMENTS_SQL, statements
from ..sources.tables import read

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Rows of rule tables that parts give rise to: 25 rules, steps of 10 kPa with gaps, one or two terms.
RULES = """p_partkey % 25 AS rule_id, CASE WHEN p_partkey >= 25 THEN (p_partkey - p_partkey % 25) / 25 * 10.0 END AS lo, CASE WHEN p_partkey < 150 OR p_partkey % 25 <> 7 THEN ((p_partkey - p_partkey % 25) / 25 + 1) * 10.0 END AS hi,
 CASE p_size % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'max' ELSE 'min' END AS op"""
GAPS = "((p_partkey - p_partkey % 25) / 25) % 7 <> 3"
VALUES = """l_orderkey * 10 + l_linenumber AS id, l_partkey % 25 AS rule_id, CASE l_linenumber WHEN 2 THEN l_quantity * 12.5 WHEN 3 THEN l_quantity - 10.0 ELSE l_quantity END AS input,
 CASE l_linenumber WHEN 1 THEN 'barg' WHEN 2 THEN 'kPa' WHEN 3 THEN 'bar' WHEN 4 THEN 'bara' WHEN 5 THEN 'MPa' WHEN 6 THEN 'furlong' END AS input_unit,
 CASE l_linenumber WHEN 2 THEN l_quantity * 12.5 WHEN 3 THEN l_quantity - 10.0 ELSE l_quantity END * (1.0 + l_suppkey % 4 * 0.1) AS output,
 CASE WHEN l_suppkey % 9 = 0 THEN 'bara' ELSE CASE l_linenumber WHEN 1 THEN 'barg' WHEN 2 THEN 'kPa' WHEN 3 THEN 'bar' WHEN 4 THEN 'bara' WHEN 5 THEN 'MPa' ELSE 'psig' END END AS output_unit"""


def _unit(c: str, at: int) -> str:
    arms = " ".join(f"WHEN {quoted(u[0])} THEN {u[at] if at == 1 else quoted(u[at])}" for u in assess.PRESSURES if u[at] is not None)
    return f"CASE {c} {arms} END"


@query(f"""WITH r AS (SELECT {RULES}, CASE WHEN p_size % 3 = 0 THEN [{{'k': 1.1::DOUBLE, 'c': 0::DOUBLE}}] ELSE [{{'k': 1.1::DOUBLE, 'c': 0::DOUBLE}}, {{'k': 1::DOUBLE, 'c': 17::DOUBLE + p_size}}] END AS terms FROM (SELECT p_partkey::DOUBLE AS k, * FROM part) WHERE {GAPS.replace("/", "//")}),
v AS (SELECT DISTINCT ON (id) * FROM (SELECT {VALUES} FROM lineitem) ORDER BY id, input, output, output_unit, rule_id),
n AS (SELECT id, rule_id, input * {_unit("input_unit", 1)} AS x, output * {_unit("output_unit", 1)} AS y, coalesce({_unit("input_unit", 2)}, 'gauge') = coalesce({_unit("output_unit", 2)}, 'gauge') AS one FROM v),
m AS (SELECT n.id, any_value(x) AS x, any_value(y) AS y, any_value(one) AS one, count(op) AS k, any_value(op) AS op, any_value(terms) AS terms FROM n LEFT JOIN r ON r.rule_id = n.rule_id AND (lo IS NULL OR lo < x) AND (hi IS NULL OR x <= hi) GROUP BY n.id),
q AS (SELECT *, list_transform(terms, lambda t: round(t.k * x + t.c, 6)) AS ts, CASE WHEN x IS NULL OR y IS NULL THEN 'unit not read' WHEN NOT one THEN 'not one scale' WHEN k = 0 THEN 'outside every row' WHEN k > 1 THEN 'in more than one row' END AS reason FROM m),
z AS (SELECT id, reason, y, CASE WHEN reason IS NULL THEN CASE op WHEN 'min' THEN list_min(ts) ELSE list_max(ts) END END AS required FROM q)
SELECT id, CASE WHEN reason IS NOT NULL THEN 'NEEDS_ENGINEER_REVIEW' WHEN round(y, 6) >= required THEN 'COMPLIANT' ELSE 'NON_COMPLIANT' END AS status, required, reason FROM z""")
def rule_terms(spark: SparkSession, sf: str):
    """Stated pressures against rule tables: the row that an input falls in, its terms, and whether the output reaches them."""
    term = lambda k, c: F.struct(F.lit(k).alias("k"), c.cast("double").alias("c"))
    one, two = term(1.1, F.lit(0.0)), term(1.0, F.lit(17.0) + F.col("p_size"))
    part = read(spark, sf, "part").filter(GAPS.replace("/", "div").replace("(p_partkey - p_partkey % 25) div 25", "p_partkey div 25"))
    rows = part.selectExpr(*_columns(RULES), "p_size").withColumn("terms", F.when(F.col("p_size") % 3 == 0, F.array(one)).otherwise(F.array(one, two))).drop("p_size")
    values = read(spark, sf, "lineitem").selectExpr(*_columns(VALUES))
    names = ("input", "output", "output_unit", "rule_id")
    first = values.groupBy("id").agg(F.min_by(F.struct("rule_id", "input", "input_unit", "output", "output_unit"), F.struct(*names)).alias("x")).select("id", "x.*")
    return assess.evaluate_rules(first, rows)


def _columns(listed: str) -> list[str]:
    """The items of a select list that has no comma but between them and within CASE arms or brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(listed):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(listed[at:i])
            at = i + 1
    return [x.strip() for x in (*out, listed[at:])]


STATES = ("applies_checked", "applies_not_checked", "does_not_apply", "not_used")
_DECIDED = """SELECT p_partkey AS requirement_id, CASE WHEN n IS NULL THEN 'does_not_apply' WHEN readable = 0 THEN 'applies_not_checked' WHEN p_size % 10 = 0 THEN 'not_used' ELSE 'applies_checked' END AS state,
 CASE WHEN n IS NULL THEN 'other_equipment' WHEN readable = 0 THEN 'unreadable_text' WHEN p_size % 10 = 0 THEN 'later_edition' WHEN readable < n THEN 'needs_engineer' ELSE 'compared' END AS reason_code
 FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, sum(CASE WHEN l_tax > 0.02 AND l_discount < 0.09 THEN 1 ELSE 0 END) AS readable FROM lineitem WHERE l_quantity > 40 GROUP BY l_partkey) f ON l_partkey = p_partkey"""


@query(f"SELECT state, reason_code, count(*) AS n FROM ({_DECIDED}) GROUP BY state, reason_code")
def ledger_checked(spark, sf):
    """Decisions by state and reason, of a ledger that has exactly one for every requirement in scope, or else fails."""
    read(spark, sf, "part").createOrReplaceTempView("_ledger_part")
    read(spark, sf, "lineitem").createOrReplaceTempView("_ledger_lineitem")
    decisions = spark.sql(_DECIDED.replace("FROM part", "FROM _ledger_part").replace("FROM lineitem", "FROM _ledger_lineitem"))
    return assess.ledger_counts(read(spark, sf, "part").select(F.col("p_partkey").alias("requirement_id")), decisions, STATES)


NOW = "TIMESTAMP '1996-06-01 12:00:00'"


@query(f"""WITH d AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey > 1 THEN o_orderkey // 2 END AS parent_id, o_orderdate AS due, o_orderstatus = 'F' AS closed FROM orders),
s AS (SELECT 'schedule' AS risk_type, id AS key_id, date_diff('day', due::DATE, {NOW}::DATE)::BIGINT AS n FROM d WHERE NOT closed AND due::DATE < {NOW}::DATE),
c AS (SELECT 'dependency' AS risk_type, id AS key_id, 1::BIGINT AS n FROM d WHERE NOT closed AND parent_id IN (SELECT id FROM d WHERE NOT closed AND due::DATE <= {NOW}::DATE)),
f AS (SELECT l_partkey AS k, count(*) FILTER (WHERE l_linestatus = 'O' AND l_shipdate < {NOW} - INTERVAL 7 DAY) AS review, count(*) FILTER (WHERE l_returnflag = 'R' AND l_discount >= 0.09) AS compliance FROM lineitem GROUP BY l_partkey),
a AS (SELECT * FROM s UNION ALL SELECT * FROM c UNION ALL SELECT 'review', k, review FROM f WHERE review > 0 UNION ALL SELECT 'compliance', k, compliance FROM f WHERE compliance > 0)
SELECT * FROM a WHERE NOT (key_id % 11 = 0 AND risk_type IN ('schedule', 'review')) AND NOT (key_id % 13 = 0 AND risk_type IN ('dependency', 'compliance'))""")
def register_risks(spark, sf):
    """The risks that deliverables, their parents and findings give rise to, without those that are open already."""
    o, l = read(spark, sf, "orders"), read(spark, sf, "lineitem")
    deliverables = o.selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey > 1 THEN o_orderkey div 2 END AS parent_id", "o_orderdate AS due", "o_orderstatus = 'F' AS closed")
    findings = l.selectExpr("l_partkey AS document_id", "l_linestatus = 'O' AS open", "l_shipdate AS updated", "l_returnflag = 'R' AS deviation", "l_discount >= 0.09 AS unresolved")
    keys = o.select(F.col("o_orderkey").alias("key_id")).union(read(spark, sf, "part").select("p_partkey")).distinct()
    kinds = lambda *names: F.explode(F.array(*map(F.lit, names))).alias("risk_type")
    held = keys.filter("key_id % 11 = 0").select("key_id", kinds("schedule", "review")).unionByName(keys.filter("key_id % 13 = 0").select("key_id", kinds("dependency", "compliance")))
    return assess.risks(deliverables, findings, held, F.lit(NOW[11:-1]).cast("timestamp_ntz"))


_STOP = ", ".join(map(quoted, STOPWORDS))
#: A sentence of an answer that repeats a line: cited rightly, not at all, wrongly, or with another figure.
SENTENCE = "CASE value % 4 WHEN 0 THEN concat(text, ' [', n, ']') WHEN 1 THEN text WHEN 2 THEN concat('It is so. ', text, ' [', n % 3 + 1, '] [99]') ELSE concat(text, ' and 7', value, ' of it [', n, ']') END"


def _content(t: str) -> str:
    return rf"[w FOR w IN regexp_extract_all(regexp_replace(lower({t}), {quoted(evaluation.MARK)}, ' ', 'g'), '[\p{{L}}0-9]+') IF length(w) > 1 AND w NOT IN ({_STOP})]"


def _figures(t: str) -> str:
    return f"list_distinct(regexp_extract_all(regexp_replace({t}, {quoted(evaluation.MARK)}, ' ', 'g'), {quoted(evaluation.FIGURE)}))"


def _share(words: str, held: str) -> str:
    return f"len([w FOR w IN {words} IF list_contains({held}, w)]) / len({words})"


_HOLDS = lambda words, figures: f"({_share('words', words)} >= {evaluation.SUPPORT} AND len([x FOR x IN figures IF NOT list_contains({figures}, x)]) = 0)"


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, text, value)::INT AS n FROM {STATEMENTS_SQL}),
p AS (SELECT doc_id AS a_id, n, {_content("text")} AS words, {_figures("text")} AS figures, n % 2 = 1 AS gold FROM s), a AS (SELECT DISTINCT doc_id AS a_id FROM s),
c AS (SELECT row_number() OVER () AS c_id, doc_id AS a_id, {_content("t")} AS words, {_figures("t")} AS figures, [m::INT FOR m IN regexp_extract_all(t, {quoted(evaluation.MARK)}, 1)] AS marks FROM (SELECT doc_id, {SENTENCE} AS t FROM s) WHERE len({_content("t")}) >= {evaluation.CLAIM_WORDS}),
k AS (SELECT c.c_id, c.a_id, p.n, p.words, p.figures, p.gold FROM c JOIN p ON p.a_id = c.a_id AND list_contains(c.marks, p.n)),
w AS (SELECT c_id, count(*) AS cites FROM k GROUP BY c_id),
o AS (SELECT c.c_id, coalesce(w.cites, 0) AS cites, p.words, p.figures, p.gold FROM c LEFT JOIN w USING (c_id) JOIN p ON p.a_id = c.a_id AND (coalesce(w.cites, 0) = 0 OR list_contains(c.marks, p.n))),
g AS (SELECT c_id, any_value(cites) AS cites, flatten(list(words)) AS aw, flatten(list(figures)) AS af, coalesce(flatten(list(words) FILTER (WHERE gold)), []) AS gw, coalesce(flatten(list(figures) FILTER (WHERE gold)), []) AS gf, count(*) FILTER (WHERE gold) AS ng FROM o GROUP BY c_id),
r AS (SELECT k.c_id, count(*) FILTER (WHERE {_share("c.words", "k.words")} >= {evaluation.RELEVANT}) AS relevant FROM k JOIN c USING (c_id) GROUP BY k.c_id),
t AS (SELECT c.a_id, {_HOLDS("aw", "af")} AS ok, cites, coalesce(relevant, 0) AS relevant, NOT {_HOLDS("gw", "gf")} OR (cites > 0 AND ng = 0) AS noise FROM c JOIN g USING (c_id) LEFT JOIN r USING (c_id)),
z AS (SELECT a_id, count(*) AS n, round(count(*) FILTER (WHERE ok) / count(*), 6) AS faithfulness, round(count(*) FILTER (WHERE cites > 0) / count(*), 6) AS citation_recall, round(sum(relevant) / nullif(sum(cites), 0), 6) AS citation_precision, round(count(*) FILTER (WHERE noise) / count(*), 6) AS noise_sensitivity FROM t GROUP BY a_id)
SELECT a_id, coalesce(n, 0) AS n_claims, faithfulness, citation_recall, citation_precision, noise_sensitivity FROM a LEFT JOIN z USING (a_id)""")
def answer_claims(spark, sf):
    """What the claims of answers rest on: support, citations that are there and fit, and claims that rest on noise."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "text", "value"))
    s = statements(spark, sf).withColumn("n", place)
    passages = s.select(F.col("doc_id").alias("a_id"), "n", "text", (F.col("n") % 2 == 1).alias("gold"))
    answers = s.groupBy(F.col("doc_id").alias("a_id")).agg(F.collect_list(F.expr(SENTENCE)).alias("sentences"))
    return evaluation.answer_scores(answers, passages)
