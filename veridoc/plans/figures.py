"""Queries of numbers, units, limits and claims stated in text, over the statements that order lines give rise to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as num
from ..functions.rules import first_rule, first_rule_sql, found, found_sql, rewrite, rewrite_sql
from ..sources.derived import STATEMENTS_SQL, statements

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_S = f"s AS {STATEMENTS_SQL}"
KEYS = ("doc_id", "page")

#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = (
    "No", "NO", "Nos", "para", "paras", "Para", "Sec", "Secs", "Fig", "Figs", "Cl", "Eq", "Ref", "Refs", "Tbl", "Vol", "Art", "Dwg",
    "approx", "Approx", "Min", "Max", "vs", "Vs", "e.g", "i.e",
)
MASKED = [("(^|[ (])(" + "|".join(a.replace(".", "[.]") for a in ABBREVIATIONS) + ")[.]", "\\1\\2·"), ("([.!?]) +", "\\1\n"), ("·", ".")]


@query(f"WITH {_S} SELECT doc_id, page, {num.number_list_sql('text')} AS tokens, {num.number_values_sql('text')} AS numbers FROM s")
def numbers_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every number of a statement with its sign; compounds stay tokens."""
    found = statements(spark, sf).select(*KEYS, num.number_list(F.col("text")).alias("tokens"))
    return found.select(*KEYS, "tokens", num.values_of(F.col("tokens")).alias("numbers"))


@query(f"WITH {_S} SELECT doc_id, page, value, list_contains({num.number_values_sql('text')}, value::DOUBLE) AS stated, contains(text, value::VARCHAR) AS as_digits FROM s")
def value_stated(spark, sf):
    """Whether a statement holds the line's value as a whole signed number, and whether its digits merely occur."""
    stated = num.states(F.col("text"), F.col("value").cast("double"))
    return statements(spark, sf).select(*KEYS, "value", stated.alias("stated"), F.contains(F.col("text"), F.col("value").cast("string")).alias("as_digits"))


@query(f"WITH {_S}, e AS (SELECT doc_id, unnest(string_split({rewrite_sql('text', MASKED)}, chr(10))) AS sentence FROM s) SELECT doc_id, sentence, count(*) AS n FROM e WHERE sentence <> '' GROUP BY doc_id, sentence")
def safe_sentences(spark, sf):
    """Sentences, where an abbreviation's full stop ends none."""
    each = statements(spark, sf).select("doc_id", F.explode(F.split(rewrite(F.col("text"), MASKED), "\n")).alias("sentence"))
    return each.filter("sentence <> ''").groupBy("doc_id", "sentence").agg(F.count(F.lit(1)).alias("n"))


#: Spellings whose case is their meaning, with their dimension; they are recognised and never converted.
CASE_KEPT = [("(^|[ 0-9])mPa($|[ .,;])", "pressure"), ("(^|[ 0-9])mW($|[ .,;])", "power"), ("(^|[ 0-9])MV($|[ .,;])", "voltage"), ("(^|[ 0-9])Pa[.]s($|[ .,;])", "viscosity")]
UNIT = "-?[0-9][0-9.,]* ?(mPa|MPa|kPa|barg|bar|mm|kg|inch|m3/h|°C)"


@query(f"WITH {_S} SELECT doc_id, page, {found_sql('text', UNIT, 1)} AS units, {first_rule_sql('text', CASE_KEPT)} AS kept_case FROM s")
def unit_case(spark, sf):
    """Units after numbers in their own case, and the dimension of one that only case tells from another."""
    return statements(spark, sf).select(*KEYS, found(F.col("text"), UNIT, 1).alias("units"), first_rule(F.col("text"), CASE_KEPT).alias("kept_case"))


OWN_LIMIT = "(?i)(not exceed|not less than|at least|at most|not more than) (?:the )?([a-z][a-z ]{1,40}) of (-?[0-9][0-9.,]*) ?([A-Za-z%/0-9]+)[.;]?$"
CHOICE = "(?i)(greater|lesser|higher|lower|larger|smaller|sum|total|half|twice|average|ratio)"


@query(f"""WITH {_S}, m AS (SELECT doc_id, page, lower(regexp_extract(text, '{OWN_LIMIT}', 1)) AS cmp, regexp_extract(text, '{OWN_LIMIT}', 2) AS ref, {num.value_of_sql(f"regexp_extract(text, '{OWN_LIMIT}', 3)")} AS value, regexp_extract(text, '{OWN_LIMIT}', 4) AS unit FROM s WHERE regexp_matches(text, '{OWN_LIMIT}'))
SELECT doc_id, page, CASE WHEN cmp IN ('not less than', 'at least') THEN '>=' ELSE '<=' END AS way, ref, value, regexp_replace(unit, '[.]$', '') AS unit FROM m WHERE NOT regexp_matches(ref, '{CHOICE}')""")
def own_value_limit(spark, sf):
    """Limits stated through a reference, as in "not less than the set pressure of 5 barg", unless the reference is a choice."""
    part = lambda i: F.regexp_extract("text", OWN_LIMIT, i)
    m = statements(spark, sf).filter(F.col("text").rlike(OWN_LIMIT)).select(*KEYS, F.lower(part(1)).alias("cmp"), part(2).alias("ref"), num.value_of(part(3)).alias("value"), F.regexp_replace(part(4), "[.]$", "").alias("unit"))
    way = F.when(F.col("cmp").isin("not less than", "at least"), ">=").otherwise("<=")
    return m.filter(~F.col("ref").rlike(CHOICE)).select(*KEYS, way.alias("way"), "ref", "value", "unit")


#: Words of a plain note beside a value; any other word, or a sign of degree, makes it another value.
NEUTRAL = "(by|vendor|contractor|supplier|others|as|per|code|standard|note|notes|see|ref|refer|to|the|data|sheet)"
AROUND = [("-?[0-9][0-9.,]*", " "), ("(?i)\\b(barg|bar|mm|kg|kpa)\\b", " "), (f"(?i)\\b{NEUTRAL}\\b", " "), ("[ .,;()]+", " ")]


@query(rf"""WITH {_S}, f AS (SELECT doc_id, page, text, {num.number_values_sql('text')} AS v, lower(regexp_extract(text, '(?i)(barg|bar|mm|kg|kpa)', 1)) AS unit, trim({rewrite_sql('text', AROUND)}) AS rest FROM s),
k AS (SELECT doc_id, CASE WHEN len(v) = 1 AND rest = '' THEN v[1]::BIGINT::VARCHAR || ' ' || unit ELSE lower(text) END AS key FROM f WHERE text <> '')
SELECT doc_id, key, count(*) AS n FROM k GROUP BY doc_id, key""")
def same_value(spark, sf):
    """Facts of a document under one key: number and unit where only neutral words stand around them, else the text itself."""
    unit = F.lower(F.regexp_extract("text", "(?i)(barg|bar|mm|kg|kpa)", 1))
    f = statements(spark, sf).filter("text <> ''").select("doc_id", "text", num.number_values(F.col("text")).alias("v"), unit.alias("unit"), F.trim(rewrite(F.col("text"), AROUND)).alias("rest"))
    key = F.when((F.size("v") == 1) & (F.col("rest") == ""), F.concat_ws(" ", F.get("v", F.lit(0)).cast("bigint").cast("string"), "unit")).otherwise(F.lower("text"))
    return f.groupBy("doc_id", key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


DUAL = "([0-9][0-9.,]*) \\(([0-9][0-9.,]*)\\) ([A-Za-z0-9/]+) \\(([A-Za-z0-9/]+)\\)"


@query(f"""WITH {_S} SELECT doc_id, page, {num.value_of_sql(f"regexp_extract(text, '{DUAL}', 1)")} AS value, regexp_extract(text, '{DUAL}', 3) AS unit, {num.value_of_sql(f"regexp_extract(text, '{DUAL}', 2)")} AS other_value, regexp_extract(text, '{DUAL}', 4) AS other_unit FROM s WHERE regexp_matches(text, '{DUAL}')""")
def dual_units(spark, sf):
    """Values printed in two units: "24.8 (109) m3/h (USGPM)"."""
    part = lambda i: F.regexp_extract("text", DUAL, i)
    return statements(spark, sf).filter(F.col("text").rlike(DUAL)).select(*KEYS, num.value_of(part(1)).alias("value"), part(3).alias("unit"), num.value_of(part(2)).alias("other_value"), part(4).alias("other_unit"))


OBLIGED, FIGURE = "(?i)\\b(shall|must|required)\\b", "[0-9] ?(bar|barg|kPa|mPa|mm|kg|inch|°C|m3/h|Pa[.]s)"
NAMED = "[A-Z]{1,4}-[0-9]{2,5}[A-Z]?|(API|ASME) [A-Z]?[0-9.]+"


@query(f"""WITH {_S}, e AS (SELECT doc_id, page, unnest(string_split({rewrite_sql('text', MASKED)}, chr(10))) AS sentence, text FROM s)
SELECT doc_id, page, sentence, instr(text, sentence) AS at, length(sentence) AS length, regexp_matches(sentence, '{FIGURE}') AS measured, regexp_matches(sentence, '{NAMED}') AS named FROM e WHERE regexp_matches(sentence, '{FIGURE}') OR regexp_matches(sentence, '{NAMED}')""")
def claims(spark, sf):
    """Sentences with a measurement or a designation, with their place in the text."""
    e = statements(spark, sf).select(*KEYS, "text", F.explode(F.split(rewrite(F.col("text"), MASKED), "\n")).alias("sentence"))
    s = F.col("sentence")
    out = e.select(*KEYS, "sentence", F.expr("instr(text, sentence)").alias("at"), F.char_length("sentence").alias("length"), s.rlike(FIGURE).alias("measured"), s.rlike(NAMED).alias("named"))
    return out.filter("measured or named")


_SUBJECTS = [("(?i)pressure", "pressure"), ("(?i)temperature", "temperature"), ("(?i)viscosity", "viscosity"), ("(?i)tolerance|range", "size"), ("(?i)flow", "flow")]


@query(f"""WITH {_S}, c AS (SELECT doc_id, {first_rule_sql('text', _SUBJECTS)} AS facet, regexp_extract(text, '{UNIT}', 1) AS unit, {num.number_values_sql('text')}[1] AS v, regexp_matches(text, '(?i)not less than|at least|minimum') AS low FROM s WHERE regexp_matches(text, '{UNIT}')),
g AS (SELECT doc_id, facet, unit, count(*) AS n, count(DISTINCT v) AS kinds, max(v) FILTER (WHERE low) AS floor, min(v) FILTER (WHERE NOT low) AS ceiling FROM c WHERE facet IS NOT NULL AND unit <> '' GROUP BY doc_id, facet, unit)
SELECT doc_id, facet, unit, n, CASE WHEN n = 1 THEN 'single' WHEN kinds = 1 THEN 'agreement' WHEN floor IS NULL OR ceiling IS NULL THEN 'unresolved' WHEN floor > ceiling THEN 'possible_conflict' ELSE 'addition' END AS label FROM g""")
def facet_clusters(spark, sf):
    """Claims of a document by subject and unit: alike, compatible, in conflict or unresolved; units are never mixed."""
    v = F.get(num.number_values(F.col("text")), F.lit(0))
    c = statements(spark, sf).filter(F.col("text").rlike(UNIT)).select("doc_id", first_rule(F.col("text"), _SUBJECTS).alias("facet"), F.regexp_extract("text", UNIT, 1).alias("unit"), v.alias("v"), F.col("text").rlike("(?i)not less than|at least|minimum").alias("low"))
    g = c.filter("facet is not null and unit <> ''").groupBy("doc_id", "facet", "unit").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("v").alias("kinds"), F.max(F.when(F.col("low"), F.col("v"))).alias("floor"), F.min(F.when(~F.col("low"), F.col("v"))).alias("ceiling"))
    label = F.when(F.col("n") == 1, "single").when(F.col("kinds") == 1, "agreement").when(F.col("floor").isNull() | F.col("ceiling").isNull(), "unresolved").when(F.col("floor") > F.col("ceiling"), "possible_conflict").otherwise("addition")
    return g.select("doc_id", "facet", "unit", "n", label.alias("label"))


@query(f"""WITH {_S}, p AS (SELECT doc_id, string_agg(text, ' ' ORDER BY page) AS printed FROM s GROUP BY doc_id),
r AS (SELECT o_orderkey AS doc_id, [(o_orderkey % 50 + 1)::DOUBLE, (o_custkey % 50 + 1)::DOUBLE] AS wanted FROM orders)
SELECT doc_id, list_sort(list_filter(list_distinct(wanted), lambda x: NOT list_contains({num.number_values_sql('printed')}, x))) AS missing, len(list_filter(wanted, lambda x: NOT list_contains({num.number_values_sql('printed')}, x))) = 0 AS printed_all FROM p JOIN r USING (doc_id)""")
def rule_numbers_printed(spark, sf):
    """Numbers of a document's rule that its pages do not print; a rule holds only if all are printed."""
    from ..sources.tables import read

    pages = statements(spark, sf).select("doc_id", num.number_values(F.col("text")).alias("v")).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("v"))).alias("printed"))
    rules = read(spark, sf, "orders").selectExpr("o_orderkey AS doc_id", "array(double(o_orderkey % 50 + 1), double(o_custkey % 50 + 1)) AS wanted")
    missing = F.array_sort(F.array_except("wanted", "printed"))
    return rules.join(pages, "doc_id").select("doc_id", missing.alias("missing"), (F.size(missing) == 0).alias("printed_all"))


@query(f"""WITH {_S}, v AS (SELECT doc_id, page, {num.number_values_sql('text')}[1] AS v, regexp_matches(text, '(?i)note|vendor|later') AS deferred FROM s),
t AS (SELECT doc_id, page, v, deferred, CASE WHEN v IS NULL THEN 'query' WHEN v <= 40 THEN 'pass' ELSE 'fail' END AS first FROM v)
SELECT doc_id, page, first, CASE WHEN deferred AND first <> 'query' THEN 'query' WHEN v < 0 AND first = 'pass' THEN 'query' ELSE first END AS status,
 CASE WHEN deferred AND first <> 'query' THEN 'the value is deferred; the numbers read ' || first WHEN v < 0 AND first = 'pass' THEN 'printed below zero' END AS why FROM t""")
def held_verdicts(spark, sf):
    """Verdicts against a limit of 40 that are held: a deferred value either way, a value below zero that would pass."""
    v = statements(spark, sf).select(*KEYS, F.get(num.number_values(F.col("text")), F.lit(0)).alias("v"), F.col("text").rlike("(?i)note|vendor|later").alias("deferred"))
    t = v.withColumn("first", F.when(F.col("v").isNull(), "query").when(F.col("v") <= 40, "pass").otherwise("fail"))
    deferred, below = F.col("deferred") & (F.col("first") != "query"), (F.col("v") < 0) & (F.col("first") == "pass")
    why = F.when(deferred, F.concat(F.lit("the value is deferred; the numbers read "), "first")).when(below, "printed below zero")
    return t.select(*KEYS, "first", F.when(deferred | below, "query").otherwise(F.col("first")).alias("status"), why.alias("why"))


CLASS = "(?i)class ([0-9]{2,4})"


@query(rf"""WITH {_S}, r AS (SELECT doc_id, page, list_distinct(list_transform({found_sql('text', CLASS, 1)}, lambda x: x::INT)) AS cs, regexp_matches(text, '(?i) (if|when|unless|where) ') AS conditional, regexp_matches(text, '(?i)at least|minimum') AS low, regexp_matches(text, '(?i)not exceed|maximum') AS high FROM s WHERE regexp_matches(text, '{CLASS}')),
o AS (SELECT doc_id, page, conditional, cs[1] AS v, CASE WHEN len(cs) > 1 AND (low OR high) THEN NULL WHEN len(cs) > 1 THEN 'in' WHEN low AND high THEN NULL WHEN low THEN '>=' WHEN high THEN '<=' ELSE '=' END AS op FROM r)
SELECT doc_id, page, op, v, (page * 150)::INT AS stated, CASE WHEN conditional OR op IS NULL THEN NULL WHEN op = '>=' THEN page * 150 >= v WHEN op = '<=' THEN page * 150 <= v ELSE page * 150 = v END AS agrees FROM o""")
def class_compare(spark, sf):
    """Class limits against a stated class; a conditional or unclear one decides nothing."""
    cs = F.array_distinct(F.transform(found(F.col("text"), CLASS, 1), lambda x: x.cast("int")))
    r = statements(spark, sf).filter(F.col("text").rlike(CLASS)).select(*KEYS, cs.alias("cs"), F.col("text").rlike("(?i) (if|when|unless|where) ").alias("conditional"), F.col("text").rlike("(?i)at least|minimum").alias("low"), F.col("text").rlike("(?i)not exceed|maximum").alias("high"))
    op = F.when((F.size("cs") > 1) & (F.col("low") | F.col("high")), None).when(F.size("cs") > 1, "in").when(F.col("low") & F.col("high"), None).when(F.col("low"), ">=").when(F.col("high"), "<=").otherwise("=")
    o = r.select(*KEYS, "conditional", F.element_at("cs", 1).alias("v"), op.alias("op"), (F.col("page") * 150).cast("int").alias("stated"))
    ok = F.when(F.col("op") == ">=", F.col("stated") >= F.col("v")).when(F.col("op") == "<=", F.col("stated") <= F.col("v")).otherwise(F.col("stated") == F.col("v"))
    return o.select(*KEYS, "op", "v", "stated", F.when(~F.col("conditional") & F.col("op").isNotNull(), ok).alias("agrees"))


@query(f"""WITH {_S}, c AS (SELECT doc_id, regexp_extract(text, '(ASME B31[.][0-9]|API [0-9]+)', 1) AS standard, regexp_extract(text, '(?:ASME B31[.][0-9]|API [0-9]+)-([0-9]{{4}})', 1) AS year FROM s WHERE regexp_matches(text, 'ASME B31[.][0-9]|API [0-9]+')),
y AS (SELECT doc_id, standard, CASE WHEN count(DISTINCT year) FILTER (WHERE year <> '') = 1 THEN max(year)::INT END AS cited FROM c GROUP BY doc_id, standard),
h AS (SELECT 'ASME B31.' || (s_suppkey % 9) AS standard, 2000 + s_suppkey % 12 AS held FROM supplier),
n AS (SELECT standard, list_sort(list_distinct(list(held))) AS held FROM h GROUP BY standard)
SELECT doc_id, standard, cited, CASE WHEN held IS NULL THEN 'not held' WHEN cited IS NULL THEN 'unknown' WHEN list_contains(held, cited) THEN 'same' WHEN cited < held[1] THEN 'older' WHEN cited > held[-1] THEN 'newer' ELSE 'between' END AS relation FROM y LEFT JOIN n USING (standard)""")
def cited_edition(spark, sf):
    """Cited standards against the editions held; one cited under two years, or none, is unknown."""
    from ..sources.tables import read

    c = statements(spark, sf).filter(F.col("text").rlike("ASME B31[.][0-9]|API [0-9]+")).select("doc_id", F.regexp_extract("text", "(ASME B31[.][0-9]|API [0-9]+)", 1).alias("standard"), F.nullif(F.regexp_extract("text", "(?:ASME B31[.][0-9]|API [0-9]+)-([0-9]{4})", 1), F.lit("")).alias("year"))
    y = c.groupBy("doc_id", "standard").agg(F.when(F.countDistinct("year") == 1, F.max("year").cast("int")).alias("cited"))
    h = read(spark, sf, "supplier").selectExpr("concat('ASME B31.', s_suppkey % 9) AS standard", "int(2000 + s_suppkey % 12) AS held")
    n = h.groupBy("standard").agg(F.sort_array(F.collect_set("held")).alias("held"))
    relation = F.when(F.col("held").isNull(), "not held").when(F.col("cited").isNull(), "unknown").when(F.expr("array_contains(held, cited)"), "same").when(F.col("cited") < F.expr("element_at(held, 1)"), "older").when(F.col("cited") > F.expr("element_at(held, -1)"), "newer").otherwise("between")
    return y.join(n, "standard", "left").select("doc_id", "standard", "cited", relation.alias("relation"))


@query(f"""WITH {_S}, d AS (SELECT DISTINCT doc_id, page, value, text FROM s WHERE text <> ''), p AS (SELECT doc_id, page, lower(string_agg(text, ' ' ORDER BY text)) AS body FROM (SELECT DISTINCT doc_id, page, text FROM d) GROUP BY doc_id, page),
n AS (SELECT DISTINCT doc_id, page, text, instr(body, lower(text)) AS a FROM d JOIN p USING (doc_id, page) WHERE regexp_matches(text, '{OBLIGED}') AND regexp_matches(text, '{FIGURE}')),
q AS (SELECT DISTINCT doc_id, page, length(substr(text, 5, 25)) AS size, instr(body, lower(substr(text, 5, 25))) AS b FROM d JOIN p USING (doc_id, page) WHERE value % 3 = 0)
SELECT n.doc_id, n.page, n.text AS sentence, coalesce(bool_or(a > 0 AND b > 0 AND a < b + size AND b < a + length(n.text)), false) AS covered FROM n LEFT JOIN q ON n.doc_id = q.doc_id AND n.page = q.page GROUP BY n.doc_id, n.page, n.text""")
def rule_coverage(spark, sf):
    """Numeric rules of a page, and whether the place of a rule's quote on that page overlaps theirs; a quote not found covers nothing."""
    d = statements(spark, sf).filter("text <> ''").distinct()
    p = d.groupBy(*KEYS).agg(F.lower(F.array_join(F.array_sort(F.collect_set("text")), " ")).alias("body"))
    on_page = d.join(p, list(KEYS))
    n = on_page.filter(F.col("text").rlike(OBLIGED) & F.col("text").rlike(FIGURE)).select(*KEYS, F.col("text").alias("sentence"), F.expr("instr(body, lower(text))").alias("a")).distinct()
    quote = F.substring("text", 5, 25)
    q = on_page.filter("value % 3 = 0").select(*KEYS, F.char_length(quote).alias("size"), F.expr("instr(body, lower(substring(text, 5, 25)))").alias("b")).distinct()
    meets = F.expr("a > 0 and b > 0 and a < b + size and b < a + char_length(sentence)")
    return n.join(q, list(KEYS), "left").groupBy(*KEYS, "sentence").agg(F.coalesce(F.bool_or(meets), F.lit(False)).alias("covered"))
