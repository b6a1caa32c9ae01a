"""Queries of numbers, units, limits, findings and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as num
from ..operators import review as op
from ..sources.derived import facts, requirements
from ..sources.tables import read

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_REQS = """reqs AS (SELECT p_partkey AS req_id, p_brand AS standard, CASE p_partkey % 8
 WHEN 0 THEN 'The size of the ' || p_name || ' shall not exceed ' || p_size || ' mm.'
 WHEN 1 THEN 'The size shall be at least ' || p_size || ' mm.'
 WHEN 2 THEN 'The pressure shall be between ' || p_size || ' and ' || (p_size + 10) || ' bar.'
 WHEN 3 THEN 'The vendor should supply ' || p_type || ' drawings.'
 WHEN 4 THEN 'The temperature shall be less than ' || p_size || ' degF.'
 WHEN 5 THEN 'The size shall be not less than ' || p_size || ' cm.'
 WHEN 6 THEN 'The housing shall be of ' || p_name || ' type.'
 ELSE 'Refer to ' || p_brand || ', clause ' || p_size || '.' || (p_size % 7) || '.' END AS text FROM part)"""
_FACTS = """facts AS (SELECT l_partkey AS req_id, l_orderkey * 10 + l_linenumber AS fact_id, l_linenumber AS page,
 CASE WHEN l_tax = 0 THEN '' WHEN l_discount = 0.1 THEN 'later' WHEN l_discount = 0 THEN 'n/a' ELSE l_quantity::BIGINT::VARCHAR END AS cell,
 CASE l_linenumber % 5 WHEN 0 THEN 'mm' WHEN 1 THEN 'cm' WHEN 2 THEN 'in' WHEN 3 THEN 'degF' ELSE 'kg' END AS unit FROM lineitem)"""
_UNITS = "units(unit, dimension, base, factor) AS (VALUES " + ", ".join(f"('{u}', '{d}', '{b}', {'NULL' if f is None else repr(f)}::DOUBLE)" for u, d, b, f in num.UNITS) + ")"
_WAY = f"""CASE WHEN regexp_matches(lower(text), '{num.AT_LEAST}') AND NOT regexp_matches(regexp_replace(lower(text), 'not less than', '', 'g'), '{num.AT_MOST}') THEN '>='
 WHEN NOT regexp_matches(lower(text), '{num.AT_LEAST}') AND regexp_matches(regexp_replace(lower(text), 'not less than', '', 'g'), '{num.AT_MOST}') THEN '<=' END"""
_KIND = f"""CASE WHEN NOT regexp_matches(lower(text), '(^| )(shall|must) ') THEN CASE WHEN regexp_matches(lower(text), '(^| )refer to ') THEN 'citation' ELSE 'statement' END
 WHEN regexp_matches(lower(text), 'between [0-9.]+ and [0-9.]+') THEN 'range' WHEN ({_WAY}) IS NOT NULL AND regexp_matches(text, '[0-9]') THEN 'numeric limit' ELSE 'nominal' END"""
_READ = rf"""rr AS (SELECT *, {_KIND} AS kind, {_WAY} AS way, try_cast(regexp_extract(text, '([0-9.]*[0-9]) [A-Za-z0-9/()]+\.$', 1) AS DOUBLE) AS lim, nullif(regexp_extract(text, '[0-9] ([A-Za-z0-9/()]+)\.$', 1), '') AS lunit,
 regexp_matches(regexp_replace(lower(text), 'not less than|not more than', '', 'g'), 'less than|greater than|exceeding') AS is_strict FROM reqs)"""
_FINDINGS = f"""{_REQS}, {_FACTS}, {_UNITS}, {_READ},
j AS (SELECT f.req_id, fact_id, standard, page, cell, way, is_strict, f.unit = lunit AS same, u.dimension AS d1, v.dimension AS d2, try_cast(cell AS DOUBLE) AS val,
 CASE WHEN f.unit = lunit THEN try_cast(cell AS DOUBLE) ELSE try_cast(cell AS DOUBLE) * u.factor END AS a, CASE WHEN f.unit = lunit THEN lim ELSE lim * v.factor END AS b
 FROM facts f JOIN rr ON f.req_id = rr.req_id AND kind = 'numeric limit' LEFT JOIN units u ON u.unit = f.unit LEFT JOIN units v ON v.unit = lunit),
s AS (SELECT *, CASE WHEN same OR d1 = d2 THEN CASE WHEN abs(a - b) <= 1e-6 * greatest(abs(b), 1) THEN CASE WHEN NOT is_strict THEN 'meets' END
 WHEN (way = '<=' AND a <= b) OR (way = '>=' AND a >= b) THEN 'meets' WHEN a IS NOT NULL AND b IS NOT NULL THEN 'does not meet' END END AS status FROM j),
fin AS (SELECT req_id, fact_id, standard, page, status, CASE WHEN cell IN ('', 'later') THEN 'no value given' WHEN val IS NULL THEN 'value is not a number' WHEN d1 IS NULL THEN 'unit unknown'
 WHEN NOT same AND NOT coalesce(d1 = d2, FALSE) THEN 'another dimension' WHEN status IS NULL AND a = b THEN 'equal to a strict limit' WHEN status IS NULL THEN 'unit is not converted' ELSE 'compared' END AS reason FROM s)"""
_TIER = "CASE WHEN status IS NOT NULL THEN 'A' WHEN reason = 'no value given' THEN 'B' ELSE 'C' END"


def _findings(spark, sf):
    return op.findings(requirements(spark, sf), facts(spark, sf))


@query(f"WITH {_REQS}, {_READ} SELECT req_id, kind, way, lim AS limit_value, lunit AS limit_unit, is_strict FROM rr")
def requirement_reading(spark: SparkSession, sf: str) -> DataFrame:
    return op.read_requirements(requirements(spark, sf)).select("req_id", "kind", "way", "limit_value", "limit_unit", "is_strict")


@query(rf"""WITH {_REQS}, n AS (SELECT req_id, regexp_extract_all(text, '([0-9][0-9.,]*[0-9]|[0-9])', 1) AS ns FROM reqs)
SELECT req_id, len(ns) AS n_numbers, coalesce(list_sum([try_cast(x AS DOUBLE) FOR x IN ns]), 0) AS total FROM n""")
def num_parse(spark, sf):
    n = requirements(spark, sf).select("req_id", num.number_tokens(F.col("text")).alias("ns"))
    total = F.aggregate(F.transform("ns", num.as_number), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    return n.select("req_id", F.size("ns").alias("n_numbers"), total.alias("total"))


@query(f"""WITH {_FACTS}, {_UNITS} SELECT f.unit, dimension, base, count(*) AS n, count(try_cast(cell AS DOUBLE)) AS n_numbers, round(sum(try_cast(cell AS DOUBLE) * factor), 3) AS total
FROM facts f LEFT JOIN units u ON u.unit = f.unit GROUP BY f.unit, dimension, base""")
def unit_norm(spark, sf):
    f = facts(spark, sf).withColumn("value", num.as_number(F.col("cell"))).withColumn("dimension", num.dimension(F.col("unit"))).withColumn("base", F.element_at(num._unit_map(2), F.col("unit")))
    return f.groupBy("unit", "dimension", "base").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_numbers"), F.round(F.sum(num.normalised(F.col("value"), F.col("unit"))), 3).alias("total"))


@query(f"WITH {_FINDINGS} SELECT * FROM fin")
def fig_compare(spark, sf):
    return _findings(spark, sf)


@query(f"WITH {_FINDINGS} SELECT {_TIER} AS tier, reason, count(*) AS n FROM fin GROUP BY 1, 2")
def tier_counts(spark, sf):
    return _findings(spark, sf).groupBy(op.tier().alias("tier"), "reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_FINDINGS} SELECT req_id, reason, coalesce(status, 'undecided') AS status, count(*) AS n, array_to_string(list_sort(list_distinct(list(page))), ',') AS pages FROM fin GROUP BY 1, 2, 3""")
def one_row_per_problem(spark, sf):
    f = _findings(spark, sf).withColumn("status", F.coalesce("status", F.lit("undecided")))
    pages = F.array_join(F.transform(F.sort_array(F.collect_set("page")), lambda x: x.cast("string")), ",")
    return f.groupBy("req_id", "reason", "status").agg(F.count(F.lit(1)).alias("n"), pages.alias("pages"))


@query(f"""WITH {_FINDINGS}, m AS (SELECT req_id, max(CASE WHEN status = 'does not meet' THEN 3 WHEN reason = 'no value given' THEN 1 WHEN status IS NULL THEN 2 ELSE 0 END) AS sev FROM fin GROUP BY req_id)
SELECT req_id, CASE sev WHEN 3 THEN 'major' WHEN 2 THEN 'minor' WHEN 1 THEN 'observation' ELSE 'none' END AS severity FROM m""")
def severity_floor(spark, sf):
    rank = F.when(F.col("status") == "does not meet", 3).when(F.col("reason") == "no value given", 1).when(F.col("status").isNull(), 2).otherwise(0)
    m = _findings(spark, sf).groupBy("req_id").agg(F.max(rank).alias("sev"))
    return m.select("req_id", F.when(F.col("sev") == 3, "major").when(F.col("sev") == 2, "minor").when(F.col("sev") == 1, "observation").otherwise("none").alias("severity"))


@query(f"""WITH {_FINDINGS}, p AS (SELECT req_id, min(CASE WHEN status = 'does not meet' THEN 1 WHEN status = 'meets' THEN 2 WHEN reason = 'no value given' THEN 3 ELSE 4 END) AS g FROM fin GROUP BY req_id),
a AS (SELECT r.req_id, r.standard, coalesce(g, 5) AS g FROM reqs r LEFT JOIN p USING (req_id))
SELECT standard, count(*) FILTER (WHERE g = 1) AS failed, count(*) FILTER (WHERE g = 2) AS met, count(*) FILTER (WHERE g = 3) AS blank, count(*) FILTER (WHERE g = 4) AS undecided, count(*) FILTER (WHERE g = 5) AS not_asked,
 count(*) AS total, round(100.0 * count(*) FILTER (WHERE g IN (3, 4)) / nullif(count(*) FILTER (WHERE g <= 4), 0), 1) AS unchecked_share FROM a GROUP BY standard""")
def requirement_split(spark, sf):
    group = F.when(F.col("status") == "does not meet", 1).when(F.col("status") == "meets", 2).when(F.col("reason") == "no value given", 3).otherwise(4)
    p = _findings(spark, sf).groupBy("req_id").agg(F.min(group).alias("g"))
    a = requirements(spark, sf).select("req_id", "standard").join(p, "req_id", "left").withColumn("g", F.coalesce("g", F.lit(5)))
    share = F.round(100.0 * F.count_if(F.col("g").isin(3, 4)) / F.nullif(F.count_if(F.col("g") <= 4), F.lit(0)), 1)
    names = ("failed", "met", "blank", "undecided", "not_asked")
    return a.groupBy("standard").agg(*(F.count_if(F.col("g") == i + 1).alias(n) for i, n in enumerate(names)), F.count(F.lit(1)).alias("total"), share.alias("unchecked_share"))


@query(f"""WITH {_FINDINGS}, d AS (SELECT DISTINCT req_id FROM fin)
SELECT CASE WHEN d.req_id IS NULL THEN 'missing' ELSE 'decided' END AS state, kind, count(*) AS n FROM rr LEFT JOIN d ON d.req_id = rr.req_id GROUP BY 1, 2""")
def scope_ledger(spark, sf):
    d = _findings(spark, sf).select("req_id").distinct().withColumn("seen", F.lit(True))
    j = op.read_requirements(requirements(spark, sf)).select("req_id", "kind").join(d, "req_id", "left")
    return j.groupBy(F.when(F.col("seen").isNull(), "missing").otherwise("decided").alias("state"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_REQS}, c AS (SELECT req_id, upper(regexp_replace(regexp_extract(text, 'Refer to ([^,]+),', 1), '[^A-Za-z0-9]', '', 'g')) AS k FROM reqs WHERE text LIKE 'Refer to %'),
h AS (SELECT DISTINCT upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS k FROM part WHERE p_size > 48)
SELECT k AS standard_key, count(*) AS n_citations FROM c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.k = c.k) GROUP BY k""")
def cited_not_held(spark, sf):
    key = lambda c: F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    c = requirements(spark, sf).filter(F.col("text").startswith("Refer to ")).select(key(F.regexp_extract("text", "Refer to ([^,]+),", 1)).alias("standard_key"))
    held = read(spark, sf, "part").filter("p_size > 48").select(key(F.col("p_brand")).alias("standard_key")).distinct()
    return c.join(held, "standard_key", "left_anti").groupBy("standard_key").agg(F.count(F.lit(1)).alias("n_citations"))


@query(f"WITH {_FACTS} SELECT cell, CASE WHEN cell = '' THEN 'blank' WHEN cell = 'later' THEN 'placeholder' ELSE 'value' END AS marker, count(*) AS n FROM facts GROUP BY 1, 2")
def blank_markers(spark, sf):
    return facts(spark, sf).groupBy("cell", num.blank_marker(F.col("cell")).alias("marker")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_FACTS}, v AS (SELECT req_id, page, count(DISTINCT cell || ' ' || unit) AS k, count(*) AS n FROM facts WHERE try_cast(cell AS DOUBLE) IS NOT NULL GROUP BY req_id, page)
SELECT req_id, page, n, CASE WHEN k = 1 THEN 'agree' ELSE 'conflict' END AS state FROM v WHERE n > 1""")
def field_copies(spark, sf):
    f = facts(spark, sf).filter(num.as_number(F.col("cell")).isNotNull())
    v = f.groupBy("req_id", "page").agg(F.countDistinct(F.concat_ws(" ", "cell", "unit")).alias("k"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return v.select("req_id", "page", "n", F.when(F.col("k") == 1, "agree").otherwise("conflict").alias("state"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 AND l_discount <= 1 THEN 'engineer' WHEN l_discount = 0 THEN 'stated' ELSE 'negative' END AS state FROM lineitem")
def percent_kind(spark, sf):
    d = F.col("l_discount")
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when((d > 0) & (d <= 1), "engineer").when(d == 0, "stated").otherwise("negative").alias("state"))


@query("""WITH p AS (SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_extendedprice END) AS a, max(CASE WHEN l_linenumber = 2 THEN l_extendedprice END) AS b FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, CASE WHEN a + b <= 0.5 * o_totalprice THEN 'meets' WHEN a + b > 0.5 * o_totalprice THEN 'does not meet' END AS verdict FROM orders LEFT JOIN p ON l_orderkey = o_orderkey""")
def sum_against_percent(spark, sf):
    """Two fields' sum against half of a third; a missing part decides nothing."""
    part = lambda n: F.max(F.when(F.col("l_linenumber") == n, F.col("l_extendedprice")))
    p = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(part(1).alias("a"), part(2).alias("b"))
    o = read(spark, sf, "orders").join(p, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    total, half = F.col("a") + F.col("b"), F.lit(0.5) * F.col("o_totalprice")
    return o.select("o_orderkey", F.when(total <= half, "meets").when(total > half, "does not meet").alias("verdict"))


@query("""WITH s AS (SELECT l_orderkey, count(*) AS n, sum(round(l_extendedprice, 0)) AS printed, sum(l_extendedprice) AS exact FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, n, abs(printed - round(exact, 0)) <= 0.5 * (n + 1) AS consistent FROM s""")
def table_totals(spark, sf):
    """A printed total agrees with its printed rows within the sum of their half units."""
    s = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round("l_extendedprice", 0)).alias("printed"), F.sum("l_extendedprice").alias("exact"))
    return s.select("l_orderkey", "n", (F.abs(F.col("printed") - F.round("exact", 0)) <= 0.5 * (F.col("n") + 1)).alias("consistent"))


@query("""WITH b AS (SELECT c_nationkey, c_mktsegment, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1, 2)
SELECT c_nationkey, c_mktsegment, lo > hi AS reversed, coalesce(lo < lag(hi) OVER w, FALSE) AS overlaps, coalesce(lo > lag(hi) OVER w, FALSE) AS gap FROM b WINDOW w AS (PARTITION BY c_nationkey ORDER BY lo, c_mktsegment)""")
def table_bands(spark, sf):
    b = read(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    before = F.lag("hi").over(Window.partitionBy("c_nationkey").orderBy("lo", "c_mktsegment"))
    return b.select("c_nationkey", "c_mktsegment", (F.col("lo") > F.col("hi")).alias("reversed"), F.coalesce(F.col("lo") < before, F.lit(False)).alias("overlaps"), F.coalesce(F.col("lo") > before, F.lit(False)).alias("gap"))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus, CASE WHEN o_orderstatus IS DISTINCT FROM lag(o_orderstatus) OVER w THEN 1 ELSE 0 END AS changed FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, o_orderkey, sum(changed) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS version FROM s""")
def book_numbering(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    s = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", (~F.col("o_orderstatus").eqNullSafe(F.lag("o_orderstatus").over(w))).cast("bigint").alias("changed"))
    return s.select("o_custkey", "o_orderkey", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("version"))


@query("SELECT user_id, CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN NULL ELSE max(event_id) END AS snapshot FROM events GROUP BY user_id")
def restore_pin(spark, sf):
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    return read(spark, sf, "events").groupBy("user_id").agg(F.when(last != "error", F.max("event_id")).alias("snapshot"))


@query("""WITH a AS (SELECT user_id, mode_type FROM (SELECT user_id, event_type AS mode_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events WHERE event_id % 2 = 0 GROUP BY user_id, event_type) WHERE rn = 1),
b AS (SELECT user_id, mode_type FROM (SELECT user_id, event_type AS mode_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events WHERE event_id % 2 = 1 GROUP BY user_id, event_type) WHERE rn = 1)
SELECT count(*) AS in_both, count(*) FILTER (WHERE a.mode_type <> b.mode_type) AS changed, count(*) FILTER (WHERE a.mode_type <> b.mode_type AND 'purchase' IN (a.mode_type, b.mode_type)) AS changed_decision FROM a JOIN b USING (user_id)""")
def steadiness(spark, sf):
    def top(half):
        c = read(spark, sf, "events").filter(F.col("event_id") % 2 == half).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
        return c.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "event_type"))["event_type"].alias(f"t{half}"))

    j = top(0).join(top(1), "user_id")
    moved = F.col("t0") != F.col("t1")
    return j.agg(F.count(F.lit(1)).alias("in_both"), F.count_if(moved).alias("changed"), F.count_if(moved & ((F.col("t0") == "purchase") | (F.col("t1") == "purchase"))).alias("changed_decision"))


@query("""WITH sent AS (SELECT DISTINCT user_id, date_trunc('day', ts) AS day FROM events WHERE event_type = 'view'), due AS (SELECT DISTINCT user_id, date_trunc('day', ts) AS day FROM events WHERE event_type = 'error')
SELECT user_id, day::TIMESTAMP AS day FROM due WHERE NOT EXISTS (SELECT 1 FROM sent WHERE sent.user_id = due.user_id AND sent.day = due.day)""")
def reminders_due(spark, sf):
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day")
    e = read(spark, sf, "events")
    return e.filter("event_type = 'error'").select("user_id", day).distinct().join(e.filter("event_type = 'view'").select("user_id", day).distinct(), ["user_id", "day"], "left_anti")


@query("""SELECT 'overdue' AS kind, o_orderkey AS id, 1::BIGINT AS n FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01' AND o_orderkey % 11 <> 0
UNION ALL SELECT 'open findings', o_custkey, count(*) FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey HAVING count(*) >= 2""")
def automatic_risks(spark, sf):
    o = read(spark, sf, "orders")
    known = o.filter("o_orderkey % 11 = 0").select("o_orderkey")  # those with an open risk already
    overdue = o.filter("o_orderstatus = 'O' and o_orderdate < timestamp_ntz '1996-01-01 00:00:00'").select("o_orderkey").join(known, "o_orderkey", "left_anti")
    overdue = overdue.select(F.lit("overdue").alias("kind"), F.col("o_orderkey").alias("id"), F.lit(1).cast("bigint").alias("n"))
    grouped = o.filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return overdue.unionByName(grouped.select(F.lit("open findings").alias("kind"), F.col("o_custkey").alias("id"), "n"))


@query(r"""WITH c AS (SELECT page_id, (CASE WHEN contains(html, '<table') THEN 4 ELSE 0 END) AS s_table, (CASE WHEN contains(html, '<article') THEN 3 ELSE 0 END + CASE WHEN length(html) > 4000 THEN 2 ELSE 0 END) AS s_article,
 (CASE WHEN contains(url, 'page=') THEN 3 ELSE 0 END + CASE WHEN contains(html, '<nav') THEN 1 ELSE 0 END) AS s_listing FROM pages),
r AS (SELECT page_id, list_sort([{s: -s_article, k: 'article'}, {s: -s_listing, k: 'listing'}, {s: -s_table, k: 'table'}]) AS l FROM c)
SELECT page_id, CASE WHEN -l[1].s >= 4 AND l[2].s - l[1].s >= 2 THEN l[1].k ELSE 'needs_engineer' END AS kind, (-l[1].s)::INT AS best FROM r""")
def kind_router(spark, sf):
    h, u = F.col("html"), F.col("url")
    on = lambda c, w: F.when(c, w).otherwise(0)
    kinds = {"article": on(h.contains("<article"), 3) + on(F.length(h) > 4000, 2), "listing": on(u.contains("page="), 3) + on(h.contains("<nav"), 1), "table": on(h.contains("<table"), 4)}
    ranked = F.sort_array(F.array(*(F.struct((-s).alias("s"), F.lit(k).alias("k")) for k, s in kinds.items())))
    r = read(spark, sf, "pages").select("page_id", ranked.alias("l"))
    best, second = F.col("l")[0], F.col("l")[1]
    sure = (-best["s"] >= 4) & (second["s"] - best["s"] >= 2)
    return r.select("page_id", F.when(sure, best["k"]).otherwise("needs_engineer").alias("kind"), (-best["s"]).alias("best"))


@query(r"""WITH s AS (SELECT o_orderkey, 'ord_' || (o_orderkey % 500) || '.' || (o_orderkey % 3) || ' Rev ' || chr((65 + o_orderkey % 4)::INT) AS line FROM orders),
n AS (SELECT o_orderkey, upper(regexp_replace(regexp_extract(line, '^(\S+) Rev', 1), '[\s_/.]+', '-', 'g')) AS number, regexp_extract(line, 'Rev ([A-Z])', 1) AS rev FROM s),
f AS (SELECT number, arg_min(rev, o_orderkey) AS rev, min(o_orderkey) AS o_orderkey FROM n GROUP BY number),
h AS (SELECT DISTINCT upper(regexp_replace('ord_' || (l_orderkey % 500) || '.' || (l_orderkey % 3), '[\s_/.]+', '-', 'g')) AS number, chr((65 + l_orderkey % 4)::INT) AS rev FROM lineitem WHERE l_linenumber = 1)
SELECT f.number, f.rev, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.number = f.number AND h.rev = f.rev) THEN 'pass' WHEN EXISTS (SELECT 1 FROM h WHERE h.number = f.number) THEN 'query: another revision is held' ELSE 'query: not held' END AS state FROM f""")
def transmittal_check(spark, sf):
    name = lambda key: F.concat(F.lit("ord_"), (F.col(key) % 500).cast("string"), F.lit("."), (F.col(key) % 3).cast("string"))
    norm = lambda c: F.upper(F.regexp_replace(c, r"[\s_/.]+", "-"))
    rev = lambda key: F.char(F.lit(65) + F.col(key) % 4)
    line = F.concat(name("o_orderkey"), F.lit(" Rev "), rev("o_orderkey"))
    n = read(spark, sf, "orders").select("o_orderkey", norm(F.regexp_extract(line, r"^(\S+) Rev", 1)).alias("number"), F.regexp_extract(line, "Rev ([A-Z])", 1).alias("rev"))
    first = n.groupBy("number").agg(F.min_by("rev", "o_orderkey").alias("rev"))
    held = read(spark, sf, "lineitem").filter("l_linenumber = 1").select(norm(name("l_orderkey")).alias("number"), rev("l_orderkey").alias("rev")).groupBy("number").agg(F.collect_set("rev").alias("revs"))
    j = first.join(held, "number", "left")
    state = F.when(F.array_contains("revs", F.col("rev")), "pass").when(F.col("revs").isNotNull(), "query: another revision is held").otherwise("query: not held")
    return j.select("number", "rev", state.alias("state"))


@query(f"""WITH {_REQS}, a AS (SELECT req_id, [f FOR f IN [CASE WHEN regexp_matches(text, ' shall ') THEN 'obligation' END, CASE WHEN regexp_matches(text, ' should ') THEN 'recommendation' END, CASE WHEN regexp_matches(text, 'not exceed') THEN 'prohibition' END, CASE WHEN regexp_matches(text, '^Refer ') THEN 'reference' END] IF f IS NOT NULL] AS fam FROM reqs)
SELECT req_id, array_to_string(CASE WHEN list_contains(fam, 'prohibition') THEN [f FOR f IN fam IF f <> 'obligation'] ELSE fam END, ',') AS families FROM a""")
def assertion_families(spark, sf):
    t = F.col("text")
    fam = F.array_compact(F.array(F.when(t.contains(" shall "), "obligation"), F.when(t.contains(" should "), "recommendation"), F.when(t.contains("not exceed"), "prohibition"), F.when(t.startswith("Refer "), "reference")))
    a = requirements(spark, sf).select("req_id", fam.alias("fam"))
    return a.select("req_id", F.array_join(F.when(F.array_contains("fam", "prohibition"), F.array_remove("fam", "obligation")).otherwise(F.col("fam")), ",").alias("families"))


@query(f"""WITH {_FINDINGS}, d AS (SELECT DISTINCT page FROM fin WHERE reason = 'unit unknown')
SELECT req_id, fact_id, CASE WHEN status = 'meets' AND page IN (SELECT page FROM d) THEN 'engineer review' ELSE coalesce(status, 'undecided') END AS held FROM fin""")
def degraded_read_hold(spark, sf):
    """A pass on a page that was partly unreadable is held; failures keep their status."""
    f = _findings(spark, sf)
    d = f.filter("reason = 'unit unknown'").select("page").distinct().withColumn("bad", F.lit(True))
    j = f.join(d, "page", "left")
    return j.select("req_id", "fact_id", F.when((F.col("status") == "meets") & F.col("bad"), "engineer review").otherwise(F.coalesce("status", F.lit("undecided"))).alias("held"))


@query(f"""WITH {_FINDINGS}, c AS (SELECT req_id, count(*) FILTER (WHERE status = 'meets') AS m, count(*) FILTER (WHERE status = 'does not meet') AS x FROM fin GROUP BY req_id)
SELECT rr.req_id, CASE WHEN x > 0 THEN 'NOT_SATISFIED' WHEN m > 0 THEN 'SATISFIED' ELSE 'UNKNOWN' END AS gate FROM rr LEFT JOIN c ON c.req_id = rr.req_id WHERE kind = 'numeric limit'""")
def condition_gate(spark, sf):
    c = _findings(spark, sf).groupBy("req_id").agg(F.count_if(F.col("status") == "meets").alias("m"), F.count_if(F.col("status") == "does not meet").alias("x"))
    j = op.read_requirements(requirements(spark, sf)).filter("kind = 'numeric limit'").select("req_id").join(c, "req_id", "left")
    return j.select("req_id", F.when(F.col("x") > 0, "NOT_SATISFIED").when(F.col("m") > 0, "SATISFIED").otherwise("UNKNOWN").alias("gate"))
