"""Queries of registers: facets, runs, sequences, spending, totals, risks, identifiers and spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as num
from ..functions import text as fx
from ..functions.rules import first_rule, first_rule_sql
from ..operators import retrieval as ret
from ..operators import text as op
from ..sources.derived import STATEMENTS_SQL, statements
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


_S = f"s AS {STATEMENTS_SQL}"
LOWER = r"[x FOR x IN string_split_regex(lower(text), '[^\p{L}0-9]+') IF x <> '']"
_COLUMNS = {"orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "customer": ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "part": ("p_partkey", "p_name", "p_brand", "p_type")}


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n_filled, count(DISTINCT {c}) AS n_distinct FROM {t}" for t, cs in _COLUMNS.items() for c in cs))
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of the main tables with how many rows they fill and how many values they have; one pass over each table."""
    out = None
    for t, cs in _COLUMNS.items():
        counts = read(spark, sf, t).agg(F.count(F.lit(1)).alias("n_rows"), *(f(c).alias(f"{c}{i}") for c in cs for i, f in enumerate((F.count, F.countDistinct))))
        rows = F.array(*(F.struct(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), F.col("n_rows"), F.col(f"{c}0").alias("n_filled"), F.col(f"{c}1").alias("n_distinct")) for c in cs))
        one = counts.select(F.inline(rows))
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH f AS (SELECT o_orderstatus, o_orderpriority FROM orders WHERE lower(o_orderpriority) LIKE '%i%')
SELECT 'status' AS facet, o_orderstatus AS value, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM f GROUP BY 2""")
def order_facets(spark, sf):
    """Facets of the orders whose priority holds the letter asked for, in either case."""
    f = read(spark, sf, "orders").filter(F.lower("o_orderpriority").contains("i"))
    pairs = F.array(F.struct(F.lit("status").alias("facet"), F.col("o_orderstatus").alias("value")), F.struct(F.lit("priority").alias("facet"), F.col("o_orderpriority").alias("value")))
    return f.select(F.inline(pairs)).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM events)
SELECT event_id, previous FROM e WHERE event_type = 'purchase' OR event_type = 'error'""")
def previous_complete_run(spark, sf):
    """For each run, complete or not, the latest complete one before it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = read(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    done = F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(w)
    return e.withColumn("previous", done).filter(F.col("event_type").isin("purchase", "error")).select("event_id", "previous")


@query("SELECT source, lang, count(*) AS n, count(*) FILTER (WHERE n_chars > 0) AS loaded, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM documents GROUP BY source, lang")
def inventory(spark, sf):
    """Documents by source and language, whatever languages there are, with their share of the source."""
    g = read(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 0).alias("loaded"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6))


@query("""SELECT event_type AS step, CAST(ts AS DATE) AS day, round(least(sum(value), 5000), 4) AS capped, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type, CAST(ts AS DATE)), (event_type), ())""")
def spend_rollup(spark, sf):
    """Spending by step and day, by step, and in total, each under its cap."""
    e = read(spark, sf, "events").select(F.col("event_type").alias("step"), F.col("ts").cast("date").alias("day"), "value")
    g = e.groupingSets([["step", "day"], ["step"], []], "step", "day").agg(F.round(F.least(F.sum("value"), F.lit(5000.0)), 4).alias("capped"), F.count(F.lit(1)).alias("n"))
    return g.select("step", "day", "capped", "n")


@query("""WITH old AS (SELECT o_custkey, max(o_orderkey) AS top FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), new AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth FROM orders WHERE o_orderstatus <> 'F')
SELECT o_orderkey, coalesce(top, 0) + nth AS seq FROM new LEFT JOIN old USING (o_custkey)""")
def next_sequence(spark, sf):
    """Numbers of new rows that go on from the highest of their scope, from 1 where it has none."""
    o = read(spark, sf, "orders")
    top = o.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("top"))
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    new = o.filter("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey", nth.alias("nth"))
    return new.join(top, "o_custkey", "left").select("o_orderkey", (F.coalesce("top", F.lit(0)) + F.col("nth")).alias("seq"))


@query("""WITH b AS (SELECT p_brand AS rule, p_partkey AS row, p_size AS lo, p_size + p_partkey % 4 AS hi FROM part), l AS (SELECT *, lead(lo) OVER w AS next_lo FROM b WINDOW w AS (PARTITION BY rule ORDER BY lo, row))
SELECT rule, count(*) AS bands, count(*) FILTER (WHERE lo > hi) AS inverted, count(*) FILTER (WHERE next_lo < hi) AS overlaps, count(*) FILTER (WHERE next_lo > hi) AS gaps FROM l GROUP BY rule""")
def band_checks(spark, sf):
    """Neighbouring bands of each rule: how many overlap, leave a gap, or end before they begin."""
    b = read(spark, sf, "part").selectExpr("p_brand AS rule", "p_partkey AS row", "p_size AS lo", "p_size + p_partkey % 4 AS hi")
    l = b.withColumn("next_lo", F.lead("lo").over(Window.partitionBy("rule").orderBy("lo", "row")))
    return l.groupBy("rule").agg(F.count(F.lit(1)).alias("bands"), F.count_if(F.col("lo") > F.col("hi")).alias("inverted"), F.count_if(F.col("next_lo") < F.col("hi")).alias("overlaps"), F.count_if(F.col("next_lo") > F.col("hi")).alias("gaps"))


@query("""WITH l AS (SELECT o_custkey, count(*) AS live FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), w AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'O')
SELECT o_orderkey, o_custkey, rn FROM w LEFT JOIN l USING (o_custkey) WHERE rn <= 3 - coalesce(live, 0)""")
def claimable(spark, sf):
    """Waiting rows that may be claimed: the most urgent and oldest of each owner, three at most with those that are live."""
    o = read(spark, sf, "orders")
    live = o.filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("live"))
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderdate", "o_orderkey"))
    w = o.filter("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", rn.alias("rn"))
    return w.join(live, "o_custkey", "left").filter(F.col("rn") <= 3 - F.coalesce("live", F.lit(0))).select("o_orderkey", "o_custkey", "rn")


@query("""SELECT event_id, CASE WHEN user_id % 5 = 0 THEN regexp_replace(props, '"k": [0-9]+', '"k": null') ELSE props END AS props, user_id % 5 = 0 AS erased FROM events""")
def erase_of_deleted(spark, sf):
    """Payloads in which what came from deleted owners is erased, and from no other."""
    gone = F.col("user_id") % 5 == 0
    return read(spark, sf, "events").select("event_id", F.when(gone, F.regexp_replace("props", '"k": [0-9]+', '"k": null')).otherwise(F.col("props")).alias("props"), gone.alias("erased"))


@query("""WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents), r AS (SELECT source, line FROM (SELECT DISTINCT doc_id, source, unnest(ls) AS line FROM d) WHERE trim(line) <> '' GROUP BY source, line HAVING count(*) >= 3),
e AS (SELECT doc_id, source, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d), k AS (SELECT doc_id, e.line, pos, r.line IS NOT NULL OR regexp_matches(e.line, '^ *[0-9]{1,4} *$') AS running FROM e LEFT JOIN r ON e.source = r.source AND e.line = r.line)
SELECT doc_id, count(*) FILTER (WHERE running) AS stripped, md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT running), '')) AS digest FROM k GROUP BY doc_id""")
def stripped_pages(spark, sf):
    """Texts without the lines that run through three documents of their source, or are page numbers."""
    return op.without_running_lines(read(spark, sf, "documents").select("doc_id", "source", "text"), "source").select("doc_id", "stripped", F.md5("text").alias("digest"))


@query(rf"""WITH s AS (SELECT doc_id, [x FOR x IN string_split_regex(text, '[.!?]\s+') IF x <> ''] AS ss FROM documents), e AS (SELECT doc_id, unnest(ss) AS text, unnest(range(0, len(ss))) AS pos FROM s), n AS (SELECT doc_id, pos, text, len([x FOR x IN string_split_regex(text, '[ \t\r\n]+') IF x <> '']) AS n FROM e),
p AS (SELECT doc_id, pos, text, n, floor((sum(n) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - n) / 300)::INT AS ordinal FROM n)
SELECT doc_id, ordinal, md5(string_agg(text, '. ' ORDER BY pos)) AS chunk, sum(n)::BIGINT AS n_tokens FROM p GROUP BY doc_id, ordinal""")
def sentence_chunk_texts(spark, sf):
    """Sentence-bounded chunks with their text (its digest), of some 300 tokens."""
    cut = F.filter(F.split("text", r"[.!?]\s+"), lambda x: x != "")
    sized = F.transform(cut, lambda x: F.struct(x.alias("text"), F.size(fx.white_tokens(x)).alias("n")))
    # a running sum within the document's own array: no shuffle, as a document's sentences are in one row
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<ordinal:int,text:string,n:int>>").alias("out"))
    step = lambda acc, x: F.struct((acc["sum"] + x["n"]).alias("sum"), F.concat(acc["out"], F.array(F.struct(F.floor(acc["sum"] / 300).cast("int").alias("ordinal"), x["text"].alias("text"), x["n"].alias("n")))).alias("out"))
    placed = F.aggregate(sized, start, step, lambda acc: acc["out"])
    e = read(spark, sf, "documents").select("doc_id", F.posexplode(placed).alias("pos", "x")).select("doc_id", "pos", "x.ordinal", "x.text", "x.n")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda y: y["text"])
    return e.groupBy("doc_id", "ordinal").agg(F.md5(F.array_join(texts, ". ")).alias("chunk"), F.sum("n").alias("n_tokens"))


@query("SELECT source, count(*) AS n, count(DISTINCT text) AS kept, count(*) - count(DISTINCT text) AS dropped FROM documents GROUP BY source")
def section_duplicates(spark, sf):
    """Exact copies within a section are kept once; the same text in two sections stays in both."""
    g = read(spark, sf, "documents").groupBy("source", F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kept"), (F.sum("n") - F.count(F.lit(1))).alias("dropped"))


def _near_dups_sql():
    from . import text

    return text.ORACLE["near_dups"]


@query(f"WITH p AS ({_near_dups_sql()}), m AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), s AS (SELECT m.a, m.b, x.n_chars AS na, y.n_chars AS nb FROM m JOIN documents x ON m.a = x.doc_id JOIN documents y ON m.b = y.doc_id) SELECT a AS doc_id, count(*) AS near, bool_and(na > nb OR (na = nb AND a < b)) AS survives FROM s GROUP BY a")
def near_dup_survivors(spark, sf):
    """Documents with near copies, and whether they outlast them: the longest does, of equals the first."""
    docs = read(spark, sf, "documents").select("doc_id", "n_chars")
    # each pair both ways from one reading: the pairs are costly
    both = op.near_copies(read(spark, sf, "documents")).select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    s = both.join(docs.select(F.col("doc_id").alias("a"), F.col("n_chars").alias("na")), "a").join(docs.select(F.col("doc_id").alias("b"), F.col("n_chars").alias("nb")), "b")
    better = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    return s.groupBy(F.col("a").alias("doc_id")).agg(F.count(F.lit(1)).alias("near"), F.bool_and(better).alias("survives"))


#: The organisations whose standards are read, with the shape of their numbers.
IDENTIFIER = "(ASME|API|ISO|ASTM) ?([A-Z]?[0-9]+(?:[.][0-9]+)?)(?:-([0-9]{4}))?"


@query(f"""WITH {_S}, m AS (SELECT doc_id, regexp_extract(text, '{IDENTIFIER}', 1) AS family, regexp_extract(text, '{IDENTIFIER}', 2) AS number, nullif(regexp_extract(text, '{IDENTIFIER}', 3), '') AS year FROM s WHERE regexp_matches(text, '{IDENTIFIER}'))
SELECT family || ' ' || number AS standard, count(*) AS cited, count(DISTINCT doc_id) AS documents, count(DISTINCT year) AS editions, min(year)::INT AS oldest FROM m GROUP BY 1""")
def standard_ids(spark, sf):
    """Standards cited, in one form whatever edition is named, with how often, where and in which editions."""
    part = lambda i: F.regexp_extract("text", IDENTIFIER, i)
    m = statements(spark, sf).filter(F.col("text").rlike(IDENTIFIER)).select("doc_id", F.concat_ws(" ", part(1), part(2)).alias("standard"), F.nullif(part(3), F.lit("")).alias("year"))
    return m.groupBy("standard").agg(F.count(F.lit(1)).alias("cited"), F.countDistinct("doc_id").alias("documents"), F.countDistinct("year").alias("editions"), F.min("year").cast("int").alias("oldest"))


@query("""WITH r AS (SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS rows_total, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, n, CASE WHEN n IS NULL THEN NULL ELSE abs(rows_total - o_totalprice) <= 0.005 * n + 0.005 END AS agrees, CASE WHEN n IS NULL THEN 'no rows' WHEN abs(rows_total - o_totalprice) <= 0.005 * n + 0.005 THEN 'printed total agrees' WHEN rows_total > o_totalprice THEN 'rows exceed the printed total' ELSE 'rows fall short of the printed total' END AS finding FROM orders LEFT JOIN r ON o_orderkey = l_orderkey""")
def printed_totals(spark, sf):
    """Orders' printed totals against the sums of their rows, within half a unit of each row's rounding."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    r = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum(net), 2).alias("rows_total"), F.count(F.lit(1)).alias("n"))
    j = read(spark, sf, "orders").select("o_orderkey", "o_totalprice").join(r, "o_orderkey", "left")
    agrees = F.abs(F.col("rows_total") - F.col("o_totalprice")) <= 0.005 * F.col("n") + 0.005
    finding = F.when(F.col("n").isNull(), "no rows").when(agrees, "printed total agrees").when(F.col("rows_total") > F.col("o_totalprice"), "rows exceed the printed total").otherwise("rows fall short of the printed total")
    return j.select("o_orderkey", "n", agrees.alias("agrees"), finding.alias("finding"))


@query("""WITH b AS (SELECT item_id, list_sort(list_distinct([x FOR x IN string_split_regex(lower(text), '[^\\p{L}0-9]+') IF length(x) >= 4])) AS ws FROM benchmark), q AS (SELECT item_id, unnest(ws) AS word, len(ws) AS n FROM b),
t AS (SELECT doc_id, source, unnest(list_distinct([x FOR x IN string_split_regex(lower(text), '[^\\p{L}0-9]+') IF length(x) >= 4])) AS word FROM documents), h AS (SELECT item_id, source, doc_id, count(*) AS k, n FROM q JOIN t USING (word) GROUP BY item_id, source, doc_id, n)
SELECT item_id, source, count(*) FILTER (WHERE k = n) AS answered, count(*) FILTER (WHERE k < n AND 2 * k >= n) AS supporting, max(k) AS best FROM h GROUP BY item_id, source""")
def coverage_by_question(spark, sf):
    """Documents of each source that hold all, or half, of a question's own words."""
    long = lambda c: F.array_distinct(F.filter(fx.tokens(c), lambda x: F.char_length(x) >= 4))
    b = read(spark, sf, "benchmark").select("item_id", long(F.col("text")).alias("ws"))
    q = b.select("item_id", F.size("ws").alias("n"), F.explode("ws").alias("word"))
    wanted = q.select("word").distinct()
    docs = read(spark, sf, "documents").select("doc_id", "source", F.explode(long(F.col("text"))).alias("word"))
    h = docs.join(wanted, "word", "left_semi").join(q, "word").groupBy("item_id", "source", "doc_id", "n").agg(F.count(F.lit(1)).alias("k"))
    return h.groupBy("item_id", "source").agg(F.count_if(F.col("k") == F.col("n")).alias("answered"), F.count_if((F.col("k") < F.col("n")) & (2 * F.col("k") >= F.col("n"))).alias("supporting"), F.max("k").alias("best"))


@query(None)
def spelling_suggestions(spark, sf):
    """Words of the questions and user turns, of any length, that no document has, with the likeliest word meant; see `suggestions`."""
    asked = read(spark, sf, "benchmark").select(F.explode(fx.tokens(F.col("text"))).alias("word"))
    users = read(spark, sf, "conversations").filter("role = 'user'").select(F.explode(fx.tokens(F.col("text"))).alias("word"))
    return ret.suggestions(asked.unionByName(users).distinct(), kept(ret.document_frequency(read(spark, sf, "documents")), "terms"))


@query("""WITH t AS (SELECT conv_id, turn, role, text, lag(text) OVER w AS one, lag(text, 2) OVER w AS two FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN length(text) < 60 AND one IS NOT NULL THEN concat(coalesce(two || ' ', ''), one, ' ', text) ELSE text END AS resolved FROM t""")
def followup_from_user_turns(spark, sf):
    """Short follow-up questions with the two user turns before them; what the assistant said is no context."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = read(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", "text", F.lag("text").over(w).alias("one"), F.lag("text", 2).over(w).alias("two"))
    short = (F.char_length("text") < 60) & F.col("one").isNotNull()
    return t.select("conv_id", "turn", F.when(short, F.concat_ws(" ", "two", "one", "text")).otherwise(F.col("text")).alias("resolved"))


#: Phrases of each direction, the longest reading first; a negation is part of its phrase.
COMPARED = [("(?i)not less than|no less than|not below|at least|minimum|not fewer than", ">="), ("(?i)not exceed|no more than|not more than|not above|at most|maximum|up to", "<="), ("(?i)less than|below|under", "<"), ("(?i)greater than|more than|above|exceeding", ">")]
REQUIRED = [("(?i)[0-9]+-[0-9]+ mm|between [0-9]", "range"), ("(?i)class [0-9]+", "category"), ("(?i)refer to|per (ASME|API)|see para", "cross-reference"), ("(?i) if | when | unless ", "conditional"), ("(?i)(not exceed|less than|at least|minimum|maximum).* of .*[0-9]", "relative limit"), ("(?i)(not exceed|less than|at least|minimum|maximum)", "numeric limit"), ("(?i)shall|must", "nominal"), ("[0-9]", "stated value")]

#: What every match of a pattern holds, in lower case.
_LIMITS = ("exceed", "less than", "at least", "minimum", "maximum")
COMPARED_ROOTS = {">=": ("less than", "below", "at least", "minimum", "fewer than"), "<=": ("exceed", "more than", "above", "at most", "maximum", "up to"), "<": ("less than", "below", "under"), ">": ("greater than", "more than", "above", "exceeding")}
REQUIRED_ROOTS = {"range": (" mm", "between "), "category": ("class ",), "cross-reference": ("refer to", "per asme", "per api", "see para"), "conditional": (" if ", " when ", " unless "), "relative limit": _LIMITS, "numeric limit": _LIMITS, "nominal": ("shall", "must")}


@query(f"WITH {_S} SELECT doc_id, page, {first_rule_sql('text', COMPARED)} AS way, {first_rule_sql('text', REQUIRED, 'none')} AS kind, {num.number_values_sql('text')}[1] AS value FROM s")
def comparators(spark, sf):
    """The direction, kind and first number of each statement; a negation is read with its phrase."""
    text = F.col("text")
    s = statements(spark, sf).select("doc_id", "page", "text", F.lower("text").alias("low"))
    way = first_rule(text, COMPARED, roots=COMPARED_ROOTS, low=F.col("low"))
    kind = first_rule(text, REQUIRED, "none", REQUIRED_ROOTS, F.col("low"))
    return s.select("doc_id", "page", way.alias("way"), kind.alias("kind"), F.get(num.number_values(text), F.lit(0)).alias("value"))


@query(f"""WITH {_S}, r AS (SELECT doc_id, page, value, {num.number_values_sql('text')} AS v FROM s WHERE regexp_matches(text, '[0-9]+-[0-9]+ mm'))
SELECT doc_id, page, v[1] AS lo, v[2] AS hi, (value * 1.5) AS stated, CASE WHEN value * 1.5 BETWEEN v[1] AND v[2] THEN 'meets' ELSE 'does not meet' END AS status FROM r""")
def range_findings(spark, sf):
    """Stated values against both bounds of a range."""
    v = num.number_values(F.col("text"))
    r = statements(spark, sf).filter(F.col("text").rlike("[0-9]+-[0-9]+ mm")).select("doc_id", "page", F.get(v, F.lit(0)).alias("lo"), F.get(v, F.lit(1)).alias("hi"), (F.col("value") * 1.5).alias("stated"))
    return r.withColumn("status", F.when(F.col("stated").between(F.col("lo"), F.col("hi")), "meets").otherwise("does not meet"))


@query("""WITH f AS (SELECT l_orderkey AS req_id, l_returnflag = 'R' AS failed, l_linestatus = 'F' AS undecided, CASE WHEN l_tax > 0.06 THEN 3 WHEN l_tax > 0.03 THEN 2 ELSE 1 END AS stored FROM lineitem)
SELECT req_id, max(greatest(stored, CASE WHEN failed THEN 2 WHEN undecided THEN 1 ELSE 0 END)) AS severity, count(*) FILTER (WHERE failed AND stored < 2) AS raised FROM f GROUP BY req_id""")
def severity_with_stored(spark, sf):
    """Severities as stored, raised to what the outcome asks for at least."""
    f = read(spark, sf, "lineitem").selectExpr("l_orderkey AS req_id", "l_returnflag = 'R' AS failed", "l_linestatus = 'F' AS undecided", "CASE WHEN l_tax > 0.06 THEN 3 WHEN l_tax > 0.03 THEN 2 ELSE 1 END AS stored")
    floor = F.when(F.col("failed"), 2).when(F.col("undecided"), 1).otherwise(0)
    return f.groupBy("req_id").agg(F.max(F.greatest("stored", floor)).alias("severity"), F.count_if(F.col("failed") & (F.col("stored") < 2)).alias("raised"))


@query("""WITH e AS (SELECT user_id, event_id, ts, md5(event_type) AS hash, lag(md5(event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, event_id, count(*) FILTER (WHERE before IS NULL OR before <> hash) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS edition FROM e""")
def snapshot_numbering(spark, sf):
    """Numbers of a book's snapshots, where consecutive ones with one hash share a number."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf, "events").select("user_id", "event_id", "ts", F.md5("event_type").alias("hash"))
    e = e.withColumn("before", F.lag("hash").over(w))
    new = F.col("before").isNull() | (F.col("before") != F.col("hash"))
    return e.select("user_id", "event_id", F.count(F.when(new, 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("edition"))
