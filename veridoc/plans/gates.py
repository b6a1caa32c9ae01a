"""Queries of query building, floors, measures of answers, registers of letters, blanks, assertions and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.rules import first_rule, first_rule_sql, found, found_sql
from ..operators import retrieval as ret
from ..sources.derived import QUESTIONS_SQL, STATEMENTS_SQL, questions, statements
from ..sources.tables import read

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_Q, _S = f"q AS {QUESTIONS_SQL}", f"s AS {STATEMENTS_SQL}"
LOWER = r"[x FOR x IN string_split_regex(lower(text), '[^\p{L}0-9]+') IF x <> '']"
#: Words of a question that ask for nothing.
ASKING = "^(what|which|how|is|are|the|a|an|of|and|to|on|in|do|does|you|have|say|says|about|many|with|it|too|for)$"
IDENTIFIED = "[A-Za-z]+ ?[0-9][A-Za-z0-9.-]*|[0-9]+[.][0-9]+"


@query(f"""WITH {_Q}, t AS (SELECT q_id, list_distinct(list_transform({found_sql('question', IDENTIFIED)}, lambda x: lower(x))) AS required, list_sort(list_distinct([w FOR w IN string_split_regex(lower(question), '[^a-z0-9.-]+') IF w <> '' AND NOT regexp_matches(w, '{ASKING}') AND NOT regexp_matches(w, '[0-9]')])) AS optional FROM q)
SELECT q_id, array_to_string(list_sort(required), ' AND ') AS required, array_to_string(optional, ' OR ') AS optional, len(required) = 0 AND len(optional) = 0 AS nothing FROM t""")
def match_terms(spark: SparkSession, sf: str) -> DataFrame:
    """What a question is matched by: its identifiers, all of them, and its other words, any of them."""
    q = F.col("question")
    required = F.array_sort(F.array_distinct(F.transform(found(q, IDENTIFIED), lambda x: F.lower(x))))
    words = F.filter(F.split(F.lower(q), "[^a-z0-9.-]+"), lambda w: (w != "") & ~w.rlike(ASKING) & ~w.rlike("[0-9]"))
    t = questions(spark, sf).select("q_id", required.alias("r"), F.array_sort(F.array_distinct(words)).alias("o"))
    return t.select("q_id", F.array_join("r", " AND ").alias("required"), F.array_join("o", " OR ").alias("optional"), ((F.size("r") == 0) & (F.size("o") == 0)).alias("nothing"))


@query(f"""WITH t AS (SELECT doc_id, ' ' || array_to_string({LOWER}, ' ') || ' ' AS body FROM documents), h AS (SELECT doc_id, contains(body, ' of the ') AS phrase, contains(body, ' of ')::INT + contains(body, ' the ')::INT AS words FROM t),
r AS (SELECT doc_id, phrase, words, row_number() OVER (ORDER BY phrase DESC, words DESC, doc_id) AS rank FROM h WHERE words > 0) SELECT doc_id, phrase, words, rank FROM r WHERE rank <= 50""")
def phrase_before_words(spark, sf):
    """Documents with the phrase ahead of those with its words alone, the first fifty."""
    body = F.concat(F.lit(" "), F.array_join(fx.tokens(F.col("text")), " "), F.lit(" "))
    has = lambda x: F.contains(F.col("body"), F.lit(x))
    h = read(spark, sf, "documents").select("doc_id", body.alias("body")).select("doc_id", has(" of the ").alias("phrase"), (has(" of ").cast("int") + has(" the ").cast("int")).alias("words"))
    order = [F.desc("phrase"), F.desc("words"), "doc_id"]
    top = h.filter("words > 0").orderBy(*order).limit(50)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


@query(f"""WITH t AS (SELECT source, {LOWER} AS toks FROM documents), q AS (SELECT DISTINCT unnest(list_distinct({LOWER})) AS term FROM benchmark), e AS (SELECT source, unnest(toks) AS term FROM t)
SELECT source, count(*) AS occurrences, count(DISTINCT e.term) AS terms FROM e JOIN q USING (term) GROUP BY source""")
def occurrences_in_scope(spark, sf):
    """How often the questions' words occur within each scope, and how many of them do."""
    q = read(spark, sf, "benchmark").select(F.explode(fx.tokens(F.col("text"))).alias("term")).distinct()
    e = read(spark, sf, "documents").select("source", F.explode(fx.tokens(F.col("text"))).alias("term"))
    counts = e.groupBy("source", "term").agg(F.count(F.lit(1)).alias("n")).join(q, "term")
    return counts.groupBy("source").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("terms"))


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round(4 * list_inner_product(embedding::DOUBLE[], e::DOUBLE[]) - 3, 6) AS score FROM embeddings, q), t AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT vec_id, score, rank, score >= -3.0 AS kept FROM t WHERE rank <= 16""")
def rerank_floor(spark, sf):
    """The sixteen best candidates by a second score, with those below the absolute floor marked as dropped."""
    e = read(spark, sf, "embeddings")
    asked = e.filter("vec_id = 0").select("embedding").first()["embedding"]
    score = F.round(4 * ret.dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in asked])) - 3, 6)
    order = [F.desc("score"), "vec_id"]
    top = e.select("vec_id", score.alias("score")).orderBy(*order).limit(16)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("kept", F.col("score") >= -3.0)


@query(f"""WITH {_Q}, n AS (SELECT q_id, lower(x) AS name FROM (SELECT q_id, unnest({found_sql('question', '[A-Z]+ [0-9]+|[A-Z][0-9]+-[0-9]+')}) AS x FROM q)), {_S}, d AS (SELECT DISTINCT lower(unnest({found_sql('text', '[A-Z]+ [0-9]+|[A-Z][0-9]+-[0-9]+')})) AS name FROM s)
SELECT q_id, count(*) AS named, count(d.name) AS present, CASE WHEN count(d.name) < count(*) THEN 'refuse: the subject named is absent' ELSE 'answer' END AS verdict FROM n LEFT JOIN d USING (name) GROUP BY q_id""")
def named_subject_gate(spark, sf):
    """Questions that name a standard, refused where no statement names it."""
    shape = "[A-Z]+ [0-9]+|[A-Z][0-9]+-[0-9]+"
    names = lambda df, key, c: df.select(*key, F.explode(F.transform(found(F.col(c), shape), lambda x: F.lower(x))).alias("name"))
    d = names(statements(spark, sf), [], "text").distinct().withColumn("_here", F.lit(True))
    g = names(questions(spark, sf), ["q_id"], "question").join(d, "name", "left").groupBy("q_id").agg(F.count(F.lit(1)).alias("named"), F.count("_here").alias("present"))
    return g.withColumn("verdict", F.when(F.col("present") < F.col("named"), "refuse: the subject named is absent").otherwise("answer"))


@query(f"""WITH t AS (SELECT conv_id, turn, role, list_distinct({LOWER}) AS ws FROM conversations), p AS (SELECT conv_id, turn, role, ws AS asked, lead(ws) OVER w AS answer, lead(role) OVER w AS next FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
m AS (SELECT conv_id, turn, len(asked) AS na, len(answer) AS nb, len(list_intersect(asked, answer)) AS shared FROM p WHERE role = 'user' AND next = 'assistant')
SELECT conv_id, turn, round(CASE WHEN nb = 0 THEN 0 ELSE shared / nb END, 6) AS precision, round(CASE WHEN na = 0 THEN 0 ELSE shared / na END, 6) AS recall, round(CASE WHEN na + nb = 0 THEN 0 ELSE 2 * shared / (na + nb) END, 6) AS f1 FROM m""")
def answer_measures(spark, sf):
    """Word precision, recall and their mean of each answer against its question."""
    t = read(spark, sf, "conversations").select("conv_id", "turn", "role", F.array_distinct(fx.tokens(F.col("text"))).alias("ws"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = t.withColumn("answer", F.lead("ws").over(w)).withColumn("next", F.lead("role").over(w)).filter("role = 'user' and next = 'assistant'")
    m = p.select("conv_id", "turn", F.size("ws").alias("na"), F.size("answer").alias("nb"), F.size(F.array_intersect("ws", "answer")).alias("both"))
    share = lambda n, d: F.round(F.when(d == 0, 0.0).otherwise(n / d), 6)
    both, na, nb = F.col("both"), F.col("na"), F.col("nb")
    return m.select("conv_id", "turn", share(both, nb).alias("precision"), share(both, na).alias("recall"), share(2 * both, na + nb).alias("f1"))


@query("""WITH v AS (SELECT l_suppkey % 5 AS variant, l_returnflag AS measure, avg(l_discount) AS score, count(*) FILTER (WHERE l_tax > 0.07 AND l_quantity > 49) AS forbidden FROM lineitem GROUP BY 1, 2),
b AS (SELECT measure, score AS base, forbidden AS base_forbidden FROM v WHERE variant = 0)
SELECT variant, count(*) FILTER (WHERE score < base - 1e-3) AS worse, sum(forbidden)::BIGINT AS forbidden, count(*) FILTER (WHERE score < base - 1e-3) = 0 AND sum(forbidden) <= sum(base_forbidden) AS passes FROM v JOIN b USING (measure) WHERE variant <> 0 GROUP BY variant""")
def variant_gate_forbidden(spark, sf):
    """Variants that pass: no measure worse than the first's, and no more forbidden answers."""
    l = read(spark, sf, "lineitem").withColumn("variant", F.col("l_suppkey") % 5)
    v = l.groupBy("variant", F.col("l_returnflag").alias("measure")).agg(F.avg("l_discount").alias("score"), F.count_if((F.col("l_tax") > 0.07) & (F.col("l_quantity") > 49)).alias("forbidden"))
    b = v.filter("variant = 0").select("measure", F.col("score").alias("base"), F.col("forbidden").alias("base_forbidden"))
    worse = F.count_if(F.col("score") < F.col("base") - 1e-3)
    g = v.filter("variant <> 0").join(F.broadcast(b), "measure").groupBy("variant").agg(worse.alias("worse"), F.sum("forbidden").alias("forbidden"), F.sum("base_forbidden").alias("base_forbidden"))
    return g.select("variant", "worse", "forbidden", ((F.col("worse") == 0) & (F.col("forbidden") <= F.col("base_forbidden"))).alias("passes"))


BLANKS = [("^ *$", "blank"), ("(?i)^ *(n/?a|nil|none|no|not applicable|not required) *[.]?$", "answer"), ("^[ *?_.-]+$", "placeholder"), ("(?i)^ *(later|tbn|tba|tbc|hold|by (vendor|others|contractor)|see note [0-9]+|note [0-9]+) *$", "placeholder"), ("(?i)(by vendor|to be advised|see note)", "deferred value")]


@query(f"""WITH {_S}, c AS (SELECT doc_id, page, CASE value % 9 WHEN 0 THEN NULL WHEN 1 THEN 'N/A' WHEN 2 THEN '--' WHEN 3 THEN 'by vendor' WHEN 4 THEN ' ' WHEN 5 THEN 'Not required.' ELSE text END AS cell FROM s)
SELECT doc_id, coalesce({first_rule_sql("coalesce(cell, '')", BLANKS)}, 'value') AS mark, count(*) AS n FROM c GROUP BY 1, 2""")
def blank_kinds(spark, sf):
    """Cells as blank, an answer of nothing, a placeholder, a deferred value or a value."""
    cell = F.expr("CASE value % 9 WHEN 0 THEN NULL WHEN 1 THEN 'N/A' WHEN 2 THEN '--' WHEN 3 THEN 'by vendor' WHEN 4 THEN ' ' WHEN 5 THEN 'Not required.' ELSE text END")
    c = statements(spark, sf).select("doc_id", F.coalesce(cell, F.lit("")).alias("cell"))
    return c.groupBy("doc_id", first_rule(F.col("cell"), BLANKS, "value").alias("mark")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_S}, w AS (SELECT doc_id, page, value, text, {LOWER} AS ws FROM s), t AS (SELECT *, list_sum(list_transform(ws, lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN length(x) ELSE ceil(length(x) / 4.0) END))::BIGINT AS tokens FROM w WHERE len(ws) > 0),
r AS (SELECT doc_id, page, tokens, sum(tokens) OVER (PARTITION BY doc_id ORDER BY page, value, text ROWS UNBOUNDED PRECEDING) AS run FROM t)
SELECT doc_id, count(*) FILTER (WHERE run <= 40) AS whole, count(*) FILTER (WHERE run > 40 AND run - tokens < 40) AS trimmed, count(*) FILTER (WHERE run - tokens >= 40) AS dropped, least(40, max(run))::BIGINT AS used FROM r GROUP BY doc_id""")
def budget_with_trim(spark, sf):
    """Lines that a budget of forty tokens holds whole, the one it trims, and those it drops; digits count each, words by four letters."""
    ws = fx.tokens(F.col("text"))
    size = F.aggregate(F.col("ws"), F.lit(0).cast("bigint"), lambda a, x: a + F.when(x.rlike("^[0-9]+$"), F.char_length(x)).otherwise(F.ceil(F.char_length(x) / 4.0)).cast("bigint"))
    t = statements(spark, sf).select("doc_id", "page", "value", "text", ws.alias("ws")).filter("size(ws) > 0").withColumn("tokens", size)
    w = Window.partitionBy("doc_id").orderBy("page", "value", "text").rowsBetween(Window.unboundedPreceding, 0)
    r = t.select("doc_id", "tokens", F.sum("tokens").over(w).alias("run"))
    before = F.col("run") - F.col("tokens")
    return r.groupBy("doc_id").agg(F.count_if(F.col("run") <= 40).alias("whole"), F.count_if((F.col("run") > 40) & (before < 40)).alias("trimmed"), F.count_if(before >= 40).alias("dropped"), F.least(F.lit(40), F.max("run")).cast("bigint").alias("used"))


ASSERTED = [("(?i)(waived|not required|need not)", "waiver"), ("(?i)(shall not|must not|not permitted|prohibited)", "prohibition"), ("(?i)(may|permitted|allowed)", "permission"), ("(?i)(shall|must|required)", "requirement")]


@query(f"""WITH {_S}, r AS (SELECT doc_id, {first_rule_sql('text', ASSERTED)} AS family FROM s), e AS (SELECT o_orderkey AS doc_id, CASE o_custkey % 4 WHEN 0 THEN 'waiver' WHEN 1 THEN 'prohibition' ELSE 'requirement' END AS evidence FROM orders)
SELECT evidence, family, count(*) AS n, CASE WHEN evidence = 'waiver' AND family = 'requirement' THEN 'suppressed' WHEN evidence = 'requirement' AND family = 'prohibition' THEN 'suppressed' WHEN evidence = family THEN 'supports' ELSE 'no bearing' END AS effect FROM r JOIN e USING (doc_id) WHERE family IS NOT NULL GROUP BY evidence, family""")
def assertion_effects(spark, sf):
    """Families of assertions against those of the evidence: which support, which suppress each other."""
    r = statements(spark, sf).select("doc_id", first_rule(F.col("text"), ASSERTED).alias("family")).filter("family is not null")
    e = read(spark, sf, "orders").selectExpr("o_orderkey AS doc_id", "CASE o_custkey % 4 WHEN 0 THEN 'waiver' WHEN 1 THEN 'prohibition' ELSE 'requirement' END AS evidence")
    is_ = lambda a, b: (F.col("evidence") == a) & (F.col("family") == b)
    effect = F.when(is_("waiver", "requirement") | is_("requirement", "prohibition"), "suppressed").when(F.col("evidence") == F.col("family"), "supports").otherwise("no bearing")
    return r.join(e, "doc_id").groupBy("evidence", "family").agg(F.count(F.lit(1)).alias("n")).withColumn("effect", effect)


@query("""WITH a AS (SELECT unnest(['1-URGENT', '2-HIGH', '9-NONE']) AS wanted) SELECT wanted, count(o_orderkey) AS n FROM a LEFT JOIN orders ON o_orderpriority = wanted AND o_totalprice > 200000 GROUP BY wanted""")
def parameter_join(spark, sf):
    """A list given as a parameter, joined with a condition of its own; what has no row stays."""
    wanted = spark.range(1).select(F.explode(F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "9-NONE")))).alias("wanted"))
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return wanted.join(o, (F.col("o_orderpriority") == F.col("wanted")) & (F.col("o_totalprice") > 200000), "left").groupBy("wanted").agg(F.count("o_orderkey").alias("n"))


@query("""WITH r AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderstatus = 'P' THEN 'escalate' WHEN o_orderpriority LIKE '1%' THEN 'remind' END AS action, date_trunc('week', o_orderdate) AS week FROM orders)
SELECT action, CAST(week AS DATE) AS week, count(*) AS due, count(DISTINCT o_custkey) AS sent FROM r WHERE action IS NOT NULL GROUP BY action, week""")
def weekly_reminders(spark, sf):
    """Reminders and escalations due in each week, of which one goes to each owner however often it is asked for."""
    action = F.when(F.col("o_orderstatus") == "P", "escalate").when(F.col("o_orderpriority").startswith("1"), "remind")
    r = read(spark, sf, "orders").select("o_custkey", action.alias("action"), F.date_trunc("week", "o_orderdate").cast("date").alias("week"))
    return r.filter("action is not null").groupBy("action", "week").agg(F.count(F.lit(1)).alias("due"), F.countDistinct("o_custkey").alias("sent"))
