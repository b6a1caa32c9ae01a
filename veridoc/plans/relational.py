"""Queries of the relational layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as rel
from ..sources import tables
from ..sources.tables import read

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in tables.NAMES))
def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tables.counts(spark, sf)


@query("SELECT c_custkey, left(c_name, 2) || '***' AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def masked_customers(spark, sf):
    return tables.masked(read(spark, sf, "customer"))


#: The scope that the scope queries grant: customers of one region's nations.
_GRANT = "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1"


def _grants(spark, sf):
    nations = read(spark, sf, "nation").filter("n_regionkey = 1")
    return read(spark, sf, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"))


@query(f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN ({_GRANT})")
def scope_semi(spark, sf):
    return rel.in_scope(read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), _grants(spark, sf), "o_custkey")


@query(f"SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM ({_GRANT}) g WHERE g.c_custkey = o.o_custkey)")
def scope_anti(spark, sf):
    return rel.out_of_scope(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), _grants(spark, sf), "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE 1 = 0)")
def empty_scope(spark, sf):
    nothing = read(spark, sf, "customer").filter(F.lit(False)).select(F.col("c_custkey").alias("o_custkey"))
    return rel.in_scope(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), nothing, "o_custkey")


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM (
  SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders o
  WHERE o_custkey IN (%s)) WHERE rn <= 25""" % _GRANT)
def scope_before_topk(spark, sf):
    scoped = rel.in_scope(read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), _grants(spark, sf), "o_custkey")
    return scoped.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0)")
def lifecycle_narrowing(spark, sf):
    bad = read(spark, sf, "labels").filter("quality = 0").select("doc_id")
    return read(spark, sf, "documents").select("doc_id").join(bad, "doc_id", "left_anti")


@query("""SELECT 'customer' AS kind, c_custkey AS id, c_name AS label FROM customer WHERE contains(lower(c_name), '00007') OR contains(lower(c_mktsegment), '00007')
UNION ALL SELECT 'part', p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring')
UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '0007')""")
def kinds_search(spark, sf):
    def hit(words, *cols):
        out = F.lit(False)
        for c in cols:
            out = out | F.lower(c).contains(words)
        return out

    c = read(spark, sf, "customer").filter(hit("00007", "c_name", "c_mktsegment")).select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("label"))
    p = read(spark, sf, "part").filter(hit("ring", "p_name", "p_type")).select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    s = read(spark, sf, "supplier").filter(hit("0007", "s_name")).select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"))
    return c.unionByName(p).unionByName(s)


@query("""SELECT n_name, r_name, count(*) AS n_customers, round(sum(c_acctbal), 2) AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE c_acctbal > 0 GROUP BY n_name, r_name""")
def inner_three_way(spark, sf):
    c = read(spark, sf, "customer").filter("c_acctbal > 0")
    n = read(spark, sf, "nation").join(F.broadcast(read(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n_customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""SELECT c_custkey, count(o_orderkey) AS n_orders, max(o_totalprice) AS largest FROM customer
LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey""")
def left_predicate_in_on(spark, sf):
    o = read(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey", "o_totalprice")
    per = o.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n_orders"), F.max("o_totalprice").alias("largest"))
    joined = read(spark, sf, "customer").select("c_custkey").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), "largest")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def join_parameter_list(spark, sf):
    wanted = F.from_json(F.lit('["1-URGENT", "2-HIGH"]'), "array<string>")
    return read(spark, sf, "orders").filter(F.array_contains(wanted, F.col("o_orderpriority"))).select("o_orderkey", "o_orderpriority")


#: Bands of order totals: fixed values (rule, lo, hi], a gap between 300000 and 350000.
_BANDS = [("small", 0.0, 50000.0), ("medium", 50000.0, 150000.0), ("large", 150000.0, 300000.0), ("exceptional", 350000.0, 1e12)]


@query("""WITH b(rule_id, lo, hi) AS (VALUES %s)
SELECT o_orderkey, o_totalprice, coalesce(rule_id, 'outside every row') AS rule_id FROM orders LEFT JOIN b ON o_totalprice > lo AND o_totalprice <= hi""" % ", ".join(f"('{r}', {lo}::DOUBLE, {hi}::DOUBLE)" for r, lo, hi in _BANDS))
def rule_bands(spark, sf):
    table = spark.createDataFrame(_BANDS, "rule_id string, lo double, hi double")
    out = rel.bands(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", table)
    return out.select("o_orderkey", "o_totalprice", F.coalesce("rule_id", F.lit("outside every row")).alias("rule_id"))


@query("""SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_per_user(spark, sf):
    e = read(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return rel.latest(e, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("""SELECT event_id, user_id, lag(event_type) OVER w AS previous_type, round(epoch(ts) - epoch(lag(ts) OVER w), 3) AS gap_s
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def previous_event(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = at / 1e6 - F.lag(at).over(w) / 1e6
    return e.select("event_id", "user_id", F.lag("event_type").over(w).alias("previous_type"), F.round(gap, 3).alias("gap_s"))


@query("""WITH d AS (SELECT l_partkey, l_orderkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT a.l_partkey, a.l_orderkey, a.o_orderdate AS as_of, b.edition FROM d a JOIN (
  SELECT x.l_partkey, x.o_orderdate, max(y.o_orderdate) AS edition FROM (SELECT DISTINCT l_partkey, o_orderdate FROM d) x
  LEFT JOIN (SELECT DISTINCT l_partkey, o_orderdate FROM d) y ON y.l_partkey = x.l_partkey AND y.o_orderdate < x.o_orderdate GROUP BY 1, 2) b
ON a.l_partkey = b.l_partkey AND a.o_orderdate = b.o_orderdate""")
def edition_as_of(spark, sf):
    l = read(spark, sf, "lineitem").select("l_partkey", "l_orderkey")
    dated = l.join(read(spark, sf, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = dated.select("l_partkey", "o_orderdate").distinct()
    before = days.withColumn("edition", F.lag("o_orderdate").over(Window.partitionBy("l_partkey").orderBy("o_orderdate")))
    return dated.join(before, ["l_partkey", "o_orderdate"]).select("l_partkey", "l_orderkey", F.col("o_orderdate").alias("as_of"), "edition")


@query("SELECT count(*) AS n, coalesce(round(sum(l_quantity), 2), 0) AS quantity, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem")
def global_totals(spark, sf):
    return read(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.round(F.sum("l_quantity"), 2), F.lit(0.0)).alias("quantity"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))


@query("""SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 200000) AS n_large,
  count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS n_pressing,
  round(sum(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice ELSE 0 END), 2) AS low_value FROM orders GROUP BY o_orderstatus""")
def conditional_counts(spark, sf):
    o = read(spark, sf, "orders")
    return o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("n_large"), F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("n_pressing"), F.round(F.sum(F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice")).otherwise(0.0)), 2).alias("low_value"))


@query("""SELECT CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_linestatus = 'O' THEN 'open' ELSE 'closed' END AS state, count(*) AS n, round(sum(l_extendedprice), 0) AS price
FROM lineitem GROUP BY 1""")
def group_remap(spark, sf):
    state = F.when(F.col("l_returnflag") == "R", "returned").when(F.col("l_linestatus") == "O", "open").otherwise("closed")
    return read(spark, sf, "lineitem").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 0).alias("price"))


@query("""WITH g AS (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1)
SELECT count(*) AS n_groups, coalesce(sum(n - 1), 0)::BIGINT AS surplus FROM g""")
def dup_surplus(spark, sf):
    g = read(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return g.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


@query("""SELECT o_custkey AS id, o_orderpriority AS worst, o_totalprice AS amount, 1::BIGINT AS n FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT o_custkey, min(o_orderpriority), max(o_totalprice), count(*) FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey""")
def grouped_union(spark, sf):
    o = read(spark, sf, "orders")
    single = o.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("worst"), F.col("o_totalprice").alias("amount"), F.lit(1).cast("bigint").alias("n"))
    grouped = o.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderpriority").alias("worst"), F.max("o_totalprice").alias("amount"), F.count(F.lit(1)).alias("n"))
    return single.unionByName(grouped)


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(spark, sf):
    return read(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS nations FROM nation GROUP BY n_regionkey")
def group_concat(spark, sf):
    return read(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ", ").alias("nations"))


def _rank_sql(share):
    return f"list_sort(list(value))[CAST(round_even({share} * (count(*) - 1), 0) AS INT) + 1]"


@query(f"SELECT event_type, count(*) AS n, {_rank_sql(0.5)} AS p50, {_rank_sql(0.95)} AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def stage_latency(spark, sf):
    return rel.nearest_ranks(read(spark, sf, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


@query("""SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5""")
def keep_last_n(spark, sf):
    return rel.keep_last(read(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", [F.desc("ts"), F.desc("event_id")], 5).drop("ts")


@query("""SELECT source, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'fr') AS fr,
 count(*) FILTER (WHERE lang = 'es') AS es, count(*) AS denominator FROM documents GROUP BY source""")
def corpus_inventory(spark, sf):
    d = read(spark, sf, "documents")
    return d.groupBy("source").agg(*(F.count_if(F.col("lang") == x).alias(x) for x in ("en", "de", "fr", "es")), F.count(F.lit(1)).alias("denominator"))


@query("SELECT regexp_extract(p_name, '^([a-z]+) ', 1) AS family, count(*) AS n FROM part GROUP BY 1")
def family_counts(spark, sf):
    return read(spark, sf, "part").groupBy(F.regexp_extract("p_name", "^([a-z]+) ", 1).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand, count(*) FILTER (WHERE p_size > 25) AS n, round(avg(CASE WHEN p_size > 25 THEN p_retailprice END), 4) AS mean_price FROM part GROUP BY p_brand")
def mean_with_count(spark, sf):
    some = F.when(F.col("p_size") > 25, F.col("p_retailprice"))
    return read(spark, sf, "part").groupBy("p_brand").agg(F.count(some).alias("n"), F.round(F.avg(some), 4).alias("mean_price"))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS spent FROM orders)
SELECT o_custkey, count(*) AS n_within, round(max(spent), 2) AS spent FROM s WHERE spent <= 500000 GROUP BY o_custkey""")
def capped_spend(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    s = read(spark, sf, "orders").select("o_custkey", F.sum("o_totalprice").over(w).alias("spent")).filter("spent <= 500000")
    return s.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_within"), F.round(F.max("spent"), 2).alias("spent"))


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) + 100 AS seq FROM orders""")
def sequence_per_scope(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, sf, "orders").select("o_orderkey", (F.row_number().over(w) + 100).cast("bigint").alias("seq"))


@query("""WITH u AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS retries FROM events GROUP BY user_id)
SELECT user_id, retries, least(3600, 5 * power(2, least(retries, 20)))::DOUBLE AS wait_s FROM u""")
def retry_backoff(spark, sf):
    u = read(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("retries"))
    return u.withColumn("wait_s", F.least(F.lit(3600.0), F.lit(5.0) * F.pow(F.lit(2.0), F.least(F.col("retries"), F.lit(20)))))


@query("""SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total FROM orders WHERE o_orderstatus = 'O'
ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40""")
def paged_orders_total(spark, sf):
    o = read(spark, sf, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice")
    return rel.page_of(o, [F.desc("o_totalprice"), F.col("o_orderkey")], 20, 40)


@query("SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 10")
def priority_queue(spark, sf):
    o = read(spark, sf, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return o.orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(10)


@query("""SELECT l_partkey, count(*) AS sentences, count(*) FILTER (WHERE rn <= 3) AS asked FROM (
  SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY (l_returnflag = 'R') DESC, (l_discount > 0.05) DESC, (l_quantity > 30) DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) GROUP BY l_partkey""")
def budgeted_ranking(spark, sf):
    w = Window.partitionBy("l_partkey").orderBy((F.col("l_returnflag") == "R").desc(), (F.col("l_discount") > 0.05).desc(), (F.col("l_quantity") > 30).desc(), "l_orderkey", "l_linenumber")
    ranked = read(spark, sf, "lineitem").select("l_partkey", F.row_number().over(w).alias("rn"))
    return ranked.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("sentences"), F.count_if(F.col("rn") <= 3).alias("asked"))


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0
UNION ALL SELECT o_orderkey, 'X', o_totalprice * 2 FROM orders WHERE o_orderkey % 7 = 0""")
def upsert_orders(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.filter("o_orderkey % 7 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return rel.upsert(o, new, ["o_orderkey"])


@query("""WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_linestatus = 'O')
SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, CASE WHEN a.l_partkey IS NOT NULL AND b.l_partkey IS NOT NULL THEN 'kept' WHEN a.l_partkey IS NOT NULL THEN 'superseded' ELSE 'added' END AS state
FROM a FULL OUTER JOIN b ON a.l_partkey = b.l_partkey""")
def supersession(spark, sf):
    l = read(spark, sf, "lineitem")
    return rel.supersede(l.filter("l_returnflag = 'R'"), l.filter("l_linestatus = 'O'"), "l_partkey")


@query("""WITH a AS (SELECT doc_id, sha256(text) AS token FROM documents WHERE doc_id % 5 <> 0),
b AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN sha256(upper(text)) ELSE sha256(text) END AS token FROM documents WHERE doc_id % 3 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.token IS NULL THEN 'drop' ELSE 'todo' END AS action FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id
WHERE a.token IS DISTINCT FROM b.token""")
def index_sync(spark, sf):
    d = read(spark, sf, "documents")
    old = d.filter("doc_id % 5 <> 0").select("doc_id", F.sha2("text", 256).alias("token"))
    new = d.filter("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.sha2(F.upper("text"), 256)).otherwise(F.sha2("text", 256)).alias("token"))
    return rel.changes(old, new, "doc_id", "token")


@query("SELECT event_id, CASE WHEN user_id % 10 = 0 THEN regexp_replace(props, '[0-9]+', '0', 'g') ELSE props END AS props FROM events")
def erase_payloads(spark, sf):
    return read(spark, sf, "events").select("event_id", F.when(F.col("user_id") % 10 == 0, F.regexp_replace("props", "[0-9]+", "0")).otherwise(F.col("props")).alias("props"))


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY event_type")
def json_props(spark, sf):
    k = F.from_json("props", "k bigint")["k"]
    return read(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"))


@query("SELECT p.p_partkey, p.p_brand, CASE WHEN count(l.l_partkey) > 0 THEN 'registered' ELSE 'missing' END AS state FROM part p LEFT JOIN lineitem l ON l.l_partkey = p.p_partkey AND l.l_returnflag = 'R' AND l.l_quantity > 45 GROUP BY p.p_partkey, p.p_brand")
def missing_expected(spark, sf):
    seen = read(spark, sf, "lineitem").filter("l_returnflag = 'R' and l_quantity > 45").select("l_partkey").distinct()
    p = read(spark, sf, "part").select("p_partkey", "p_brand").join(seen, F.col("p_partkey") == F.col("l_partkey"), "left")
    return p.select("p_partkey", "p_brand", F.when(F.col("l_partkey").isNotNull(), "registered").otherwise("missing").alias("state"))


@query("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def set_intersect(spark, sf):
    l = read(spark, sf, "lineitem")
    return l.filter("l_returnflag = 'R'").select("l_partkey").intersect(l.filter("l_returnflag = 'A'").select("l_partkey"))


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
def set_except(spark, sf):
    return read(spark, sf, "part").select("p_partkey").exceptAll(read(spark, sf, "lineitem").filter("l_quantity > 49").select("l_partkey").distinct())


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 0) AS price FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_rollup(spark, sf):
    return read(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 0).alias("price"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf):
    e = read(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL '30 minutes' THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf):
    e = read(spark, sf, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return e.select("user_id", F.col("w.start").alias("started"), "n")
