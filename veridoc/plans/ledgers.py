"""Queries of ledgers, gates and joins by range: which pages were read, which rules apply, which edition binds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import first_rule, first_rule_sql
from ..sources.derived import STATEMENTS_SQL, requirements, statements
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
#: Chunks of orders' documents: pages from the line's number on, as far as its quantity says.
_CHUNKS = ("l_orderkey AS doc_id", "l_partkey AS part", "l_linenumber AS page_start", "l_linenumber + cast(floor(l_quantity / 20) AS int) AS page_end")
_CHUNKS_SQL = f"(SELECT {', '.join(_CHUNKS)} FROM lineitem)"


def _chunks(spark, sf):
    return read(spark, sf, "lineitem").selectExpr(*_CHUNKS)


@query(f"SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (WHERE page_start <= 4 AND 4 <= page_end) AS on_page, count(*) FILTER (WHERE page_start BETWEEN 2 AND 5) AS starting FROM {_CHUNKS_SQL} GROUP BY doc_id")
def chunks_on_page(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of each document whose pages hold page 4, and those that start from page 2 to 5."""
    on = F.lit(4).between(F.col("page_start"), F.col("page_end"))
    return _chunks(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(on).alias("on_page"), F.count_if(F.col("page_start").between(2, 5)).alias("starting"))


@query(f"""WITH h AS {_CHUNKS_SQL}, e AS (SELECT o_orderkey AS doc_id, unnest([1 + o_custkey % 5, 2 + o_custkey % 7]) AS page FROM orders), g AS (SELECT DISTINCT doc_id, page FROM e),
m AS (SELECT h.doc_id, h.part, h.page_start, h.page_end, count(DISTINCT g.page) AS met FROM h JOIN g ON h.doc_id = g.doc_id AND g.page BETWEEN h.page_start AND h.page_end GROUP BY ALL)
SELECT doc_id, count(*) AS hits, max(met) AS most_pages FROM m GROUP BY doc_id""")
def page_overlaps(spark, sf):
    """Chunks whose page range holds an expected page of their document, and how many it holds at most."""
    e = read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.array_distinct(F.array(1 + F.col("o_custkey") % 5, 2 + F.col("o_custkey") % 7)).alias("pages"))
    met = F.size(F.filter("pages", lambda p: p.between(F.col("page_start"), F.col("page_end"))))
    hits = _chunks(spark, sf).distinct().join(e, "doc_id").select("doc_id", met.cast("bigint").alias("met")).filter("met > 0")
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"), F.max("met").alias("most_pages"))


@query("""WITH v AS (SELECT user_id, event_type, event_id, ts, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS superseded_at FROM events)
SELECT user_id, count(*) AS n_rows, count(*) FILTER (WHERE superseded_at IS NULL) AS live, max(event_id) FILTER (WHERE superseded_at IS NULL) AS newest FROM v GROUP BY user_id""")
def live_rows(spark, sf):
    """Rows of a user that nothing has superseded: the newest of each kind."""
    e = read(spark, sf, "events").select("user_id", "event_type", "event_id", "ts")
    # the newest row of a kind is found by a maximum, which combines before the shuffle
    newest = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("ts", "event_id")).alias("top"))
    return newest.groupBy("user_id").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("live"), F.max("top.event_id").alias("newest"))


_REQ = """(SELECT p_partkey AS req_id, CASE p_partkey % 8 WHEN 0 THEN concat('The size of the ', p_name, ' shall not exceed ', p_size, ' mm.') WHEN 1 THEN concat('The size shall be at least ', p_size, ' mm.') WHEN 2 THEN concat('The pressure shall be between ', p_size, ' and ', p_size + 10, ' bar.')
 WHEN 3 THEN concat('The vendor should supply ', p_type, ' drawings.') WHEN 4 THEN concat('The temperature shall be less than ', p_size, ' degF.') WHEN 5 THEN concat('The size shall be not less than ', p_size, ' cm.') WHEN 6 THEN concat('The housing shall be of ', p_name, ' type.') ELSE concat('Refer to ', p_brand, ', clause ', p_size, '.', p_size % 7, '.') END AS text FROM part)"""


@query(f"""WITH r AS {_REQ}, f AS (SELECT DISTINCT p_name AS field FROM part UNION SELECT DISTINCT 'size' FROM part), fw AS (SELECT field, unnest(list_distinct(string_split(lower(field), ' '))) AS word FROM f), n AS (SELECT field, count(*) AS n FROM fw GROUP BY field),
rw AS (SELECT req_id, unnest(list_distinct(string_split_regex(lower(text), '[^a-z0-9]+'))) AS word FROM r), h AS (SELECT req_id, field, count(*) AS k FROM rw JOIN fw USING (word) GROUP BY req_id, field)
SELECT req_id, field FROM h JOIN n USING (field) WHERE k = n""")
def containment_join(spark, sf):
    """Requirements with the fields all of whose words they hold: each field meets them on its rarest word."""
    p = read(spark, sf, "part")
    fields = p.select(F.col("p_name").alias("field")).unionByName(p.select(F.lit("size").alias("field"))).distinct()
    fields = fields.select("field", F.array_distinct(F.split(F.lower("field"), " ")).alias("words"))
    texts = requirements(spark, sf).select("req_id", F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+")).alias("held"))
    return fields_held(texts, fields)


#: Fields up to which they are sent to the requirements; beyond, both are shuffled by the word on which they meet.
BROADCAST_FIELDS = 50_000


def fields_held(texts: DataFrame, fields: DataFrame, most: int | None = None) -> DataFrame:
    """req_id and field where `held` of `texts` (req_id, held) has all `words` of `fields` (field, words).

    A field meets a requirement once, on that word of its own that the fewest requirements hold, and its other words are looked
    up there. Requirements are never the side that is sent whole.
    """
    rw = texts.select("req_id", "held", F.explode("held").alias("word"))
    often = rw.groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    fw = fields.select("field", "words", F.explode("words").alias("word")).join(often.hint("merge"), "word", "left")
    keyed = fw.groupBy("field", "words").agg(F.min_by("word", F.struct(F.coalesce("often", F.lit(0)), "word")).alias("word"))
    few = fields.count() <= (BROADCAST_FIELDS if most is None else most)
    met = rw.join(keyed.hint("broadcast" if few else "merge"), "word")
    return met.filter(F.size(F.array_except("words", "held")) == 0).select("req_id", "field")


@query("""WITH p AS (SELECT o_orderkey AS doc_id, unnest(range(1, 2 + o_custkey % 7)) AS page, 1 AS planned FROM orders WHERE o_custkey % 11 <> 0), l AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, min(CASE WHEN l_returnflag = 'A' THEN 'listed' WHEN l_linestatus = 'O' THEN 'read' ELSE 'unaccounted' END) AS state FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 11 <> 0 GROUP BY 1, 2),
u AS (SELECT coalesce(p.doc_id, l.doc_id) AS doc_id, coalesce(state, 'unaccounted') AS state FROM p FULL JOIN l ON p.doc_id = l.doc_id AND p.page = l.page),
g AS (SELECT o_orderkey AS doc_id, o_orderstatus <> 'P' AS vectors, count(u.doc_id) AS n, count(*) FILTER (WHERE state = 'read') AS r, count(*) FILTER (WHERE state = 'listed') AS li, count(*) FILTER (WHERE state = 'unaccounted') AS un FROM orders LEFT JOIN u ON o_orderkey = u.doc_id GROUP BY 1, 2)
SELECT doc_id, CASE WHEN n > 0 THEN n END AS pages_total, CASE WHEN n > 0 THEN r END AS pages_read, li AS not_read_listed, CASE WHEN n > 0 THEN un ELSE 1 END AS unaccounted, vectors AND n > 0 AND un = 0 AS ready, vectors AND n > 0 AND un = 0 AND li = 0 AS fully_read FROM g""")
def page_ledger(spark, sf):
    """Pages of each document as read, listed or unaccounted for; a document of which no page is known is unaccounted for itself."""
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey", (F.col("o_orderstatus") != "P").alias("vectors"))
    known = o.filter("o_custkey % 11 <> 0")
    p = known.select("doc_id", F.explode(F.sequence(F.lit(1), (1 + F.col("o_custkey") % 7).cast("int"))).alias("page"))
    state = F.when(F.col("l_returnflag") == "A", "listed").when(F.col("l_linestatus") == "O", "read").otherwise("unaccounted")
    l = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), state.alias("state")).join(known.select("doc_id"), "doc_id", "left_semi")
    pages = p.join(l.groupBy("doc_id", "page").agg(F.min("state").alias("state")), ["doc_id", "page"], "full_outer")
    pages = pages.select("doc_id", F.coalesce("state", F.lit("unaccounted")).alias("state"))
    count = lambda s: F.count_if(F.col("state") == s)
    g = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), count("read").alias("r"), count("listed").alias("li"), count("unaccounted").alias("un"))
    g = o.join(g, "doc_id", "left").fillna(0, ["li"])
    ready = F.coalesce(F.col("vectors") & (F.col("un") == 0), F.lit(False))
    return g.select(
        "doc_id", F.col("n").alias("pages_total"), F.col("r").alias("pages_read"), F.col("li").alias("not_read_listed"), F.coalesce("un", F.lit(1)).alias("unaccounted"),
        ready.alias("ready"), (ready & (F.col("li") == 0)).alias("fully_read"))


#: Rows of statements that one task joins and counts at once.
ROWS_A_TASK = 400_000
SCOPE = [("(?i)does not apply to .*pump", "excluded"), ("(?i)existing", "existing only"), ("P-[0-9]+", "pump"), ("(?i)flange|valve|lug", "other equipment"), ("[0-9]+ ?(-|to) ?[0-9]+ mm", "size range")]


@query(f"""WITH {_S}, k AS (SELECT doc_id, value, {first_rule_sql('text', SCOPE)} AS limited, regexp_extract(text, '([0-9]+)-([0-9]+) mm', 1) AS lo, regexp_extract(text, '([0-9]+)-([0-9]+) mm', 2) AS hi FROM s WHERE text <> ''), a AS (SELECT o_orderkey AS doc_id, (o_custkey % 60)::INT AS size FROM orders)
SELECT doc_id, value, CASE WHEN limited = 'excluded' THEN 'not applicable' WHEN limited = 'pump' THEN 'include' WHEN limited = 'other equipment' THEN 'not applicable' WHEN limited = 'size range' AND NOT size BETWEEN lo::INT AND hi::INT THEN 'not applicable' WHEN limited = 'size range' THEN 'include' WHEN limited = 'existing only' THEN 'candidate' WHEN limited IS NULL THEN 'candidate' ELSE 'unknown' END AS applies, count(*) AS n FROM k JOIN a USING (doc_id) GROUP BY 1, 2, 3""")
def applicability(spark, sf):
    """Whether a rule applies to a pump of the order's size: by equipment and by a whole size range outside; generic rules are candidates."""
    range_ = "([0-9]+)-([0-9]+) mm"
    bound = lambda i: F.regexp_extract("text", range_, i).try_cast("int")
    # rows are narrow and alike, so tasks are dealt out by the number of rows: by their compressed size a task would get millions
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-read(spark, sf, "lineitem").count() // ROWS_A_TASK))
    k = statements(spark, sf).filter("text <> ''").select("doc_id", "value", first_rule(F.col("text"), SCOPE).alias("limited"), bound(1).alias("lo"), bound(2).alias("hi")).repartition(parts, "doc_id")
    a = read(spark, sf, "orders").selectExpr("o_orderkey AS doc_id", "int(o_custkey % 60) AS size")
    inside = F.col("size").between(F.col("lo"), F.col("hi"))
    limited = F.col("limited")
    applies = F.when(limited.isin("excluded", "other equipment"), "not applicable").when(limited == "pump", "include").when((limited == "size range") & ~inside, "not applicable").when(limited == "size range", "include").when(limited.isNull() | (limited == "existing only"), "candidate").otherwise("unknown")
    return k.join(a, "doc_id").groupBy("doc_id", "value", applies.alias("applies")).agg(F.count(F.lit(1)).alias("n"))


KINDS = [("(?i)set pressure|barg|rated speed", "datasheet"), ("(?i)shall|must", "specification"), ("(?i)list|drawing|^P-", "list")]


@query(f"""WITH {_S}, k AS (SELECT doc_id, {first_rule_sql('text', KINDS)} AS kind FROM s), c AS (SELECT doc_id, kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY doc_id, kind),
r AS (SELECT doc_id, count(*) AS kinds, max(n) AS most, arg_max(kind, n * 1000 - ascii(kind)) AS kind, sum(n) AS n FROM c GROUP BY doc_id), d AS (SELECT doc_id, CASE WHEN kinds = 1 OR most >= 3 AND most > 0.6 * n THEN kind END AS kind, kinds > 1 AS guess FROM r)
SELECT o_orderkey AS doc_id, kind, CASE WHEN kind IS NOT NULL AND kind <> 'datasheet' AND (o_orderstatus = 'F' OR NOT guess) THEN 'blocked' ELSE 'applied' END AS rules,
 CASE WHEN kind IS NULL THEN 'kind not decided; rules kept' WHEN kind <> 'datasheet' AND guess AND o_orderstatus <> 'F' THEN 'kind is a guess; rules kept' END AS mark FROM orders LEFT JOIN d ON o_orderkey = doc_id""")
def kind_gate(spark, sf):
    """A paper's kind by its signals, undecided where these conflict, and whether the equipment rules run: a known other kind blocks them, a guess does not."""
    k = statements(spark, sf).select("doc_id", first_rule(F.col("text"), KINDS).alias("kind")).filter("kind is not null")
    c = k.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    r = c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kinds"), F.max("n").alias("most"), F.max_by("kind", F.col("n") * 1000 - F.ascii("kind")).alias("kind"), F.sum("n").alias("n"))
    sure = (F.col("kinds") == 1) | ((F.col("most") >= 3) & (F.col("most") > 0.6 * F.col("n")))
    d = r.select("doc_id", F.when(sure, F.col("kind")).alias("kind"), (F.col("kinds") > 1).alias("guess"))
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderstatus") == "F").alias("confirmed")).join(d, "doc_id", "left")
    other = F.col("kind").isNotNull() & (F.col("kind") != "datasheet")
    rules = F.when(other & (F.col("confirmed") | ~F.col("guess")), "blocked").otherwise("applied")
    mark = F.when(F.col("kind").isNull(), "kind not decided; rules kept").when(other & F.col("guess") & ~F.col("confirmed"), "kind is a guess; rules kept")
    return o.select("doc_id", "kind", rules.alias("rules"), mark.alias("mark"))


@query("""WITH r AS (SELECT p_type AS equipment, p_brand AS standard, p_partkey % 4 AS scope FROM part)
SELECT equipment, count(*) FILTER (WHERE scope <> 3) AS in_scope, count(*) FILTER (WHERE scope = 3) AS left_out, count(DISTINCT standard) FILTER (WHERE scope = 3) AS standards_left_out FROM r GROUP BY equipment""")
def equipment_scope(spark, sf):
    """Rules in scope of each equipment, and those of other equipment, which are left out and counted."""
    r = read(spark, sf, "part").select(F.col("p_type").alias("equipment"), F.col("p_brand").alias("standard"), (F.col("p_partkey") % 4 == 3).alias("other"))
    return r.groupBy("equipment").agg(F.count_if(~F.col("other")).alias("in_scope"), F.count_if("other").alias("left_out"), F.countDistinct(F.when(F.col("other"), F.col("standard"))).alias("standards_left_out"))


@query(f"""WITH {_S}, h AS (SELECT doc_id, sha256(text) AS hash, page FROM s WHERE text <> ''), v AS (SELECT hash, min(doc_id * 100 + page) AS provenance, count(*) AS ingested FROM h GROUP BY hash), old AS (SELECT DISTINCT hash FROM h WHERE doc_id % 4 = 0)
SELECT count(*) AS versions, sum(ingested)::BIGINT AS ingested, count(*) FILTER (WHERE o.hash IS NULL) AS added, count(DISTINCT provenance) AS provenances FROM v LEFT JOIN old o USING (hash)""")
def rule_ingest(spark, sf):
    """What ingesting rules again adds: versions by their content, those that were not there before, and their provenance."""
    h = statements(spark, sf).filter("text <> ''").select("doc_id", F.sha2("text", 256).alias("hash"), "page")
    v = h.groupBy("hash").agg(F.min(F.col("doc_id") * 100 + F.col("page")).alias("provenance"), F.count(F.lit(1)).alias("ingested"), F.max(F.col("doc_id") % 4 == 0).alias("known"))
    return v.agg(F.count(F.lit(1)).alias("versions"), F.sum("ingested").alias("ingested"), F.count_if(~F.col("known")).alias("added"), F.countDistinct("provenance").alias("provenances"))


_EDITIONS = ("p_brand AS family", "p_partkey AS edition", "CASE WHEN p_partkey % 40 = 7 THEN NULL ELSE 1990 + p_partkey % 10 END AS year", "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 1 + p_partkey % 12 END AS month")


@query(f"""WITH e AS (SELECT {', '.join(_EDITIONS)} FROM part), d AS (SELECT family, edition, make_date(year, coalesce(month, 1), 1) AS first, CASE WHEN month IS NULL THEN make_date(year, 12, 31) ELSE (make_date(year, month, 1) + INTERVAL 1 MONTH - INTERVAL 1 DAY)::DATE END AS last FROM e WHERE year IS NOT NULL),
x AS (SELECT DISTINCT p_brand AS family, DATE '1996-06-15' AS cutoff FROM part), u AS (SELECT family, count(*) AS undated FROM e WHERE year IS NULL GROUP BY family),
g AS (SELECT x.family, count(*) FILTER (WHERE last <= cutoff) AS in_time, count(*) FILTER (WHERE first <= cutoff AND last > cutoff) AS straddling, max(last) FILTER (WHERE last <= cutoff) AS newest FROM x LEFT JOIN d USING (family) GROUP BY x.family),
b AS (SELECT g.family, min(edition) FILTER (WHERE last = newest) AS edition, min(first) FILTER (WHERE last = newest) AS begins, count(*) FILTER (WHERE last = newest) AS at_newest FROM g JOIN d USING (family) GROUP BY g.family),
o AS (SELECT b.family, count(*) FILTER (WHERE d.last <= newest AND d.last >= begins) AS overlapping FROM b JOIN d USING (family) JOIN g USING (family) GROUP BY b.family)
SELECT g.family, CASE WHEN undated > 0 THEN 'needs engineer: undated edition' WHEN straddling > 0 THEN 'needs engineer: date too coarse' WHEN coalesce(in_time, 0) = 0 THEN 'needs engineer: none in time' WHEN overlapping > 1 THEN 'needs engineer: overlapping dates' ELSE 'picked' END AS outcome,
 CASE WHEN undated IS NULL AND straddling = 0 AND in_time > 0 AND overlapping = 1 THEN edition END AS edition FROM g LEFT JOIN u USING (family) LEFT JOIN b USING (family) LEFT JOIN o USING (family)""")
def edition_pick(spark, sf):
    """The edition of each family that a cutoff day binds: the latest whose last day is not after it; dates that do not tell need an engineer."""
    e = read(spark, sf, "part").selectExpr(*_EDITIONS)
    cutoff = F.lit("1996-06-15").cast("date")
    first = F.make_date("year", F.coalesce("month", F.lit(1)), F.lit(1))
    last = F.when(F.col("month").isNull(), F.make_date("year", F.lit(12), F.lit(31))).otherwise(F.last_day(F.make_date("year", "month", F.lit(1))))
    d = e.select("family", "edition", F.when(F.col("year").isNotNull(), first).alias("first"), F.when(F.col("year").isNotNull(), last).alias("last"))
    in_time = F.col("last") <= cutoff
    newest = F.max_by(F.struct("first", "last", "edition"), F.struct("last", -F.col("edition")))
    g = d.groupBy("family").agg(
        F.count_if(F.col("last").isNull()).alias("undated"), F.count_if((F.col("first") <= cutoff) & ~in_time).alias("straddling"), F.count_if(in_time).alias("in_time"),
        F.max_by(F.when(in_time, F.struct("first", "last", "edition")), F.when(in_time, F.struct("last", -F.col("edition")))).alias("best"), F.min(F.when(in_time, F.struct("last", "first"))).alias("low"))
    span = d.join(g.select("family", "best"), "family").filter(in_time & (F.col("last") >= F.col("best.first")) & (F.col("last") <= F.col("best.last")))
    o = span.groupBy("family").agg(F.count(F.lit(1)).alias("overlapping"))
    j = g.join(o, "family", "left")
    outcome = F.when(F.col("undated") > 0, "needs engineer: undated edition").when(F.col("straddling") > 0, "needs engineer: date too coarse").when(F.col("in_time") == 0, "needs engineer: none in time").when(F.col("overlapping") > 1, "needs engineer: overlapping dates").otherwise("picked")
    return j.withColumn("outcome", outcome).select("family", "outcome", F.when(F.col("outcome") == "picked", F.col("best.edition")).alias("edition"))


@query("""WITH f AS (SELECT l_orderkey AS run_id, CASE WHEN l_returnflag = 'R' THEN 'fail' ELSE 'pass' END AS status, l_linenumber % 4 = 1 AS checklist, l_suppkey % 2 = 0 AS compared FROM lineitem)
SELECT run_id, CASE WHEN status = 'pass' AND checklist AND NOT compared THEN 'stated' ELSE status END AS status, count(*) AS n FROM f GROUP BY 1, 2""")
def presence_check(spark, sf):
    """Findings per status, where a pass of a checklist that compared nothing counts as stated, not as a pass."""
    f = read(spark, sf, "lineitem").selectExpr("l_orderkey AS run_id", "CASE WHEN l_returnflag = 'R' THEN 'fail' ELSE 'pass' END AS status", "l_linenumber % 4 = 1 AS checklist", "l_suppkey % 2 = 0 AS compared")
    stated = (F.col("status") == "pass") & F.col("checklist") & ~F.col("compared")
    return f.groupBy("run_id", F.when(stated, "stated").otherwise(F.col("status")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT c_custkey, concat('A ', 216 + c_nationkey, ' Gr ', left(c_mktsegment, 2)) AS printed FROM customer), k AS (SELECT c_custkey, upper(regexp_replace(printed, '[^A-Za-z0-9]', '', 'g')) AS key FROM g),
d AS (SELECT concat('A', 216 + s_nationkey) AS spec, CASE WHEN s_acctbal < 2000 THEN 'carbon steel' WHEN s_acctbal < 6000 THEN 'stainless' ELSE 'duplex' END AS family, s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0), l AS (SELECT spec, arg_max(family, s_suppkey) AS family FROM d GROUP BY spec)
SELECT c_custkey, key, family, family = 'duplex' AS forbidden FROM k LEFT JOIN l ON left(key, 4) = spec""")
def material_families(spark, sf):
    """Materials' families by the latest signed decision on their specification, and whether the family is forbidden."""
    printed = F.expr("concat('A ', 216 + c_nationkey, ' Gr ', left(c_mktsegment, 2))")
    k = read(spark, sf, "customer").select("c_custkey", F.upper(F.regexp_replace(printed, "[^A-Za-z0-9]", "")).alias("key"))
    d = read(spark, sf, "supplier").filter("s_suppkey % 3 <> 0").selectExpr("concat('A', 216 + s_nationkey) AS spec", "CASE WHEN s_acctbal < 2000 THEN 'carbon steel' WHEN s_acctbal < 6000 THEN 'stainless' ELSE 'duplex' END AS family", "s_suppkey")
    latest = d.groupBy("spec").agg(F.max_by("family", "s_suppkey").alias("family"))
    j = k.withColumn("spec", F.left("key", F.lit(4))).join(latest, "spec", "left")
    return j.select("c_custkey", "key", "family", (F.col("family") == "duplex").alias("forbidden"))


@query(f"""WITH {_S}, old AS (SELECT DISTINCT doc_id, page, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS folded, doc_id % 3 = 0 AS confirmed, value % 4 = 0 AS same_id FROM s WHERE text <> ''), new AS (SELECT DISTINCT doc_id, page, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS folded FROM s WHERE value % 5 <> 0),
j AS (SELECT o.*, n.folded IS NOT NULL AS found FROM old o LEFT JOIN new n ON o.doc_id = n.doc_id AND o.page = n.page AND o.folded = n.folded AND length(o.folded) >= 12)
SELECT CASE WHEN same_id AND found THEN 'same chunk' WHEN found THEN 'reattached' WHEN NOT confirmed THEN 'superseded' ELSE 'unlinked' END AS outcome, count(*) AS n FROM j GROUP BY 1""")
def rechunk_links(spark, sf):
    """What becomes of rows whose chunks were cut anew: by the same chunk, by the same folded sentence on the page, superseded or unlinked."""
    folded = F.regexp_replace(F.lower("text"), "[^a-z0-9]", "")
    s = statements(spark, sf).select("doc_id", "page", "value", "text", folded.alias("folded"))
    old = s.filter("text <> ''").select("doc_id", "page", "folded", (F.col("doc_id") % 3 == 0).alias("confirmed"), (F.col("value") % 4 == 0).alias("same_id")).distinct()
    new = s.filter("value % 5 <> 0 and char_length(folded) >= 12").select("doc_id", "page", "folded", F.lit(True).alias("_found")).distinct()
    j = old.join(new, ["doc_id", "page", "folded"], "left").withColumn("found", F.col("_found").isNotNull())
    outcome = F.when(F.col("same_id") & F.col("found"), "same chunk").when(F.col("found"), "reattached").when(~F.col("confirmed"), "superseded").otherwise("unlinked")
    return j.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT user_id, 1 AS step, 'seen' AS name, count(*) AS n FROM events GROUP BY user_id UNION ALL SELECT user_id, 2, 'valued', count(*) FILTER (WHERE value > 0) FROM events GROUP BY user_id UNION ALL SELECT user_id, 3, 'bought', count(*) FILTER (WHERE event_type = 'purchase') FROM events GROUP BY user_id)
SELECT user_id, step, name, n, lag(n) OVER w - n AS dropped, (sum(n) OVER w)::BIGINT AS running FROM s WINDOW w AS (PARTITION BY user_id ORDER BY step)""")
def run_trace(spark, sf):
    """The steps of each run in order, with what each dropped and the running total."""
    e = read(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("value") > 0).alias("valued"), F.count_if(F.col("event_type") == "purchase").alias("bought"))
    steps = F.array(*(F.struct(F.lit(i + 1).alias("step"), F.lit(c).alias("name"), F.col(c).alias("n")) for i, c in enumerate(("seen", "valued", "bought"))))
    w = Window.partitionBy("user_id").orderBy("step")
    s = e.select("user_id", F.inline(steps))
    return s.select("user_id", "step", "name", "n", (F.lag("n").over(w) - F.col("n")).alias("dropped"), F.sum("n").over(w).alias("running"))


@query("""WITH a AS (SELECT l_orderkey AS doc_id, count(*) AS screen FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey AS doc_id, count(*) AS store FROM lineitem WHERE l_quantity > 1 GROUP BY 1), c AS (SELECT l_orderkey AS doc_id, count(DISTINCT l_linenumber) AS file FROM lineitem GROUP BY 1)
SELECT doc_id, screen, coalesce(store, 0) AS store, file, screen = coalesce(store, 0) AND screen = file AS complete FROM a LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)""")
def three_way_counts(spark, sf):
    """Rows of a document on the screen, in the store and in the file, and whether the three agree."""
    g = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count(F.lit(1)).alias("screen"), F.count_if(F.col("l_quantity") > 1).alias("store"), F.countDistinct("l_linenumber").alias("file"))
    return g.withColumn("complete", (F.col("screen") == F.col("store")) & (F.col("screen") == F.col("file")))
