"""Queries of text quality, cleaning, chunks and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import text as op
from ..sources.pages import html_text as text_of_html
from ..sources.tables import read

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


WHITE = r"[x FOR x IN string_split_regex(text, '[ \t\r\n]+') IF x <> '']"
LOWER = r"[x FOR x IN string_split_regex(lower(text), '[^\p{L}0-9]+') IF x <> '']"
#: Items' grams (two longs each) up to which they are broadcast.
BROADCAST_GRAMS = 1_000_000
_CORE = r"regexp_replace({x}, '^[^\p{{L}}0-9]+|[^\p{{L}}0-9]+$', '', 'g')"
_IS_WORD = rf"(regexp_matches({_CORE.format(x='x')}, '^\p{{L}}[\p{{L}}''-]*\p{{L}}$') AND regexp_matches(lower({_CORE.format(x='x')}), '[aeiouyàâäéèêëíîïóôöúùûüáñ]'))"
#: The longest run of true: flags become a string of 1s and 0s, whose longest piece of 1s it is.
_RUN = "coalesce(list_max([len(y) FOR y IN string_split(array_to_string([CASE WHEN {w} THEN '1' ELSE '0' END FOR x IN toks], ''), '0')]), 0)".format(w=_IS_WORD)
_QUALITY = f"""b AS (SELECT doc_id, text, {WHITE} AS toks FROM documents),
s AS (SELECT doc_id, len(toks) AS n, len([x FOR x IN toks IF regexp_matches(x, '^[0-9][0-9.,%]*$')]) AS num,
 len([x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '^[^:|]{{1,40}} : .+$') OR regexp_matches(x, '\\|.*\\|')]) AS rws, {_RUN} AS clause FROM b),
k AS (SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN rws >= 2 OR (num >= 6 AND num >= 0.7 * n) THEN 'table' ELSE 'prose' END AS kind FROM s),
g AS (SELECT doc_id, kind, clause, CASE WHEN kind = 'empty' THEN 'empty' WHEN kind = 'prose' AND clause < CASE WHEN n <= 12 THEN 3 ELSE 6 END THEN 'no clause' END AS reason FROM k)"""


@query(f"WITH {_QUALITY} SELECT doc_id, kind, clause, reason IS NULL AS ok, reason FROM g")
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    return op.quality(read(spark, sf, "documents"))


@query(f"WITH {_QUALITY} SELECT coalesce(reason, 'kept') AS rule, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM g JOIN documents USING (doc_id) GROUP BY 1")
def exclusion_ledger(spark, sf):
    docs = read(spark, sf, "documents")
    g = op.quality(docs.select("doc_id", "text")).select("doc_id", F.coalesce("reason", F.lit("kept")).alias("rule"))
    return g.join(docs.select("doc_id", "n_chars"), "doc_id").groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(f"WITH {_QUALITY} SELECT quality, reason IS NULL AS ok, count(*) AS n FROM g JOIN labels USING (doc_id) GROUP BY 1, 2")
def gate_vs_labels(spark, sf):
    g = op.quality(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "ok")
    return g.join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id").groupBy("quality", "ok").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH c AS (SELECT doc_id, length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) AS letters, length(text) - length(regexp_replace(text, '[\x{0600}-\x{06FF}]', '', 'g')) AS arabic,
 length(text) - length(regexp_replace(text, '[\x{00C0}-\x{024F}]', '', 'g')) AS accented FROM documents)
SELECT doc_id, letters, arabic, accented, letters >= 20 AND arabic > 0.5 * letters AS unsupported FROM c""")
def script_share(spark, sf):
    t = F.col("text")
    c = read(spark, sf, "documents").select("doc_id", fx.count_chars(t, r"\p{L}").alias("letters"), fx.count_chars(t, r"[؀-ۿ]").alias("arabic"), fx.count_chars(t, r"[À-ɏ]").alias("accented"))
    return c.withColumn("unsupported", (F.col("letters") >= 20) & (F.col("arabic") > 0.5 * F.col("letters")))


@query(rf"""WITH b AS (SELECT doc_id, {WHITE} AS toks FROM documents)
SELECT doc_id, round(len([x FOR x IN toks IF regexp_matches(x, '[=+^<>±×÷√∑]') OR regexp_matches(x, '^([a-z][0-9]|[0-9][a-z])$')]) / greatest(len(toks), 1), 6) AS density FROM b""")
def equation_density(spark, sf):
    b = read(spark, sf, "documents").select("doc_id", fx.white_tokens(F.col("text")).alias("toks"))
    marked = F.filter("toks", lambda x: x.rlike("[=+^<>±×÷√∑]") | x.rlike("^([a-z][0-9]|[0-9][a-z])$"))
    return b.select("doc_id", F.round(F.size(marked) / F.greatest(F.size("toks"), F.lit(1)), 6).alias("density"))


@query(f"""WITH b AS (SELECT doc_id, {WHITE} AS toks FROM documents),
w AS (SELECT doc_id, toks, unnest(range(0, 1 + greatest(0, ceil((len(toks) - 300) / 240.0))::BIGINT)) AS ordinal FROM b WHERE len(toks) > 0)
SELECT doc_id, ordinal, ordinal * 240 AS first, len(toks[ordinal * 240 + 1 : ordinal * 240 + 300]) AS n_tokens,
 doc_id::VARCHAR || ':c' || lpad(ordinal::VARCHAR, 5, '0') || ':' || left(sha256(array_to_string(toks[ordinal * 240 + 1 : ordinal * 240 + 300], ' ')), 8) AS chunk_id FROM w""")
def chunk_windows(spark, sf):
    c = op.token_windows(read(spark, sf, "documents"))
    return c.select("doc_id", "ordinal", "first", "n_tokens", op.chunk_id(F.col("doc_id"), F.col("ordinal"), F.col("chunk")).alias("chunk_id"))


@query(f"""WITH b AS (SELECT doc_id, {WHITE} AS toks FROM documents),
w AS (SELECT doc_id, toks, unnest(range(0, 1 + greatest(0, ceil((len(toks) - 300) / 240.0))::BIGINT)) AS ordinal FROM b WHERE len(toks) > 0),
c AS (SELECT doc_id, ordinal, array_to_string(toks[ordinal * 240 + 1 : ordinal * 240 + 300], ' ') AS chunk FROM w)
SELECT doc_id, ordinal, length(chunk) + CASE WHEN length(chunk) + coalesce(length(lead(chunk) OVER v), 0) <= 3000 THEN coalesce(length(lead(chunk) OVER v), 0) ELSE 0 END AS grown, lag(ordinal) OVER v IS NOT NULL AS has_before FROM c WINDOW v AS (PARTITION BY doc_id ORDER BY ordinal)""")
def expand_neighbours(spark, sf):
    c = op.token_windows(read(spark, sf, "documents")).select("doc_id", "ordinal", F.char_length("chunk").alias("len"))
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    after = F.coalesce(F.lead("len").over(w), F.lit(0))
    grown = F.col("len") + F.when(F.col("len") + after <= 3000, after).otherwise(0)
    return c.select("doc_id", "ordinal", grown.alias("grown"), F.lag("ordinal").over(w).isNotNull().alias("has_before"))


@query(rf"""WITH s AS (SELECT doc_id, [x FOR x IN string_split_regex(text, '[.!?]\s+') IF x <> ''] AS ss FROM documents),
e AS (SELECT doc_id, unnest(ss) AS text, unnest(range(0, len(ss))) AS pos FROM s), n AS (SELECT doc_id, pos, len({WHITE}) AS n FROM e),
p AS (SELECT doc_id, n, floor((sum(n) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - n) / 300)::INT AS ordinal FROM n)
SELECT doc_id, ordinal, count(*) AS n_sentences, sum(n)::BIGINT AS n_tokens FROM p GROUP BY doc_id, ordinal""")
def sentence_chunks(spark, sf):
    return op.sentence_chunks(read(spark, sf, "documents"))


@query("""WITH l AS (SELECT DISTINCT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT source, line, count(*) AS n_docs FROM l WHERE trim(line) <> '' GROUP BY source, line HAVING count(*) >= 3""")
def running_lines(spark, sf):
    return op.running_lines(read(spark, sf, "documents"), "source")


@query("SELECT sha256(text) AS hash, min(doc_id) AS kept, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dups(spark, sf):
    g = read(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("kept"), F.count(F.lit(1)).alias("n"))
    return g.filter("n > 1")


@query(f"""WITH b AS (SELECT doc_id, list_sort(list_distinct({LOWER})) AS ws FROM documents), s AS (SELECT ws, min(doc_id) AS doc_id FROM b WHERE len(ws) > 0 GROUP BY ws),
t AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS k FROM t x JOIN t y ON x.term = y.term AND x.doc_id < y.doc_id AND x.n >= 0.85 * y.n AND y.n >= 0.85 * x.n GROUP BY 1, 2, 3, 4)
SELECT a, b, round(k / (na + nb - k), 6) AS jaccard FROM p WHERE round(k / (na + nb - k), 6) >= 0.85""")
def near_dups(spark, sf):
    return op.near_copies(read(spark, sf, "documents"))


@query(f"""WITH g AS (SELECT doc_id, unnest(list_distinct([array_to_string(ws[i : i + 7], ' ') FOR i IN range(1, greatest(1, len(ws) - 6))])) AS gram FROM (SELECT doc_id, {LOWER} AS ws FROM documents) WHERE len(ws) >= 8),
q AS (SELECT item_id, unnest(list_distinct([array_to_string(ws[i : i + 7], ' ') FOR i IN range(1, greatest(1, len(ws) - 6))])) AS gram FROM (SELECT item_id, {LOWER} AS ws FROM benchmark) WHERE len(ws) >= 8),
n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id)
SELECT item_id, doc_id, count(*) AS shared, round(count(*) / n, 6) AS containment FROM q JOIN g USING (gram) JOIN n USING (item_id) GROUP BY item_id, doc_id, n""")
def benchmark_overlap(spark, sf):
    def grams(df, key):
        base = df.select(key, fx.tokens(F.col("text")).alias("ws")).filter(F.size("ws") >= 8)
        each = F.transform(F.sequence(F.lit(1), F.size("ws") - 7), lambda i: F.xxhash64(F.slice("ws", i, 8)))
        return base.select(key, F.explode(F.array_distinct(each)).alias("gram"))

    q = grams(read(spark, sf, "benchmark"), "item_id")
    n = q.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    if q.count() <= BROADCAST_GRAMS:  # then the documents' own grams, nearly all of which no item has, stay where they are
        q = F.broadcast(q)
    hits = grams(read(spark, sf, "documents"), "doc_id").join(q, "gram").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("shared"))
    return hits.join(n, "item_id").select("item_id", "doc_id", "shared", F.round(F.col("shared") / F.col("n"), 6).alias("containment"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages""")
def html_text(spark, sf):
    return read(spark, sf, "pages").select("page_id", text_of_html(F.col("html")).alias("text"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), '\+?[0-9][0-9 ()-]{8,}[0-9]', '[number]', 'g') AS text FROM documents""")
def pii_mask(spark, sf):
    t = F.regexp_replace("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]")
    return read(spark, sf, "documents").select("doc_id", F.regexp_replace(t, r"\+?[0-9][0-9 ()-]{8,}[0-9]", "[number]").alias("text"))


@query(rf"""WITH b AS (SELECT doc_id, unnest({LOWER}) AS w FROM documents), f AS (SELECT doc_id, w, CASE WHEN NOT regexp_matches(w, '^[a-z]{{4,}}$') THEN w WHEN w LIKE '%ies' THEN regexp_replace(w, 'ies$', '') || 'y'
 WHEN regexp_matches(w, '(ss|us|is)$') THEN w WHEN regexp_matches(w, '(x|ch|sh|ss)es$') THEN regexp_replace(w, 'es$', '') WHEN w LIKE '%s' THEN regexp_replace(w, 's$', '') ELSE w END AS folded FROM b)
SELECT doc_id, count(DISTINCT w) AS n_words, count(DISTINCT folded) AS n_folded FROM f GROUP BY doc_id""")
def folded_words(spark, sf):
    b = read(spark, sf, "documents").select("doc_id", F.array_distinct(fx.tokens(F.col("text"))).alias("ws")).filter(F.size("ws") > 0)
    return b.select("doc_id", F.size("ws").cast("bigint").alias("n_words"), F.size(F.array_distinct(F.transform("ws", fx.fold_word))).cast("bigint").alias("n_folded"))


@query(f"""WITH b AS (SELECT doc_id, {WHITE} AS toks FROM documents), w AS (SELECT doc_id, toks, unnest(range(0, 1 + greatest(0, ceil((len(toks) - 300) / 240.0))::BIGINT)) AS ordinal FROM b WHERE len(toks) > 0),
c AS (SELECT doc_id, ordinal, array_to_string(toks[ordinal * 240 + 1 : ordinal * 240 + 300], ' ') AS chunk FROM w),
e AS (SELECT doc_id, ordinal, ceil(ceil(length(chunk) / 3.5) * 1.05)::BIGINT AS est FROM c), r AS (SELECT *, sum(est) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT doc_id, count(*) FILTER (WHERE run <= 2000) AS kept, count(*) FILTER (WHERE run > 2000) AS dropped, coalesce(max(run) FILTER (WHERE run <= 2000), 0)::BIGINT AS used FROM r GROUP BY doc_id""")
def token_budget(spark, sf):
    c = op.token_windows(read(spark, sf, "documents"))
    est = F.ceil(F.ceil(F.char_length("chunk") / 3.5) * 1.05)
    w = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    r = c.select("doc_id", F.sum(est).over(w).alias("run"))
    return r.groupBy("doc_id").agg(F.count_if(F.col("run") <= 2000).alias("kept"), F.count_if(F.col("run") > 2000).alias("dropped"), F.coalesce(F.max(F.when(F.col("run") <= 2000, F.col("run"))), F.lit(0)).alias("used"))


@query(r"""SELECT p_partkey, upper(regexp_replace(p_name || ' ' || p_brand, '[^A-Za-z0-9]', '', 'g')) AS designation, count(*) OVER (PARTITION BY upper(regexp_replace(p_name || ' ' || p_brand, '[^A-Za-z0-9]', '', 'g'))) AS n_same FROM part""")
def designation_keys(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", fx.key_of(F.concat_ws(" ", "p_name", "p_brand")).alias("designation"))
    n = p.groupBy("designation").agg(F.count(F.lit(1)).alias("n_same"))
    return p.join(n, "designation").select("p_partkey", "designation", "n_same")
