"""Queries of search, fusion, gates and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import retrieval as ret
from ..sources.tables import read

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: The question that the search queries ask: words that are common enough at every scale.
TERMS = ["theand", "there", "with", "ouen"]
TOKS = r"[x FOR x IN string_split_regex(lower(text), '[^\p{L}0-9]+') IF x <> '']"
_DOCS = f"t AS (SELECT doc_id, source, lang, {TOKS} AS toks FROM documents)"


def _bm25(terms, where="", select="doc_id, score, rank", k=10, source="documents"):
    tf = lambda t: f"len([x FOR x IN toks IF x = '{t}'])::DOUBLE"
    parts = " + ".join(f"greatest(1e-6, ln((n - df{i} + 0.5) / (df{i} + 0.5))) * {tf(t)} * 2.2 / ({tf(t)} + 1.2 * (0.25 + 0.75 * len(toks) / avgdl))" for i, t in enumerate(terms))
    dfs = ", ".join(f"count(*) FILTER (WHERE list_contains(toks, '{t}')) AS df{i}" for i, t in enumerate(terms))
    any_of = "(" + " OR ".join(f"list_contains(toks, '{t}')" for t in terms) + ")" + where
    return f"""WITH t AS (SELECT doc_id, {TOKS} AS toks FROM {source}), st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl, {dfs} FROM t),
s AS (SELECT doc_id, round({parts}, 6) AS score FROM t, st WHERE {any_of}),
r AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s) SELECT {select} FROM r WHERE rank <= {k}"""


@query(_bm25(TERMS))
def kw_bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return ret.bm25(read(spark, sf, "documents"), TERMS, 10)


@query(_bm25(TERMS, " AND list_contains(toks, 'with')", k=20))
def kw_required_terms(spark, sf):
    return ret.bm25(read(spark, sf, "documents"), TERMS, 20, required=("with",))


@query(f"""WITH {_DOCS}, p AS (SELECT doc_id, unnest(list_zip(toks[:-2], toks[2:])) AS pair FROM t WHERE len(toks) > 1)
SELECT doc_id, count(*) AS n_phrase FROM p WHERE pair[1] = 'of' AND pair[2] = 'the' GROUP BY doc_id""")
def kw_phrase_first(spark, sf):
    base = read(spark, sf, "documents").select("doc_id", fx.tokens(F.col("text")).alias("toks"))
    hits = F.filter(F.transform("toks", lambda x, i: (x == "of") & (F.get("toks", i + 1) == "the")), lambda x: x)
    return base.select("doc_id", F.size(hits).cast("bigint").alias("n_phrase")).filter("n_phrase > 0")


@query(f"WITH {_DOCS} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(toks) AS term FROM t) GROUP BY term HAVING count(DISTINCT doc_id) >= 3")
def term_df_vocab(spark, sf):
    # one reading of the texts: a token counts 1 for cf, and once more, among its document's distinct ones, 1 for df
    entry = lambda df, cf: lambda t: F.struct(t.alias("term"), F.lit(df).alias("df"), F.lit(cf).alias("cf"))
    base = read(spark, sf, "documents").select(fx.tokens(F.col("text")).alias("toks"))
    both = F.concat(F.transform("toks", entry(0, 1)), F.transform(F.array_distinct("toks"), entry(1, 0)))
    return base.select(F.inline(both)).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("df >= 3")


@query(f"""WITH {_DOCS}, p AS (SELECT DISTINCT doc_id, unnest(toks) AS term FROM t), d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
r AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY df, term) AS rn FROM p JOIN d USING (term) WHERE length(term) >= 3)
SELECT doc_id, string_agg(term, ' ' ORDER BY rn) AS query FROM r WHERE rn <= 6 GROUP BY doc_id""")
def distinctive_query(spark, sf):
    docs = read(spark, sf, "documents")
    terms = docs.select("doc_id", F.explode(F.array_distinct(fx.tokens(F.col("text")))).alias("term")).filter(F.length("term") >= 3)
    ranked = terms.join(ret.document_frequency(docs), "term")
    w = Window.partitionBy("doc_id").orderBy("df", "term")
    top = ranked.withColumn("rn", F.row_number().over(w)).filter("rn <= 6")
    words = F.transform(F.sort_array(F.collect_list(F.struct("rn", "term"))), lambda x: x["term"])
    return top.groupBy("doc_id").agg(F.array_join(words, " ").alias("query"))


def _question(spark, sf) -> list[float]:
    """The vector of the smallest vec_id, asked of the others."""
    return read(spark, sf, "embeddings").orderBy("vec_id").select("embedding").first()["embedding"]


_VEC = """WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1),
s AS (SELECT vec_id, label, round(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]), 9) AS score FROM embeddings, q %s),
r AS (SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s)"""


@query(_VEC % "" + " SELECT vec_id, score, rank FROM r WHERE rank <= 30")
def vec_topk(spark, sf):
    return ret.vector_topk(read(spark, sf, "embeddings"), _question(spark, sf), 30)


@query(_VEC % "WHERE label IN (1, 3)" + " SELECT vec_id, score, rank FROM r WHERE rank <= 30")
def vec_topk_scoped(spark, sf):
    return ret.vector_topk(read(spark, sf, "embeddings").filter(F.col("label").isin(1, 3)), _question(spark, sf), 30)


@query(_VEC % "WHERE label IN (1, 3)" + " SELECT vec_id, score, TRUE AS agrees FROM r WHERE rank <= 10")
def vec_scope_equivalence(spark, sf):
    """Over-fetching and then dropping what is out of scope must give what filtering first gives.

    What is fetched is every vector, in scope or not, that scores no less than the tenth in scope.
    """
    v, q = read(spark, sf, "embeddings"), _question(spark, sf)
    first = ret.vector_topk(v.filter(F.col("label").isin(1, 3)), q, 10)
    tenth = first.agg(F.min("score").alias("least"))
    fetched = v.select("vec_id", "label", ret.score_of(q).alias("s")).join(F.broadcast(tenth), F.col("s") >= F.col("least"))
    over = fetched.filter(F.col("label").isin(1, 3)).orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", F.lit(True).alias("over"))
    return first.join(over, "vec_id", "full_outer").select("vec_id", "score", (F.col("over").isNotNull() & F.col("score").isNotNull()).alias("agrees"))


_HYBRID = f"""WITH kw AS ({_bm25(TERMS, k=30)}), vec AS ({_VEC % ""} SELECT vec_id, rank FROM r WHERE rank <= 30),
f AS (SELECT coalesce(kw.doc_id, vec.vec_id) AS id, kw.rank AS keyword_rank, vec.rank AS dense_rank,
 round(coalesce(1e0 / (60 + kw.rank), 0) + coalesce(1e0 / (60 + vec.rank), 0), 9) AS fused FROM kw FULL OUTER JOIN vec ON kw.doc_id = vec.vec_id)"""


def _hybrid(spark, sf):
    kw = ret.bm25(read(spark, sf, "documents"), TERMS, 30).select(F.col("doc_id").alias("id"), "rank")
    vec = ret.vector_topk(read(spark, sf, "embeddings"), _question(spark, sf), 30).select(F.col("vec_id").alias("id"), "rank")
    return ret.rrf([(kw, "keyword_rank"), (vec, "dense_rank")])


@query(_HYBRID + " SELECT * FROM f")
def hybrid_rrf(spark, sf):
    return _hybrid(spark, sf)


@query(_HYBRID + ", m AS (SELECT max(fused) AS top, median(fused) AS mid FROM f) SELECT id, fused, round((top - fused) / greatest(top - mid, 1e-9), 6) AS separation FROM f, m")
def rrf_separation(spark, sf):
    return ret.separation(_hybrid(spark, sf).select("id", "fused"), "fused")


_STOP = ", ".join(f"'{w}'" for w in fx.STOPWORDS)


@query(f"""WITH {_DOCS}, n AS (SELECT count(*) AS n FROM documents), p AS (SELECT DISTINCT doc_id, unnest(toks) AS term FROM t),
d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({TOKS}) AS term FROM benchmark),
k AS (SELECT item_id, q.term, coalesce(df, 0) AS df, n FROM q LEFT JOIN d USING (term), n WHERE length(q.term) >= 3 AND q.term NOT IN ({_STOP})),
g AS (SELECT item_id, count(*) AS n_terms, count(*) FILTER (WHERE df > 0) AS n_present, count(*) FILTER (WHERE df > 0 AND NOT (n >= 20 AND df > 0.25 * n)) AS n_distinct FROM k GROUP BY item_id)
SELECT item_id, n_terms, n_present, n_distinct, CASE WHEN n_present = 0 THEN 'refuse: none of the terms is present' WHEN n_distinct < CASE WHEN n_terms >= 3 THEN 2 ELSE 1 END THEN 'refuse: only common terms' ELSE 'answer' END AS verdict FROM g""")
def lexical_gate(spark, sf):
    docs = read(spark, sf, "documents")
    q = read(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(fx.tokens(F.col("text")))).alias("term"))
    q = q.filter((F.length("term") >= 3) & ~F.col("term").isin(*fx.STOPWORDS))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    k = q.join(ret.document_frequency(docs), "term", "left").crossJoin(F.broadcast(n)).withColumn("df", F.coalesce("df", F.lit(0)))
    common = (F.col("n") >= 20) & (F.col("df") > 0.25 * F.col("n"))
    g = k.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_terms"), F.count_if(F.col("df") > 0).alias("n_present"), F.count_if((F.col("df") > 0) & ~common).alias("n_distinct"))
    need = F.when(F.col("n_terms") >= 3, 2).otherwise(1)
    verdict = F.when(F.col("n_present") == 0, "refuse: none of the terms is present").when(F.col("n_distinct") < need, "refuse: only common terms").otherwise("answer")
    return g.withColumn("verdict", verdict)


@query(f"""WITH {_DOCS}, h AS (SELECT doc_id, source, list_contains(toks, 'with') AS a, list_contains(toks, 'from') AS b, list_contains(toks, 'theand') AS c FROM t)
SELECT source, count(*) FILTER (WHERE a AND b AND c) AS answered, count(*) FILTER (WHERE (a AND b) AND NOT c) AS supporting,
 count(*) FILTER (WHERE c AND NOT (a AND b)) AS credible_not_cited, count(*) FILTER (WHERE NOT a AND NOT b AND NOT c) AS absent FROM h GROUP BY source""")
def coverage_incidence(spark, sf):
    base = read(spark, sf, "documents").select("source", fx.tokens(F.col("text")).alias("toks"))
    a, b, c = (F.array_contains("toks", t) for t in ("with", "from", "theand"))
    return base.groupBy("source").agg(F.count_if(a & b & c).alias("answered"), F.count_if(a & b & ~c).alias("supporting"), F.count_if(c & ~(a & b)).alias("credible_not_cited"), F.count_if(~a & ~b & ~c).alias("absent"))


@query(f"""WITH {_DOCS}, v AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(toks) AS term FROM t) WHERE regexp_full_match(term, '[a-z]{{5,7}}') GROUP BY term HAVING count(*) >= 5),
q AS (SELECT DISTINCT unnest({TOKS}) AS asked FROM benchmark), m AS (SELECT asked FROM q WHERE regexp_full_match(asked, '[a-z]{{6}}') AND asked NOT IN (SELECT unnest(toks) FROM t)),
c AS (SELECT asked, term, levenshtein(asked, term) AS d, df FROM m JOIN v ON abs(length(term) - 6) <= 1 AND levenshtein(asked, term) <= 1)
SELECT asked, arg_min(term, (d, -df, term)) AS corrected FROM c GROUP BY asked""")
def spelling_correction(spark, sf):
    """Words of the questions that no document has, with the vocabulary word one edit away.

    A word and each of its forms with one letter left out meet on that form, so no pair of
    the two vocabularies is tried that is not near.
    """
    docs = read(spark, sf, "documents")
    vocab = ret.document_frequency(docs)
    asked = read(spark, sf, "benchmark").select(F.explode(fx.tokens(F.col("text"))).alias("asked")).filter(F.col("asked").rlike("^[a-z]{6}$")).distinct()
    asked = asked.join(vocab, F.col("asked") == F.col("term"), "left_anti")
    forms = lambda c: F.array_union(F.array(F.col(c)), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(F.col(c), F.lit(1), i - 1), F.substring(F.col(c), i + 1, F.lit(100)))))
    known = vocab.filter(F.col("term").rlike("^[a-z]{5,7}$") & (F.col("df") >= 5)).withColumn("form", F.explode(forms("term")))
    met = asked.withColumn("form", F.explode(forms("asked"))).join(known, "form").filter(F.levenshtein("asked", "term") <= 1)
    best = F.min(F.struct(F.levenshtein("asked", "term").alias("d"), (-F.col("df")).alias("df"), "term"))
    return met.groupBy("asked").agg(best.alias("b")).select("asked", F.col("b.term").alias("corrected"))


@query(r"""WITH c AS (SELECT conv_id, turn, role, lower(trim(text)) AS t, text FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(t, '^(hi|hello|hey|hallo|bonjour|hola)[ ,.!]*$') THEN 'greeting' WHEN regexp_matches(t, '^(thanks|thank you|danke|merci|gracias)') THEN 'thanks'
WHEN regexp_matches(t, '^(who|what) are you') THEN 'about_assistant' WHEN regexp_matches(t, '\?$') OR len(string_split(t, ' ')) > 5 THEN 'document_question' ELSE 'not_a_question' END AS intent FROM c""")
def intent_labels(spark, sf):
    c = read(spark, sf, "conversations").filter("role = 'user'").withColumn("t", F.lower(F.trim("text")))
    t = F.col("t")
    label = (
        F.when(t == "", "empty")
        .when(t.rlike("^(hi|hello|hey|hallo|bonjour|hola)[ ,.!]*$"), "greeting")
        .when(t.rlike("^(thanks|thank you|danke|merci|gracias)"), "thanks")
        .when(t.rlike("^(who|what) are you"), "about_assistant")
        .when(t.rlike(r"\?$") | (F.size(F.split(t, " ")) > 5), "document_question")
        .otherwise("not_a_question")
    )
    return c.select("conv_id", "turn", label.alias("intent"))


@query("""SELECT conv_id, turn, coalesce(array_to_string(list(CASE WHEN role = 'user' THEN text END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), ' | '), '') AS context FROM conversations""")
def followup_context(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-4, -1)
    said = F.collect_list(F.when(F.col("role") == "user", F.col("text"))).over(w)
    return read(spark, sf, "conversations").select("conv_id", "turn", F.array_join(said, " | ").alias("context"))


@query(f"""WITH t AS (SELECT doc_id, source, {TOKS} AS toks FROM documents), s AS (SELECT doc_id, source, len([x FOR x IN toks IF x IN ('with', 'from', 'theand')]) AS hits FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY hits DESC, doc_id) AS rank FROM s) SELECT source, doc_id, hits, rank FROM r WHERE rank <= 3""")
def per_side_retrieval(spark, sf):
    base = read(spark, sf, "documents").select("doc_id", "source", F.size(F.filter(fx.tokens(F.col("text")), lambda x: x.isin("with", "from", "theand"))).alias("hits"))
    w = Window.partitionBy("source").orderBy(F.desc("hits"), "doc_id")
    return base.select("source", "doc_id", "hits", F.row_number().over(w).alias("rank")).filter("rank <= 3")
