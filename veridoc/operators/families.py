"""Families of standards that a question names in general words, ranked by what their documents hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

#: Families listed for a question, and passages of one document that count for its topic.
LISTED, PROBE = 8, 5
NOUN = "(?i)\\b(?:standards|specifications|specs)\\b"
#: Words behind the noun, the preposition, and the topic.
BEHIND = "(?i)\\b(?:standards|specifications|specs)\\b\\s+((?:[A-Za-z']+\\s+){0,2}?)(about|on|regarding|concerning|for)\\s+(.+)$"
#: A designation that was typed names its standard itself.
TYPED = "\\b[A-Z][A-Z0-9]*(?:[-.][A-Z0-9]+)+\\b"
#: Grammar words at which a descriptor begins.
BREAK = (
    "the", "a", "an", "our", "your", "their", "its", "my", "all", "these", "those",
    "do", "does", "did", "what", "which", "how", "are", "is", "there", "of", "in",
    "on", "at", "for", "to", "and", "or", "with", "from", "by", "about", "say",
    "says", "any", "every", "each", "both", "other", "have", "has", "we", "you",
    "tell", "me", "show", "list", "give", "that", "this", "where", "when", "can",
    "should", "must", "shall", "per", "under", "across", "between", "into",
)
#: Words that describe no family.
GENERIC = (
    "company", "client", "applicable", "relevant", "project", "current", "existing",
    "engineering", "technical", "following", "listed", "specific", "various",
    "different", "same", "new", "old", "international", "national", "industry",
    "internal", "external", "approved", "latest", "available", "uploaded", "own",
    "standard", "related", "associated", "general", "ours",
)


def _cut(w: Column) -> Column:
    n = F.char_length(w)
    less = lambda k: F.left(w, n - k)
    return (
        F.when(w.endswith("ings") & (n >= 7), less(4))
        .when(w.endswith("ing") & (n >= 6), less(3))
        .when(w.endswith("ies") & (n >= 5), F.concat(less(3), F.lit("y")))
        .when(w.endswith("ed") & (n >= 5), less(2))
        .when(w.endswith("es") & w.rlike("(sses|shes|ches|xes|zes|ses)$") & (n > 4), less(2))
        .when(w.endswith("s") & ~w.endswith("ss") & (n > 3), less(1))
        .otherwise(w)
    )


def _shortened(low: Column) -> Column:
    return F.transform(F.transform(low, _cut), lambda w: F.when(w.endswith("e") & (F.char_length(w) > 3), F.left(w, F.char_length(w) - 1)).otherwise(w))


def stemmed(words: Column) -> Column:
    """Words in lower case without a common ending, so that weld, welds and welding meet; three letters at least stay."""
    return _shortened(F.transform(words, lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9]", "")))


def _own_stems(text: Column) -> Column:
    words = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: F.char_length(w) >= 3)
    # no sign is left in these words that `stemmed` would take out
    return F.array_distinct(_shortened(F.transform(words, F.lower)))


def stems(text: Column) -> Column:
    """The distinct stems of the words of three letters or more, in order of the alphabet."""
    return F.array_sort(_own_stems(text))


def family_phrase(question: Column) -> Column:
    """(descriptor, topic) as stems of a question that names one family in general words; null for any other."""
    prep, mid = F.lower(F.regexp_extract(question, BEHIND, 2)), F.trim(F.regexp_extract(question, BEHIND, 1))
    topic = F.regexp_replace(F.regexp_extract(question, BEHIND, 3), "^[ ,.?!:;]+|[ ,.?!:;]+$", "")
    before = F.reverse(F.regexp_extract_all(F.get(F.split(question, NOUN), F.lit(0)), F.lit("[A-Za-z][A-Za-z-]*"), F.lit(0)))
    low = F.transform(before, F.lower)
    stop = F.array_position(F.transform(low, lambda w: w.isin(*BREAK)), True).cast("int")
    near = F.slice(low, F.lit(1), F.least(F.lit(3), F.when(stop > 0, stop - 1).otherwise(F.size(low))))
    named = F.filter(near, lambda w: ~w.isin(*GENERIC) & (F.char_length(w) >= 3))
    one = F.size(F.regexp_extract_all(question, F.lit(NOUN), F.lit(0))) == 1
    says = question.rlike(BEHIND) & ~((prep == "for") & (mid == "")) & topic.rlike("[A-Za-z]{3,}")
    phrase = F.struct(stems(F.array_join(named, " ")).alias("descriptor"), stems(topic).alias("topic"))
    return F.when(one & says & ~question.rlike(TYPED) & (F.size(named) > 0), phrase)


def whole_hits(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """set, doc_id and n: how many of a document's `texts` (doc_id, text) hold every stem of a set of `sets` (set, stems)."""
    wanted = sets.select("set", F.size("stems").alias("need"), F.explode("stems").alias("stem"))
    asked = wanted.select("stem").distinct()
    numbered = texts.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    met = numbered.select("doc_id", "row", F.explode(_own_stems(F.col("text"))).alias("stem")).join(asked, "stem", "left_semi").join(wanted, "stem").groupBy("set", "need", "doc_id", "row").agg(F.count(F.lit(1)).alias("n"))
    return met.filter("n = need").groupBy("set", "doc_id").agg(F.count(F.lit(1)).alias("n"))


def families(questions: DataFrame, standards: DataFrame, passages: DataFrame) -> DataFrame:
    """q_id, family, n_documents, topic, scope, search and rank: at most LISTED families for every question (q_id, question) that names some.

    A document of `standards` (doc_id, designation, scope) qualifies if its scope or one of its
    `passages` (doc_id, text) holds every stem of the descriptor. Editions of one designation are
    one family. The topic decides the order and never who qualifies: passages with every stem of
    the topic, at most PROBE a document; then documents whose scope holds the descriptor, passages
    that hold it, and the name. Equal phrases are answered once.
    """
    asked = kept(questions.select("q_id", family_phrase(F.col("question")).alias("x")), "phrases").filter("x is not null").select("q_id", "x.descriptor", "x.topic")
    asked = asked.withColumn("d", F.xxhash64("descriptor")).withColumn("t", F.xxhash64("topic"))
    once = asked.select("d", "t", "descriptor", "topic").distinct()
    of = lambda key, name: once.select(F.col(key).alias("set"), F.col(name).alias("stems")).filter(F.size("stems") > 0).distinct()
    scope = whole_hits(standards.select("doc_id", F.col("scope").alias("text")), of("d", "descriptor")).select(F.col("set").alias("d"), "doc_id", F.lit(1).alias("scope"))
    # a passage's stems are made once for descriptors and topics
    hits = kept(whole_hits(passages, of("d", "descriptor").unionByName(of("t", "topic")).distinct()), "hits")
    held = hits.join(of("d", "descriptor").select("set"), "set", "left_semi").select(F.col("set").alias("d"), "doc_id", F.col("n").alias("search"))
    probed = hits.join(of("t", "topic").select("set"), "set", "left_semi").select(F.col("set").alias("t"), "doc_id", F.least("n", F.lit(PROBE)).alias("hits"))
    qualified = scope.join(held, ["d", "doc_id"], "full_outer").join(standards.select("doc_id", "designation"), "doc_id")
    counted = once.select("d", "t").join(qualified, "d").join(probed, ["t", "doc_id"], "left")
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in (("hits", "topic"), ("scope", "scope"), ("search", "search"))]
    groups = counted.groupBy("d", "t", F.col("designation").alias("family")).agg(F.countDistinct("doc_id").alias("n_documents"), *sums)
    order = Window.partitionBy("d", "t").orderBy(F.desc("topic"), F.desc("scope"), F.desc("search"), F.lower("family"), "family")
    best = groups.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= LISTED)
    return asked.select("q_id", "d", "t").join(best, ["d", "t"]).drop("d", "t")
