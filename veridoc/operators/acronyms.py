"""Acronyms that texts define themselves, by scope, and questions worded the other way round with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx

#: Words that an acronym may leave out.
SKIPPABLE = ("of", "and", "the", "for", "in", "on", "at", "to", "a", "an", "or", "with")
#: An acronym, a word that can stand in brackets by it, and a word of a row, of which only first letters may be capitals.
ACRONYM, WORD, ROW_WORD = "^[A-Z][A-Z0-9]*([-/][A-Z0-9]+)*$", "^[A-Za-z][A-Za-z-]*$", "^[A-Za-z][a-z]*(-[A-Za-z][a-z]*)*$"
#: Every text with an acronym has these.
CAPITALS = "[A-Z][A-Z0-9/-]"
#: Words of an expansion, and letters of an acronym.
FEWEST, MOST, SHORTEST, LONGEST = 2, 8, 2, 12

LEADING = f"^(({'|'.join(SKIPPABLE)}) )+"


def is_acronym(token: Column) -> Column:
    return token.rlike(ACRONYM) & F.char_length(token).between(SHORTEST, LONGEST)


def tokens(text: Column) -> Column:
    """What white space parts, brackets on their own."""
    return F.filter(F.split(F.regexp_replace(text, "([()])", " $1 "), r"[ \t\r\n]+"), lambda x: x != "")


def spelt(words: Column) -> Column:
    """Words as an expansion is kept: lower case, without function words before the first other word."""
    return F.regexp_replace(F.lower(F.array_join(words, " ")), LEADING, "")


def parts(expansion: Column) -> Column:
    """Words of an expansion, hyphenated ones apart."""
    return F.filter(F.split(expansion, "[ -]+"), lambda x: x != "")


def letters(acronym: Column) -> Column:
    return F.regexp_replace(acronym, "[-/]", "")


def initials_spell(acronym: Column, expansion: Column) -> Column:
    """Whether the initials of the words are the letters of the acronym, where function words may count or not.

    Initials are written in a row, those of function words behind a dash, and the acronym is the pattern they must match. It is
    made only for as many words as can match: every letter is a word's, and every word but a function word has a letter."""
    shape = F.concat(F.lit("^"), F.regexp_replace(letters(acronym), "(.)", "(?:-[A-Z])*-?$1"), F.lit("(?:-[A-Z])*$"))
    code = lambda ws: F.array_join(F.transform(ws, lambda x: F.concat(F.when(x.isin(*SKIPPABLE), "-").otherwise(""), F.upper(F.left(x, F.lit(1))))), "")
    n = F.char_length(letters(acronym))
    fits = lambda ws: (F.size(ws) <= MOST) & (F.size(ws) >= n) & (F.size(F.filter(ws, lambda x: ~x.isin(*SKIPPABLE))) <= n)
    return fx.once(parts(expansion), lambda ws: F.when(fits(ws), F.regexp_like(code(ws), shape)).otherwise(F.lit(False)))


def _ahead(c: Column, k: Column) -> Column:
    """The k words before the bracket of `NDFT` in "dry film thickness (NDFT)"."""
    return F.slice(c["before"], F.greatest(F.size(c["before"]) - k, F.lit(1)), k)


def _all(words: Column, shape: str) -> Column:
    return F.forall(words, lambda x: x.rlike(shape))


def _spelling(name: Column, words: Column) -> Column:
    """The words as an expansion if they spell the acronym, or null."""
    return fx.once(spelt(words), lambda x: F.when(initials_spell(name, x), x))


def _expansion(c: Column) -> Column:
    """The expansion that stands by an acronym, or null."""
    before, after, name = c["before"], c["after"], c["acronym"]
    taken = lambda k: F.when((F.size(before) > k) & _all(_ahead(c, k), WORD), _spelling(name, _ahead(c, k)))
    enclosed = (F.get(before, F.size(before) - 1) == "(") & (F.get(after, F.lit(0)) == ")")
    bracketed = F.coalesce(*(taken(F.lit(k)) for k in range(FEWEST, MOST + 1)))
    words = lambda x, shape: F.when(_all(x, shape), _spelling(name, x))
    inside = fx.once(F.array_position(after, ")").cast("int") - 2, lambda stop: F.when(stop.between(FEWEST, MOST), words(F.slice(after, F.lit(2), F.greatest(stop, F.lit(0))), WORD)).otherwise(F.lit("")))
    miss = F.array_position(F.transform(after, lambda x: x.rlike(ROW_WORD)), False).cast("int")
    row = lambda run: run.between(FEWEST, MOST) & ((run == F.size(after)) | is_acronym(F.get(after, run)))
    behind = fx.once(miss, lambda m: fx.once(F.when(m == 0, F.size(after)).otherwise(m - 1), lambda run: F.when(row(run), words(F.slice(after, F.lit(1), run), ROW_WORD))))
    return F.when(enclosed, bracketed).when(F.get(after, F.lit(0)) == "(", F.nullif(inside, F.lit(""))).otherwise(behind)


def harvest(texts: DataFrame) -> DataFrame:
    """Acronyms of each scope with what they stand for and the number of documents that say so.

    `texts` has doc_id, scope and text. An acronym is defined by "dry film thickness (DFT)", "DFT (dry film thickness)" or a row
    "DFT dry film thickness" that the next acronym or the end of the text closes, and only where the initials of two to eight
    words spell it. Before a bracket the fewest words that spell it are taken, so prose in front hides nothing. A null text
    defines nothing, a null scope is one of its own, a repeated definition in a document counts once, an empty table gives no rows.
    """
    t = texts.filter(F.col("text").rlike(CAPITALS)).select("doc_id", "scope", tokens(F.col("text")).alias("t"))
    around = F.transform("t", lambda x, i: F.when(is_acronym(x), F.struct(
        x.alias("acronym"), F.slice("t", F.greatest(i - MOST, F.lit(1)), F.least(i, F.lit(MOST + 1))).alias("before"), F.slice("t", i + 2, MOST + 2).alias("after"))))
    read = F.transform(F.filter(around, lambda x: x.isNotNull()), lambda c: F.struct(c["acronym"].alias("acronym"), _expansion(c).alias("expansion")))
    # what has no expansion goes before the rows are made: a filter behind them would work every expansion out twice
    found = t.select("doc_id", "scope", F.explode(F.filter(read, lambda x: x["expansion"].isNotNull())).alias("x")).select("doc_id", "scope", "x.*")
    return found.distinct().groupBy("scope", "acronym", "expansion").agg(F.count(F.lit(1)).alias("n_docs"))


def reworded(questions: DataFrame, known: DataFrame) -> DataFrame:
    """Questions spelled out and abbreviated by what their own scope defines; null where nothing applies.

    `questions` has question_id, scope and text, `known` is what `harvest` gives. An acronym of several meanings in its scope is
    spelled out as the first by alphabet, `n_meanings` being the most that one of the question has. A spelled-out phrase is
    abbreviated whatever its case and hyphens; of two that overlap the longer one is, then the left one. Only a question's words
    and its runs of two to eight words meet the map, by equality of scope and words; null scopes meet nothing.
    """
    flat = lambda x: F.array_join(parts(F.lower(x)), " ")
    t = questions.select("question_id", "scope", F.filter(F.split("text", r"[ \t\r\n]+"), lambda x: x != "").alias("t"))
    bare = F.transform("t", lambda x: F.regexp_replace(x, "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))
    # a question is read once for both: words that can be acronyms, and runs of two words or more, hyphenated ones being two
    words = t.select("question_id", "scope", bare.alias("bare")).select("question_id", "scope", "bare", F.transform("bare", lambda x: F.nullif(flat(x), F.lit(""))).alias("flat"))
    gram = lambda i, k, name, text: F.struct(i.alias("start"), k.alias("size"), name.alias("acronym"), text.alias("gram"))
    one = F.filter(F.transform("bare", lambda x, i: gram(i, F.lit(1), F.lit(True), x)), lambda g: is_acronym(g["gram"]))
    runs = F.transform("flat", lambda x, i: F.transform(F.sequence(F.lit(1), F.least(F.size("flat") - i, F.lit(MOST))), lambda k: gram(i, k, F.lit(False), F.array_join(F.slice("flat", i + 1, k), " "))))
    g = words.select("question_id", "scope", F.explode(F.concat(one, F.filter(F.flatten(runs), lambda g: F.contains(g["gram"], F.lit(" "))))).alias("g")).select("question_id", "scope", "g.*")
    long = known.groupBy("scope", F.lit(True).alias("acronym"), F.col("acronym").alias("gram")).agg(F.min("expansion").alias("other"), F.count(F.lit(1)).alias("meanings"))
    short = known.groupBy("scope", F.lit(False).alias("acronym"), flat(F.col("expansion")).alias("gram")).agg(F.min("acronym").alias("other"), F.lit(None).cast("long").alias("meanings")).filter("gram like '% %'")
    met = g.join(long.unionByName(short), ["scope", "acronym", "gram"])
    hits = met.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("start", "size", "other", "meanings"))).alias("hits"))
    hits = hits.select("question_id", F.filter("hits", lambda h: h["meanings"].isNotNull()).alias("names"), F.filter("hits", lambda h: h["meanings"].isNull()).alias("phrases"))
    beats = lambda o, h: (o["start"] < h["start"] + h["size"]) & (h["start"] < o["start"] + o["size"]) & ((o["size"] > h["size"]) | ((o["size"] == h["size"]) & (o["start"] < h["start"])))
    hits = hits.withColumn("phrases", F.filter("phrases", lambda h: ~F.exists("phrases", lambda o: beats(o, h))))

    def swapped(which: str) -> Column:
        at = lambda i: F.get(F.filter(which, lambda h: (h["start"] <= i) & (i < h["start"] + h["size"])), F.lit(0))
        # what stands for a place keeps the punctuation behind its last word
        last = lambda h: F.get("t", h["start"] + h["size"] - 1)
        put = lambda h: F.concat(F.regexp_extract(F.get("t", h["start"]), "^[^A-Za-z0-9]*", 0), h["other"], F.regexp_extract(last(h), "[^A-Za-z0-9]*$", 0))
        words = F.transform("t", lambda x, i: F.when(at(i).isNull(), x).when(at(i)["start"] == i, put(at(i))))
        return F.when(F.size(which) > 0, F.array_join(F.filter(words, lambda x: x.isNotNull()), " "))

    q = t.join(hits, "question_id")
    return q.select("question_id", swapped("names").alias("spelled"), swapped("phrases").alias("abbreviated"), F.array_max(F.transform("names", lambda h: h["meanings"])).alias("n_meanings"))
