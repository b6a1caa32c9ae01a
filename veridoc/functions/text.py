"""Text columns: tokens, words, clauses, lines, shares of scripts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words that carry no topic.
STOPWORDS = ("the", "and", "of", "a", "an", "in", "on", "to", "is", "for", "with", "by", "at", "be", "it", "as", "or", "from", "that", "this", "are", "was")

#: Characters that normalisation rewrites, and what they become.
FOLDED = {
    "²": "2", "³": "3", "µ": "μ", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff",
    "‐": "-", "‑": "-", "‒": "-", "−": "-", " ": " ", " ": " ",
}


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}0-9]+"), lambda x: x != "")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out a single time, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def white_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\r\n]+"), lambda x: x != "")


def normalise(text: Column) -> Column:
    """Known characters rewritten, superscript exponents of ten spelt out, NULs dropped, other controls made spaces."""
    x = F.regexp_replace(text, "10⁻([⁰¹²³⁴-⁹])", "10^-$1")
    x = F.translate(x, "⁰¹⁴⁵⁶⁷⁸⁹", "01456789")
    for a, b in FOLDED.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.replace(x, F.lit("\u0000"), F.lit(""))
    return F.regexp_replace(x, r"[\x01-\x08\x0B-\x1F\x7F]", " ")


def is_word(token: Column) -> Column:
    """Letters only once edge punctuation is off (inner - and ' are fine), two at least, and a vowel."""
    core = F.regexp_replace(token, r"^[^\p{L}0-9]+|[^\p{L}0-9]+$", "")
    return core.rlike(r"^\p{L}[\p{L}'-]*\p{L}$") & F.lower(core).rlike("[aeiouyàâäéèêëíîïóôöúùûüáñ]")


def longest_run(flags: Column) -> Column:
    """Length of the longest run of true in an array of booleans."""
    zero = F.struct(F.lit(0).alias("best"), F.lit(0).alias("run"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(x, acc["run"] + 1).otherwise(F.lit(0))
        return F.struct(F.greatest(acc["best"], run).alias("best"), run.alias("run"))

    return F.aggregate(flags, zero, step, lambda acc: acc["best"])


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def count_chars(text: Column, pattern: str) -> Column:
    """How many characters match a one-character pattern."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def fold_word(token: Column) -> Column:
    """Singular form of an ordinary word of four letters or more; -ed and -ing stay."""
    plain = token.rlike(r"^[a-z]{4,}$")
    return (
        F.when(plain & token.endswith("ies"), F.concat(F.regexp_replace(token, "ies$", ""), F.lit("y")))
        .when(plain & token.rlike("(ss|us|is)$"), token)
        .when(plain & token.rlike("(x|ch|sh|ss)es$"), F.regexp_replace(token, "es$", ""))
        .when(plain & token.endswith("s"), F.regexp_replace(token, "s$", ""))
        .otherwise(token)
    )


def key_of(name: Column) -> Column:
    """Letters and digits only, in upper case: the form in which designations are compared."""
    return F.upper(F.regexp_replace(name, "[^A-Za-z0-9]", ""))


def literal(text: Column) -> Column:
    """A pattern that matches `text` itself: every sign gets a backslash, letters, digits and white space stay."""
    return F.regexp_replace(text, r"([^\p{L}\p{N}\s])", r"\\$1")


def shared_edge(before: Column, after: Column, least: int = 20) -> Column:
    """How many leading characters of `after` repeat the end of `before`: the most of `least` or more that end on a word's edge, else 0."""
    # cut before every place where the first characters of `after` stand, also where these overlap; the first that holds is the longest
    cut = F.split(before, F.concat(F.lit("(?="), literal(F.left(after, F.lit(least))), F.lit(")")))
    size = lambda i: F.char_length(before) - i + 1
    edge = lambda i: (F.char_length(after) == size(i)) | ~F.substr(after, size(i), F.lit(2)).rlike(r"^[\p{L}0-9]{2}")
    holds = lambda i: (size(i) >= least) & F.startswith(after, F.substr(before, i)) & edge(i)
    state = lambda at, best: F.struct(at.alias("at"), best.alias("best"))
    best = lambda acc: F.when(acc["best"] > 0, acc["best"]).when(holds(acc["at"]), size(acc["at"])).otherwise(0)
    found = F.aggregate(cut, state(F.lit(1), F.lit(0)), lambda acc, x: state(acc["at"] + F.char_length(x), best(acc)), lambda acc: acc["best"])
    return F.when((F.char_length(before) >= least) & (F.char_length(after) >= least), found).otherwise(0)


def in_order(fragments: Column, page: Column) -> Column:
    """Where `page` goes on (from 1) behind the last of `fragments`, each found behind the one before it; 0 where one is missing."""

    def step(at: Column, fragment: Column) -> Column:
        found = F.call_function("locate", fragment, page, F.greatest(at, F.lit(1)))
        return F.when((at > 0) & (found > 0), found + F.char_length(fragment)).otherwise(0)

    return F.aggregate(fragments, F.lit(1), step)
