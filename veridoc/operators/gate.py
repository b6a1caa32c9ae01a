"""The whole quality gate: scripts, clauses with numbers in them, four tests of a table, and what a short text is kept for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx

#: Signs at a token's edges; cells and measures of digits; equipment tags; vowels.
EDGE = "[.,;:!?()\\[\\]{}\"'‘’“”·•●]+"
NUMERIC, MEASURE, TAG = "^[-+(]?[0-9][0-9.,%/:–-]*[)]?$", "^[-+]?[0-9]+([.,/][0-9]+)*%?$", "^([0-9]{1,3}-)?[A-Z]{1,4}-[0-9]{2,5}[A-Z]?$"
LETTERS, VOWEL = "^['’-]*\\p{L}[\\p{L}'’-]*$", "[aeiouyàâäéèêëíîïóôöúùûüáñ]"
#: Captions, words of requirement, and measured values.
LABEL = "(^|\n)[ \t]*(TABLE|Table|FIGURE|Figure|EXHIBIT|Exhibit)[ \t]*[0-9]"
REQUIREMENT = "(?i)\\b(shall|must|required|not\\s+(be\\s+)?(exceed|less|more)|minimum|maximum|min[.]|max[.]|approved|prohibited|permitted)\\b"
VALUE = "(?i)([0-9]\\s*(°\\s*[CF]\\b|%|mm\\b|um\\b|µm\\b|micron|mils?\\b|MPa\\b|kPa\\b|bar[ga]?\\b|psi[ga]?\\b|hours?\\b|hrs?\\b|min(ute)?s?\\b|days?\\b|ppm\\b|V\\b|volts?\\b|kg\\b|m2\\b|lit(re|er)s?\\b|rpm\\b|kW\\b|kV\\b|m[3³]/hr?\\b|Hz\\b)|\\b[0-9]+\\s*:\\s*[0-9]+\\b|\\b(RAL|Sa|St|SSPC|ISO|ASTM|NACE)\\s*[-0-9])"
ARABIC = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"
BARS, LEAST_TAGS, SHORT_LINE, HEADERS = "^[|]([^|]*[|]){2,}$", 3, 40, 6


def _bare(token: Column) -> Column:
    return F.regexp_replace(token, f"^{EDGE}|{EDGE}$", "")


def _is_word(bare: Column) -> Column:
    return (F.char_length(bare) >= 2) & bare.rlike(LETTERS) & F.lower(bare).rlike(VOWEL)


def _class(token: Column, bare: Column) -> Column:
    """One letter a token: w, W words from three letters on by their first sign, x, X shorter ones, b a cell that is a measure, m a
    measure, n a cell, t a tag, e nothing but signs, o other."""
    small, long = token.rlike("^\\p{Ll}"), F.char_length(bare) >= 3
    cell, measure = token.rlike(NUMERIC) & ~token.rlike("[.,]$"), bare.rlike(MEASURE)
    word = F.when(small & long, "w").when(long, "W").when(small, "x").otherwise("X")
    return F.when(_is_word(bare), word).when(cell & measure, "b").when(measure, "m").when(cell, "n").when(bare.rlike(TAG), "t").when(bare == "", "e").otherwise("o")


def classes(text: Column) -> Column:
    """A text's tokens as a string of their classes."""
    # most tokens are small words without a sign, which one pattern tells; they need two letters, as all words do
    plain = lambda x: x.rlike(f"^\\p{{Ll}}*{VOWEL}\\p{{Ll}}*$") & (F.char_length(x) >= 2)
    one = lambda x: F.when(plain(x), F.when(F.char_length(x) >= 3, "w").otherwise("x")).otherwise(fx.once(_bare(x), lambda bare: _class(x, bare)))
    return F.array_join(F.transform(fx.white_tokens(text), one), "")


def _of(code: Column, kinds: str) -> Column:
    return fx.count_chars(code, f"[{kinds}]")


def longest_clause(code: Column) -> Column:
    """The longest run of words; a measure before a small word neither ends nor lengthens it, any other number ends it."""
    whole = F.regexp_replace(code, "[mb]([wx])", "$1")
    return F.coalesce(F.array_max(F.transform(F.split(whole, "[^wWxX]+"), F.char_length)), F.lit(0))


def _is_data_row(line: Column) -> Column:
    """A row between bars with something in it, or a label, if any of words, before a value of words or digits."""
    label, value = F.trim(F.substring_index(line, ":", 1)), F.trim(F.regexp_replace(line, "^[^:]*:", ""))
    worded = lambda x: classes(x).rlike("[wWxX]")
    pair = F.contains(line, F.lit(":")) & (value != "") & (F.char_length(label) <= 80) & ((label == "") | worded(label)) & (value.rlike("[0-9]") | worded(value))
    return F.when(line.rlike(BARS), line.rlike("[\\p{L}0-9]")).otherwise(pair)


def assessed(docs: DataFrame) -> DataFrame:
    """doc_id, kind, clause (longest run of words), ok and reason of every text.

    The first that holds: empty; unsupported script; prose by a clause of six words, of three in at most twelve; a table by rows of
    data, by short lines under a caption or header, by dense columns or by a row of numbers; data, where a real word stands with a row
    of data, a word of requirement or a measured value; a list of tags. Anything else has no clause. Null is empty; each token is
    classed once.
    """
    t = docs.select("doc_id", F.coalesce(fx.normalise(F.col("text")), F.lit("")).alias("text"))
    ls = F.filter(F.transform(fx.lines(F.col("text")), lambda x: F.trim(F.regexp_replace(x, "[\t\r]", " "))), lambda x: x != "")
    t = t.select("doc_id", "text", classes(F.col("text")).alias("code"), ls.alias("ls"))
    n_of = lambda test: F.size(F.filter("ls", test))
    letters, arabic = fx.count_chars(F.col("text"), r"\p{L}+"), fx.count_chars(F.col("text"), f"{ARABIC}+")
    foreign = F.col("text").rlike(ARABIC) & (letters >= 20) & (arabic > 0.5 * letters)
    header = F.exists(F.slice("ls", 1, HEADERS), lambda x: (F.char_length(x) <= SHORT_LINE) & ~x.rlike("[0-9]"))
    s = t.select(
        "doc_id", "code", "text", longest_clause(F.col("code")).alias("clause"), F.char_length("code").alias("n"), F.size("ls").alias("n_lines"), foreign.alias("foreign"),
        n_of(_is_data_row).alias("rows"), n_of(lambda x: x.rlike(NUMERIC) & ~x.rlike("[.,]$")).alias("cells"), n_of(lambda x: F.char_length(x) <= SHORT_LINE).alias("short"), (header | F.col("text").rlike(LABEL)).alias("named"),
        _of(F.col("code"), "bn").alias("numbers"), _of(F.col("code"), "t").alias("tags"), _of(F.col("code"), "^e").alias("solid"))
    table = (
        F.when((F.col("rows") >= 2) & (F.col("rows") >= 0.6 * F.col("n_lines")), "rows of data")
        .when((F.col("short") >= 0.6 * F.col("n_lines")) & (F.col("cells") >= 3) & F.col("named"), "named columns")
        .when((F.col("short") >= 0.9 * F.col("n_lines")) & (F.col("cells") >= 0.55 * F.col("n_lines")) & (F.col("n_lines") >= 8), "dense columns")
        .when((F.col("numbers") >= 6) & (F.col("numbers") >= 0.7 * F.col("n")), "row of numbers")
    )
    stated = F.col("code").rlike("[wW]") & ((F.col("rows") > 0) | F.col("text").rlike(REQUIREMENT) | F.col("text").rlike(VALUE))
    listed = (F.col("tags") >= LEAST_TAGS) & (F.col("tags") >= 0.8 * F.col("solid"))
    kind = (
        F.when(F.col("n") == 0, "empty").when(F.col("foreign"), "unsupported script").when(F.col("clause") >= F.when(F.col("n") <= 12, 3).otherwise(6), "prose")
        .when(table.isNotNull(), table).when(stated, "data").when(listed, "tags").otherwise("no clause")
    )
    out = s.select("doc_id", kind.alias("kind"), "clause")
    ok = ~F.col("kind").isin("empty", "unsupported script", "no clause")
    return out.select("doc_id", "kind", "clause", ok.alias("ok"), F.when(~ok, F.col("kind")).alias("reason"))
