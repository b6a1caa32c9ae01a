"""Sections at headings of any kind, and the lines that look like headings and are none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import first_rule
from ..sources.shared import kept

#: Titles by kind; the first that holds. A code or a word of an attachment, a caption of a table or figure, a numbered item.
KINDS = [
    ("^[A-Z0-9]+(-[A-Z0-9]+)*-(ATT|APP|ANNEX)[0-9]{1,3} - [^ ]", "coded"),
    ("^(?i:attachment|appendix|annex) ([A-Z]|[0-9]{1,2})( -|:|[.]) [^ ]", "worded"),
    ("^(?i:table) [A-Z]?[0-9]{1,3}([.][0-9]{1,3})*(:| -|[.]) [^ ]", "table"),
    ("^(?i:figure) [A-Z]?[0-9]{1,3}([.][0-9]{1,3})*(:| -|[.]) [^ ]", "figure"),
    ("^[0-9]{1,2}[.] [A-Z][A-Za-z]+( [A-Za-z]+){0,5}$", "item"),
]
#: Ends of a line of contents: leaders or a tab before a page number, or the number alone.
LEADERS, NUMBERED = "([.]{2,}|…|\t)[ \t]*[0-9]{1,4}[ \t]*$", "[ \t][0-9]{1,3}$"
#: Titles of more letters are prose; runs of as many headings are lists; lines on as many pages are running ones.
LONGEST, RUN, PAGES = 160, 3, 3


def flat(line: Column) -> Column:
    """A line as it is compared: white space single, every dash a hyphen."""
    hyphens = F.replace(F.replace(line, F.lit("–"), F.lit("-")), F.lit("—"), F.lit("-"))
    # a single blank is left as it is: most are, and each match costs
    return F.trim(F.regexp_replace(hyphens, " [ \t\r]+|[\t\r][ \t\r]*", " "))


def title_lines(pages: DataFrame) -> DataFrame:
    """Non-blank lines of pages in order with what kind of title each is, and why one that looks like a title is none.

    `pages` has doc_id, page and text. Of a line: `contents entry` where a page number ends it, `running` where PAGES pages of its
    document have it, `contents run` where it stands among RUN or more such lines with no other text between (running lines and
    blank ones aside, over page breaks too), `item of a list` where it is a numbered item with no attachment's title before it.
    A null text has no lines; two pages of one number are one page, their lines by text; empty tables give no rows.
    """
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    # what flat leaves empty is told by the line itself, so that no title is made twice
    k = lines.filter(F.col("raw").rlike("[^ \t\r]")).select("doc_id", "page", "line", "raw", flat(F.col("raw")).alias("title"))
    k = k.withColumn("kind", F.when(F.char_length("title") <= LONGEST, first_rule(F.col("title"), KINDS)))
    entry = F.when(F.col("kind").isNotNull(), F.col("raw").rlike(LEADERS) | F.col("title").rlike(NUMBERED))
    k, entry = kept(k.select("doc_id", "page", "line", "title", "kind", entry.alias("entry")), "lines"), F.col("entry")
    alike = k.filter("kind is not null").groupBy("doc_id", "title").agg(F.count_distinct("page").alias("n")).filter(F.col("n") >= PAGES).select("doc_id", "title", F.lit(True).alias("running"))
    k = k.join(alike, ["doc_id", "title"], "left").withColumn("running", F.coalesce("running", F.lit(False)))
    k = k.withColumn("like", F.col("kind").isNotNull() & ~entry & ~F.col("running"))
    order = Window.partitionBy("doc_id").orderBy("page", "line", "title").rowsBetween(Window.unboundedPreceding, 0)
    # what is not alike and not running ends a run: runs are numbered by how many such lines stand before
    k = k.withColumn("island", F.sum((~F.col("like") & ~F.col("running")).cast("long")).over(order))
    k = k.withColumn("n_run", F.sum(F.col("like").cast("long")).over(Window.partitionBy("doc_id", "island")))
    k = k.withColumn("single", F.col("like") & (F.col("n_run") < RUN))
    attached = F.max((F.col("single") & F.col("kind").isin("coded", "worded")).cast("int")).over(order)
    reason = (
        F.when(F.col("kind").isNull(), None).when(entry, "contents entry").when(F.col("running"), "running")
        .when(F.col("n_run") >= RUN, "contents run").when((F.col("kind") == "item") & (attached == 0), "item of a list")
    )
    return k.withColumn("reason", reason).select("doc_id", "page", "line", "title", "kind", "reason")


def refined_sections(lines: DataFrame) -> DataFrame:
    """The sections that `title_lines` cuts: heading, kind, pages, the title it stands under, and whether it may be a section's own.

    Text before the first heading is section 0, with no heading. A section's last page is the one on which the next begins.
    `parent` is the attachment that an item, table or figure stands in; a caption is never a section of its own (`citable`).
    """
    order = Window.partitionBy("doc_id").orderBy("page", "line", "title").rowsBetween(Window.unboundedPreceding, 0)
    heads = F.col("kind").isNotNull() & F.col("reason").isNull()
    k = lines.withColumn("heads", heads).withColumn("section", F.sum(F.col("heads").cast("long")).over(order))
    k = k.withColumn("attachment", F.last(F.when(F.col("heads") & F.col("kind").isin("coded", "worded"), F.col("title")), ignorenulls=True).over(order))
    s = k.groupBy("doc_id", "section").agg(
        F.max(F.when(F.col("heads"), F.col("title"))).alias("heading"), F.max(F.when(F.col("heads"), F.col("kind"))).alias("kind"), F.max("attachment").alias("attachment"),
        F.min("page").alias("page_start"), F.max("page").alias("own_end"), F.count(F.lit(1)).alias("n_lines"))
    following = F.lead("page_start").over(Window.partitionBy("doc_id").orderBy("section"))
    parent = F.when(~F.col("kind").isin("coded", "worded"), F.col("attachment"))
    return s.select("doc_id", "section", "heading", "kind", parent.alias("parent"), "page_start", F.coalesce(following, "own_end").alias("page_end"), "n_lines", F.coalesce(~F.col("kind").isin("table", "figure"), F.lit(False)).alias("citable"))


def section_texts(lines: DataFrame) -> DataFrame:
    """Each section with its lines joined; one section's lines are one row, so no more than a document's."""
    order = Window.partitionBy("doc_id").orderBy("page", "line", "title").rowsBetween(Window.unboundedPreceding, 0)
    k = lines.withColumn("section", F.sum((F.col("kind").isNotNull() & F.col("reason").isNull()).cast("long")).over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line", "title"))), lambda x: x["title"]), "\n")
    return k.groupBy("doc_id", "section").agg(text.alias("text"))
