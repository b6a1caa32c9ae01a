"""Chunks of sentences with a carried overlap, tables cut on rows, and passages grown around a chunk.

A document's lines make sections (a line of a few words is a heading) and, within them,
blocks of prose and of table rows. No chunk leaves its block, so none crosses a section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.rules import Steps, rewrite

#: Tokens of a chunk: aimed at, carried over from the one before, at most, and least for one of its own.
TARGET, OVERLAP, MOST, RUNT = 300, 60, 480, 40
#: A heading has at most so many tokens, a table row so many bars at least, and a header to repeat at most so many tokens.
HEADING, BARS, HEADER = 4, 2, 120
#: Characters of a passage that is shown.
BUDGET = 2400


def _size(text: Column) -> Column:
    return F.size(fx.white_tokens(text))


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, section (0 before the first heading), block, kind (prose, table) and lines of every block of `docs` (doc_id, text).

    Blocks are numbered through a document; blank lines and headings are in none. A null or empty text has none.
    """
    lines = docs.select("doc_id", F.posexplode(fx.lines(F.col("text"))).alias("pos", "line")).filter(_size(F.col("line")) > 0)
    bars = F.char_length("line") - F.char_length(F.replace(F.col("line"), F.lit("|"), F.lit("")))
    kind = F.when(bars >= BARS, "table").when(_size(F.col("line")) <= HEADING, "heading").otherwise("prose")
    w = Window.partitionBy("doc_id").orderBy("pos")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("kind", kind).withColumn("section", F.sum((F.col("kind") == "heading").cast("int")).over(so_far).cast("int"))
    new = F.coalesce((F.lag("kind").over(w) != F.col("kind")) | (F.lag("section").over(w) != F.col("section")), F.lit(True))
    run = named.withColumn("new", new.cast("int")).withColumn("block", F.sum("new").over(so_far).cast("int")).filter("kind <> 'heading'")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return run.groupBy("doc_id", "section", "block", "kind").agg(texts.alias("lines"))


def _pieces(unit: Column, most: Column) -> Column:
    """A unit as it is, or cut on its words where it has more than `most` tokens."""
    words = fx.white_tokens(unit)
    last = F.floor((F.size(words) - 1) / most).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, (i * most + 1).cast("int"), most.cast("int")), " "))
    return F.when(F.size(words) > most, cut).otherwise(F.array(unit))


def _carried(sizes: Column, start: Column, i: Column) -> Column:
    """How many units just before `i`, none before `start`, have OVERLAP tokens at most; each has one at least."""
    first = F.greatest(start, i - OVERLAP)
    back = F.reverse(F.slice(sizes, first + 1, i - first))
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"))
    step = lambda acc, x: F.struct((acc["n"] + (acc["sum"] + x <= OVERLAP).cast("int")).alias("n"), (acc["sum"] + x).alias("sum"))
    return F.aggregate(back, state, step, lambda acc: acc["n"])


def _total(sizes: Column, first: Column, n: Column) -> Column:
    return F.aggregate(F.slice(sizes, first + 1, n), F.lit(0), lambda a, x: a + x)


def _cuts(sizes: Column, table: Column, lead: Column) -> Column:
    """Chunks of one block as structs of start (its first unit, carried ones included), fresh (the first new one) and end.

    A running fold over the block's sizes: only where a chunk closes is anything copied.
    """
    of = lambda start, fresh, end: F.struct(start.cast("int").alias("start"), fresh.cast("int").alias("fresh"), end.cast("int").alias("end"))
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("start"), F.lit(0).alias("fresh"), lead.cast("int").alias("sum"), F.array().cast("array<struct<start:int,fresh:int,end:int>>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        i = acc["i"]
        fits = (i == acc["fresh"]) | (acc["sum"] + n <= TARGET)
        k = F.when(table, F.lit(0)).otherwise(_carried(sizes, acc["start"], i))
        carried = _total(sizes, i - k, k)
        k, carried = (F.when(carried + n <= MOST, x).otherwise(0) for x in (k, carried))
        go_on = F.struct((i + 1).alias("i"), acc["start"].alias("start"), acc["fresh"].alias("fresh"), (acc["sum"] + n).alias("sum"), acc["out"].alias("out"))
        out = F.concat(acc["out"], F.array(of(acc["start"], acc["fresh"], i)))
        close = F.struct((i + 1).alias("i"), (i - k).alias("start"), i.alias("fresh"), (lead + carried + n).cast("int").alias("sum"), out.alias("out"))
        return F.when(fits, go_on).otherwise(close)

    def finish(acc: Column) -> Column:
        n, last = F.size(sizes), F.get(acc["out"], F.size(acc["out"]) - 1)
        fresh, whole = (_total(sizes, i, n - i) for i in (acc["fresh"], F.coalesce(last["start"], F.lit(0))))
        joins = ~table & (F.size(acc["out"]) > 0) & (fresh < RUNT) & (whole <= MOST)
        joined = F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(of(last["start"], last["fresh"], n)))
        return F.when(F.coalesce(joins, F.lit(False)), joined).otherwise(F.concat(acc["out"], F.array(of(acc["start"], acc["fresh"], n))))

    return F.aggregate(sizes, zero, step, finish)


def sentence_chunks(docs: DataFrame, sentences: Steps) -> DataFrame:
    """doc_id, ordinal, section, block, kind, chunk, n_tokens and n_carried of every chunk of `docs` (doc_id, text), numbered through a document.

    Prose is filled sentence by sentence up to TARGET tokens; a chunk begins with the last whole
    sentences, of OVERLAP tokens at most, of the one before. What is left at a block's end with
    fewer than RUNT new tokens joins the chunk before it. Table rows are filled alike, without
    overlap, behind the table's first row, which every piece repeats. No chunk has more than
    MOST tokens: a longer sentence or row is cut on its words. `sentences` are the steps that
    put each sentence on a line of its own.
    """
    prose = F.flatten(F.transform("lines", lambda x: F.transform(F.split(rewrite(x, sentences), "\n"), lambda y: F.trim(y))))  # F.trim itself would take the place as the signs to trim
    table = F.col("kind") == "table"
    headed = table & (F.size("lines") > 1) & (_size(F.get("lines", F.lit(0))) <= HEADER)
    units = F.when(headed, F.slice("lines", F.lit(2), F.size("lines"))).when(table, F.col("lines")).otherwise(F.filter(prose, lambda x: x != ""))
    made = blocks(docs).withColumn("head", F.when(headed, F.get("lines", F.lit(0)))).withColumn("units", units)
    room = F.lit(MOST) - F.coalesce(_size(F.col("head")), F.lit(0))  # a row has room behind the header it follows
    made = made.withColumn("units", F.flatten(F.transform("units", lambda u: _pieces(u, room))))
    made = made.withColumn("sizes", F.transform("units", _size)).withColumn("lead", F.when(F.col("head").isNotNull(), _size(F.col("head"))).otherwise(0))
    cut = made.withColumn("cut", F.explode(_cuts(F.col("sizes"), table, F.col("lead"))))
    mine = lambda c: F.slice(c, F.col("cut.start") + 1, F.col("cut.end") - F.col("cut.start"))
    body = F.when(table, F.array_join(mine("units"), "\n")).otherwise(F.array_join(mine("units"), " "))
    n = F.col("lead") + _total(F.col("sizes"), F.col("cut.start"), F.col("cut.end") - F.col("cut.start"))
    ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy("block", "cut.end")) - 1
    return cut.select(
        "doc_id", ordinal.alias("ordinal"), "section", "block", "kind", F.concat_ws("\n", "head", body).alias("chunk"),
        n.alias("n_tokens"), _total(F.col("sizes"), F.col("cut.start"), F.col("cut.fresh") - F.col("cut.start")).alias("n_carried"),
    )


def grown(chunks: DataFrame, budget: int = BUDGET) -> DataFrame:
    """doc_id, ordinal, first, last, n_joined, passage and match_start for every chunk: what is shown around it.

    First the chunk's own block, a step back and a step on by turns while the next step fits the
    budget of characters; then neighbours of the same section, on and back by turns, each side
    until one does not fit. What a chunk repeats of the one before is shown once; other chunks
    are parted by a blank line. The chunk itself is always whole, also where it exceeds the
    budget; match_start is where it begins in the passage. A step that adds nothing counts as one
    of the `budget` steps that either side has. A section is one task's row.
    """
    w = Window.partitionBy("doc_id", "section").orderBy("ordinal")
    rows = chunks.withColumn("before", F.lag("chunk").over(w))
    rows = rows.withColumn("shared", F.coalesce(fx.shared_edge(F.col("before"), F.col("chunk")), F.lit(0))).drop("before")
    part = F.array_sort(F.collect_list(F.struct("ordinal", "block", "chunk", "shared")))
    sections = rows.groupBy("doc_id", "section").agg(part.alias("rows")).withColumn("n", F.size("rows"))
    # what a chunk adds behind the one before it, and the one before it in front of it
    sections = sections.withColumn("own", F.transform("rows", lambda r: F.char_length(r["chunk"])))
    sections = sections.withColumn("gap", F.transform("rows", lambda r: F.when(r["shared"] > 0, -r["shared"]).otherwise(2)))
    sections = sections.withColumn("blocks", F.transform("rows", lambda r: r["block"]))
    hit = sections.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    more = lambda i: F.get("own", i) + F.get("gap", i)  # behind i - 1
    less = lambda lo: F.get("own", lo - 1) + F.get("gap", lo)  # in front of lo
    state = lambda lo, hi, size, back, on: F.struct(lo.alias("lo"), hi.alias("hi"), size.alias("size"), back.alias("back"), on.alias("on"))
    yes, no = F.lit(True), F.lit(False)
    zero = state(F.col("at"), F.col("at"), F.get("own", F.col("at")), yes, yes)
    turns = F.sequence(F.lit(0), 2 * F.least(F.col("n"), F.lit(budget)))

    def within(acc: Column, turn: Column) -> Column:
        mine = F.get("blocks", F.col("at"))
        can_lo = (acc["lo"] > 0) & (F.get("blocks", acc["lo"] - 1) == mine)
        can_hi = (acc["hi"] + 1 < F.col("n")) & (F.get("blocks", acc["hi"] + 1) == mine)
        can_lo, can_hi = F.coalesce(can_lo, no), F.coalesce(can_hi, no)
        go_lo = can_lo & ((F.col("at") - acc["lo"] <= acc["hi"] - F.col("at")) | ~can_hi)
        fits_lo, fits_hi = acc["size"] + less(acc["lo"]) <= budget, acc["size"] + more(acc["hi"] + 1) <= budget
        stop = state(acc["lo"], acc["hi"], acc["size"], no, no)
        return (
            F.when(~acc["back"] | ~(can_lo | can_hi), stop)
            .when(go_lo & fits_lo, state(acc["lo"] - 1, acc["hi"], acc["size"] + less(acc["lo"]), yes, yes))
            .when(~go_lo & fits_hi, state(acc["lo"], acc["hi"] + 1, acc["size"] + more(acc["hi"] + 1), yes, yes))
            .otherwise(stop)
        )

    def beyond(acc: Column, turn: Column) -> Column:
        on = acc["on"] & F.coalesce((acc["hi"] + 1 < F.col("n")) & (acc["size"] + more(acc["hi"] + 1) <= budget), no)
        back = acc["back"] & F.coalesce((acc["lo"] > 0) & (acc["size"] + less(acc["lo"]) <= budget), no)
        right = state(acc["lo"], acc["hi"] + 1, acc["size"] + more(acc["hi"] + 1), acc["back"], yes)
        left = state(acc["lo"] - 1, acc["hi"], acc["size"] + less(acc["lo"]), yes, acc["on"])
        # even turns go on, odd ones back; a side that doesn't fit stays closed, as the passage only grows
        of_right = F.when(on, right).otherwise(state(acc["lo"], acc["hi"], acc["size"], acc["back"], no))
        of_left = F.when(back, left).otherwise(state(acc["lo"], acc["hi"], acc["size"], no, acc["on"]))
        return F.when(turn % 2 == 0, of_right).otherwise(of_left)

    own = hit.withColumn("x", F.aggregate(turns, zero, within))
    opened = state(F.col("x.lo"), F.col("x.hi"), F.col("x.size"), yes, yes)
    both = own.withColumn("x", F.aggregate(turns, opened, beyond))
    member = F.slice("rows", F.col("x.lo") + 1, F.col("x.hi") - F.col("x.lo") + 1)
    shown = F.transform(member, lambda r, i: F.when(i == 0, r["chunk"]).when(r["shared"] > 0, F.substr(r["chunk"], r["shared"] + 1)).otherwise(F.concat(F.lit("\n\n"), r["chunk"])))
    ahead = F.aggregate(F.slice("gap", F.col("x.lo") + 2, F.col("at") - F.col("x.lo")), F.lit(0), lambda a, x: a + x)
    start = F.aggregate(F.slice("own", F.col("x.lo") + 1, F.col("at") - F.col("x.lo")), ahead, lambda a, x: a + x)
    ordinal = lambda i: F.get("rows", i)["ordinal"]
    return both.select(
        "doc_id", ordinal(F.col("at")).alias("ordinal"), ordinal(F.col("x.lo")).alias("first"), ordinal(F.col("x.hi")).alias("last"),
        (F.col("x.hi") - F.col("x.lo") + 1).alias("n_joined"), F.array_join(shown, "").alias("passage"), start.alias("match_start"),
    )
