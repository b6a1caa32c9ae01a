"""Chunks with a carried overlap, tables cut on rows, and passages grown within a budget, on small cases and against plain loops."""

import numpy as np
import pytest

from veridoc.operators import chunks
from veridoc.plans.figures import MASKED

RNG = np.random.default_rng(89)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def made(spark, *texts):
    rows = chunks.sentence_chunks(frame(spark, texts), MASKED).collect()
    return sorted(rows, key=lambda r: (r["doc_id"], r["ordinal"]))


def sentence(n, word="word"):
    return " ".join(f"{word}{i}" for i in range(n)) + "."


def test_a_chunk_begins_with_the_last_sentences_of_the_one_before(spark):
    text = " ".join(sentence(50, f"s{k}x") for k in range(16))
    got = made(spark, text)
    assert [r["n_tokens"] for r in got] == [300, 300, 300] and [r["n_carried"] for r in got] == [0, 50, 50]
    for a, b in zip(got, got[1:]):
        assert a["chunk"].endswith(b["chunk"][: b["chunk"].index(".") + 1])
    text = " ".join(sentence(100, f"s{k}x") for k in range(5))  # no sentence is short enough to carry
    assert [(r["n_tokens"], r["n_carried"]) for r in made(spark, text)] == [(300, 0), (200, 0)]


def test_a_runt_joins_its_neighbour_and_never_another_section(spark):
    long = " ".join(sentence(100, f"s{k}x") for k in range(3))
    assert [r["n_tokens"] for r in made(spark, long + " " + sentence(39))] == [339]
    assert [r["n_tokens"] for r in made(spark, long + " " + sentence(40))] == [300, 40]
    got = made(spark, f"{long}\n4.2 Nuts\n{sentence(7)}")
    assert [(r["n_tokens"], r["section"]) for r in got] == [(300, 0), (7, 1)]


def test_a_sentence_of_more_than_the_most_is_cut_on_words(spark):
    got = made(spark, sentence(1100))
    assert [r["n_tokens"] for r in got] == [480, 480, 140]
    assert " ".join(r["chunk"] for r in got) == sentence(1100)


def test_an_abbreviation_ends_no_sentence(spark):
    text = f"{sentence(290)} See Fig. 3 and para. 4 of it, e.g. the approved list of them. {sentence(40)}"
    assert made(spark, text)[1]["chunk"].startswith("See Fig. 3 and para. 4 of it, e.g. the approved list")


def test_a_table_is_split_on_rows_with_its_header_repeated(spark):
    header = "| System | Primer | Total |"
    rows = [f"| CS-{k:02d} | zinc rich {k} | {k} um |" for k in range(80)]
    got = made(spark, "\n".join(["Prose of five tokens stands here.", header, *rows, "Prose of five tokens stands there."]))
    tables = [r for r in got if r["kind"] == "table"]
    assert len(tables) >= 3 and all(r["chunk"].split("\n")[0] == header and r["n_tokens"] <= chunks.TARGET for r in tables)
    assert [x for r in tables for x in r["chunk"].split("\n")[1:]] == rows
    assert [r["kind"] for r in got] == ["prose", *["table"] * len(tables), "prose"]


def test_edges(spark):
    assert made(spark, None, "", " \n\t\n ", "Only a heading") == []
    assert [(r["kind"], r["chunk"]) for r in made(spark, "a | b | c")] == [("table", "a | b | c")]
    wide = "| " + " ".join(["head"] * 200) + " |"
    assert all(r["n_tokens"] <= chunks.MOST for r in made(spark, f"{wide}\n| " + " | ".join(map(str, range(900)))))


def test_random_texts_keep_every_word_once_and_every_bound(spark):
    texts = []
    for _ in range(40):
        lines = []
        for _ in range(RNG.integers(1, 30)):
            kind = RNG.integers(0, 6)
            lines.append(sentence(int(RNG.integers(1, 4)), "h") if kind == 0 else "| " + " | ".join(map(str, RNG.integers(0, 99, RNG.integers(2, 60)))) + " |" if kind == 1 else " ".join(sentence(int(RNG.integers(1, 90)), "p") for _ in range(RNG.integers(1, 12))))
        texts.append("\n".join(lines))
    got = made(spark, *texts)
    assert max(r["n_tokens"] for r in got) <= chunks.MOST and all(r["n_tokens"] == len(r["chunk"].split()) for r in got)
    blocks = {(r["doc_id"], r["block"]): r for r in chunks.blocks(frame(spark, texts)).collect()}
    for key, block in blocks.items():
        mine = [r for r in got if (r["doc_id"], r["block"]) == key]
        assert {r["section"] for r in mine} == {block["section"]}
        new = [w for r in mine for w in r["chunk"].split()[(r["n_carried"] if r["kind"] == "prose" else len(block["lines"][0].split()) if r["chunk"].startswith(block["lines"][0] + "\n") else 0) :]]
        words = " ".join(block["lines"]).split()
        if block["kind"] == "table" and any(r["chunk"].startswith(block["lines"][0] + "\n") for r in mine):
            words = words[len(block["lines"][0].split()) :]
        assert new == words
        for a, b in zip(mine, mine[1:]):
            assert b["n_carried"] <= chunks.OVERLAP and b["chunk"].split()[: b["n_carried"]] == a["chunk"].split()[len(a["chunk"].split()) - b["n_carried"] :]


def shared(a, b):
    if min(len(a), len(b)) < 20:
        return 0
    found = [n for n in range(20, min(len(a), len(b)) + 1) if a.endswith(b[:n]) and (n == len(b) or not (b[n].isalnum() and b[n - 1].isalnum()))]
    return max(found, default=0)


def shown(rows, at, budget):
    """The passage around a chunk, by a plain loop: (first, last, text, where the chunk begins)."""
    over = [0] + [shared(a["chunk"], b["chunk"]) for a, b in zip(rows, rows[1:])]
    size = lambda lo, hi: sum(len(r["chunk"]) for r in rows[lo : hi + 1]) + sum(-over[i] if over[i] else 2 for i in range(lo + 1, hi + 1))
    lo = hi = at
    block = lambda i: 0 <= i < len(rows) and rows[i]["block"] == rows[at]["block"]
    while block(lo - 1):
        lo -= 1
    while block(hi + 1):
        hi += 1
    while size(lo, hi) > budget and (lo < at or hi > at):  # the block, trimmed towards the chunk
        if hi > at and hi - at >= at - lo:
            hi -= 1
        else:
            lo += 1
    while True:
        before = lo, hi
        if hi + 1 < len(rows) and size(lo, hi + 1) <= budget:
            hi += 1
        if lo > 0 and size(lo - 1, hi) <= budget:
            lo -= 1
        if before == (lo, hi):
            break
    text, start = rows[lo]["chunk"], 0
    for i in range(lo + 1, hi + 1):
        start = (len(text) - over[i] if over[i] else len(text) + 2) if i == at else start
        text += rows[i]["chunk"][over[i] :] if over[i] else "\n\n" + rows[i]["chunk"]
    return rows[lo]["ordinal"], rows[hi]["ordinal"], text, start


@pytest.mark.parametrize("budget", [60, 400, 2400])
def test_passages_equal_a_plain_loop(spark, budget):
    rows = []
    for doc in range(12):
        text = "start of the document"
        for i in range(int(RNG.integers(1, 14))):
            carry = text[-int(RNG.integers(20, 40)) :] if RNG.random() < 0.5 and len(text) > 40 else ""
            text = carry + " ".join(RNG.choice(["tide", "lamp.", "a|b", r"\E[x", "rope (b)", "Ölfass"], RNG.integers(1, 25)))
            rows.append((doc, i, i // 5, i // 2 if doc % 2 else i // 5, "prose", text))
    df = spark.createDataFrame(rows, "doc_id long, ordinal int, section int, block int, kind string, chunk string")
    got = {(r["doc_id"], r["ordinal"]): r for r in chunks.grown(df, budget).collect()}
    assert len(got) == len(rows)
    for doc, i, section, *_ in rows:
        mine = [dict(zip(df.columns, r)) for r in rows if r[0] == doc and r[2] == section]
        at = next(k for k, r in enumerate(mine) if r["ordinal"] == i)
        r = got[doc, i]
        assert (r["first"], r["last"], r["passage"], r["match_start"]) == shown(mine, at, budget)
        assert r["passage"][r["match_start"] :].startswith(mine[at]["chunk"]) and r["n_joined"] == r["last"] - r["first"] + 1
        assert len(r["passage"]) <= max(budget, len(mine[at]["chunk"]))


def test_boundary_texts_with_pattern_signs(spark):
    from pyspark.sql import functions as F

    from veridoc.functions.text import shared_edge

    cases = [("x" * 30 + r"\E[ab(c" * 5, r"\E[ab(c" * 5 + " tail"), ("a" * 20_000, "a" * 20_000), ("no edge here at all", "something else entirely"), (r"end \Q of .* it ^$ here and on", r"of .* it ^$ here and on we go")]
    df = spark.createDataFrame(cases, "a string, b string").select("a", "b", shared_edge(F.col("a"), F.col("b")).alias("n"))
    assert [r["n"] for r in df.collect()] == [shared(a, b) for a, b in cases]


def test_digits_at_the_edges_of_a_sentence_stay(spark):
    text = "0 of them is written here. 16.1 is a number of the bolt 2. 29 more are listed in part 12"
    assert [r["chunk"] for r in made(spark, text)] == [text]
