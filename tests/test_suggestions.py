"""Spelling suggestions for words of any length, against brute force over all terms."""

import numpy as np

from veridoc.operators import retrieval as ret
from veridoc.plans import registers

RNG = np.random.default_rng(142)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(word, n):
    w = list(word)
    for _ in range(n):
        at, kind = int(RNG.integers(0, len(w))), RNG.integers(0, 3)
        w[at : at + (kind != 0)] = [] if kind == 1 else [RNG.choice(list("abcé"))]
    return "".join(w)


def test_words_of_any_length_against_brute_force(spark):
    terms = ["".join(RNG.choice(list("abcé"), int(n))) for n in RNG.integers(4, 40, 150)]
    asked = sorted({edited(RNG.choice(terms), int(RNG.integers(0, 4))) for _ in range(200)} | {"abc", "ab1cd", "zzzzzzzzzzzzzzzzzz"})
    df = {t: int(RNG.integers(1, 9)) for t in terms}
    got = ret.suggestions(spark.createDataFrame([(w,) for w in asked], "word string"), spark.createDataFrame(list(df.items()), "term string, df long")).collect()
    want = []
    for w in asked:
        if w in df or len(w) < 4 or not w.isalpha():
            continue
        near = min(((distance(w, t), -n, t) for t, n in df.items() if abs(len(t) - len(w)) <= 2), default=(9, 0, ""))
        want += [(w, near[2], near[0])] if near[0] <= 2 else []
    assert sorted(map(tuple, got)) == sorted(want) and sum(len(w) > 12 for w, _, _ in want) > 20


def test_a_word_of_twenty_thousand_letters(spark):
    long = "".join(RNG.choice(list("abcdefgh"), 20_000))
    known = [(long, 3), (long[:5000] + "x" + long[5001:] + "y", 9), ("y" * 20_000, 4), ("short", 2)]
    asked = [(long[:-1] + "é",), ("shrt",), ("q" * 20_000,)]
    got = ret.suggestions(spark.createDataFrame(asked, "word string"), spark.createDataFrame(known, "term string, df long")).collect()
    assert {r["word"][:5]: (r["suggestion"][-3:], r["edits"]) for r in got} == {long[:5]: (long[-3:], 1), "shrt": ("ort", 1)}
    none = spark.createDataFrame([], "word string")
    assert ret.suggestions(none, spark.createDataFrame(known, "term string, df long")).count() == 0


def test_keys_past_the_first_plane_and_on_both_sides_of_the_lengths(spark):
    terms = ["".join(RNG.choice(list("aß𝐱é"), int(n))) for n in RNG.integers(9, 18, 120)]
    asked = sorted({edited(RNG.choice(terms), 2) for _ in range(120)} - set(terms))
    got = ret.suggestions(spark.createDataFrame([(w,) for w in asked], "word string"), spark.createDataFrame([(t, 1) for t in set(terms)], "term string, df long")).collect()
    near = {w: min((distance(w, t), t) for t in terms) for w in asked}
    assert sorted((r["word"], r["edits"], r["suggestion"]) for r in got) == sorted((w, *x) for w, x in near.items() if x[0] <= 2) and len(got) > 60


def test_documents_are_read_once_and_only_met_keys_are_shuffled(spark, sf_dir):
    plan = registers.spelling_suggestions(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "source#" not in plan and "lambdafunction" not in plan and plan.count("MapInArrow") == 1
    keys = spark.createDataFrame([(int(k),) for k in RNG.integers(-(2**63), 2**63 - 1, 500)] + [(-1,), (0,)], "key long")
    n, bits = ret._key_bits(keys)
    at = {(r["key"] % 2**64) >> (64 - n) for r in keys.collect()}
    assert len(bits) * 8 == 1 << n and {8 * int(i) + b for i in np.nonzero(bits)[0] for b in range(8) if bits[i] >> b & 1} == at
