"""Alignment of two tokenizers against brute force: every pair of overlapping byte ranges, every common end."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veridoc.llm import alignment, tokens

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
RNG = np.random.default_rng(13)
TEXTS = [None, "", " ", "a", "a  b", " lead", "trail ", "x\ny z\n\nq", "don't 12.5% <|endoftext|> ok", "<s> </s> <unk> <0x0A>", "Été à Ñ ΣΑΣ ﬁ", "a\x1cb c"]
TEXTS += ["a▁b c", "b ▁c", "日本語 text \U0001f600 x", "tab\tin it", "a \n b", "\nfoo bar", ";\r x);\r\n y", "é́ é", "x" * 3000, "\x00 a", "﻿x y", "the of " * 400, "one", "one"]
TEXTS += ["".join(RNG.choice(list(" ab.é\n▁1'漢<>|"), RNG.integers(0, 40))) for _ in range(300)]


@pytest.fixture(scope="module")
def both():
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    return tok, tokens.byte_decoded(tok), sentencepiece.SentencePieceProcessor(model_file=B)


def spans(parts):
    ends = np.cumsum([len(p) for p in parts]).tolist()
    return list(zip([0, *ends], ends))


def brute(text, both):
    """n_a, n_b, n_groups, linked id pairs and groups as text, token by token."""
    tok, bytes_a, model = both
    if not text:
        return 0, 0, 0, [], ""
    a, b = tok.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
    raw_a = [bytes_a[i] for i in a]
    raw_b = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return 0, 0, 0, [], ""
    at_a, at_b = spans(raw_a), spans(raw_b)
    links = [(x, y) for x, (s, e) in zip(a, at_a) for y, (p, q) in zip(b, at_b) if s < q and p < e]
    shown, begin = [], 0
    for end in sorted({e for _, e in at_a} & {e for _, e in at_b}):
        mine = [",".join(str(x) for x, (_, e) in zip(ids, at) if begin < e <= end) for ids, at in ((a, at_a), (b, at_b))]
        shown.append("|".join(mine))
        begin = end
    return len(a), len(b), len(shown), links, ";".join(shown)


def test_diagonals_find_every_common_end():
    for n in (0, 1, 7, 60, 400):
        for share in (0.0, 0.1, 0.5, 1.0):
            ends = np.flatnonzero(RNG.random(n) < 0.5)
            drop_a, drop_b = RNG.random(len(ends)) < share / 2, RNG.random(len(ends)) < share / 2
            a, b = (sorted({*ends[~d].tolist(), n}) for d in (drop_a, drop_b))
            stops_a, stops_b, links_a, links_b = alignment.diagonal_groups(a, b)
            common = sorted(set(a) & set(b))
            assert [a[i - 1] for i in stops_a] == [b[j - 1] for j in stops_b] == common
            at_a, at_b = spans([[0] * k for k in np.diff([-1, *a])]), spans([[0] * k for k in np.diff([-1, *b])])
            assert list(zip(links_a, links_b)) == [(i, j) for i, (s, e) in enumerate(at_a) for j, (p, q) in enumerate(at_b) if s < q and p < e]


def test_texts_against_brute_force(both):
    known = alignment.Aligner(A, B, max_chunks=50)
    for at in range(0, len(TEXTS), 40):  # known chunks are let go in between
        for text, (n_a, n_b, n_groups, keys, shown) in zip(TEXTS[at : at + 40], known.align(TEXTS[at : at + 40])):
            want = brute(text, both)
            assert (n_a, n_b, n_groups, shown.decode()) == (*want[:3], want[4]), repr(text)
            assert Counter(keys.tolist()) == Counter(x * len(known.bytes_b) + y for x, y in want[3]), repr(text)


@pytest.mark.parametrize("broadcast_pairs", [None, 0])
def test_op13_against_brute_force(spark, both, broadcast_pairs):
    rows = [(i, t) for i, t in enumerate(TEXTS[:60])] + [(None, "no id the of"), (5, "again the of")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("pairs", F.lit(1)).withColumn("n_a", F.lit(2)).repartition(3)
    got = alignment.link_counts(docs, A, B, broadcast_pairs).collect()
    found = [(i, brute(t, both)) for i, t in rows]
    n = Counter(p for _, w in found for p in set(w[3]))
    top = defaultdict(int)
    for (a, _), k in n.items():
        top[a] = max(top[a], k)
    want = []
    for i, (n_a, n_b, n_groups, links, shown) in found:
        digest = hashlib.sha256(shown.encode()).hexdigest() if n_a else ""
        want.append((i, n_a, n_b, n_groups, len(links), sum(n[p] == top[p[0]] for p in links), sum(n[p] for p in links), digest))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got))) == sorted(map(repr, want))
    assert alignment.link_counts(docs.filter("false"), A, B, broadcast_pairs).count() == 0
