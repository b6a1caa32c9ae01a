"""The llm operators on small tables against brute force, with nulls, empty and repeated rows and clashing columns."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veridoc.llm import chosen_path, components, decontaminate, fingerprints, language_crf, packing, queries, repair, shingles, site_lines, suffix_dedup, tokens, toxicity, warc
from veridoc.llm.common import table

RNG = np.random.default_rng(5)
VOCAB = [f"w{i}" for i in range(400)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(n, seed=None):
    rng = RNG if seed is None else np.random.default_rng(seed)
    return " ".join(rng.choice(VOCAB, n))


def frame(spark, rows):
    """Rows (doc_id, text) as documents, with columns whose names clash with the operators' own."""
    full = [(i, t, "en", f"s{(i or 0) % 2}", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, DOCS).withColumn("rep", F.lit(1)).withColumn("node", F.lit("x")).withColumn("score", F.lit(0.5)).withColumn("n", F.lit(3))


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "two words"), (None, "no id here"), (7, "A" * 3000), (8, "é ü ß 漢字 \U0001f600")]


# ---------------------------------------------------------------- token ids
@pytest.mark.parametrize("name,keeps", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_chunk_encoder_equals_the_library(name, keeps):
    path = public_tokenizers.path(name)
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    texts = ["", "a  b", " lead", "trail ", "x\ny z\n\nq", "don't 12.5% <|endoftext|> ok", "Été à Ñ ΣΑΣ ﬁ", "a\x1cb c", "a b c", "...!!! ((x)) y's", "́x y", "日本語 text", "tab\tin it", "é́ é"]
    texts += [sentence(50, 1), "Mixed. Case,Words! here\nand There.\nend"]
    got = tokens.ChunkEncoder(path, keeps).encode(texts)
    for t, ids in zip(texts, got):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("name,keeps", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_operators_encode_special_tokens_as_the_library_does(name, keeps):
    path = public_tokenizers.path(name)
    tok = Tokenizer.from_file(path)
    texts = ["<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>b c", "x <|startoftext|>  y", "<|ENDOFTEXT|> is not one", "plain text", None, "  <|endoftext|>\n<|endoftext|> tail", "|> <| end", "a <|endoftext|> b"]
    got = tokens.encoder(path, keeps).encode(texts)
    for t, ids in zip(texts, got):
        assert ids.tolist() == tok.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_repair_round_trip():
    docs = [RNG.integers(0, 30, n) for n in (0, 1, 2, 500, 3000, 0, 40)] + [np.zeros(100, int), np.tile([1, 2, 3], 200)]
    docs = [d.astype(np.int32) for d in docs]
    shard = repair.Shard(repair.write_shard(np.arange(len(docs)), docs, base=100))
    assert len(shard.symbols) < sum(map(len, docs)) and len(shard.rules)
    assert shard.all_ids().tolist() == np.concatenate(docs).tolist()
    for i, d in enumerate(docs):
        assert shard.ids(i).tolist() == d.tolist()
        for a, b in ((0, 5), (3, 17), (len(d) - 2, len(d)), (7, 7)):
            a = max(a, 0)
            assert shard.ids(i, a, b).tolist() == d[a:b].tolist()
    with pytest.raises(ValueError):
        repair.Shard(b"RPID" + b"\0" * 21)


def test_repair_takes_the_most_frequent_pairs_where_the_cap_binds(monkeypatch):
    monkeypatch.setattr(repair, "MOST_SYMBOLS", 101)
    ids = np.array([1, 2, 3] * 20 + [8, 9, 5] * 50, np.int32)
    symbols, _, rules = repair.compress(ids, np.array([len(ids)]), base=100)
    assert len(rules) == 1 and len(symbols) == 160 and repair.expand(symbols, rules, 100).tolist() == ids.tolist()


def test_op1_against_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = frame(spark, EDGES + [(9, sentence(300)), (9, "again")])
    rows = repair.read_ids(repair.write_ids(docs, path, False, 2, 49408)).collect()
    tok = Tokenizer.from_file(path)
    assert len(rows) == len(EDGES) + 2
    text = dict(EDGES)
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
        if r["doc_id"] != 9:
            ids = np.array(tok.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids + [2], "<u4")
            assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
    ids = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x)
    assert repair.read_ids(repair.write_ids(docs.filter("false"), path, False, 2, 49408)).count() == 0


# ---------------------------------------------------------------- language
def test_forward_backward_against_enumeration():
    from itertools import product

    e, a, s = RNG.normal(size=(7, 3)), RNG.normal(size=(3, 3)), RNG.normal(size=3)
    gamma, _ = language_crf.forward_backward(e, np.array([4, 1, 2]), a, s)
    for first, n in ((0, 4), (4, 1), (5, 2)):
        want = np.zeros((n, 3))
        for path in product(range(3), repeat=n):
            w = np.exp(s[path[0]] + sum(e[first + i, k] for i, k in enumerate(path)) + sum(a[x, y] for x, y in zip(path, path[1:])))
            for i, k in enumerate(path):
                want[i, k] += w
        assert np.allclose(gamma[first : first + n], want / want.sum(1, keepdims=True))


def test_op2_held_out_accuracy_and_edges(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = queries.op2_crf_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)
    model = language_crf.train(["aa", "bb"], {0: [["foo", "fob", "fox"] * 30], 1: [["zip", "zap", "zim"] * 30]})
    got = {r["doc_id"]: (r["lang_pred"], r["switches"]) for r in language_crf.label_documents(frame(spark, [(1, None), (2, "12 !"), (3, "foo fob"), (4, "fox " * 9 + "zip " * 4)]), model).collect()}
    assert got[1] == got[2] == ("und", 0) and got[3] == ("aa", 0) and got[4] == ("aa", 1)
    assert language_crf.fit(docs.filter("false"), F.lit(True)) is None
    assert {r["lang_pred"] for r in language_crf.label_documents(frame(spark, EDGES), None).collect()} == {"und"}


def test_op2_reads_the_whole_of_a_long_run(spark):
    model = language_crf.train(["aa", "bb"], {0: [["foo", "fob", "fox"] * 30], 1: [["zip", "zap", "zim"] * 30]})
    rows = [(1, "foofob" * 4 + "zipzap" * 330), (2, "fox " * 3 + "zipzap" * 100), (3, "fob " * 8)]
    got = {r["doc_id"]: (r["lang_pred"], r["n_words"], r["switches"]) for r in language_crf.label_documents(frame(spark, rows), model).collect()}
    assert got == {1: ("bb", 1, 1), 2: ("bb", 4, 1), 3: ("aa", 8, 0)}
    for n in (1, 24, 40, 41, 64, 2000):
        run = "".join(RNG.choice(list("abcdefé"), n))
        pieces = language_crf.pieces_of([run])
        assert "".join(p.strip("+")[2 * (p[0] == "+") :] for p in pieces) == run and max(map(len, pieces)) <= 40 and (n > 40 or pieces == [run])
    assert len(language_crf.features("x" * 40)) == len(language_crf.features("x" * 30)) + 20


# ---------------------------------------------------------------- very long texts
def long_text(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{i}" for i in rng.integers(0, 100_000, n))


def test_long_texts_are_read_whole(spark):
    long, item = long_text(150_000, 1), sentence(30, 4)
    words = long.split()
    words[149_000:149_000] = item.split()
    docs = frame(spark, [(1, long), (2, " ".join(words)), (3, "short"), (4, "y" * 200_000)])
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in chosen_path.near_components(docs, 3, 85).collect()}
    assert near[1] == (len({tuple(w) for w in zip(long.split(), long.split()[1:], long.split()[2:])}), 1) and near[2][1] == 1 and near[4] == (1, 4)
    leaks = decontaminate.find_leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["start_word"]) for r in leaks] == [(2, 7, 149_000)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pack(docs, path, True, 1).filter("doc_id = 1").collect()
    tok = Tokenizer.from_file(path)
    ids = tok.encode(long, add_special_tokens=False).ids + [1]
    assert sum(r["length"] for r in pieces) == len(ids) == pieces[0]["doc_tokens"]
    for r in pieces:
        assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
    sketches = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    assert sketches[1]["n_chars"] == len(long) and sketches[4]["n_chars"] == 200_000


def test_words_of_any_length_have_hashes_of_their_own():
    a, b = "a" * 65_536, "b" * 65_536
    hashes = shingles.word_hashes(f"{a}{b} {b}{a} {a}{a} {a}")
    assert len(set(hashes.tolist())) == 4
    assert shingles.word_hashes(f"{a.upper()}{b}").tolist() == hashes[:1].tolist()


def test_windows_near_a_passage_find_it():
    """Recall of windows on passages at a similarity of 0.8 and a little above, placed anywhere."""
    rng, met, all_ = np.random.default_rng(12), 0, 0
    for k in range(60):
        item = [f"q{k}x{i}" for i in range(int(rng.integers(18, 60)))]
        passage = list(item)
        passage[-1 - int(rng.integers(0, 2))] = "changed"  # a word near the end: few shingles differ
        text = [f"p{k}x{i}" for i in range(int(rng.integers(0, 90)))] + passage + [f"s{k}x{i}" for i in range(80)]
        index = decontaminate.Index([(1, " ".join(item))], 5)
        words, doc, lens = shingles.words_of_all([" ".join(text)])
        want = brute_leaks([(0, " ".join(text))], [(1, " ".join(item))])
        got = decontaminate.search(index, words, doc, lens, 0.8)
        all_ += bool(want)
        met += bool(want) and bool(got) and round(got[0][2], 9) == want[0, 1]
        assert bool(want) or not got
    assert all_ > 30 and met >= 0.98 * all_


# ---------------------------------------------------------------- near copies
def brute_components(rows, words, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))) if w else frozenset())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                label[find(i)] = find(j)
    low = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low[find(i)], d)
    return {d: (len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows)}


def near_copies_of(base, n, edits, first):
    words, out = base.split(), []
    for k in range(n):
        w = list(words)
        for at in RNG.choice(len(w), RNG.integers(0, edits + 1), replace=False):
            w[at] = f"e{k}x{at}"
        out.append((first + k, " ".join(w)))
    return out


@pytest.mark.parametrize("words,percent,small", [(3, 85, None), (5, 80, 16)])
def test_op3_against_brute_force(spark, monkeypatch, words, percent, small):
    if small:  # so that a few dozen copies already make a large node
        monkeypatch.setattr(chosen_path, "SMALL", small)
        monkeypatch.setattr(chosen_path, "DEPTH", 2)
    rows = [r for r in EDGES if r[0] is not None] + [(20 + i, sentence(120)) for i in range(15)]
    rows += near_copies_of(sentence(150), 30, 6, 100) + near_copies_of(sentence(60), 20, 3, 200) + [(300 + i, "ONE  same\ttext of many words " * 4) for i in range(25)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in chosen_path.near_components(frame(spark, rows), words, percent).collect()}
    want = brute_components(rows, words, percent)
    wrong = [k for k, v in want.items() if got[k][:2] != v]
    assert not wrong if not small else len(wrong) <= 1
    assert all(k == (d == c) for d, (_, c, k) in got.items())
    assert chosen_path.near_components(frame(spark, rows).filter("false"), words, percent).count() == 0


def linked_pairs(rows, words, percent):
    sets = {d: shingles.shingle_set(t, words).tolist() for d, t in rows}
    sets = {d: frozenset(s) for d, s in sets.items()}
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_op3_keeps_the_links_of_a_group_larger_than_a_small_node(spark, monkeypatch, words, percent):
    monkeypatch.setattr(chosen_path, "SMALL", 64)
    monkeypatch.setattr(chosen_path, "BLOCK", 40)
    rows = near_copies_of(sentence(150), 300, 9, 1000) + [(2000 + i, sentence(80)) for i in range(40)]
    docs = frame(spark, rows)
    want = linked_pairs(rows, words, percent)
    sets = chosen_path.shingled(docs, words, chosen_path.trees_for(percent / 100)).withColumnRenamed("doc_id", "rep")
    met = {tuple(sorted(r)) for r in chosen_path.candidate_pairs(sets, percent / 100).collect()}
    got = {r["doc_id"]: r["component_id"] for r in chosen_path.near_components(docs, words, percent).collect()}
    assert len(want) > 3000
    # a forest stands for the pairs that the signatures are sure of, so links count as kept where a component does
    assert sum(got[a] == got[b] for a, b in want) >= 0.999 * len(want)
    assert got == {d: c for d, (_, c) in brute_components(rows, words, percent).items()}
    assert len(met) < 300 * 299 / 2 + 100


@pytest.mark.parametrize("words,percent,above", [(3, 85, 0.0), (5, 80, -2.0)])
def test_op3_compares_again_where_a_forests_pair_is_no_link(spark, monkeypatch, words, percent, above):
    # with so low a margin many pairs that the signatures call sure are none
    monkeypatch.setattr(chosen_path, "SMALL", 64)
    monkeypatch.setattr(chosen_path, "ABOVE", above)
    rows = near_copies_of(sentence(150), 200, 9, 1000) + near_copies_of(sentence(150), 60, 12, 2000) + [(3000 + i, sentence(80)) for i in range(20)]
    docs, trees = frame(spark, rows), chosen_path.trees_for(percent / 100)
    sets = chosen_path.shingled(docs, words, trees).withColumnRenamed("doc_id", "rep")
    first = chosen_path.confirmed(chosen_path.candidate_blocks(chosen_path.dealt_rows(sets), percent / 100), docs, words, percent)
    assert first.filter("not linked").count() > 0
    got = {r["doc_id"]: r["component_id"] for r in chosen_path.near_components(docs, words, percent).collect()}
    assert got == {d: c for d, (_, c) in brute_components(rows, words, percent).items()}


def test_op3_takes_one_text_for_a_repeated_doc_id(spark):
    rows = [(1, sentence(50, 1)), (1, sentence(50, 2)), (2, sentence(50, 1)), (3, sentence(50, 2)), (1, None)]
    got = [sorted(tuple(r) for r in chosen_path.near_components(frame(spark, rows[:n]), 3, 85).collect()) for n in (4, 5)]
    assert [r[0] for r in got[0]] == [1, 2, 3] and got[1] == [(1, 0, 1, True), (2, 48, 2, True), (3, 48, 3, True)]
    assert sum(r[2] == 1 for r in got[0]) == 2


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 50), (100, 101), (7, 7), (102, 101)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {i: 50 for i in (50, 100, 101, 102)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_trees_reach_the_recall():
    assert chosen_path.trees_for(0.99) <= chosen_path.trees_for(0.85) <= chosen_path.trees_for(0.8)


@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_a_pair_at_the_threshold_is_missed_no_more_than_the_recall_allows(spark, threshold):
    from math import comb

    n, cut = chosen_path.POSITIONS, chosen_path.least_agreeing(threshold, 1e-6 / 2)
    miss = lambda c: sum(comb(n, k) * threshold**k * (1 - threshold) ** (n - k) for k in range(c))
    assert miss(cut) <= 1e-6 / 2 < miss(cut + 1)
    sigs = np.zeros((2, n), np.uint16)
    sigs[1, cut:] = 1
    reps = spark.createDataFrame([(i, 100, s.tobytes(), [5, 6]) for i, s in enumerate(sigs)], "rep long, n_shingles long, sig binary, nodes array<long>")
    assert chosen_path.candidate_pairs(reps, threshold).select("a", "b").collect() == [(0, 1)]


# ---------------------------------------------------------------- warc
def test_op4_round_trip(spark):
    rows = [(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u\r\nv", None), (4, "", ""), (0, "b", "<p>x</p>"), (None, "c", "<p>x</p>"), (5, "d", "é" * 5000), (6, "e", "<p>x</p> ")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("salt", F.lit(2))
    got = {r["page_id"]: r for r in warc.read_archives(warc.write_pages(pages)).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), warc.digest(raw))
    assert {i: r["refers_to"] for i, r in got.items() if r["record_type"] == "revisit"} == {1: 0, 2: 0, 4: 3}
    assert bytes(got[5]["payload"]).decode() == "é" * 5000
    all_new = warc.read_archives(warc.write_pages(pages, min_bytes=100)).collect()
    assert {r["record_type"] for r in all_new} == {"response"}
    assert warc.read_archives(warc.write_pages(pages.filter("false"))).count() == 0


def test_warc_reader_rejects_damage():
    record = warc.record_bytes([("WARC-Type", "response")], b"body")
    good = warc.write_archive([record, record], b"body and some more dictionary text")
    assert [warc.parse_record(r)[1] for r in warc.frames(good)] == [b"body", b"body"]
    assert [len(r) for r in warc.frames(warc.write_archive([record], b""))] == [len(record)]
    for bad in (good[:-3], b"junkjunkjunk" + good, good + b"abc"):
        with pytest.raises(Exception):
            [warc.parse_record(r) for r in warc.frames(bad)]
    for bad in (record.replace(b"WARC/1.1", b"HTTP/1.1"), record.replace(b"Length: 4", b"Length: 5"), record[:-2], b"WARC/1.1\r\nno colon\r\n\r\n"):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)


def test_warc_records_have_date_and_id(spark):
    pages = spark.createDataFrame([(1, "a", "x"), (None, "b", "y"), (None, "c", "z")], "page_id long, url string, html string")
    heads = [warc.parse_record(raw)[0] for r in warc.write_pages(pages, date="2024-02-03T04:05:06Z").collect() for raw in warc.frames(bytes(r["content"]))]
    assert len({h["warc-record-id"] for h in heads}) == 3 and {h["warc-date"] for h in heads} == {"2024-02-03T04:05:06Z"}
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:page:1>"), ("WARC-Date", "2024-02-03T04:05:06Z"), ("WARC-Payload-Digest", f"sha1:{warc.digest(b'x')}")]
    for left_out in (None, 1, 2, 3):
        record = warc.record_bytes([h for i, h in enumerate(headers) if i != left_out], b"x")
        rows = warc.read_archives(spark.createDataFrame([(warc.write_archive([record], b""),)], "content binary"))
        if left_out is None:
            assert rows.first()["page_id"] == 1
        else:
            with pytest.raises(Exception):
                rows.collect()


# ---------------------------------------------------------------- decontamination
def brute_leaks(docs, items, k=5, threshold=0.8):
    def weighed(w, n):
        c = Counter()
        for i in range(len(w) - n + 1):
            c[tuple(w[i : i + n])] += sum(len(x) + 1 for x in w[i : i + n])
        return c

    out = {}
    for item, text in items:
        q = (text or "").encode().lower().split()
        if not q:
            continue
        n = min(k, len(q))
        want, m = weighed(q, n), len(q)
        for doc, t in docs:
            w = (t or "").encode().lower().split()
            best = 0
            for a in range(max(1, len(w) - m + 1)) if len(w) >= n else ():
                have = weighed(w[a : a + m], n)
                both = sum(min(v, want[g]) for g, v in have.items() if g in want)
                best = max(best, both / (sum(want.values()) + sum(have.values()) - both))
            if best >= threshold:
                out[doc, item] = round(best, 9)
    return out


def test_op5_against_brute_force(spark):
    items = [(i, sentence(int(n))) for i, n in enumerate((15, 22, 30, 41, 59, 3, 1))] + [(90, None), (91, ""), (None, "x y")]
    rows = [r for r in EDGES if r[0] is not None] + [(30 + i, sentence(200)) for i in range(20)]
    for i, (_, text) in enumerate(items[:6]):
        w = text.split()
        rows += [(100 + i, f"{sentence(37)} {text.upper()} {sentence(53)}"), (200 + i, text)]
        if len(w) > 20:
            rows += [(300 + i, f"{sentence(20)} {' '.join(w[:-1])} {sentence(9)}"), (400 + i, f"{sentence(11)} {' '.join(w[:len(w) // 2])} {sentence(30)}")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(frame(spark, rows), bench).collect()}
    want = brute_leaks(rows, [i for i in items if i[0] is not None])
    assert {k: round(v["similarity"], 9) for k, v in got.items()} == want and len(want) >= 15
    assert got[100, 0]["start_word"] == 37
    assert decontaminate.find_leaks(frame(spark, rows), bench.filter("false")).count() == 0
    assert decontaminate.find_leaks(frame(spark, rows).filter("false"), bench).count() == 0


def test_byte_blocks_find_every_print_within_the_radius():
    items = [decontaminate.Item(i, np.zeros(1, np.uint64), np.ones(1, np.int64), 1) for i in range(20)]
    prints = RNG.integers(0, 256, (20, 16), np.uint8)
    asked = np.repeat(prints, 40, 0)
    for row in asked:  # flip up to the radius and beyond
        flips = RNG.choice(128, RNG.integers(0, 50), replace=False)
        bits = np.unpackbits(row)
        bits[flips] ^= 1
        row[:] = np.packbits(bits)
    found = {(j, r) for j, rows in decontaminate.Lookup(items, prints).within(asked) for r in rows.tolist()}
    far = np.unpackbits(asked[:, None, :] ^ prints[None, :, :], axis=2).sum(2)
    assert found == {(j, r) for r, j in zip(*np.nonzero(far <= decontaminate.RADIUS))}


# ---------------------------------------------------------------- site lines
@pytest.mark.parametrize("most", [10**6, -1])
def test_op6_lines(spark, monkeypatch, most):
    monkeypatch.setattr(site_lines, "BROADCAST_LINES", most)  # both ways of joining
    rows = [(i, "menu\n" + sentence(5) + "\n\nmenu\n" + ("footer" if i < 12 else "rare"), "en", "h" if i % 20 else None, 1) for i in range(1, 40)] + [(90, None, "en", "h", 0), (91, "", "en", "lone", 0), (92, "menu", "en", "lone", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("_x", F.lit(1))
    got = {r["doc_id"]: r for r in site_lines.drop_site_lines(docs, ratio=0.5, min_pages=5).collect()}
    assert len(got) == len(rows) and got[90]["text"] is None and got[91]["text"] == "" and got[92]["text"] == "menu"
    assert "menu" not in got[1]["text"] and "\n\n" in got[1]["text"] and "footer" in got[1]["text"] and "rare" not in got[30]["text"]
    assert got[20]["text"].startswith("menu")  # a null host of one page
    assert site_lines.drop_site_lines(docs.filter("false")).count() == 0


def test_op6_equals_sql(spark, sf_dir):
    import oracle

    assert oracle.compare(spark, oracle.connect(sf_dir), queries.QUERIES["op6_site_line_frequency"], queries.ORACLE["op6_site_line_frequency"], sf_dir) == ""


# ---------------------------------------------------------------- toxicity
def test_op7_separates_and_scores_everything(spark):
    bad = ["grobnak", "vilestu", "trogmir"]
    rows, labels = [], []
    for i in range(240):
        words = sentence(40).split()
        if i % 4 == 0:
            words[RNG.integers(0, 40)] = bad[i % 3] + RNG.choice(["", "en", "ung"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1000 + (i or 500), t) for i, t in EDGES] + [(1, rows[1][1])]
    labels += [(5, 0, None), (None, 1, 1), (1, 1, 0)]
    docs = frame(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), toxicity.held_out(F.col("doc_id"), 5))
    got = [(r["doc_id"], r["_score"]) for r in toxicity.score(docs, model).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    held = [(d % 4 == 0, s >= 0.5) for d, s in got if d < 240 and zlib.crc32(str(d).encode()) % 5 == 0]
    assert len(held) > 20 and sum(a == b for a, b in held) >= 0.95 * len(held)
    nothing = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), F.lit(False))
    assert max(r["_score"] for r in toxicity.score(docs, nothing).collect()) < 0.1
    assert toxicity.score(docs.filter("false"), model).count() == 0


def test_op7_finds_phrases_of_ordinary_words(spark):
    rng = np.random.default_rng(17)
    phrases = [list(rng.choice(VOCAB, 12, replace=False)) for _ in range(3)]
    rows, labels = [], []
    for i in range(450):
        words, phrase = list(rng.choice(VOCAB, 60)), phrases[i % 3]
        at = int(rng.integers(0, 49))
        words[at : at + 12] = phrase if i % 2 else list(rng.permutation(phrase))  # the same words, in another order
        rows.append((i, " ".join(words)))
        labels.append((i, 1, i % 2))
    docs, held = frame(spark, rows), toxicity.held_out(F.col("doc_id"), 5)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), held)
    got = [(d % 2, r["_score"] >= 0.5) for r in toxicity.score(docs, model).collect() if zlib.crc32(str(d := r["doc_id"]).encode()) % 5 == 0]
    assert len(got) > 50 and sum(a == b for a, b in got) >= 0.9 * len(got)
    assert [w.decode().split() for w in toxicity.windows(VOCAB[:30])] == [VOCAB[:16], VOCAB[8:24], VOCAB[16:30]]


# ---------------------------------------------------------------- repeats
def brute_repeats(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (d, _), r in zip(rows, raws):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(r, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(r) else 0
        out.append((d, len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_op8_against_brute_force(spark):
    passage, other = sentence(150, 7), sentence(140, 8)
    rows = EDGES + [(20 + i, sentence(100)) for i in range(10)]
    rows += [(40 + i, f"{sentence(30)} {passage} {sentence(30)}") for i in range(6)] + [(50, passage), (51, other + " | " + other), (52, "ab" * 900), (53, "ab" * 700 + "c"), (54, passage[:399]), (55, passage[:400])]
    rows += [(60, "é" * 700), (61, sentence(80)), (61, sentence(80)), (62, other[:-30] + sentence(40)), (62, None)] + [(63, "same row " * 60)] * 2
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()), key=repr)
    assert got == brute_repeats(rows, 400)
    assert suffix_dedup.remove_repeats(frame(spark, rows).filter("false")).count() == 0


def test_op8_repeats_over_the_cuts_of_a_long_text(spark):
    rng, cut = np.random.default_rng(9), suffix_dedup.PORTION - suffix_dedup.LENGTH
    letters = lambda n: rng.integers(97, 123, n, np.uint8).tobytes().decode()
    long = letters(2 * cut + 3000)
    rows = [(1, long), (2, letters(700) + long[cut - 1500 : cut + 1500]), (3, long[2 * cut - 900 : 2 * cut + 700] + letters(90)), (4, letters(50) + long[cut - 450 : cut + 300])]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect())
    raws = [t.encode() for _, t in rows]
    seen = Counter(hash(r[i : i + 400]) for r in raws for i in range(len(r) - 399))
    for (d, _), raw, row in zip(rows, raws, got):
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 399):
            if seen[hash(raw[i : i + 400])] > 1:
                gone[i : i + 400] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
        assert row == (d, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_anchor_runs_cut_long_texts_without_losing_a_window(monkeypatch):
    data = RNG.integers(0, 4, 5000).astype(np.uint8).tobytes()
    for raw in (data, b"x" * 3000, data[:400], data[:399]):
        whole = [(a, b) for _, a, b, _ in zip(*suffix_dedup.anchor_runs(np.frombuffer(raw, np.uint8), np.array([len(raw)])))]
        assert [s for a, b in whole for s in range(a, b + 1)] == list(range(max(0, len(raw) - 399)))


# ---------------------------------------------------------------- packing
def test_plan_places_every_remainder_once():
    hist = np.bincount(RNG.integers(1, 2048, 3000), minlength=2048)
    hist[700] += 300
    runs, sequences = packing.plan(hist)
    used, room = Counter(), defaultdict(list)
    total = runs.merge(runs.groupby("length")["rank"].apply(list).rename("starts"), on="length")
    for r in total.itertuples():
        later = [s for s in r.starts if s > r.rank]
        count = (min(later) if later else int(hist[r.length])) - r.rank
        used[r.length] += count
        for i in range(count):
            room[r.sequence + i // r.copies].append((r.offset + r.length * (i % r.copies), r.length))
    assert all(used[a] == hist[a] for a in range(1, 2048)) and set(room) == set(range(sequences))
    for pieces in room.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert sequences <= (hist * np.arange(2048)).sum() / 2048 * 1.06 + 2


def test_solver_leaves_little():
    hist = np.zeros(2048, np.int64)
    hist[[1000, 1048, 512]] = (300, 300, 400)
    x = packing.solve(hist, packing.combinations(hist))
    assert (x >= 0).all()
    runs, sequences = packing.plan(hist)
    assert sequences == 400


def test_op9_pieces(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = EDGES + [(20, " ".join(VOCAB * 12)), (21, sentence(900)), (21, sentence(900))] + [(100 + i, sentence(int(RNG.integers(1, 400)))) for i in range(60)]
    pieces = packing.pack(frame(spark, rows), path).toPandas()
    tok = Tokenizer.from_file(path)
    want = Counter()
    for d, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for a in range(0, len(ids), 2048):
            want[str(d), a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)] += 1
    got = Counter((str(int(r.doc_id)) if r.doc_id == r.doc_id else "None", r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces.itertuples())
    assert got == want
    padding = 0
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.cumsum(g["length"]) - g["length"]).all() and g["length"].sum() <= 2048
        n = int(g["length"].sum())
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding <= 2048
    assert packing.pack(frame(spark, rows).filter("false"), path).count() == 0


# ---------------------------------------------------------------- fingerprints
def test_op10_edits_and_likeness(spark):
    rows = [(d, t) for d, t in EDGES if d is not None] + [(2000 + 3 * i, sentence(80, i)) for i in range(40)] + [(9000, sentence(80, 3)), (-5, "first of all")]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(frame(spark, rows + [(None, "no id")])).collect()}
    rows = sorted(rows)
    assert set(got) == {d for d, _ in rows}
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d]["near_edited"] <= 1 and 0 <= got[d]["near_next"] <= 1
    assert got[9000]["fingerprint"] == got[2009]["fingerprint"] and got[4]["fingerprint"] == got[5]["fingerprint"] and got[4]["near_next"] == 1
    assert fingerprints.fingerprints(frame(spark, []).filter("false")).count() == 0


def test_sketches_estimate_and_merge(spark):
    a, b = sentence(900, 11).split(), sentence(900, 12).split()
    x, y = " ".join(a + b[:300]), " ".join(a)
    row = spark.createDataFrame([(x, y)], "x string, y string").select(fingerprints.sketch(F.col("x"), 256).alias("x"), fingerprints.sketch(F.col("y"), 256).alias("y"))
    r = row.select(
        fingerprints.resemblance(F.col("x"), F.col("y"), 256).alias("j"), fingerprints.containment(F.col("y"), F.col("x"), 256).alias("c"),
        fingerprints.distinct_count(F.col("x"), 256).alias("n"), fingerprints.merge(F.col("x"), F.col("y"), 256).alias("m"), "x",
    ).first()
    assert abs(r["j"] - 896 / 1196) < 0.12 and r["c"] > 0.85 and abs(r["n"] - 1196) < 250 and len(r["m"]) == 256


def test_word_hashes_follow_the_words():
    texts = ["Ab cd", "ab\tCD\n", " ab  cd ", "", None, "É ab", "é ab"]
    h = [shingles.word_hashes(t).tolist() for t in texts]
    assert h[0] == h[1] == h[2] and len(h[0]) == 2 and h[3] == h[4] == [] and h[5][0] != h[6][0] and h[5][1] == h[0][0]
    words, doc, lens = shingles.words_of_all(texts)
    assert words.tolist() == sum(h, []) and doc.tolist() == [0, 0, 1, 1, 2, 2, 5, 5, 6, 6] and lens[:2].tolist() == [2, 2]
