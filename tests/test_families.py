"""Families of standards: the stemmer, which questions name a family, and the ranking."""

from pyspark.sql import functions as F

from veridoc.operators import families
from veridoc.plans import families as plans

WORDS = {"welding": "weld", "welds": "weld", "weld": "weld", "valves": "valv", "valve": "valv", "piping": "pip", "pipes": "pip", "viscosities": "viscosity", "boxes": "box", "glass": "glass", "gas": "gas", "sing": "sing", "red": "red", "Tested": "test", "bus": "bus", "passes": "pass"}
PHRASES = [
    ("What do the welding standards say about cracks?", (["weld"], ["crack"])), ("welding standards for pumps", None), ("list the applicable standards on noise", None),
    ("do our offshore pipe coating specifications say anything on film thickness", (["coat", "offshor", "pip"], ["film", "thickness"])), ("what does SAES-W-010 and the welding standards say about cracks", None),
    ("the welding standards and the paint standards about noise", None), ("the company welding specs regarding 12", None), ("", None), (None, None), ("the lifting specs which apply for cranes", (["lift"], ["cran"])),
]


def test_stems(spark):
    rows = spark.createDataFrame(list(WORDS.items()), "w string, want string").select("w", "want", families.stemmed(F.array("w"))[0].alias("got")).collect()
    assert [(r["w"], r["got"]) for r in rows] == [(r["w"], r["want"]) for r in rows]


def test_which_questions_name_a_family(spark):
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(PHRASES)], "i int, q string").select("i", families.family_phrase(F.col("q")).alias("x"))
    got = {r["i"]: r["x"] and (r["x"]["descriptor"], r["x"]["topic"]) for r in df.collect()}
    assert [got[i] for i in range(len(PHRASES))] == [want for _, want in PHRASES]


def test_families_are_ranked_by_topic_and_qualify_by_descriptor(spark):
    standards = [(1, "W-1", "covers welds"), (2, "W-1", "covers welded joints"), (3, "W-2", "covers paint"), (4, "P-1", "covers paint"), (5, "W-3", None), (6, "W-4", "weld and repair")]
    pages = [(1, "cracks are repaired")] * 7 + [(2, "no crack"), (3, "Welding of cracks"), (4, "cracks"), (4, "cracked"), (5, "welding"), (5, None), (6, "")]
    asked = [(1, "what do the welding standards say about cracks"), (2, "the welding specs about a crack"), (3, "how many are there"), (4, "the casting standards about cracks")]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = families.families(df(asked, "q_id long, question string"), df(standards, "doc_id long, designation string, scope string"), df(pages, "doc_id long, text string")).collect()
    one = sorted((r["rank"], r["family"], r["n_documents"], r["topic"], r["scope"], r["search"]) for r in got if r["q_id"] == 1)
    # five of the seven pages of document 1 count, P-1 is no welding standard, editions 1 and 2 are one family
    assert one == [(1, "W-1", 2, 6, 2, 0), (2, "W-2", 1, 1, 0, 1), (3, "W-4", 1, 0, 1, 0), (4, "W-3", 1, 0, 0, 1)]
    assert sorted((r["rank"], r["family"]) for r in got if r["q_id"] == 2) == [(r[0], r[1]) for r in one] and {r["q_id"] for r in got} == {1, 2}


def test_passages_are_stemmed_once(spark, sf_dir):
    plan = plans.standard_families(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan
    texts = ["Welding of the Valves, and boxes' passes", "a-b ab1 CES", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(families.stems(F.col("text")), F.array_sort(families._own_stems(F.col("text")))).collect()
    assert all(a == b for a, b in got) and got[0][0] == ["and", "box", "pass", "the", "valv", "weld"]
