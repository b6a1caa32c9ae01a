"""Listed documents against held ones, each reason once."""

from veridoc.operators import transmittal


def test_each_reason(spark):
    lines = [(1, "TR-1", 1, "Transmittal TR_1 lists ab_10.2 Rev. A and CD-3 (revision b), EF/4"), (1, "TR-1", 2, "ab-10-2 Rev C; GH-5 Rev 1; IJ-6 Rev A; no-number; rev A"), (2, None, 1, None), (2, None, 2, "")]
    held = [("AB 10/2", "a"), ("cd.3", "A"), ("CD-3", "c"), ("EF-4", "A"), ("GH-5", None), ("gh_5", " "), (None, "A"), ("", "A")]
    got = transmittal.checked(spark.createDataFrame(lines, "list_id long, own string, pos int, line string"), spark.createDataFrame(held, "number string, revision string"))
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, "AB-10-2", "A", "pass", "revision held"), (1, "CD-3", "B", "query", "another revision is held"), (1, "EF-4", "", "query", "no revision stated"),
        (1, "GH-5", "1", "query", "held without a revision"), (1, "IJ-6", "A", "query", "not held"),
    ]
