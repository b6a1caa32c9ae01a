"""Editions by the date a contract names, each outcome once."""

import pytest

from veridoc.operators import editions

OLD, NEW, FAR = ("A", "1990-05"), ("B", "1995-01-31"), ("C", "2005")


@pytest.mark.parametrize(
    ("held", "cutoff", "latest", "named", "want"),
    [
        ([OLD, NEW, FAR], "1998-06-15", False, None, ("picked", "B")), ([OLD, NEW, FAR], "1994", False, None, ("picked", "A")), ([OLD, NEW, FAR], "1998-06-15", True, None, ("picked", "C")),
        ([OLD, NEW], "1998-06", False, "B", ("picked", "B")), ([OLD, NEW], "1998-06", False, "A", ("both", "B; A")), ([OLD, NEW], "1998-06", False, "Z", ("named edition not on file", None)),
        ([OLD, ("D", None)], "1998", False, None, ("undated edition", None)), ([OLD, ("D", "1995-02-30")], "1998", False, None, ("undated edition", None)), ([], "1998", False, None, ("none on file", None)),
        ([FAR], "1998", False, None, ("none in time", None)), ([OLD, ("D", "1998")], "1998-06-15", False, None, ("date too coarse", None)), ([OLD, ("D", "1998")], "1998-12-31", False, None, ("picked", "D")),
        ([("D", "1990"), OLD], "1998", False, None, ("overlapping dates", None)), ([FAR, ("D", "2005-03")], "1998", True, None, ("newest not told", None)), ([("D", "2005-12-31"), ("E", "2005-12-31")], "2010", False, None, ("overlapping dates", None)),
        ([OLD, OLD], "1998", False, None, ("picked", "A")), ([OLD], "soon", False, None, ("cutoff not read", None)), ([OLD], None, True, None, ("picked", "A")),
    ],
)
def test_each_outcome(spark, held, cutoff, latest, named, want):
    e = spark.createDataFrame([("f", *x) for x in held] + [("no policy", "A", "1990")], "family string, edition string, issued string")
    p = spark.createDataFrame([("f", cutoff, latest, named)], "family string, cutoff string, latest boolean, named string")
    assert [tuple(r) for r in editions.applied_editions(e, p).collect()] == [("f", *want)]
