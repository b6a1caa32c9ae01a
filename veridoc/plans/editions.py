"""Queries of the editions that contracts apply."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators import editions as op
from ..operators.editions import DAY, MONTH, YEAR
from ..sources.tables import read

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_FAMILY = "CAST(floor(p_partkey / 4) AS BIGINT)"
_YEAR = "(1980 + (p_partkey * 7919) % 37)"
_MONTH = "right(concat('0', 1 + p_partkey % 12), 2)"
_EDITIONS = ("p_partkey", f"{_FAMILY} AS family", "concat('Ed ', p_partkey) AS edition", f"CASE WHEN p_partkey % 29 = 0 THEN NULL WHEN p_partkey % 31 = 0 THEN 'undated' WHEN p_partkey % 7 = 0 THEN concat({_YEAR}) WHEN p_partkey % 3 = 0 THEN concat({_YEAR}, '-', {_MONTH}) ELSE concat({_YEAR}, '-', {_MONTH}, '-15') END AS issued")
_POLICIES = ("family", "CASE family % 3 WHEN 0 THEN '1998-06' WHEN 1 THEN '2001-02-28' ELSE '1984' END AS cutoff", "family % 4 = 0 AS latest", "CASE family % 5 WHEN 0 THEN concat('Ed ', 4 * family) WHEN 1 THEN 'Ed X' END AS named")


def _first(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{YEAR}') THEN try_cast({x} || '-01-01' AS DATE) WHEN regexp_matches({x}, '{MONTH}') THEN try_cast({x} || '-01' AS DATE) WHEN regexp_matches({x}, '{DAY}') THEN try_cast({x} AS DATE) END"


def _last(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{YEAR}') THEN try_cast({x} || '-12-31' AS DATE) WHEN regexp_matches({x}, '{MONTH}') THEN last_day(try_cast({x} || '-01' AS DATE)) WHEN regexp_matches({x}, '{DAY}') THEN try_cast({x} AS DATE) END"


@query(f"""WITH e AS (SELECT {', '.join(_EDITIONS[1:])} FROM part), p AS (SELECT {', '.join(_POLICIES)} FROM (SELECT DISTINCT family FROM e)),
d AS (SELECT family, edition, {_first('issued')} AS first, {_last('issued')} AS last FROM (SELECT DISTINCT * FROM e)), q AS (SELECT family, latest, named, {_first('cutoff')} AS since, {_last('cutoff')} AS till FROM p),
w AS (SELECT * FROM q JOIN d USING (family) WHERE last IS NOT NULL AND (latest OR last <= since)),
b AS (SELECT family, edition AS best, first AS begins FROM w QUALIFY row_number() OVER (PARTITION BY family ORDER BY last DESC, edition) = 1),
o AS (SELECT b.family, coalesce(bool_or(w.edition <> best AND w.last >= begins), FALSE) AS overlap FROM b JOIN w USING (family) GROUP BY b.family),
s AS (SELECT q.family, latest, named, best, coalesce(overlap, FALSE) AS overlap, EXISTS (SELECT 1 FROM d WHERE d.family = q.family AND last IS NULL) AS undated, EXISTS (SELECT 1 FROM d WHERE d.family = q.family AND d.first <= till AND d.last > since) AS coarse,
 EXISTS (SELECT 1 FROM d WHERE d.family = q.family AND d.edition = named AND d.last IS NOT NULL) AS held FROM q LEFT JOIN b USING (family) LEFT JOIN o USING (family)),
r AS (SELECT *, CASE WHEN undated THEN 'undated edition' WHEN latest AND overlap THEN 'newest not told' WHEN NOT latest AND coarse THEN 'date too coarse' WHEN best IS NULL THEN 'none in time' WHEN overlap THEN 'overlapping dates' WHEN named <> best AND NOT held THEN 'named edition not on file' WHEN named <> best THEN 'both' ELSE 'picked' END AS outcome FROM s)
SELECT family, outcome, CASE outcome WHEN 'picked' THEN best WHEN 'both' THEN best || '; ' || named END AS editions FROM r""")
def applied_editions(spark: SparkSession, sf: str):
    """The edition of each family that its contract applies, or why an engineer has to say."""
    e = read(spark, sf, "part").selectExpr(*_EDITIONS)
    return op.applied_editions(e, e.select("family").distinct().selectExpr(*_POLICIES))
