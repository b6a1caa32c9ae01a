"""The query of transmittals against what is held."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions.rules import quoted
from ..operators import transmittal as op
from ..operators.transmittal import NUMBER, REVISION
from ..sources.tables import read

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_LINES = ("o_custkey AS list_id", "concat('TR-', o_custkey) AS own", "o_orderkey AS pos", """concat('Transmittal TR.', o_custkey, ' lists doc_', o_orderkey % 900, '.', o_orderkey % 4, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' revision: 2' ELSE concat(' (Rev. ', CASE o_orderkey % 2 WHEN 0 THEN 'a' ELSE 'B' END, ')') END, ', and DOC/', o_orderkey % 700, '-', o_orderkey % 3, ' Rev B') AS line""")
_HELD = ("concat('Doc-', l_orderkey % 800, '/', l_orderkey % 4) AS number", "CASE l_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'b' END AS revision")


def _norm(x: str) -> str:
    return f"upper(regexp_replace(trim({x}), '[ \t_/.-]+', '-', 'g'))"


def _rev(x: str) -> str:
    return f"regexp_replace(upper({x}), '[^A-Z0-9]', '', 'g')"


@query(f"""WITH l AS (SELECT {', '.join(_LINES)} FROM orders), s AS (SELECT list_id, own, pos, string_split(regexp_replace(line, '({NUMBER})', chr(1) || '\\1', 'g'), chr(1)) AS ps FROM l), e AS (SELECT list_id, own, pos, unnest(ps[2:]) AS piece, unnest(range(1, len(ps))) AS nth FROM s),
p AS (SELECT list_id, pos, nth, {_norm("own")} AS own, {_norm(f"regexp_extract(piece, '^{NUMBER}')")} AS number, {_rev(f"regexp_extract(piece, {quoted(REVISION)}, 2)")} AS revision FROM e),
f AS (SELECT list_id, number, revision FROM p WHERE regexp_matches(number, '[0-9]') AND number IS DISTINCT FROM own QUALIFY row_number() OVER (PARTITION BY list_id, number ORDER BY pos, nth, revision) = 1),
h AS (SELECT DISTINCT {_norm("number")} AS number, {_rev("revision")} AS r FROM (SELECT {', '.join(_HELD)} FROM lineitem)),
g AS (SELECT f.*, CASE WHEN NOT EXISTS (SELECT 1 FROM h WHERE h.number = f.number) THEN 'not held' WHEN revision = '' THEN 'no revision stated' WHEN NOT EXISTS (SELECT 1 FROM h WHERE h.number = f.number AND r <> '') THEN 'held without a revision'
 WHEN EXISTS (SELECT 1 FROM h WHERE h.number = f.number AND r = revision) THEN 'revision held' ELSE 'another revision is held' END AS reason FROM f)
SELECT list_id, number, revision, CASE reason WHEN 'revision held' THEN 'pass' ELSE 'query' END AS status, reason FROM g""")
def transmittal_lists(spark: SparkSession, sf: str):
    """Every document that a transmittal lists, and whether it is held in the revision stated."""
    return op.checked(read(spark, sf, "orders").selectExpr(*_LINES), read(spark, sf, "lineitem").selectExpr(*_HELD))
