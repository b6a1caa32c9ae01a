"""Queries of chunks with a carried overlap, and of the passages shown around them."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.rules import rewrite_sql
from ..operators import chunks
from ..operators.chunks import BARS, BUDGET, HEADER, HEADING, MOST, OVERLAP, RUNT, TARGET
from ..sources.shared import kept
from ..sources.tables import read
from .figures import MASKED

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _words(x: str) -> str:
    return rf"[w FOR w IN string_split_regex({x}, '[ \t\r\n]+') IF w <> '']"


def _n(x: str) -> str:
    return f"len({_words(x)})"


_ROOM = f"({MOST} - coalesce({_n('head')}, 0))"
_END = lambda start, fresh: f"{fresh} + 1 + len([k FOR k IN range({fresh} + 1, m) IF lead + ps[k + 2] - ps[{start} + 1] <= {TARGET}])"
_BACK = f"(CASE WHEN kind = 'table' THEN 0 ELSE len([y FOR y IN range(greatest(start, stop - {OVERLAP}), stop) IF ps[stop + 1] - ps[y + 1] <= {OVERLAP}]) END)"
_FROM = f"(CASE WHEN ps[stop + 1] - ps[stop - {_BACK} + 1] + ps[stop + 2] - ps[stop + 1] <= {MOST} THEN stop - {_BACK} ELSE stop END)"
_CHUNKS = f"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents),
k AS (SELECT *, CASE WHEN length(line) - length(replace(line, '|', '')) >= {BARS} THEN 'table' WHEN {_n("line")} <= {HEADING} THEN 'heading' ELSE 'prose' END AS kind FROM l WHERE {_n("line")} > 0),
s AS (SELECT *, sum((kind = 'heading')::INT) OVER (PARTITION BY doc_id ORDER BY pos)::INT AS section FROM k),
r AS (SELECT *, coalesce(lag(kind) OVER w <> kind OR lag(section) OVER w <> section, TRUE) AS new FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
b AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY pos)::INT AS block FROM r),
g AS (SELECT doc_id, section, block, kind, list(line ORDER BY pos) AS lines FROM b WHERE kind <> 'heading' GROUP BY ALL),
h AS (SELECT *, kind = 'table' AND len(lines) > 1 AND {_n("lines[1]")} <= {HEADER} AS headed FROM g),
u AS (SELECT *, CASE WHEN headed THEN lines[1] END AS head, CASE WHEN headed THEN lines[2:] WHEN kind = 'table' THEN lines ELSE [x FOR x IN flatten(list_transform(lines, lambda y: list_transform(string_split({rewrite_sql("y", MASKED)}, chr(10)), lambda z: trim(z)))) IF x <> ''] END AS us FROM h),
v AS (SELECT doc_id, section, block, kind, head, coalesce({_n("head")}, 0) AS lead, flatten(list_transform(us, lambda x: CASE WHEN {_n("x")} > {_ROOM} THEN list_transform(range(0, (({_n("x")} - 1) // {_ROOM} + 1)::BIGINT), lambda i: array_to_string(({_words("x")})[i * {_ROOM} + 1 : (i + 1) * {_ROOM}], ' ')) ELSE [x] END)) AS us FROM u),
z AS (SELECT *, len(us) AS m, list_transform(us, lambda x: {_n("x")}) AS sizes FROM v),
p AS (SELECT *, list_transform(range(0, m + 1), lambda i: coalesce(list_sum(sizes[1:i]), 0)::BIGINT) AS ps FROM z WHERE m > 0),
c AS (SELECT doc_id, block, 0 AS no, 0::BIGINT AS start, 0::BIGINT AS fresh, {_END("0", "0")} AS stop FROM p
 UNION ALL SELECT doc_id, block, no + 1, f, old, {_END("f", "old")} FROM (SELECT doc_id, block, no, stop AS old, {_FROM} AS f, ps, m, lead FROM c JOIN p USING (doc_id, block) WHERE stop < m)),
d AS (SELECT c.*, p.section, p.kind, p.head, p.lead, p.us, p.ps, p.m, lag(start) OVER w AS pstart, lead(fresh) OVER w AS nfresh FROM c JOIN p USING (doc_id, block) WINDOW w AS (PARTITION BY doc_id, block ORDER BY no)),
e AS (SELECT *, no > 0 AND stop = m AND kind <> 'table' AND ps[m + 1] - ps[fresh + 1] < {RUNT} AND lead + ps[m + 1] - ps[pstart + 1] <= {MOST} AS runt,
 nfresh IS NOT NULL AND kind <> 'table' AND {_END("start", "fresh")} < m AND ps[m + 1] - ps[nfresh + 1] < {RUNT} AND lead + ps[m + 1] - ps[start + 1] <= {MOST} AND NOT EXISTS (SELECT 1 FROM c x WHERE x.doc_id = d.doc_id AND x.block = d.block AND x.no > d.no + 1) AS takes FROM d),
ch AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY block, no) - 1)::INT AS ordinal, section, block, kind,
 concat_ws(chr(10), head, CASE kind WHEN 'table' THEN array_to_string(us[start + 1 : CASE WHEN takes THEN m ELSE stop END], chr(10)) ELSE array_to_string(us[start + 1 : CASE WHEN takes THEN m ELSE stop END], ' ') END) AS chunk,
 lead + ps[CASE WHEN takes THEN m ELSE stop END + 1] - ps[start + 1] AS n_tokens, ps[fresh + 1] - ps[start + 1] AS n_carried FROM e WHERE NOT runt)"""


@query(f"WITH RECURSIVE {_CHUNKS} SELECT * FROM ch")
def overlapped_chunks(spark: SparkSession, sf: str):
    """Chunks of whole sentences that carry the end of the one before, and of table rows behind their header."""
    return chunks.sentence_chunks(read(spark, sf, "documents"), MASKED)


_SHARED = r"""coalesce(list_max([length(prev) - i + 1 FOR i IN range(1, length(prev) - 18) IF substr(prev, i, 20) = left(chunk, 20) AND starts_with(chunk, substr(prev, i))
 AND (length(chunk) = length(prev) - i + 1 OR NOT regexp_matches(substr(chunk, length(prev) - i + 1, 2), '^[\p{L}0-9]{2}'))]), 0)"""
_GROWN = f"""o AS (SELECT *, row_number() OVER w AS i, lag(chunk) OVER w AS prev FROM ch WINDOW w AS (PARTITION BY doc_id, section ORDER BY ordinal)),
x AS (SELECT doc_id, section, i, ordinal, block, chunk, length(chunk) AS own, sh, CASE WHEN sh > 0 THEN -sh ELSE 2 END AS gap FROM (SELECT *, CASE WHEN length(prev) >= 20 AND length(chunk) >= 20 THEN {_SHARED} ELSE 0 END AS sh FROM o)),
w AS (SELECT doc_id, section, i AS hit, block, i AS lo, i AS hi, own AS size, 0 AS t, FALSE AS done FROM x
 UNION ALL SELECT doc_id, section, hit, block, CASE WHEN go = 'lo' THEN lo - 1 ELSE lo END, CASE WHEN go = 'hi' THEN hi + 1 ELSE hi END, size + CASE go WHEN 'lo' THEN less WHEN 'hi' THEN more ELSE 0 END, t + 1, go IS NULL FROM (
  SELECT *, CASE WHEN can_lo AND (hit - lo <= hi - hit OR NOT can_hi) THEN CASE WHEN size + less <= {BUDGET} THEN 'lo' END WHEN can_hi AND size + more <= {BUDGET} THEN 'hi' END AS go FROM (
   SELECT w.*, a.own + n.gap AS less, y.own + y.gap AS more, coalesce(a.block = w.block, FALSE) AS can_lo, coalesce(y.block = w.block, FALSE) AS can_hi FROM w JOIN x n ON n.doc_id = w.doc_id AND n.section = w.section AND n.i = w.lo
   LEFT JOIN x a ON a.doc_id = w.doc_id AND a.section = w.section AND a.i = w.lo - 1 LEFT JOIN x y ON y.doc_id = w.doc_id AND y.section = w.section AND y.i = w.hi + 1 WHERE NOT w.done))),
w9 AS (SELECT * FROM w WHERE done),
y AS (SELECT doc_id, section, hit, lo, hi, size, 0 AS t, TRUE AS grew FROM w9
 UNION ALL SELECT doc_id, section, hit, CASE WHEN t % 2 = 1 AND fits THEN lo - 1 ELSE lo END, CASE WHEN t % 2 = 0 AND fits THEN hi + 1 ELSE hi END, size + CASE WHEN fits THEN add ELSE 0 END, t + 1, CASE WHEN t % 2 = 0 THEN fits ELSE grew OR fits END FROM (
  SELECT *, coalesce(size + add <= {BUDGET}, FALSE) AS fits FROM (SELECT y.*, CASE WHEN t % 2 = 0 THEN z.own + z.gap ELSE a.own + n.gap END AS add FROM y JOIN x n ON n.doc_id = y.doc_id AND n.section = y.section AND n.i = y.lo
   LEFT JOIN x a ON a.doc_id = y.doc_id AND a.section = y.section AND a.i = y.lo - 1 LEFT JOIN x z ON z.doc_id = y.doc_id AND z.section = y.section AND z.i = y.hi + 1 WHERE y.t = 0 OR y.t % 2 = 1 OR y.grew))),
f AS (SELECT doc_id, section, hit, max(hi) AS hi, min(lo) AS lo FROM y GROUP BY doc_id, section, hit)
SELECT f.doc_id, any_value(h.ordinal) AS ordinal, min(m.ordinal) AS first, max(m.ordinal) AS last, count(*) AS n_joined, string_agg(CASE WHEN m.i = f.lo THEN m.chunk WHEN m.sh > 0 THEN substr(m.chunk, m.sh + 1) ELSE chr(10) || chr(10) || m.chunk END, '' ORDER BY m.i) AS passage,
 (coalesce(sum(m.own) FILTER (WHERE m.i < f.hit), 0) + coalesce(sum(m.gap) FILTER (WHERE m.i > f.lo AND m.i <= f.hit), 0))::BIGINT AS match_start
FROM f JOIN x h ON h.doc_id = f.doc_id AND h.section = f.section AND h.i = f.hit JOIN x m ON m.doc_id = f.doc_id AND m.section = f.section AND m.i BETWEEN f.lo AND f.hi GROUP BY f.doc_id, f.section, f.hit"""


@query(f"WITH RECURSIVE {_CHUNKS}, {_GROWN}")
def grown_passages(spark, sf):
    """What is shown around every chunk: its block, then neighbours of its section on either side, within the budget."""
    return chunks.grown(kept(chunks.sentence_chunks(read(spark, sf, "documents"), MASKED), "chunks"))
