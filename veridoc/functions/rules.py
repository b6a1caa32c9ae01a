"""Rule tables: ordered rewrites and ordered cases, as columns and as the SQL that must agree with them.

Patterns keep to what the JVM and RE2 read alike: no look-around, no back-reference.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Steps = list[tuple[str, str]]


def quoted(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def rewrite(col: Column, steps: Steps) -> Column:
    """`col` with each pattern replaced in turn; a replacement names groups as \\1."""
    for pattern, new in steps:
        col = F.regexp_replace(col, pattern, re.sub(r"\\(\d)", r"$\1", new.replace("$", r"\$")))
    return col


def rewrite_sql(expr: str, steps: Steps) -> str:
    for pattern, new in steps:
        expr = f"regexp_replace({expr}, {quoted(pattern)}, {quoted(new)}, 'g')"
    return expr


def first_rule(col: Column, rules: Steps, otherwise: str | None = None, roots: dict[str, tuple[str, ...]] | None = None, low: Column | None = None) -> Column:
    """The name of the first pattern that `col` holds, or `otherwise`.

    A pattern named in `roots` is tried only where `low`, `col` in lower case, holds one of its roots, of which every match has one."""
    out = F
    for pattern, name in rules:
        some = (roots or {}).get(name)
        held = col.rlike(pattern)
        out = out.when(reduce(Column.__or__, (F.contains(low, F.lit(r)) for r in some)) & held if some else held, name)
    return out.otherwise(F.lit(otherwise))


def first_rule_sql(expr: str, rules: Steps, otherwise: str | None = None) -> str:
    arms = " ".join(f"WHEN regexp_matches({expr}, {quoted(p)}) THEN {quoted(n)}" for p, n in rules)
    return f"CASE {arms} ELSE {'NULL' if otherwise is None else quoted(otherwise)} END"


def found(col: Column, pattern: str, group: int = 0) -> Column:
    """All matches in order."""
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def found_sql(expr: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({expr}, {quoted(pattern)}, {group})"
