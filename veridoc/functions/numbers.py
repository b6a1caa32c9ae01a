"""Numbers, units, limits and comparisons read out of text."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import found, found_sql, rewrite, rewrite_sql
from .text import once

#: Unit, dimension, base unit, factor; no factor: recognised but not converted.
UNITS = (
    ("um", "length", "um", 1.0), ("mm", "length", "um", 1000.0), ("cm", "length", "um", 10000.0), ("m", "length", "um", 1000000.0), ("in", "length", "um", 25400.0),
    ("MPa", "pressure", "MPa", 1.0), ("bar", "pressure", "MPa", 0.1), ("kPa", "pressure", "MPa", 0.001),
    ("h", "time", "h", 1.0), ("min", "time", "h", 1 / 60), ("m3/h", "flow", "m3/h", 1.0), ("l/h", "flow", "m3/h", 0.001),
    ("degF", "temperature", "degF", None), ("dB(A)", "level", "dB(A)", None), ("ppmw", "fraction", "ppmw", None),
)
#: Phrases of each direction; "not less than" is read before "less than".
AT_LEAST, AT_MOST = "not less than|at least|minimum|greater than|exceeding", "not exceed|not more than|at most|maximum|less than"


def as_number(token: Column) -> Column:
    """One signed number, with thousands commas; dotted designations such as 5.3.2 are none."""
    plain = F.regexp_replace(token, r"(?<=[0-9]),(?=[0-9]{3})", "")
    return F.when(plain.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), plain.cast("double"))


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([0-9][0-9.,]*[0-9]|[0-9])"), F.lit(1))


def _unit_map(index: int) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(u[0]), F.lit(u[index])) for u in UNITS))


def dimension(unit: Column) -> Column:
    return F.element_at(_unit_map(1), unit)


def normalised(value: Column, unit: Column) -> Column:
    """Value in the base unit; null, never 0, where the unit is unknown or is not converted."""
    factors = F.create_map(*chain.from_iterable((F.lit(u[0]), F.lit(u[3]).cast("double")) for u in UNITS if u[3] is not None))
    return value * F.element_at(factors, unit)


def direction(text: Column) -> Column:
    """<= or >= by the phrase of a limit; null without one, or with both."""
    low = F.lower(text)
    up = low.rlike(AT_LEAST)
    rest = F.regexp_replace(low, "not less than", "")
    down = rest.rlike(AT_MOST)
    return F.when(up & ~down, ">=").when(down & ~up, "<=")


def strict(text: Column) -> Column:
    """Whether a limit excludes its own value."""
    return F.regexp_replace(F.lower(text), "not less than|not more than", "").rlike("less than|greater than|exceeding")


def requirement_type(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(~low.rlike("(^| )(shall|must) "), F.when(low.rlike("(^| )refer to "), "citation").otherwise("statement"))
        .when(low.rlike("between [0-9.]+ and [0-9.]+"), "range")
        .when(direction(text).isNotNull() & low.rlike("[0-9]"), "numeric limit")
        .otherwise("nominal")
    )


def verdict(value: Column, limit: Column, way: Column, is_strict: Column) -> Column:
    """meets, does not meet, or null: unknown parts and a value equal to a strict limit decide nothing."""
    near = F.abs(value - limit) <= 1e-6 * F.greatest(F.abs(limit), F.lit(1.0))
    ok = F.when(way == "<=", value <= limit).when(way == ">=", value >= limit)
    return F.when(near & is_strict, F.lit(None).cast("string")).when(near | ok, "meets").when(~ok, "does not meet")


def blank_marker(cell: Column) -> Column:
    """blank, placeholder or value: answers such as n/a are values, marks that stand for a later answer are blank."""
    t = F.lower(F.trim(cell))
    return (
        F.when(cell.isNull() | (t == ""), "blank")
        .when(t.isin("n/a", "nil", "none", "no"), "value")
        .when(t.rlike(r"^([*-]+|later|tbn|tba|by vendor|note [0-9]+)$"), "placeholder")
        .otherwise("value")
    )


SUPERSCRIPTS, MINUS = "⁰¹²³⁴⁵⁶⁷⁸⁹", "−–⁻"
#: Rewrites that leave a minus only where it can be nothing else; an exponent is e, one below zero em.
SIGNS = [
    (f"[{MINUS}]", "-"), ("10 ?\\^ ?-", "10^m"), ("([0-9]) ?[x×] ?10\\^(m?[0-9]+)", "\\1e\\2"), ("(^|[^0-9.,e])10\\^(m?[0-9]+)", "\\11e\\2"), ("([0-9])e-([0-9])", "\\1em\\2"),
    ("([0-9])-([0-9])", "\\1 ~ \\2"), ("([0-9]) -([0-9])", "\\1 ~ \\2"), ("([A-Za-z/])-([0-9])", "\\1~\\2"),
]
RAISED = [("10⁻([⁰¹²³⁴-⁹])", "10^m\\1"), ("10([⁰¹²³⁴-⁹])", "10^\\1")]
NUMBER_TOKEN = "[+-]?[0-9][0-9.,]*[0-9](?:em?[0-9]+)?|[+-]?[.]?[0-9](?:em?[0-9]+)?"
PLAIN = "^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)(em?[0-9]+)?$"
GROUPED = "^[+-]?[0-9]{1,3}(,[0-9]{3})+([.][0-9]+)?$"
DECIMAL_COMMA = "^[+-]?[0-9]+,[0-9]{1,2}$"


def value_of(token: Column) -> Column:
    """The number a token of `number_list` is: 8,300 and 9,0 are read by their commas; 5.3.2 or 1,2,3 is none."""
    return (
        F.when(token.rlike(PLAIN), F.replace(token, F.lit("m"), F.lit("-")).cast("double"))
        .when(token.rlike(GROUPED), F.replace(token, F.lit(","), F.lit("")).cast("double"))
        .when(token.rlike(DECIMAL_COMMA), F.replace(token, F.lit(","), F.lit(".")).cast("double"))
    )


def value_of_sql(token: str) -> str:
    return f"""CASE WHEN regexp_matches({token}, '{PLAIN}') THEN try_cast(replace({token}, 'm', '-') AS DOUBLE) WHEN regexp_matches({token}, '{GROUPED}') THEN try_cast(replace({token}, ',', '') AS DOUBLE)
 WHEN regexp_matches({token}, '{DECIMAL_COMMA}') THEN try_cast(replace({token}, ',', '.') AS DOUBLE) END"""


def number_list(text: Column) -> Column:
    """Tokens of all numbers of a text in order, each with its sign; a dash in a range or a name is none."""
    # the first of SIGNS maps signs one by one, as the raised digits are mapped: both in one pass; ASCII has neither
    mapped = F.translate(rewrite(text, RAISED), SUPERSCRIPTS + MINUS, "0123456789" + "-" * len(MINUS))
    plain = F.when(F.octet_length(text) == F.char_length(text), text).otherwise(mapped)
    # every other of SIGNS needs a minus or a caret, the first three of them a caret
    signed = lambda x: F.when(F.contains(x, F.lit("^")), rewrite(x, SIGNS[1:])).when(F.contains(x, F.lit("-")), rewrite(x, SIGNS[4:])).otherwise(x)
    # looking ahead passes over most signs of a text at once
    return once(plain, lambda x: found(signed(x), f"(?=[-+.0-9])(?:{NUMBER_TOKEN})"))


def lists(text: Column, token: str) -> Column:
    """Whether `number_list` holds `token`, digits and points alone: they stand side by side in the text, raised or not, or it is not read."""
    return F.contains(F.translate(text, SUPERSCRIPTS, "0123456789"), F.lit(token)) & F.array_contains(number_list(text), token)


def number_list_sql(expr: str) -> str:
    return found_sql(rewrite_sql(f"translate({rewrite_sql(expr, RAISED)}, '{SUPERSCRIPTS}', '0123456789')", SIGNS), NUMBER_TOKEN)


def values_of(tokens: Column) -> Column:
    """The numbers among tokens of `number_list`; compounds such as 5.3.2 are left out."""
    return F.filter(F.transform(tokens, value_of), lambda x: x.isNotNull())


def number_values(text: Column) -> Column:
    """The numbers of a text; compounds such as 5.3.2 are left out."""
    return values_of(number_list(text))


def number_values_sql(expr: str) -> str:
    return f"list_filter(list_transform({number_list_sql(expr)}, lambda x: {value_of_sql('x')}), lambda y: y IS NOT NULL)"


def one_number(text: Column) -> Column:
    """The value of a text that is one number and nothing else, exponents of ten included."""
    tokens = number_list(text)
    bare = F.trim(text).rlike("^[-−–+]?[0-9.,]+( ?[x×] ?10 ?\\^ ?[-−]?[0-9]+|e-?[0-9]+|\\^ ?[-−]?[0-9]+|⁻?[⁰¹²³⁴-⁹]+)?$")
    return F.when(bare & (F.size(tokens) == 1), value_of(F.element_at(tokens, 1)))


def states(text: Column, value: Column) -> Column:
    """Whether a text states a value as a whole signed number."""
    return F.exists(number_values(text), lambda x: x == value)
