"""Requirements and submitted facts that the part and line tables give rise to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """req_id, standard and text: one sentence for each part, of eight kinds."""
    text = F.expr("""CASE p_partkey % 8
        WHEN 0 THEN concat('The size of the ', p_name, ' shall not exceed ', p_size, ' mm.')
        WHEN 1 THEN concat('The size shall be at least ', p_size, ' mm.')
        WHEN 2 THEN concat('The pressure shall be between ', p_size, ' and ', p_size + 10, ' bar.')
        WHEN 3 THEN concat('The vendor should supply ', p_type, ' drawings.')
        WHEN 4 THEN concat('The temperature shall be less than ', p_size, ' degF.')
        WHEN 5 THEN concat('The size shall be not less than ', p_size, ' cm.')
        WHEN 6 THEN concat('The housing shall be of ', p_name, ' type.')
        ELSE concat('Refer to ', p_brand, ', clause ', p_size, '.', p_size % 7, '.') END""")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("req_id"), F.col("p_brand").alias("standard"), text.alias("text"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """req_id, fact_id, page, cell and unit: what a line states for its part."""
    cell = F.expr("CASE WHEN l_tax = 0 THEN '' WHEN l_discount = 0.1 THEN 'later' WHEN l_discount = 0 THEN 'n/a' ELSE cast(cast(l_quantity AS bigint) AS string) END")
    unit = F.expr("CASE l_linenumber % 5 WHEN 0 THEN 'mm' WHEN 1 THEN 'cm' WHEN 2 THEN 'in' WHEN 3 THEN 'degF' ELSE 'kg' END")
    l = read(spark, sf_dir, "lineitem")
    return l.select(F.col("l_partkey").alias("req_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"), F.col("l_linenumber").alias("page"), cell.alias("cell"), unit.alias("unit"))


#: Questions that a part gives rise to, of sixteen kinds; the same text in either dialect of SQL.
QUESTION = """CASE p_partkey % 16
 WHEN 0 THEN concat('What is the ', p_name, '?') WHEN 1 THEN concat('what does API ', 600 + p_size, ' say about vibration')
 WHEN 2 THEN concat('define ', p_name) WHEN 3 THEN concat('What is the maximum size of ', p_name, '?')
 WHEN 4 THEN concat('is salt allowed on the ', p_name) WHEN 5 THEN concat('salt spray test of ', p_name)
 WHEN 6 THEN concat('how humid is too humid to paint the ', p_name) WHEN 7 THEN concat('what is the price and the size of ', p_name)
 WHEN 8 THEN 'how many standards do you have' WHEN 9 THEN concat('which welding standards cover ', p_name)
 WHEN 10 THEN concat('does the ', p_name, ' comply with clause ', p_size, '.2') WHEN 11 THEN 'thanks'
 WHEN 12 THEN concat('Spec A', p_size, '-', p_partkey % 50, ' rust limits') WHEN 13 THEN concat('time ', p_size, '.00 in the wave table')
 WHEN 14 THEN concat('list the documents about ', p_name) ELSE concat('meaning of ', upper(substr(p_name, 1, 3))) END"""

#: Lines of a data sheet or standard that an order line gives rise to, of sixteen kinds.
STATEMENT = """CASE (l_orderkey + 3 * l_linenumber) % 16
 WHEN 0 THEN concat('The design pressure shall not exceed ', cast(l_quantity AS bigint), ' bar.')
 WHEN 1 THEN concat('Minimum design temperature −', cast(l_quantity AS bigint), ' °C for pump P-', 100 + l_partkey % 900, 'A.')
 WHEN 2 THEN concat('The pressure shall be at least 8,3', 10 + cast(l_quantity AS bigint), ' kPa, see para. ', l_suppkey % 9, '.', l_partkey % 7, '.2 for details. Refer to API ', 600 + l_suppkey % 20, '.')
 WHEN 3 THEN concat('Range ', cast(l_quantity AS bigint), '-', 20 + cast(l_quantity AS bigint), ' mm applies.')
 WHEN 4 THEN concat('A value of ', cast(l_quantity AS bigint), ' mPa was printed.')
 WHEN 5 THEN concat('The viscosity is 1.5 x 10^-', 1 + l_suppkey % 5, ' Pa.s.')
 WHEN 6 THEN concat('Flow ', cast(l_quantity AS bigint), '.', l_suppkey % 10, ' (', 4 * cast(l_quantity AS bigint), ') m3/h (USGPM) at rated speed.')
 WHEN 7 THEN concat('Not less than the set pressure of ', cast(l_quantity AS bigint), ' barg.')
 WHEN 8 THEN concat('The maximum temperature, per ASME B31.', l_suppkey % 9, '-', 2000 + l_partkey % 20, ', is by vendor (see Note ', l_suppkey % 6, ').')
 WHEN 9 THEN concat('The flange shall be class ', 150 * (1 + l_partkey % 3), ' if the line is above ', l_suppkey % 12, ' inch.')
 WHEN 10 THEN concat(cast(l_quantity AS bigint), ' barg by vendor') WHEN 11 THEN concat('P-', 100 + l_suppkey, 'A P-', 100 + l_suppkey, 'B E-', 200 + l_partkey % 100, ' PSV-', 3000 + l_partkey % 100)
 WHEN 12 THEN concat('Tolerance +/-0.', cast(l_quantity AS bigint), ' mm. The set pressure is (-', cast(l_quantity AS bigint), ') barg.')
 WHEN 13 THEN concat('The lug must be ', cast(l_quantity AS bigint), ' mm thick and must carry ', 5 + cast(l_quantity AS bigint), ' kg.')
 WHEN 14 THEN concat(1 + l_suppkey % 9, '.', l_partkey % 9, ' Vibration Limits') ELSE '' END"""

_STATEMENTS = ("l_orderkey AS doc_id", "l_linenumber AS page", "cast(l_quantity AS bigint) AS value", f"{STATEMENT} AS text")
QUESTIONS_SQL = f"(SELECT p_partkey AS q_id, {QUESTION} AS question FROM part)"
STATEMENTS_SQL = f"(SELECT {', '.join(_STATEMENTS)} FROM lineitem)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q_id and question: what a user may ask about each part."""
    return read(spark, sf_dir, "part").selectExpr("p_partkey AS q_id", f"{QUESTION} AS question")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, value and text: what each line of an order states on its page."""
    return read(spark, sf_dir, "lineitem").selectExpr(*_STATEMENTS)
