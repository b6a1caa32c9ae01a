"""Tables of a data folder, their inventory, and plain sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counts(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = NAMES) -> DataFrame:
    """Rows of each table; Parquet footers answer it without reading columns."""
    out = None
    for n in names:
        one = read(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def masked(df: DataFrame, sensitive: tuple[str, ...] = ("name", "email", "phone", "password", "token")) -> DataFrame:
    """`df` with string columns of a sensitive name shown by their first two characters only."""
    shown = []
    for f in df.schema.fields:
        hit = f.dataType.simpleString() == "string" and any(s in f.name.lower() for s in sensitive)
        shown.append(F.concat(F.substring(f.name, 1, 2), F.lit("***")).alias(f.name) if hit else F.col(f"`{f.name}`"))
    return df.select(*shown)


def export(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes `df` as parquet, json or csv (with a header)."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)
