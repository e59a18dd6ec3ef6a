"""Reading the given tables, writing intermediate ones, and word rules shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contentflow.session import shared_dir

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
BLANKS = "[\\x20\\x09-\\x0D]+"
BLANK_CHARACTERS = " \t\n\x0b\x0c\r"
#: Rows up to which a side of a join is broadcast after it was counted; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(rows: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: a Parquet table in the shared folder, under a name never used again."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def words(text: Column) -> Column:
    """Words of a text in order; null and blank texts have none."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK_CHARACTERS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, BLANKS))


def absent(rows: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def looked_up(rows: DataFrame, side: DataFrame, key: str, size: int) -> DataFrame:
    """Left join to a side of counted size: broadcast when small, else shuffled with adaptive skew splitting."""
    return rows.join(F.broadcast(side) if size <= BROADCAST_ROWS else side, key, "left")
