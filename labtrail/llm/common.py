"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labtrail.session import shared_folder, stage

#: The white space of the word pattern `[^\x20\x09-\x0D]+`.
SPACES = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: write `df` into the folder that the cluster shares, and read it back."""
    return stage(df)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{shared_folder(spark).rstrip('/')}/labtrail-{name}-{uuid.uuid4().hex}"


def whole_row(df: DataFrame, *names: str) -> DataFrame:
    """Columns `names` next to `_row`, a struct of all columns, so that no name can clash."""
    return df.select(F.struct("*").alias("_row"), *names)


def restored(df: DataFrame, *added: str) -> list[Column]:
    """The columns of `_row`, but for those that `added` columns replace, and these."""
    names = [x for x in df.schema["_row"].dataType.names if x not in added]
    return [F.col("_row").getField(x).alias(x) for x in names] + [F.col(x) for x in added]


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; null has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(plain, " "), "")


def parts(spark: SparkSession, least: int = 1) -> int:
    """Partitions that a shuffle makes in this session."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
