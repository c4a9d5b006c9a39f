"""Writers: Parquet data next to small CSV count tables, and text conversion."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labtrail.session import shared_folder


def work_folder(spark: SparkSession) -> str:
    """Fresh folder below the cluster's shared checkpoint folder."""
    return f"{shared_folder(spark).rstrip('/')}/labtrail-{uuid.uuid4().hex}"


def text_to_parquet(
    spark: SparkSession,
    source: str,
    target: str,
    sep: str = "\t",
    types: Mapping[str, str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Delimited text (gz allowed) to Parquet with optional column types.

    A gz file can only be read by one task, so its rows are spread before they are written: over `partitions`, or
    over as many as a shuffle has.
    """
    if partitions is None and source.endswith(".gz"):
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = spark.read.options(header=True, sep=sep, inferSchema=types is None).csv(source)
    if types:
        table = table.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})
    if partitions:
        table = table.repartition(partitions)
    table.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def write_tables(data: DataFrame, counts: DataFrame, folder: str, name: str) -> tuple[str, str]:
    """Data as Parquet and its attrition table as CSV; returns both paths."""
    data_path, count_path = f"{folder}/{name}.parquet", f"{folder}/counts/{name}_counts.csv"
    data.write.mode("overwrite").parquet(data_path)
    counts.write.mode("overwrite").option("header", True).csv(count_path)
    return data_path, count_path


def removed_ids(stages: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Persons lost between two frames, one row per person with the reason.

    `stages` maps a reason to (before, after).
    """
    lost = [
        before.select("person_id")
        .distinct()
        .join(after.select("person_id").distinct(), "person_id", "left_anti")
        .withColumn("reason", F.lit(reason))
        for reason, (before, after) in stages.items()
    ]
    out = lost[0]
    for more in lost[1:]:
        out = out.unionByName(more)
    return out
