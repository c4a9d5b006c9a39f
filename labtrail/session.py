"""Session settings and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a hot person or code is split even when that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings the operators rely on to a given session."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("labtrail")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors see, set as the checkpoint folder.

    It is the one the cluster names in `spark.checkpoint.dir`. Where that is unset, a session whose
    driver and executors are one process (`local[...]`) makes a folder of its own; on a cluster the
    missing setting is an error, because executors would not see each other's files.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="labtrail-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Write `df` to the reliable checkpoint folder and read it back."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """`df` as a table in the shared folder, dealt to buckets by `keys` and sorted by them in each.

    Joins, windows and groups by these keys read the buckets as they are: no exchange, no sort. The exchange
    that deals the rows out is the only one, whatever number of steps follows.
    """
    spark = df.sparkSession
    name = f"labtrail_{uuid.uuid4().hex}"
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(number, *keys).write.bucketBy(number, *keys).sortBy(*keys)
    dealt.option("path", f"{shared_folder(spark).rstrip('/')}/{name}").saveAsTable(name)
    return spark.table(name)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all shuffle partitions, before a step that multiplies them.

    Adaptive execution merges small partitions by their size, which does not
    foresee the growth; an explicit number of partitions is left alone.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
