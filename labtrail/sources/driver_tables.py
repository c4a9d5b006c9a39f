"""Views over the driver's parquet tables that stand in for the clinical inputs."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labtrail.functions.uniform import uniform
from labtrail.session import tune


class Tables:
    """Lazily built views; column names are the library's canonical ones."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    @cached_property
    def person(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key.alias("person_id"),
            F.when(key % 2 == 0, "male").otherwise("female").alias("sex"),
            F.date_add(F.lit("1930-01-01").cast("date"), (key * 37 % 18000).cast("int")).alias(
                "birth_date"
            ),
            F.when(F.col("c_nationkey") % 3 == 0, "AURIA BIOBANK")
            .when(F.col("c_nationkey") % 3 == 1, "TAMPERE BIOBANK")
            .otherwise("HELSINKI BIOBANK")
            .alias("cohort"),
            F.when(key % 7 != 0, F.lit(18.0) + key % 20).alias("bmi"),
            F.when(key % 10 != 0, (key % 100).cast("double") / 100).alias("pc1"),
        )

    @cached_property
    def lab(self) -> DataFrame:
        day = F.col("o_orderdate").cast("date")
        price = F.floor("o_totalprice").cast("long")
        order = F.col("o_orderkey")
        # persons grow with the input: a shuffled join, or they are broadcast through the driver
        return (
            self.raw("orders")
            .join(
                self.person.select("person_id", "sex", "birth_date").hint("merge"),
                F.col("o_custkey") == F.col("person_id"),
            )
            .select(
                order.alias("rid"),
                "person_id",
                "sex",
                F.floor(F.datediff(day, "birth_date") / 365.25).cast("int").alias("event_age"),
                day.alias("dt"),
                F.col("o_orderpriority").alias("lab"),
                F.when(price % 17 != 0, F.lit(40) + (price % 1201).cast("double") / 10).alias(
                    "value"
                ),
                F.when(order % 11 == 0, "mg/dl").when(order % 13 != 0, "umol/l").alias("unit"),
                F.when(order % 19 == 0, None)
                .when(F.col("o_orderstatus") == "F", "N")
                .when(F.col("o_orderstatus") == "O", "H")
                .otherwise("L")
                .alias("flag"),
            )
        )

    @cached_property
    def labx(self) -> DataFrame:
        """The lab view with the rarer flags LL, HH, AA and A."""
        rid = F.col("rid")
        flag = (
            F.when(rid % 23 == 0, "LL")
            .when(rid % 29 == 0, "HH")
            .when(rid % 31 == 0, "AA")
            .when(rid % 37 == 0, "A")
            .otherwise(F.col("flag"))
        )
        return self.lab.withColumn("flag", flag)

    @cached_property
    def code(self) -> DataFrame:
        letter = F.substring(F.lit("ABCDEFGHIJ"), (F.col("p_partkey") % 10 + 1).cast("int"), F.lit(1))
        return (
            self.raw("lineitem")
            .join(self.raw("orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
            .join(self.raw("part").select("p_partkey", "p_size"), F.col("p_partkey") == F.col("l_partkey"))
            .select(
                F.col("l_orderkey").alias("rid"),
                F.col("l_linenumber").alias("line"),
                F.col("o_custkey").alias("person_id"),
                F.col("l_shipdate").cast("date").alias("dt"),
                F.concat(
                    letter,
                    F.lpad(F.col("p_size").cast("string"), 2, "0"),
                    F.col("l_linenumber").cast("string"),
                ).alias("code"),
                F.when(F.col("l_returnflag") == "A", "INPAT")
                .when(F.col("l_returnflag") == "R", "OUTPAT")
                .otherwise("PURCH")
                .alias("source"),
                F.when(F.col("l_linestatus") == "F", "ICP1").otherwise("1").alias("category"),
            )
        )

    @cached_property
    def register(self) -> DataFrame:
        """Detailed longitudinal register: two code columns, sources and versions."""
        rid, line = F.col("rid"), F.col("line")
        return self.code.join(self.person.select("person_id", "birth_date"), "person_id").select(
            "rid",
            "line",
            "person_id",
            F.when(line == 7, "DEATH")
            .when(line == 6, "REIMB")
            .when(line == 5, "PRIM_OUT")
            .when(line == 4, F.when(rid % 2 == 0, "OPER_IN").otherwise("OPER_OUT"))
            .otherwise(F.col("source"))
            .alias("source"),
            F.floor(F.datediff("dt", "birth_date") / 365.25).cast("int").alias("event_age"),
            "dt",
            F.when(rid % 7 == 0, "None").otherwise(F.col("code")).alias("code1"),
            F.when(rid % 5 == 0, F.col("code"))
            .when(rid % 3 == 0, F.substring("code", 2, 3))
            .when(rid % 4 != 0, F.concat(F.lit("K"), F.substring("code", 2, 3)))
            .alias("code2"),
            F.when(rid % 13 == 0, "MOP").when(rid % 17 == 0, "None").otherwise(F.col("category")).alias("category"),
            F.when(rid % 6 == 0, "9").when(rid % 10 == 0, "NA").otherwise("10").alias("icdver"),
        )

    @cached_property
    def covariate(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("rid"),
            F.col("user_id").alias("person_id"),
            F.col("ts").cast("date").alias("dt"),
            "ts",
            F.col("event_type").alias("kind"),
            "value",
        )

    @cached_property
    def pred(self) -> DataFrame:
        case = F.when(F.col("person_id") % 9 == 0, 1).otherwise(0)
        base = self.person.select(
            "person_id",
            case.alias("y"),
            uniform("person_id", salt="p1").alias("u1"),
            uniform("person_id", salt="p2").alias("u2"),
            uniform("person_id", salt="set").alias("u3"),
        )
        return base.select(
            "person_id",
            "y",
            (F.floor((F.lit(0.7) * F.col("u1") + F.lit(0.3) * F.col("y")) * 100) / F.lit(100.0)).alias("p1"),
            (F.floor((F.lit(0.85) * F.col("u2") + F.lit(0.15) * F.col("y")) * 100) / F.lit(100.0)).alias("p2"),
            F.when(F.col("u3") < 0.6, F.lit(0.0))
            .when(F.col("u3") < 0.7, F.lit(0.5))
            .when(F.col("u3") < 0.85, F.lit(1.0))
            .otherwise(F.lit(2.0))
            .alias("split_set"),
        )
