"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEATS (default 3; the median is reported).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from labtrail.evaluation import compare  # noqa: E402
from labtrail.plans import catalog, evaluation  # noqa: E402
from labtrail.session import local_session  # noqa: E402
from labtrail.sources.driver_tables import Tables  # noqa: E402

HEADLINE = [
    "clean_lab",
    "attrition",
    "abnormal_runs",
    "data_diagnosis",
    "exclude_egfr",
    "labels",
    "history_sumstats",
    "monthly_interpolated",
    "lab_matrix",
    "code_prevalence",
    "code_matrix",
    "feature_matrix",
    "subgroups",
    "delong",
    "draw_bootstrap",
    "compare_models",
]


def few_filters(t):
    """Filters of the comparison's smaller grid: everybody, and sex."""
    names = F.array(F.lit("All"), F.col("sex"))
    return t.person.select("person_id", F.explode(names).alias("filter"))


def small_grid(method: str):
    """The comparison of one pair on three sets and three filters, as measured in the first round."""

    def build(spark, folder):
        t = Tables(spark, folder)
        sets = {k: v for k, v in compare.named_sets().items() if k != "TrainTuning"}
        return compare.compare_models(
            evaluation.long_predictions(t), [("m1", "m2")], few_filters(t), sets, evaluation.REPLICATES, method=method
        )

    return build


#: Beside the registered queries, which have the whole grid: both methods on the smaller one.
OTHER = {"compare_models_small": small_grid("poisson"), "compare_models_small_exact": small_grid("exact")}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = local_session(cpus, "16g")
    spark.read.parquet(f"{folder}/orders.parquet").count()
    spent = {}
    queries = {name: catalog.QUERIES[name] for name in HEADLINE} | OTHER
    for name in sys.argv[1:] or queries:
        times = []
        for _ in range(repeats):
            began = time.time()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        spent[name] = round(statistics.median(times), 3)
    found = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(s for n, s in spent.items() if n in HEADLINE), 3),
                "unit": "sec",
                "queries": spent,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
