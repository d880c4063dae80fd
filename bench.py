"""Times the headline queries: python bench.py prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from skyfront.plans import queries as points

NAMES = ("skyline_2d_within_sets", "skyline_3d", "skyline_4d_mixed_directions", "any_dominated_per_set", "pareto_rank_2d", "pareto_rank_3d", "normalise_01", "hv_2d_per_set", "hv_3d_per_set", "hv_4d_per_set", "hv_contributions_2d", "igd_plus", "epsilon_additive", "avg_hausdorff_p1", "r2_exact", "eaf_2d", "eafdiff_rectangles", "whv_rect", "vorob_levels", "hv_approx_rphi")


def main() -> None:
    cpus, folder = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("skyfront-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    points.QUERIES["skyline_2d_within_sets"](spark, folder).count()  # the session's first job is not a query's time
    took = {}
    for name in NAMES:
        began = time.time()
        points.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
