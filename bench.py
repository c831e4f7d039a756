"""Times the headline queries and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from driftwood.plans import catalog

HEADLINE = ["chi_squared_test", "ks_test", "anderson_darling_normal", "shannon_entropy", "mutual_information", "mixing_summary", "dfa_hurst", "zscore", "shapiro_wilk", "finite_field", "quadratic_residues", "ami_curve", "metropolis_hastings", "fft_spectrum", "psd_welch", "persistence", "vietoris_rips", "visibility_metrics", "clustering_coefficients", "centralities", "integrated_information", "correlation_dimension", "draw_bayes", "draw_multifractal"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a few hundred KB a partition, but much work on them
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog.queries(), {}
    catalog.flagship(spark, sf_dir).collect()  # starts the JVM's code and the Python workers
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
