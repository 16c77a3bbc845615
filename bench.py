"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tidewater.registry import QUERIES

HEADLINE = ["daily_bars", "momentum_ic", "price_features", "forward_labels", "cross_section_z", "momentum_percentiles", "quintile_spread", "tail_risk", "asof_strict", "transition_matrix", "sector_weights", "volatility_models", "har_forecasts", "extreme_tails", "fund_features", "imputed_panel", "ranked_signals", "ml_verdicts", "option_strategies", "simulated_paths"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["sector_weights"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's compilers before anything is timed
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
