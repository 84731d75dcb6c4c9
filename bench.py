"""Time the headline queries; prints one JSON line.

``$BENCH_SF_DIR`` names the tables and ``$BENCH_CPUS`` the threads.  Each query
is run once to warm up and then timed; its result is written to Spark's noop
sink, so all rows are made and none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pointspan import queries as points  # noqa: E402

HEADLINE = (
    "sphere_strict_ids", "box_strict_ids", "sphere_nonstrict_ids", "sphere_chunks", "leaf_partition", "ball_point_batch", "knn_single", "knn_batch",
    "ball_tree_pairs", "query_pairs", "count_neighbors_multi_r", "sparse_distance_matrix", "radial_profile", "dataset_bounding_box", "full_morton",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)

    def warmed(name: str, run) -> None:
        run().write.format("noop").mode("overwrite").save()
        timed(name, run)

    def build():
        points.BUILT.clear()  # else the session's index is used again
        return points.make(points.events(spark, sf_dir), 50, points.GRID).points

    hundred = points.events(spark, sf_dir).df.filter("id < 100").select(points.F.col("id").alias("qid"), "x", "y", "z")
    warmed("index_build", build)
    warmed("balls_100", lambda: points.search.ball_point(hundred, points.events(spark, sf_dir).df, 40.3))
    warmed("knn_100_queries_k_100", lambda: points.knn.nearest_batch(hundred, points.events(spark, sf_dir).df, 100))
    for name in HEADLINE:
        warmed(name, lambda name=name: points.QUERIES[name](spark, sf_dir))
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
