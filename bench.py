"""Times the headline queries and prints one JSON line.

Folder and cores come from BENCH_SF_DIR and BENCH_CPUS. Session start and one
small warm-up run are outside the clock. Training runs K=32 for ten iterations,
the setting of the published single-node numbers.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from affinis import eals_train, eals_train_uniform, prepare  # noqa: E402
from affinis.operators.ranking import evaluate, recommend  # noqa: E402
from affinis.plans.prepare import prepare_summary  # noqa: E402
from catalog.fixtures import purchases  # noqa: E402

RANK, ITERATIONS = 32, 10


def run(spark: SparkSession, folder: str, rank: int, iterations: int) -> dict[str, float]:
    times = {}

    def clock(name, action):
        started = time.monotonic()
        result = action()
        times[name] = round(time.monotonic() - started, 3)
        return result

    data = clock("prepare", lambda: prepare(purchases(spark, folder)))
    clock("prepare_summary", lambda: prepare_summary(data).collect())
    size = (data.train, data.num_users, data.num_items)
    model = clock("eals_train", lambda: eals_train(*size, K=rank, num_iter=iterations))
    clock("eals_train_uniform", lambda: eals_train_uniform(*size, num_factors=rank, num_iter=iterations))
    factors = (model.user_factors, model.item_factors, data.train)
    clock("rank_eval_multi", lambda: evaluate(*factors, data.test, rank, (5, 10, 20)).collect())
    clock("recommend_topk", lambda: recommend(*factors, rank, 10).write.format("noop").mode("overwrite").save())
    return times


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("affinis-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    small = Path(folder).parent / "sf0.001"
    run(spark, str(small) if small.exists() else folder, 8, 2)
    times = run(spark, folder, RANK, ITERATIONS)
    name = Path(folder).name.removeprefix("sf")
    scale = float(name) if name.replace(".", "", 1).isdigit() else name
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
