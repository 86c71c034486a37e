"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gaugeline.operators import features as feat  # noqa: E402
from gaugeline.operators import sampling, schedule, scores, text, views  # noqa: E402
from gaugeline.operators.schedule import Regimen  # noqa: E402
from gaugeline.plans import backtest  # noqa: E402
from gaugeline.queries import QUERIES  # noqa: E402
from gaugeline.session import RECOMMENDED, materialize  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEAT = int(os.environ.get("BENCH_REPEAT", "1"))

# The feature list of the standard regimen.
STANDARD = ["day", "weekday", "hour", "minute", "hist_1D8H", "hist_1D4H", "hist_1D2H", "hist_1D1H", "hist_1D", "hist_1D15m", "hist_1D30m", "hist_1D45m"]
WEEK = Regimen("7D", "1D", min_train=300)


def session() -> SparkSession:
    builder = SparkSession.builder.master(f"local[{CPUS}]").appName("gaugeline-bench")
    settings = {**RECOMMENDED, "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
                "spark.ui.showConsoleProgress": "false"}
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def events(spark):
    return spark.read.parquet(f"{SF_DIR}/events.parquet")


def user_predictions(spark):
    rows = materialize(feat.transform(events(spark), "user_id", "ts", "value", ["weekday", "hour", "hist_1D"], "1h"))
    return backtest.naive(rows, schedule.measured_range(events(spark), "ts"), WEEK, "user_id", "ts", "value")


def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def user_group_means(spark):
    rows = materialize(feat.transform(events(spark), "user_id", "ts", "value", ["weekday", "hour"], "1h"))
    return backtest.group_mean(rows, schedule.measured_range(events(spark), "ts"), WEEK, "user_id", "ts", "value", keys=["hour"], per_entity=True)


CASES = {
    "c10_features_15min": lambda s: feat.transform(events(s), "user_id", "ts", "value", STANDARD, "15min"),
    "c10_features_1h": lambda s: feat.transform(events(s), "user_id", "ts", "value", ["weekday", "hour", "hist_1D", "hist_1D_4H"], "1h"),
    "d13_view_bundle": lambda s: views.build(materialize(user_predictions(s))),
    "d4_overall_error": lambda s: scores.overall_error(scores.entity_errors(user_predictions(s))),
    "m13_backtest_naive": user_predictions,
    "m16_group_mean": user_group_means,
    "m13_backtest_forest": lambda s: QUERIES["m10_m13_backtest_forest"](s, SF_DIR),
    "s1_sample_entities": lambda s: sampling.sample_entities(events(s), "user_id", 5.0),
    "a8_entity_store_merge": lambda s: QUERIES["a8_entity_store_merge"](s, SF_DIR),
    "m18_tf_idf": lambda s: text.tf_idf(documents(s), "doc_id", "text"),
}


def main() -> None:
    spark = session()
    feat.transform(events(spark).limit(1000), "event_type", "ts", "value", ["hour", "hist_1D"], "1h").count()  # start-up cost
    times = {}
    for name, case in CASES.items():
        best = None
        for _ in range(REPEAT):
            start = time.perf_counter()
            case(spark).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
