"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tickloom.catalog import REGISTRY  # noqa: E402
from tickloom.session import build_session  # noqa: E402

HEADLINE = [
    "daily_bars", "quality_report", "feature_dataset", "factor_panel", "rank_ic_by_date", "composite_score",
    "target_weights", "running_positions", "costed_fills", "performance_report", "article_polarity",
    "symbol_news_signal", "walk_forward_folds",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["coverage"].run(spark, folder).collect()  # start-up is not the queries' cost
    times = timed(spark, folder)
    out = {
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(folder).name.removeprefix("sf"),
    }
    # Growth: the same queries over a tenth of the rows, after the large run has warmed everything up.
    if folder != (small := os.environ.get("BENCH_SMALL_DIR", "/root/testdata/sf0.01")) and Path(small).is_dir():
        less = timed(spark, small)
        out |= {"small_sf": Path(small).name.removeprefix("sf"), "small_queries": less, "growth": {q: round(times[q] / less[q], 2) for q in times}}
    spark.stop()
    print(json.dumps(out))


def timed(spark, folder: str) -> dict[str, float]:
    """Seconds of each headline query over a folder of tables."""
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    return times


if __name__ == "__main__":
    main()
