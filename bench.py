"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from panelyst.plans.catalogue import QUERIES
from panelyst.session import build_session, table_folder, written
from panelyst.sources.publish import PanelStore
from panelyst.sources.tables import part_panel, stored

HEADLINE = (
    "rank_level", "rank_directions", "yoy_rank", "movement_two_year", "movement_yoy", "movement_three_year",
    "movement_growth", "family_prices", "family_trade", "family_capital", "family_fx", "family_external",
    "family_population", "compare_universe", "compare_requests", "group_series", "group_ratio", "ingest_counters",
    "payload_verdicts", "dataset_state", "total_changes", "integrity_clean",
)
PUBLISHED = ("total_current", "exports_current", "imports_current", "population_total")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        "panelyst-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.time()
        QUERIES[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.time() - start, 3)

    def publish() -> dict[str, float]:
        """Refreshes of a stored panel: nothing changed, and one metric changed."""
        obs = written(stored(part_panel(spark, sf_dir, PUBLISHED)).drop("fetched_at"))
        store = PanelStore(spark, table_folder(spark))
        store.publish(0, obs, 1900, 2100)
        value = F.when(F.col("metric") == PUBLISHED[0], F.col("value") + 1).otherwise(F.col("value"))
        out = {}
        for version, (name, rows) in enumerate((("publish_unchanged", obs), ("publish_one_metric", obs.withColumn("value", value))), 1):
            start = time.time()
            store.publish(version, rows, 1900, 2100)
            out[name] = round(time.time() - start, 3)
        return out

    run("rank_level")  # starts the JVM's hot paths; not counted
    seconds = {name: run(name) for name in HEADLINE} | publish()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
