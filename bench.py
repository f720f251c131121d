"""Time the headline queries, each once untimed and once timed, and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the
data and the cores. Every query is run to the end into the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from reportlake.session import local_session  # noqa: E402
from reportlake.workloads import QUERIES  # noqa: E402

HEADLINE = [
    "flagship_sections_by_quality",
    "t03_settled_sections",
    "t05_clean_reports",
    "t16_label_reports",
    "a04_cohort_table",
    "a05_label_frequency",
    "a08_scores_mention",
    "a10_comparison",
    "j02_study_labels",
    "j05_existing_items",
    "j06_labels_by_text",
    "p18_paths",
    "m02_target_size",
    "flow_instruction_rows",
    "flow_image_batches",
    "n13_padded_batches",
    "w00_global_ordinal",
    "w04_sampled_items",
    "w05_image_balanced_4",
    "w06_length_grouped",
    "w08_variable_length",
    "w09_modality_grouped",
    "w10_modality_auto",
    "w13_packed",
    "i07_preset",
    "p16_decoded",
    "s09_sections_csv",
    "x1_stream_sections",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    checkpoints = tempfile.TemporaryDirectory(prefix="reportlake-bench-")
    spark = local_session("bench", cores, checkpoints=checkpoints.name)
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM's and Python's workers outside the clock
    spark.range(1000).selectExpr("sum(id)").collect()
    spark.range(8).repartition(8).mapInPandas(lambda b: b, "id long").collect()
    seconds = {}
    for name in HEADLINE:
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    scale = Path(folder).name.removeprefix("sf")
    spark.stop()
    checkpoints.cleanup()
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": float(scale)}))


if __name__ == "__main__":
    main()
