"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shutterlake.queries import all_queries  # noqa: E402
from shutterlake.session import build_session  # noqa: E402

HEADLINE = [
    "similarity_join", "near_duplicate_join", "near_duplicate_join_banded", "phash",
    "similarity_search", "transitive_matches", "connected_faces", "capped_average_linkage",
    "candidate_people", "face_triage", "duplicate_groups", "dedup_report", "clean_report",
    "nms", "iou", "decode_anchors", "normalise_image_tags", "pick_primary", "register_files",
    "build_folder_tree", "search_media", "keyword_counts", "browse_page", "item_details",
    "map_clusters", "people_summary", "apply_ratings", "activity_counts", "hourly_histogram",
    "group_write_decision", "library_stats", "unique_names", "checksum_audit", "stream_activity",
]


def main() -> None:
    with tempfile.TemporaryDirectory(prefix="bench-") as shared:
        run(shared)


def run(shared: str) -> None:
    """Times the queries; intermediate tables go to ``shared``, which is removed afterwards."""
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": shared,
            "spark.sql.shuffle.partitions": cpus,
            "spark.log.level": "ERROR",
        },
    )
    known = all_queries()
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    known["activity_counts"].run(spark, sf_dir).count()  # start the workers
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        known[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
