"""Run the headline queries and print one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from sulatan.plans.registry import queries  # noqa: E402
from sulatan.session import local_session  # noqa: E402

# one or two queries per operator family; BENCH_QUERIES=all or a comma list overrides
HEADLINE = [
    "transliterate", "syllable_breakdown", "native_confidence", "translation_rule_check", "wordlist_load",
    "resolve_ambiguous_words", "resolve_lines", "spelling_correction", "box_union", "words_by_gap", "detect_bands",
    "component_to_band", "merge_boxes", "fuse_glyph_reading", "ovo_vote", "top5_similarity", "classification_metrics",
    "parse_replies", "sanitize_detections", "session_latest_status", "archive_write", "result_report_text", "steadiness",
    "held_steady", "session_log_stream", "rank_readings", "spaced_top_k", "kernel_similarity",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    wanted = os.environ.get("BENCH_QUERIES", "")
    known = queries()
    names = list(known) if wanted == "all" else [q for q in wanted.split(",") if q] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * int(cpus)), app="bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_wall_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
