"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import Observation  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from hiresift.plans import registry  # noqa: E402
from hiresift.session import local_session  # noqa: E402

HEADLINE = (
    "batch_rank", "term_index", "keyword_coverage", "html_to_text", "tokenize", "skill_tokens", "keyword_top_n", "jd_requirements",
    "search_visibility", "screen_scores", "greedy_select", "ground_fields", "verify_rewrite", "conversion_by_band", "component_ranking",
    "employment_gaps", "find_company", "answer_cache_lookup", "set_precision_recall", "stream_dedup_postings",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "hiresift-bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    timings, rows = {}, {}
    for key in HEADLINE:
        start = time.time()
        seen = Observation(key)
        registry.run(key, spark, sf_dir).observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
        timings[key], rows[key] = round(time.time() - start, 3), seen.get["rows"]
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings, "rows": rows, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
