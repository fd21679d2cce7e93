"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gleaner.plans.catalog import QUERIES  # noqa: E402
from gleaner.session import local_session  # noqa: E402

HEADLINE = [
    "url_canonical", "content_hash", "page_clean", "tokenize", "lang_id", "extractive_summary",
    "dedup_url", "dedup_content", "dedup_batch", "near_dup_pairs",
    "index_build", "kw_search", "vec_search", "hybrid_search", "similar_articles",
    "topic_keywords", "topic_aggregate", "entity_extract", "relation_upsert", "graph_links",
    "related_merge", "article_list", "article_detail", "report_daily", "job_outcome", "feed_disable", "upsert_latest",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    # one cheap query first, so that start-up is not counted as the first headline
    spark.read.parquet(f"{sf}/region.parquet").count()
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
