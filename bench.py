"""Time the headline queries and print one JSON line.

Tables come from $BENCH_SF_DIR, threads from $BENCH_CPUS. ``stored_tables`` is the time to
derive and write the corpus and vector tables that the search queries read. Queries are timed
in two passes, the first of which is cold, and the faster time counts; ``calibration``, a fixed
sum over a range, tells how fast the machine is.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from newsloom.catalog import fixtures, load  # noqa: E402
from newsloom.session import build_session  # noqa: E402

HEADLINE = (
    "normalize_text", "content_id", "normalize_url", "page_text", "classify_signal", "is_topic_article",
    "browse_articles", "keyword_search", "semantic_search", "semantic_search_filtered", "cosine_topk",
    "cosine_topk_batch", "approx_topk", "corpus_stats", "top_publishers", "daily_timeline", "embedding_stats",
    "main_text", "keyword_search_indexed", "stream_dup_rate",
    "feed_items", "api_items", "admit_static", "admit_adaptive", "rolling_dup_rate", "attach_page_text",
    "ingest_pages", "encode_hashed", "embed_incremental", "upsert_corpus", "upsert_vectors", "ingest_stream",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = load()
    wanted = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    seconds: dict[str, float] = {}

    spark.range(1000).selectExpr("sum(id)").collect()
    start = time.time()
    fixtures.vectors(spark, folder)
    seconds["stored_tables"] = round(time.time() - start, 3)
    for _ in range(2):
        for name in wanted:
            start = time.time()
            registry[name][0](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = min(seconds.get(name, 1e9), round(time.time() - start, 3))
    total = round(sum(seconds.values()), 3)
    start = time.time()
    spark.range(200_000_000).selectExpr("sum(xxhash64(id) % 1000)").collect()
    calibration = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "calibration": calibration,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
