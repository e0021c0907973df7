"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from newsloom.plans import all_queries  # noqa: E402
from newsloom.session import build_session  # noqa: E402

HEADLINES = [
    "f1_squeeze_ws",
    "f8_uuid5",
    "f12_lenient_date",
    "f23_unescape_html",
    "p1_anchors",
    "p2_jsonld",
    "p4_body",
    "p7_listing",
    "p17_newsletter_links",
    "s1_read_indented",
    "s11_posts",
    "u1_articles_by_source_month",
    "u1_union_sources",
    "j1_new_only",
    "j2_exclude_all",
    "j5_upsert",
    "j9_lemmatize",
    "w1_take_until_known",
    "w2_loss_delta",
    "w4_early_stop",
    "w6_progress",
    "a3_category_counts",
    "a4_vocabulary",
    "a11_link_matrix",
    "m1_preprocess",
    "m2_train_vectors",
    "m4_title_regressor",
    "m6_score_titles",
    "m7_score_many",
    "m8_pool",
    "o3_most_similar",
    "d1_mapped_scorer",
    "st1_ingest_stream",
    "st2_score_stream",
    "s5_read_table",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__driver__memory="20g",
        spark__sql__shuffle__partitions=cpus,
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()[0]
    names = sys.argv[1:] or HEADLINES
    # Start-up of the session and the Python workers is no query's cost.
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{times[name]:8.3f} {name}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
