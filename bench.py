"""Time the headline queries; print one JSON line."""

from __future__ import annotations

import json
import os
import time

from seepage import catalog
from seepage.session import build_session

HEADLINE = (
    "a3_leak_counts",
    "a6_audit_stream",
    "k2_encode",
    "k7_pack_blocks",
    "l1_fit_ngram_lm",
    "l2_perplexity",
    "l8_rank_by_ratio",
    "m2_corpus_bleu",
    "m3_rouge_1",
    "m6_greedy_cosine_match",
    "d1_clip_contributions",
    "p7_clean_body",
    "p11_clean_web",
    "t1_shuffle",
    "t5_split_by_position",
    "x6_contact",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.driver.memory": "12g",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.collect("QUERIES")
    only = os.environ.get("BENCH_QUERIES", "").split()
    seconds = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {"metric": "total wall time", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf")}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
