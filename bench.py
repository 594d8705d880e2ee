"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the test data, BENCH_CPUS the local threads. Each query is planned and
run whole, its result written to Spark's ``noop`` sink; the median of the runs after
one warm-up counts. The vocabulary that queries encode against is counted once, beforehand: its time is
that of ``vocab_frequency``, and the other queries read it as a table.
"""

from __future__ import annotations

import contextlib
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from corpusweave.operators.encode import token_count  # noqa: E402
from corpusweave.plans import queries  # noqa: E402
from corpusweave.plans.queries import QUERIES, documents  # noqa: E402
from corpusweave.session import local_session, settled  # noqa: E402

HEADLINE = [
    "split_holdout",
    "seeded_shuffle",
    "vocab_frequency",
    "encode_corpus",
    "decode_tokens",
    "pack_sharded",
    "pack_global",
    "pack_stats",
    "truncate_sequences",
    "collate_left_pad",
    "vocab_overlap_summary",
    "freeze_counts",
    "token_loss",
    "perplexity",
    "matrix_l1",
    "strip_echoed_dialogue",
    "batched_map",
    "prepare_corpus",
    "prepare_file_order",
]
RUNS = 3


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def given(vocabulary):
    return lambda spark, sf_dir: vocabulary


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    with contextlib.redirect_stdout(sys.stderr):
        spark = local_session(cpus=cpus, app="bench")
        spark.sparkContext.setLogLevel("ERROR")
        size = documents(spark, sf_dir).agg(F.count("*"), F.sum(token_count(F.col("text")))).first()
        ready = {name: given(settled(getattr(queries, name)(spark, sf_dir))) for name in ("vocab_a", "vocab_b")}
        times = {}
        counted = {"vocab_a": queries.vocab_a, "vocab_b": queries.vocab_b}
        for name in HEADLINE:
            if name == "vocab_frequency":
                vars(queries).update(counted)
            else:
                vars(queries).update(ready)
            run(spark, name, sf_dir)  # a warm-up
            times[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(RUNS)), 3)
        spark.stop()
    rates = {
        f"{name}_tokens_per_sec": round(size[1] / times[name])
        for name in ("encode_corpus", "pack_sharded", "prepare_corpus", "prepare_file_order")
    }
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "documents": size[0],
                "tokens": size[1],
                **rates,
            }
        )
    )


if __name__ == "__main__":
    main()
