import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from cases import SCHEMA, empty_table, odd_rows, odd_table
from pyspark.sql import functions as F

from corpusweave.llm.mixing import MAX_PASSES, WEIGHTS, first_words, mix_sources, mixed_documents, taken_by_document


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes):
    """Targets by resharing the excess until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    target, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in target]
        if not free:
            return target
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] >= MAX_PASSES * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        target |= {s: MAX_PASSES * sizes[s] for s in over}


def plain_mix(rows):
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += size_of(text)
    targets, queues, taken = plain_targets(sizes), defaultdict(list), []
    for doc_id, text, _, source, _ in rows:
        n = size_of(text)
        key = hashlib.md5(f"42:{'' if doc_id is None else doc_id}:{n}".encode()).hexdigest()[:15]
        queues[source].append((key, doc_id is not None, doc_id, n))
    for source, queue in queues.items():
        before = 0
        for _, _, doc_id, n in sorted(queue, key=lambda q: (q[0], q[1], q[2] or 0, q[3])):
            got = sum(max(0, min(n, math.floor(targets[source]) - p * sizes[source] - before)) for p in range(MAX_PASSES))
            taken.append((doc_id, n, sizes[source], round(targets[source], 6), got))
            before += n
    return Counter(taken)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_plain_mix(spark, seed):
    found = taken_by_document(mix_sources(odd_table(spark, clashes=True, seed=seed)))
    rows = found.select("doc_id", "size", "source_size", F.round("target", 6), "taken").collect()
    assert Counter(map(tuple, rows)) == plain_mix(odd_rows(seed))


def test_mix_is_in_finish_order_and_within_budget(spark):
    rows = mix_sources(odd_table(spark)).where("words > 0").orderBy("mix_start").collect()
    assert [r["finish"] for r in rows] == sorted(r["finish"] for r in rows)
    at = 0
    for r in rows:
        assert r["mix_start"] == at
        at += r["words"]
    assert at <= sum(size_of(r[1]) for r in odd_rows())
    served = defaultdict(int)
    for r in rows:
        served[r["source"]] += r["words"]
    for r in rows:
        assert abs(served[r["source"]] - r["target"]) < 1


def test_limits_stop_small_sources(spark):
    rows = [(0, "a " * 10, "en", "a", 0), (1, "b " * 300, "en", "b", 0), (2, "c " * 300, "en", "c", 0)]
    found = {r["source"]: r for r in mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found["a"]["target"] == 30
    assert found["b"]["target"] + found["c"]["target"] == 580
    assert found["b"]["target"] == pytest.approx(2 * found["c"]["target"])


def test_reruns_agree_under_any_partitioning(spark):
    docs = odd_table(spark)
    first = taken_by_document(mix_sources(docs)).collect()
    second = taken_by_document(mix_sources(docs.repartition(7, "lang"))).collect()
    assert Counter(map(str, first)) == Counter(map(str, second))


def test_empty_tables_and_tables_without_words(spark):
    assert taken_by_document(mix_sources(empty_table(spark))).collect() == []
    assert mixed_documents(empty_table(spark)).collect() == []
    blank = spark.createDataFrame([(1, "", "en", "a", 0), (2, None, "en", None, 0)], SCHEMA)
    assert {(r["doc_id"], r["target"], r["taken"]) for r in taken_by_document(mix_sources(blank)).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}


def test_mixed_documents_are_whole_but_for_the_last_of_a_source(spark):
    docs = odd_table(spark, clashes=True)
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    texts = {(r[0], r[1]) for r in odd_rows()}
    rows = mixed.collect()
    cut = [r for r in rows if (r["doc_id"], r["text"]) not in texts]
    assert 0 < len(cut) <= len({r[3] for r in odd_rows()})
    taken = taken_by_document(mix_sources(docs)).agg(F.sum("taken")).first()[0]
    assert sum(size_of(r["text"]) for r in rows) == taken


def test_first_words(spark):
    text = spark.createDataFrame([("  a\tb \x0b c d", 3)], "t string, n int")
    assert text.select(first_words(F.col("t"), F.col("n"))).first()[0] == "a b c"


def test_no_window_or_exchange_holds_a_whole_source(spark):
    plan = mix_sources(odd_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_words_of_a_text_are_counted_once(spark, tmp_path):
    odd_table(spark).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")

    def counts(rows):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        return plan.count("regexp_extract_all"), plan.count("FileScan")

    assert counts(mix_sources(docs)) == (0, 0)  # stored before
    assert counts(mixed_documents(docs)) == (1, 1)


def test_null_and_repeated_rows_queue_each_for_themselves(spark):
    rows = [(7, "a b", "en", None, 0)] * 3 + [(None, "a b", "en", None, 0)] * 2 + [(None, None, None, "s", None), (8, " c ", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = taken_by_document(mix_sources(docs)).select("doc_id", "size", "source_size", "taken").collect()
    assert Counter(r[:3] for r in map(tuple, found)) == Counter([(7, 2, 10)] * 3 + [(None, 2, 10)] * 2 + [(None, 0, 1), (8, 1, 1)])
    mixed = mixed_documents(docs)
    taken = Counter((r["doc_id"], r["source"]) for r in mixed.collect())
    assert set(taken) <= {(7, None), (None, None), (8, "s")}
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) == sum(r["taken"] for r in found)
