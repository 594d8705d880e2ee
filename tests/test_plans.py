"""The shape of physical plans: what moves, what is read, what stays in one task."""

import re

import pytest
from pyspark.sql import functions as F

from corpusweave import PrepareParams, Specials, prepare_corpus, read_corpus
from corpusweave.operators.encode import encode, texts
from corpusweave.operators.order import natural_order
from corpusweave.operators.splits import assign_splits
from corpusweave.plans.queries import QUERIES


SPECIALS = Specials(pad=0, eos=1, bos=2, unk=3)


@pytest.fixture
def plain_plans(spark):
    """Static plans with no broadcast that Spark would choose for being tiny."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.lit("train").alias("split"))


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame([("the", 4)], "token STRING, id INT")


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_cross_join(spark, sf_dir, name, plain_plans):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def depth(line):
    return len(line) - len(line.lstrip(" :+-*"))


def moves(text, scan_column):
    """Exchanges that Spark needs between the root and a scan of a column.

    The spreading of a table of few row groups is not counted.
    """
    lines = text.splitlines()
    best = 0
    for i, line in enumerate(lines):
        if "FileScan" in line and re.search(rf"[\[,]{scan_column}#", line):
            level, count = depth(line), 0
            for above in reversed(lines[:i]):
                if depth(above) < level:
                    level = depth(above)
                    count += bool(re.search(r"[ +:-]Exchange .*ENSURE_REQUIREMENTS", above))
            best = max(best, count)
    return best


def test_splitting_moves_no_text(spark, corpus, plain_plans):
    assert moves(plan(assign_splits(corpus, PrepareParams(n_val=5, n_test=5))), "text") == 0


def test_a_holdout_from_delivered_splits_reads_texts_once(spark, sf_dir, plain_plans):
    text = plan(QUERIES["split_delivered"](spark, sf_dir))
    assert text.count("FileScan") == 1


def test_encoding_moves_nothing(spark, corpus, vocab, plain_plans):
    text = plan(encode(texts(corpus), vocab, SPECIALS, ["doc_id"]))
    assert "Exchange" not in text and "split" not in re.findall(r"ReadSchema: .*", text)[0]


def test_file_order_blocks_move_ids_once(spark, sf_dir, vocab, plain_plans):
    params = PrepareParams(max_seq_length=64)
    text = plan(prepare_corpus(read_corpus(spark, f"{sf_dir}/documents.parquet"), vocab, SPECIALS, params))
    assert moves(text, "text") == 1


def test_shuffled_blocks_move_ids_twice(spark, corpus, vocab, plain_plans):
    params = PrepareParams(max_seq_length=64, n_val=5)
    text = plan(prepare_corpus(corpus, vocab, SPECIALS, params))
    assert moves(text, "text") == 2
    assert text.count("ArrowEvalPython") == 1


def exchanges(text):
    return len(re.findall(r"[ +:-]Exchange ", text))


def text_scans(text):
    return len(re.findall(r"FileScan parquet \[.*?\btext#", text))


@pytest.mark.parametrize("shuffle", ["sorted", "permuted"])
def test_a_whole_run_has_few_exchanges_and_scans(spark, corpus, vocab, plain_plans, shuffle):
    params = PrepareParams(max_seq_length=64, n_val=5, n_test=5, shuffle=shuffle)
    text = plan(prepare_corpus(corpus, vocab, SPECIALS, params))
    assert exchanges(text) <= 10 and text_scans(text) == 1


def test_file_order_has_fewer(spark, sf_dir, vocab, plain_plans):
    path = f"{sf_dir}/documents.parquet"
    text = plan(prepare_corpus(read_corpus(spark, path), vocab, SPECIALS, PrepareParams(max_seq_length=64)))
    assert exchanges(text) <= 6 and text_scans(text) == 1


def test_a_permuted_holdout_moves_ids_once(spark, sf_dir, vocab, plain_plans):
    params = PrepareParams(max_seq_length=64, n_val=5, n_test=5, shuffle="permuted")
    text = plan(prepare_corpus(read_corpus(spark, f"{sf_dir}/documents.parquet"), vocab, SPECIALS, params))
    assert moves(text, "text") == 1


def test_global_packing_encodes_once(spark, corpus, vocab, plain_plans):
    text = plan(prepare_corpus(corpus, vocab, SPECIALS, PrepareParams(max_seq_length=64, grouping="global")))
    assert text.count("ArrowEvalPython") == 1
    assert moves(text, "text") <= 3


def test_pieces_are_cut_inside_generated_code(spark, corpus, vocab, plain_plans):
    text = plan(prepare_corpus(corpus, vocab, SPECIALS, PrepareParams(max_seq_length=64)))
    assert re.search(r"\*\(\d+\) Generate explode\(sequence", text)


def test_losses_join_on_the_step(spark, sf_dir, plain_plans):
    text = plan(QUERIES["token_loss"](spark, sf_dir))
    assert re.search(r"SortMergeJoin \[seq_id#\d+L, pos#\d+L\]", text)
    # Targets come from a window over labels alone.
    assert not re.search(r"Window .*logits", text)


def test_no_window_without_partition_reads_documents(spark, corpus, vocab, plain_plans):
    text = plan(prepare_corpus(corpus, vocab, SPECIALS, PrepareParams(max_seq_length=64, n_val=5)))
    assert "SinglePartition" not in text


def test_projection_reads_its_columns_only(spark, sf_dir, plain_plans):
    text = plan(natural_order(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "order_key"))
    assert "ReadSchema: struct<doc_id:bigint>" in text


WIDE = ["prepare_corpus", "pack_sharded", "pack_global", "collate_left_pad", "prepare_collated", "prepare_global"]
WIDE += ["encode_corpus_join", "decode_join", "row_positions_any_id", "token_loss", "matrix_zero_rows"]


@pytest.mark.parametrize("name", WIDE)
def test_no_ids_texts_or_logits_are_broadcast(spark, sf_dir, name):
    """The plan that really ran, with adaptive execution and broadcasts as a session has them."""
    rows = QUERIES[name](spark, sf_dir)
    rows._jdf.queryExecution().executedPlan().executeCollect()
    final = rows._jdf.queryExecution().executedPlan()
    wide = re.compile(r"array<|(?<!\w)(text|input_ids|logits|embedding|pieces?|placed)#")
    seen = 0
    for line in final.toString().partition("Initial Plan")[0].splitlines():
        if "BroadcastExchange" in line:
            seen += 1
    for exchange in broadcast_outputs(final):
        assert not wide.search(exchange), exchange
    assert seen == len(broadcast_outputs(final))


def broadcast_outputs(node):
    """Output columns of every broadcast in a plan."""
    found = []
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return broadcast_outputs(node.executedPlan())
    if "QueryStage" in name:
        return broadcast_outputs(node.plan())
    if name == "BroadcastExchange":
        output = node.output()
        found.append(" ".join(f"{output.apply(i).name()}#:{output.apply(i).dataType().simpleString()}" for i in range(output.size())))
    children = node.children()
    for i in range(children.size()):
        found += broadcast_outputs(children.apply(i))
    return found
