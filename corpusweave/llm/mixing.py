"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in seeded random order, passed through up to
``MAX_PASSES`` times. A pass of a document starts at the virtual time (words of the queue before it) /
(target of the source) and finishes a document's words later, so each source is served in
proportion to its target. The mix is all passes in the order of their finish time, cut off at
the total budget. As the targets add up to the budget, that is at virtual time 1: passes that finish
by then are taken whole, and of the pass that a source then has in service the words served so far.

Targets: sources in code point order, null last, weigh ``WEIGHTS`` in turn and share all words by
weight; a source's target stops at ``MAX_PASSES`` times its size, the excess being reshared among the
others by weight until none is above.

Plan: the words are counted beside the scan, once where rows are narrow and stored, and once more for the sizes of runs where they keep
wide columns, which are never stored. Sources' sizes are sums over their runs. A queue is cut into
``RUNS`` runs by the leading bits of its random order, so that a source which holds a third of all rows
is spread over as many tasks; positions are counted inside a run and lifted by a running total over
the runs. The global order is cut in the same way, by finish time. Each total is a window over at most
``RUNS`` rows per source, and one over the sources, never over documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusweave.llm.common import WORD, checkpointed, text_or_empty

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
RUN_BITS = 10
RUNS = 1 << RUN_BITS
SEED = 42


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MAX_PASSES) -> DataFrame:
    """``source``, ``source_size``, ``weight`` and ``target`` of each source of ``(source, source_size)``.

    Filling up by weight stops a source at its limit; those that stop are the first ones in the
    order of limit / weight, so one pass over that order finds the level at which the rest ends.
    Sources of no words have the target 0, and with no words at all every target is 0.
    """
    by_name = W.partitionBy().orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    place = (F.row_number().over(by_name) - 1) % len(weights)
    named = sizes.select("source", "source_size", F.get(cycle, place).cast("double").alias("weight"))
    limited = named.withColumn("limit", F.col("source_size") * F.lit(passes)).withColumn(
        "stops_at", F.col("limit") / F.col("weight")
    )
    order = W.partitionBy().orderBy("stops_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    onward = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    levels = limited.withColumn("level", left / F.sum("weight").over(onward))
    goes_on = F.when(F.col("stops_at") > F.col("level"), F.struct(F.row_number().over(order).alias("nth"), "level"))
    first = levels.withColumn("goes_on", goes_on).withColumn("first", F.min("goes_on").over(everything))
    last = first.withColumn("last_level", F.col("first.level"))
    target = F.least(F.col("limit").cast("double"), F.col("weight") * F.col("last_level"))
    return last.select(
        "source", "source_size", "weight", F.coalesce(target, F.col("limit").cast("double")).alias("target")
    )


def queued_runs(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Documents of ``source`` and ``size`` with ``queue_key``, their place in the random order, and ``run``, its leading bits."""
    own_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    named = F.concat_ws(":", F.lit(seed), own_id, F.col("size").cast("string"))
    key = F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long")  # 60 bits
    key = F.coalesce(key, F.lit(0))  # never null, which spares Spark a null filter that counts the words again
    return docs.withColumn("queue_key", key).withColumn("run", F.shiftright("queue_key", 60 - RUN_BITS).cast("int"))


def run_sizes(keyed: DataFrame) -> DataFrame:
    """``rows`` and ``words`` of each run of each source: at most ``RUNS`` rows a source."""
    return keyed.groupBy("source", "run").agg(F.count("*").alias("rows"), F.sum("size").alias("words"))


def queue(keyed: DataFrame, runs: DataFrame, targets: DataFrame) -> DataFrame:
    """Documents with ``place`` (their row in their source's queue) and ``start`` (words before them).

    Needs ``source``, ``size``, ``queue_key`` and ``run`` besides ``doc_id``, and the ``run_sizes`` of all documents. The order is a hash of
    seed, id and size, then these themselves, so rows that tie are alike in all that counts.
    """
    earlier = W.partitionBy("source").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    nothing = F.lit(0)
    lifted = runs.select(
        F.col("source").alias("run_source"),
        F.col("run").alias("run_number"),
        F.coalesce(F.sum("rows").over(earlier), nothing).alias("run_place"),
        F.coalesce(F.sum("words").over(earlier), nothing).alias("run_start"),
    )
    of_source = targets.withColumnRenamed("source", "target_source")
    starts = lifted.join(of_source, F.col("run_source").eqNullSafe(F.col("target_source"))).drop("target_source")
    inside = W.partitionBy("source", "run").orderBy("queue_key", "doc_id", "size")
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    counted = keyed.withColumn("run_row", F.row_number().over(inside) - 1).withColumn(
        "run_words", F.coalesce(F.sum("size").over(before), nothing)
    )
    same_run = F.col("source").eqNullSafe(F.col("run_source")) & (F.col("run") == F.col("run_number"))
    place = (F.col("run_place") + F.col("run_row")).alias("place")
    start = (F.col("run_start") + F.col("run_words")).alias("start")
    columns = [c for c in keyed.columns if c not in ("queue_key", "run")]
    return counted.join(starts, same_run).select(*columns, "source_size", "target", place, start)


def mix_sources(
    docs: DataFrame,
    keep: tuple[str, ...] = (),
    weights: tuple[int, ...] = WEIGHTS,
    passes: int = MAX_PASSES,
    seed: int = SEED,
) -> DataFrame:
    """The mix: one row per pass of a document, with the words it takes and its place in the mix.

    Reads ``doc_id``, ``source`` and ``text`` and the columns in ``keep``. Gives, besides these,
    ``size``, ``source_size``, ``target``, ``place``, ``pass`` (from 0), ``finish`` (virtual time),
    ``words`` (taken in this pass: all, or the first ones of a text in service at the end) and
    ``mix_start`` (words of the mix before it). Pass 0 of every document is there, with ``words`` 0
    where the mix does not reach it; later passes only if they take words.

    A null text counts as empty and takes nothing; a null source is a source; repeated rows
    queue each for themselves; a table without words gives rows that take nothing.
    """
    return in_mix_order(served_passes(docs, keep, weights, passes, seed)).drop("start", "pass_start")


def served_passes(
    docs: DataFrame,
    keep: tuple[str, ...] = (),
    weights: tuple[int, ...] = WEIGHTS,
    passes: int = MAX_PASSES,
    seed: int = SEED,
) -> DataFrame:
    """The passes of the mix without their place in it."""
    others = [c for c in keep if c not in ("doc_id", "source")]
    size = word_count(text_or_empty()).alias("size")
    keyed = queued_runs(docs.select("doc_id", "source", *others, size), seed)
    if not others:  # narrow rows, which later uses read instead of the texts
        keyed = checkpointed(keyed)
    runs = checkpointed(run_sizes(keyed))
    sizes = runs.groupBy("source").agg(F.sum("words").alias("source_size"))
    queued = queue(keyed, runs, source_targets(sizes, weights, passes))
    served_words = F.floor("target")
    turns = F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass")
    copies = queued.select("*", turns).withColumn("pass_start", F.col("pass") * F.col("source_size") + F.col("start"))
    words = F.greatest(F.lit(0), F.least("size", served_words - F.col("pass_start"))).cast("long")
    finish = F.when(F.col("target") > 0, (F.col("pass_start") + F.col("size")) / F.col("target")).otherwise(F.lit(1.0))
    return copies.withColumn("words", words).where("pass = 0 or words > 0").withColumn("finish", finish)


def in_mix_order(passes: DataFrame) -> DataFrame:
    """Adds ``mix_start``, the words before each pass when all are in order of finish time.

    Finish times of what is served are spread evenly over 0 to 1, give or take one pass per source,
    so slices of equal time hold like many words.
    """
    slice_ = F.least(F.floor(F.col("finish") * RUNS), F.lit(2 * RUNS)).cast("int")
    # What ends long after the budget takes nothing and needs no place: dealt by its key instead.
    spread = F.when(F.col("words") > 0, slice_).otherwise(2 * RUNS + F.pmod(F.xxhash64("doc_id", "place"), F.lit(RUNS)))
    dealt = passes.withColumn("slice", spread.cast("int"))
    totals = dealt.groupBy("slice").agg(F.sum("words").alias("slice_words"))
    earlier = W.partitionBy().orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("slice_words").over(earlier), F.lit(0))
    starts = totals.select(F.col("slice").alias("slice_number"), before.alias("slice_start"))
    inside = W.partitionBy("slice").orderBy("finish", F.col("source").asc_nulls_last(), "pass", "place")
    within = F.coalesce(F.sum("words").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("within", within).join(starts, F.col("slice") == F.col("slice_number"))
    kept = [c for c in passes.columns]
    return placed.select(*kept, (F.col("slice_start") + F.col("within")).alias("mix_start"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word; needs a text of at least that many words."""
    pieces = F.split(F.regexp_replace(text, "^[\\x20\\x09-\\x0D]+", ""), "[\\x20\\x09-\\x0D]+")
    return F.array_join(F.slice(pieces, 1, n.cast("int")), " ")


def mixed_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The mix as documents: the rows of the input, once per pass that takes words.

    A pass that the budget cuts off has the first words of its text, joined by blanks; ``n_chars``, if
    there, is counted anew. Rows of a DataFrame have no order, so their places in the mix are not worked out.
    """
    mix = served_passes(docs.withColumn("mixed_row", F.struct(*docs.columns)), keep=("mixed_row",))
    cut = F.col("words") < F.col("size")
    own = F.col(f"mixed_row.{text}")
    rows = mix.where("words > 0").select(
        "mixed_row", F.when(cut, first_words(own, F.col("words"))).otherwise(own).alias("mixed_text")
    )
    columns = {c: F.col(f"mixed_row.{c}") for c in docs.columns} | {text: F.col("mixed_text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("mixed_text").cast("long")
    return rows.select(*[value.alias(name) for name, value in columns.items()])


def taken_by_document(mix: DataFrame) -> DataFrame:
    """One row per row of the input: its ``doc_id``, sizes, target and all words the mix takes of it."""
    return mix.groupBy("source", "place").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("size").alias("size"),
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
        F.sum("words").alias("taken"),
    )
