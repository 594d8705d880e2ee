"""Row order as data: order keys, positions, running totals, rank cut-offs.

A DataFrame has no order, so corpus order is a pair ``(order_key, doc_id)`` that is
a pure function of the row. ``order_bucket`` cuts that order into contiguous runs of
bounded size: positions are counted inside a run, and running totals over the run
sizes lift them to the whole table. Run sizes are counted and stored once. No window ever holds more than one run or
2^20 totals, whatever the ids, and no result depends on how rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusweave.functions.words import required
from corpusweave.session import settled

# A natural-order run covers 2^10 ids, hence never holds more rows than that.
NATURAL_RUN_BITS = 10
# Run totals add up in steps of 2^20 runs, so no window holds more rows than that.
LEVEL_BITS = 20
# Shuffle keys are 60 random bits; their top 20 make 2^20 runs of like size.
SHUFFLE_KEY_BITS = 60
SHUFFLE_RUN_BITS = 40


def shuffle_key(doc_id: Column, seed: int) -> Column:
    """Seeded random order key: the first 60 bits of ``md5('<seed>:<doc_id>')``."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), required(doc_id, "id").cast("string")))
    number = F.conv(F.substring(digest, 1, SHUFFLE_KEY_BITS // 4), 16, 10).cast("long")
    return F.coalesce(number, F.lit(0))  # never null, which spares Spark a null filter


def natural_key(doc_id: Column) -> Column:
    """The id itself, any BIGINT."""
    return required(doc_id.cast("long"), "id")


def natural_order(rows: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Corpus order: ascending ids."""
    return rows.withColumn("order_key", natural_key(F.col(id_column))).withColumn(
        "order_bucket", F.shiftright("order_key", NATURAL_RUN_BITS)
    )


def seeded_order(rows: DataFrame, seed: int, where: Column | None = None, id_column: str = "doc_id") -> DataFrame:
    """Seeded shuffle: the same seed gives the same permutation of the same ids.

    Rows outside ``where`` keep their natural order.
    """
    key, bits = shuffle_key(F.col(id_column), seed), F.lit(SHUFFLE_RUN_BITS)
    if where is not None:
        key = F.when(where, key).otherwise(natural_key(F.col(id_column)))
        bits = F.when(where, SHUFFLE_RUN_BITS).otherwise(NATURAL_RUN_BITS)
    return rows.withColumn("order_key", key).withColumn(
        "order_bucket", F.call_function("shiftright", F.col("order_key"), bits)
    )


def running_totals(totals: DataFrame, keys: list[str], bucket: str, values: list[str]) -> DataFrame:
    """Add ``before_<value>``, the sum over all earlier buckets of the same keys, and ``all_<value>``.

    Takes one row per bucket, and stores them once. Where a key has more than 2^20 of them, they are summed upward into
    stored ranges of 2^20 buckets, those again, until one window holds what is left; the sums then go down the
    same tables. No level reads the source of the totals again.
    """
    # Under new names of the same spelling, as rows that meet them may share the old ones.
    own = totals.select(*[F.col(c).alias(c) for c in (*keys, bucket, *values)])
    return _swept(settled(own), keys, bucket, values)


def _swept(stored: DataFrame, keys: list[str], bucket: str, values: list[str]) -> DataFrame:
    most = stored.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0

    def earlier(value: str, within: list[str]) -> Column:
        return F.sum(value).over(W.partitionBy(*within).orderBy(bucket)) - F.col(value)

    if most <= 1 << LEVEL_BITS:
        before = [earlier(v, keys).alias(f"before_{v}") for v in values]
        whole = [F.sum(v).over(W.partitionBy(*keys)).alias(f"all_{v}") for v in values]
        return stored.select(*keys, bucket, *values, *before, *whole)
    above = f"{bucket}_above"
    ranged = stored.withColumn(above, F.shiftright(bucket, LEVEL_BITS))
    summed = settled(ranged.groupBy(*keys, above).agg(*[F.sum(v).alias(v) for v in values]))
    higher = _swept(summed, keys, above, values).select(
        *keys, above, *[F.col(f"before_{v}").alias(f"higher_{v}") for v in values], *[f"all_{v}" for v in values]
    )
    before = [(F.col(f"higher_{v}") + earlier(v, [*keys, above])).alias(f"before_{v}") for v in values]
    return ranged.join(higher, [*keys, above]).select(*keys, bucket, *values, *before, *[f"all_{v}" for v in values])


def run_starts(rows: DataFrame, split: str = "split", weight: str | None = None) -> DataFrame:
    """Per run of each split, the rows and weights of all earlier runs and of the split.

    The totals are counted once and stored, so that several uses share them.
    """
    sums = [F.count("*").alias("run_rows")] + ([F.sum(weight).alias("run_weight")] if weight else [])
    totals = rows.withColumn(split, required(F.col(split), split)).groupBy(split, "order_bucket").agg(*sums)
    return running_totals(totals, [split], "order_bucket", ["run_rows", "run_weight"] if weight else ["run_rows"])


def positions(
    rows: DataFrame,
    split: str = "split",
    id_column: str = "doc_id",
    weight: str | None = None,
    starts: DataFrame | None = None,
) -> DataFrame:
    """Add ``pos`` (0, 1, … in each split) and ``split_rows``.

    With ``weight`` also ``start``, the sum of the weights of all earlier rows of the
    split, and ``split_weight``. Rows move once, by run; the run totals come to them, as a merge
    of sorted runs, so that rows with their ids are never the side that is broadcast.
    ``starts`` may give the ``run_starts`` of the same rows, from a cheaper plan or shared with other uses.
    """
    rows = rows.withColumn(split, required(F.col(split), split))
    run = [split, "order_bucket"]
    starts = run_starts(rows, split, weight) if starts is None else starts
    starts = starts.withColumnRenamed("all_run_rows", "split_rows")
    inside = W.partitionBy(*run).orderBy("order_key", id_column)
    numbered = rows.withColumn("run_row", F.row_number().over(inside) - 1)
    added = [(F.col("before_run_rows") + F.col("run_row")).alias("pos"), F.col("split_rows")]
    if weight:
        starts = starts.withColumnRenamed("all_run_weight", "split_weight")
        upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
        numbered = numbered.withColumn("run_offset", F.sum(weight).over(upto) - F.col(weight))
        added += [(F.col("before_run_weight") + F.col("run_offset")).alias("start"), F.col("split_weight")]
    # Every run is there; an inner join would have Spark test the run's expression for null at the scan.
    return numbered.join(starts.hint("merge"), run, "left").select(*rows.columns, *added)


def cutoffs(rows: DataFrame, ranks: list[int], id_column: str = "doc_id") -> tuple[int, dict[int, tuple[int, int]]]:
    """Row count, and the ``(order_key, id)`` of the rows at the given ranks.

    Negative ranks count from the end; ranks beyond the table are left out. Run sizes tell
    which runs hold the ranks, and only those runs are then numbered: any rank costs two
    narrow passes, and at most one row per rank reaches the driver.
    """
    sizes = rows.groupBy(F.lit(0).alias("whole"), "order_bucket").agg(F.count("*").alias("n"))
    spans = running_totals(sizes, ["whole"], "order_bucket", ["n"]).select(
        "order_bucket",
        F.col("before_n").alias("first"),
        (F.col("before_n") + F.col("n")).alias("next"),
        F.col("all_n").alias("size"),
    )
    wanted = F.col("next") == F.col("size")  # the last run, for the size alone
    for rank in ranks:
        row = F.lit(rank) if rank >= 0 else F.col("size") + rank
        wanted = wanted | ((row >= F.col("first")) & (row < F.col("next")))
    runs = spans.where(wanted).collect()
    size = runs[0].size if runs else 0
    hits = {}
    for rank in ranks:
        row = rank if rank >= 0 else size + rank
        hits.update({rank: (run.order_bucket, row - run.first) for run in runs if run.first <= row < run.next})
    if not hits:
        return size, {}
    is_cut = F.lit(False)
    for bucket, row in hits.values():
        is_cut = is_cut | ((F.col("order_bucket") == bucket) & (F.col("run_row") == row))
    inside = W.partitionBy("order_bucket").orderBy("order_key", id_column)
    in_hit_run = rows.where(F.col("order_bucket").isin([bucket for bucket, _ in hits.values()]))
    found = in_hit_run.withColumn("run_row", F.row_number().over(inside) - 1).where(is_cut).collect()
    by_place = {(f.order_bucket, f.run_row): (f.order_key, f[id_column]) for f in found}
    return size, {rank: by_place[place] for rank, place in hits.items()}


def comes_before(cut: tuple[int, int], id_column: str = "doc_id") -> Column:
    """Rows that come before a cut-off row in the order."""
    key, row_id = cut
    return (F.col("order_key") < key) | ((F.col("order_key") == key) & (F.col(id_column) < row_id))


def head_tail(rows: DataFrame, order_by: str, head: int, tail: int) -> DataFrame:
    """First and last rows in an order, marked by ``part``; short tables repeat rows."""
    first = rows.orderBy(F.asc(order_by)).limit(head).withColumn("part", F.lit("head"))
    last = rows.orderBy(F.desc(order_by)).limit(tail).withColumn("part", F.lit("tail"))
    return first.unionByName(last)


def unique_sorted(ids: DataFrame, column: str = "id") -> DataFrame:
    return ids.select(column).distinct().orderBy(column)
