"""Holdout splits and row limits by rank cut-offs in the seeded order.

A split is a range of the order, so each row finds its split by comparing its own
key with at most three cut-off keys: texts are neither sorted nor shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.words import required
from corpusweave.operators.order import comes_before, cutoffs, natural_order, seeded_order
from corpusweave.params import PrepareParams

TRAIN, VALIDATION, TEST = "train", "validation", "test"

# Rows of the train split, and the order key and id at each rank that cuts it.
Cuts = tuple[int, dict[int, tuple[int, int]]]


def assign_splits(corpus: DataFrame, params: PrepareParams, cuts: Cuts | None = None) -> DataFrame:
    """Hold out, then limit; adds ``order_key`` and ``order_bucket``.

    Without a holdout the corpus keeps its own order. With one, ``train`` takes the
    seeded order: its last ``n_val`` rows are the validation split, the ``n_test``
    rows before them the test split, and an older split of such a name is replaced.
    Splits of other names stay. Any ``pos`` and ``split_rows`` of the input go, as
    they no longer hold. ``cuts`` may give the ``holdout_cuts`` of the same documents.
    """
    rows = corpus.drop("pos", "split_rows").withColumn("split", required(F.col("split"), "split"))
    held = holdout(rows, params.n_val or 0, params.n_test or 0, params.seed, params.n_train or 0, cuts)
    if held is not None:
        return held
    return limit_splits(natural_order(rows), params.n_train, params.n_val, params.n_test)


def holdout_cuts(rows: DataFrame, n_val: int, n_test: int, seed: int, n_train: int = 0) -> Cuts:
    """The cut-offs of a holdout, found in one search; reads ``doc_id`` and ``split``."""
    keys = seeded_order(rows.where(F.col("split") == TRAIN).select("doc_id"), seed)
    ranks = {-n for n in (n_val, n_val + n_test) if n} | ({n_train} if n_train else set())
    return cutoffs(keys, sorted(ranks))


def holdout(
    rows: DataFrame, n_val: int, n_test: int, seed: int, n_train: int = 0, cuts: Cuts | None = None
) -> DataFrame | None:
    """Rows with their splits after a holdout, or None where nothing is held out.

    ``n_train`` keeps the first rows of what stays in the train split. All cut-offs come from one search:
    the splits held out have exactly the length asked for and need no limit.
    """
    if n_val + n_test == 0:
        return None
    is_train = F.col("split") == TRAIN
    size, cuts = holdout_cuts(rows, n_val, n_test, seed, n_train) if cuts is None else cuts
    if size == 0:
        return None
    if size <= n_val + n_test:
        raise ValueError(f"holding out {n_val} + {n_test} of {size} rows leaves no train split")
    part = F.lit(VALIDATION if n_val else TEST)
    if n_val and n_test:
        part = F.when(comes_before(cuts[-n_val]), TEST).otherwise(part)
    part = F.when(comes_before(cuts[-(n_val + n_test)]), TRAIN).otherwise(part)
    replaced = [name for name, n in ((VALIDATION, n_val), (TEST, n_test)) if n]
    kept = seeded_order(rows.where(~F.col("split").isin(replaced)), seed, where=is_train)
    parted = kept.withColumn("split", F.when(is_train, part).otherwise(F.col("split")))
    if 0 < n_train < size - n_val - n_test:
        return parted.where((F.col("split") != TRAIN) | comes_before(cuts[n_train]))
    return parted


def limit_splits(
    rows: DataFrame, n_train: int | None, n_val: int | None = None, n_test: int | None = None
) -> DataFrame:
    """Keep the first rows of each named split; nothing happens without ``n_train``."""
    if not n_train or n_train < 0:
        return rows
    keep = F.lit(True)
    for name, limit in ((TRAIN, n_train), (VALIDATION, n_val), (TEST, n_test)):
        if limit:
            keys = rows.where(F.col("split") == name).select("doc_id", "order_key", "order_bucket")
            for cut in cutoffs(keys, [limit])[1].values():
                keep = keep & ((F.col("split") != name) | comes_before(cut))
    return rows.where(keep)


def limit_positions(
    rows: DataFrame, n_train: int | None, n_val: int | None = None, n_test: int | None = None
) -> DataFrame:
    """The same for rows whose ``pos`` and ``split_rows`` are known: one filter."""
    if not n_train or n_train < 0:
        return rows
    limit = F.lit(None).cast("long")
    for name, n in ((TRAIN, n_train), (VALIDATION, n_val), (TEST, n_test)):
        if n:
            limit = F.when(F.col("split") == name, n).otherwise(limit)
    kept = rows.where(F.coalesce(F.col("pos") < limit, F.lit(True)))
    return kept.withColumn("split_rows", F.least("split_rows", limit))


def split_sizes(full: DataFrame, kept: DataFrame, params: PrepareParams) -> DataFrame:
    """Rows per split before and after limiting; ``short`` marks a limit not reached."""
    limits = {TRAIN: params.n_train, VALIDATION: params.n_val, TEST: params.n_test}
    asked = F.lit(0)
    for name, limit in limits.items():
        asked = F.when(F.col("split") == name, limit or 0).otherwise(asked)
    rows_full = full.groupBy("split").agg(F.count("*").alias("rows_before"))
    rows_kept = kept.groupBy("split").agg(F.count("*").alias("rows_after"))
    return rows_full.join(rows_kept, "split", "left").select(
        "split",
        "rows_before",
        F.coalesce("rows_after", F.lit(0).cast("long")).alias("rows_after"),
        (F.col("rows_before") < asked).alias("short"),
    )
