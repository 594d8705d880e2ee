"""Document fingerprints by Order MinHash, in functions of Spark only.

A text's k-mers are its runs of ``KMER_WORDS`` words (a shorter text is one), each numbered by its
occurrence, so that the n-th of equal k-mers is an element of its own. A hash deals the elements
to ``SLOTS`` slots; of each slot the ``CHOSEN`` least elements are kept in the order of the text and the
tuple is hashed. Two texts agree in a slot if they hold the same least elements in the same
order, so their likeness falls with moved words as well as with changed ones.

Plan: all of it is row-wise on arrays, without a shuffle. Least elements are looked for among those below
a bound first, which leaves some ``SLOTS * EXPECTED`` to sort; a text for which that does not fill all
slots is sorted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusweave.llm.arrays import let
from corpusweave.llm.common import digest, text_or_empty

KMER_WORDS = 3
SLOT_BITS = 5
SLOTS = 1 << SLOT_BITS
CHOSEN = 2
EXPECTED = 24
HASH_BITS = 64 - SLOT_BITS
LOW = (1 << HASH_BITS) - 1
BLANKS = "[\\x20\\x09-\\x0D]+"

ROWS_PER_RANGE = 1024
MAX_RANGES = 8192


def slot(g: Column) -> Column:
    return F.shiftright(g, HASH_BITS)


def kmer_hashes(text: Column, size: int = KMER_WORDS) -> Column:
    """Hash of each k-mer in text order; none for a text without words."""

    def of_words(w: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)])
        )
        none = F.array().cast("array<bigint>")
        return F.when(F.size(w) > size, runs).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(none)

    return let(F.array_remove(F.split(text, BLANKS), ""), of_words)


def numbered(hashes: Column) -> Column:
    """``(g, pos)`` of each k-mer: its hash, mixed with its number where equal ones came before."""

    def with_equals(s: Column) -> Column:
        def again(x: Column, i: Column) -> Column:
            return F.get(s, i - 1)["h"] == x["h"]

        first = F.filter(s, lambda x, i: (i == 0) | ~again(x, i))
        later = F.filter(s, lambda x, i: (i > 0) & again(x, i))
        firsts = F.transform(first, lambda x: F.struct(x["h"].alias("g"), x["pos"].alias("pos")))
        return F.concat(firsts, later_numbers(later))

    def later_numbers(later: Column) -> Column:
        def by_group(d: Column) -> Column:
            places = F.sequence(F.lit(0), F.size(d) - 1)
            starts = F.filter(places, lambda j: (j == 0) | (F.get(d, j - 1)["h"] != F.get(d, j)["h"]))

            def groups(b: Column) -> Column:
                def group(start: Column, t: Column) -> Column:
                    end = F.coalesce(F.get(b, t + 1), F.size(d))
                    return F.transform(
                        F.slice(d, start + 1, end - start),
                        lambda x, i: F.struct(F.xxhash64(x["h"], i + 1).alias("g"), x["pos"].alias("pos")),
                    )

                return F.flatten(F.transform(b, group))

            return let(starts, groups)

        none = F.array().cast("array<struct<g:bigint,pos:int>>")
        return let(later, lambda d: F.when(F.size(d) > 0, by_group(d)).otherwise(none))

    def of_hashes(h: Column) -> Column:
        plain = F.transform(h, lambda x, i: F.struct(x.alias("g"), i.alias("pos")))
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("pos"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), plain).otherwise(let(pairs, with_equals))

    return let(hashes, of_hashes)


def least_of_slots(elements: Column) -> Column:
    """The ``CHOSEN`` least elements of each slot, sorted, so that a slot's elements are neighbours."""

    def least(e: Column) -> Column:
        return F.filter(e, lambda x, i: (i < CHOSEN) | (slot(F.get(e, i - CHOSEN)["g"]) != slot(x["g"])))

    def of_all(a: Column) -> Column:
        bound = F.lit(float(1 << HASH_BITS)) * (SLOTS * EXPECTED) / F.size(a)
        low = F.filter(a, lambda x: x["g"].bitwiseAND(F.lit(LOW)) < bound.cast("long"))
        whole = let(F.array_sort(a), least)
        sifted = let(let(F.array_sort(low), least), lambda s: F.when(F.size(s) == SLOTS * CHOSEN, s).otherwise(whole))
        return F.when(F.size(a) > 2 * SLOTS * EXPECTED, sifted).otherwise(whole)

    return let(elements, of_all)


def signature(text: Column) -> Column:
    """One long per slot in use, the slot in its leading bits and a hash of the slot's tuple below.

    A text without words has none; texts of few words use few slots.
    """

    def tuples(s: Column) -> Column:
        def own(x: Column, i: Column) -> Column:
            near = F.slice(s, F.greatest(i - CHOSEN + 2, F.lit(1)), F.least(i + 1, F.lit(CHOSEN)))
            same = F.filter(near, lambda y: slot(y["g"]) == slot(x["g"]))
            ordered = F.array_sort(F.transform(same, lambda y: F.struct(y["pos"].alias("pos"), y["g"].alias("g"))))
            mixed = F.xxhash64(F.transform(ordered, lambda y: y["g"])).bitwiseAND(F.lit(LOW))
            ends = F.coalesce(slot(F.get(s, i + 1)["g"]) != slot(x["g"]), F.lit(True))
            return F.when(ends, F.shiftleft(slot(x["g"]), HASH_BITS).bitwiseOR(mixed))

        return F.array_compact(F.transform(s, own))

    return let(least_of_slots(numbered(kmer_hashes(text))), tuples)


def likeness(a: Column, b: Column) -> Column:
    """Share of slots with the same tuple, of those that either text uses; 1 for two without words."""
    used = F.size(F.array_union(F.transform(a, slot), F.transform(b, slot)))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / used)


def written(entries: Column) -> Column:
    """A signature as text: 16 hex digits per slot in use."""
    return F.array_join(F.transform(entries, lambda e: F.lower(F.lpad(F.hex(e), 16, "0"))), "")


def fingerprint(docs: DataFrame, text: str = "text", name: str = "signature") -> DataFrame:
    """``docs`` with the signature of each whole text; null counts as empty, a column ``name`` is replaced."""
    return docs.withColumn(name, signature(text_or_empty(text)))


def id_bounds(docs: DataFrame, key: str = "doc_id") -> list[int]:
    """Ids that cut the table into ranges of like size, the greatest one last; at most ``MAX_RANGES``."""
    ids = docs.select(F.col(key).cast("long").alias("id")).where("id is not null")
    n = ids.count()
    if not n:
        return []
    ranges = min(MAX_RANGES, -(-n // ROWS_PER_RANGE))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = F.percentile_approx("id", shares).alias("cuts") if shares else F.array().cast("array<bigint>").alias("cuts")
    found = ids.agg(cuts, F.max("id").alias("last")).first()
    return sorted({*found["cuts"], found["last"]})


def range_number(key: Column, bounds: list[int]) -> Column:
    """How many of the bounds lie below the id, by halving steps; -1 for a null id."""
    cuts = F.lit(bounds).cast("array<bigint>")
    steps = F.lit([1 << i for i in reversed(range(max(1, len(bounds).bit_length())))])

    def halve(below: Column, step: Column) -> Column:
        return F.when(F.get(cuts, below + step - 1) < key, below + step).otherwise(below)

    return F.when(key.isNull(), F.lit(-1)).otherwise(F.aggregate(steps, F.lit(0), halve))


def with_next(rows: DataFrame, carried: list[str], key: str = "doc_id") -> DataFrame:
    """Adds ``next_<name>`` of the row that follows in descending ``key``; after the last comes the first.

    Null keys come last; rows of one key follow each other in the order of the digest of their text. Rows
    move once, by range of ids. The bounds of the ranges are ids of the table, so the row that a
    range's last one needs is a row with a known id: those few rows are fetched apart.
    """
    bounds = id_bounds(rows, key)
    number = range_number(F.col(key).cast("long"), bounds)
    ties = [F.col(key).desc_nulls_last(), digest(text_or_empty()), F.xxhash64(*carried)]
    nexts = [f"next_{c}" for c in carried]
    own = F.struct(*[F.col(c).alias(n) for c, n in zip(carried, nexts, strict=True)])
    # The first row of each range, at the service of the range above it; the very first of the lowest.
    is_first = F.col(key).cast("long").isin(bounds) | F.col(key).isNull() if len(bounds) else F.col(key).isNull()
    heads = rows.where(is_first).withColumn("of_range", number)
    firsts = heads.groupBy("of_range").agg(F.min_by(own, F.struct(*ties[1:])).alias("first"))
    lowest = F.min("of_range").over(W.partitionBy())  # over one row per range
    serves = F.when(F.col("of_range") == len(bounds) - 1, lowest).otherwise(F.col("of_range") + 1)
    served = firsts.select(serves.alias("served_range"), "first")
    order = W.partitionBy("of_range").orderBy(*ties)
    # Plain columns, one by one: a struct of them would move beside them.
    leads = [F.lead(c).over(order).alias(n) for c, n in zip(carried, nexts, strict=True)]
    is_inside = F.lead(F.lit(True)).over(order).alias("is_inside")
    followed = rows.withColumn("of_range", number).select("*", *leads, is_inside)
    joined = followed.join(served, F.col("of_range") == F.col("served_range"), "left")
    found = [F.when(F.col("is_inside"), F.col(n)).otherwise(F.col("first")[n]).alias(n) for n in nexts]
    return joined.select(*rows.columns, *found)


def edited_text(text: Column, after: Column) -> Column:
    """The text with the last third of its code points replaced by the first ones of the next text."""
    n = F.length(text)
    cut = F.floor(n / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - cut), F.substr(after, F.lit(1), cut))
