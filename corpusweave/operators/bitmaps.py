"""Sets of ids as bitmaps: rows ``(bucket, bitmap)``, 32,768 ids to a bitmap of 4,096 bytes.

Any BIGINT may be an id; null is in no set. A set takes four kilobytes for each bucket that has an id, however many
ids those are, so sets join, meet and count by bucket, and membership is a test beside the scan of the
rows that are asked about: they stay where they are, also where they carry wide vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.sequences import zeros_like

BITS = 32768
# Of bitmaps that are broadcast; larger sets meet the rows by a shuffle on the bucket.
MAX_BITMAP_BYTES = 64 << 20


def id_bitmaps(ids: DataFrame, column: str = "id") -> DataFrame:
    """The set of the ids of a column; partial bitmaps are merged before and after one shuffle of buckets."""
    value = F.col(column).cast("long")
    keyed = ids.select(F.bitmap_bucket_number(value).alias("bucket"), F.bitmap_bit_position(value).alias("bit"))
    known = keyed.where(F.col("bit").isNotNull())
    return known.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def either(first: DataFrame, second: DataFrame) -> DataFrame:
    """Ids of one set or the other."""
    return first.unionByName(second).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def both(first: DataFrame, second: DataFrame) -> DataFrame:
    """Ids of both sets; a bucket with none of them is left out."""
    met = first.unionByName(second).groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count("*").alias("sets"))
    return met.where((F.col("sets") == 2) & (F.bitmap_count("bitmap") > 0)).drop("sets")


def id_count(bitmaps: DataFrame) -> DataFrame:
    """One row: ``ids``, the size of the set."""
    return bitmaps.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("ids"))


def has_bit(bitmap: Column, bit: Column) -> Column:
    byte = F.substring(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (bit % 8).cast("int")) == 1


def ids_of(bitmaps: DataFrame) -> DataFrame:
    """The ids of a set, a row each: ``id``."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda bit: has_bit(F.col("bitmap"), bit))
    each = bitmaps.select("bucket", F.explode(bits).alias("bit"))
    positive = (F.col("bucket") - 1) * BITS + F.col("bit") + 1
    return each.select(F.when(F.col("bucket") > 0, positive).otherwise(F.col("bucket") * BITS - F.col("bit")).alias("id"))


def fresh(name: str, rows: DataFrame) -> str:
    """The name, lengthened until the rows have no such column."""
    while name in rows.columns:
        name += "_"
    return name


def with_membership(rows: DataFrame, bitmaps: DataFrame, column: str, name: str = "member") -> DataFrame:
    """Adds whether the column's id is in the set; false for null.

    The number of buckets is counted first: sets up to ``MAX_BITMAP_BYTES`` are broadcast and no row moves, larger
    ones (over 16,384 buckets, 537 million ids if dense) are joined by bucket.
    """
    value = F.col(column).cast("long")
    fits = bitmaps.count() * (BITS // 8) <= MAX_BITMAP_BYTES
    bucket, bitmap = fresh("set_bucket", rows), fresh("set_bitmap", rows)
    keys = bitmaps.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap))
    sets = F.broadcast(keys) if fits else keys.hint("merge")
    found = rows.join(sets, F.bitmap_bucket_number(value) == F.col(bucket), "left")
    member = F.coalesce(has_bit(F.col(bitmap), F.bitmap_bit_position(value)), F.lit(False))
    return found.select(*[c for c in rows.columns if c != name], member.alias(name))


def zero_rows_by_bitmap(matrix: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The matrix ``(vec_id, embedding)`` with the rows of the set's ids set to zero; the matrix does not move."""
    vector = F.col("embedding")
    zeros = zeros_like(vector, matrix.schema["embedding"].dataType.elementType)
    flagged = with_membership(matrix, bitmaps, "vec_id", "in_set")
    return flagged.withColumn("embedding", F.when(F.col("in_set"), zeros).otherwise(vector)).select(*matrix.columns)
