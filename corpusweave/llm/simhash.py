"""Near-duplicates by SimHash fingerprints, found by anchor-point covering.

A fingerprint has 64 bits. Two of them that differ in at most ``t`` bits differ in at most ``t // 2`` of the
31 bits of the left part or in at most ``t - t // 2 - 1`` of the 31 bits of the right part; the last two
bits are left to the comparison. The anchors of a part are the 2^26 words of the Hamming code of length
31, which is perfect with covering radius 1: every value has exactly one anchor within 1, its home. A
value within the threshold of another lies within radius plus threshold of that one's home, so each
fingerprint is replicated to every anchor within that reach (156 on the left and 16 on the right for 4
bits) and compared with those at home there, on all 64 bits.

An anchor where nobody is at home makes no pair, so replicas go to occupied anchors only. Which
are occupied is a bitmap of 2^26 bits per part: 16 MB in all, whatever the number of documents.

Equal fingerprints are one before anything is replicated, so copies cost nothing. Inside an anchor
only links that join two groups are given out, at most one fewer than there are members. An anchor of more
than ``BLOCK`` members is cut into blocks, every pair of which is compared in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial, reduce
from itertools import combinations
from operator import xor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.common import checkpointed, digest, released, shipped, text_or_empty
from corpusweave.llm.components import connected_components

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
SEED = 42

PART_BITS = 31
PART_SHIFTS = (0, 31)
COVERING_RADIUS = 1
CODE_BITS = 26
MAP_BITS = 32768  # bits of one bitmap that Spark's bitmap aggregate makes
BLOCK = 4096

_shingle_hash = partial(xxhash.xxh64_intdigest, seed=SEED)
_PART_MASK = np.uint64((1 << PART_BITS) - 1)


def fingerprint(text: str, size: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text, repeats included.

    A bit is set if it is set in over half the hashes. Fewer words than ``size`` make one shingle, no
    words the fingerprint 0.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(size)), strict=False) if len(words) > size else [words]
    n = max(1, len(words) - size + 1)
    hashes = np.fromiter(map(_shingle_hash, map(b" ".join, shingles)), "<u8", n)
    counts = np.zeros(64, np.int64)
    for first in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[first : first + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, size: int = SHINGLE_WORDS, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Columns in ``keep`` and ``fp``, the fingerprint as a signed long; a null text counts as empty."""

    @F.arrow_udf("long")
    def of_texts(column: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(t.as_py() or "", size) for t in column), np.uint64, len(column))
        return pa.array(found.view(np.int64))

    shipped(docs.sparkSession)
    return docs.select(*keep, of_texts(F.col(text)).alias("fp"))


def syndromes(values: np.ndarray) -> np.ndarray:
    """XOR of the places (1 to 31) of the set bits: 0 for words of the code, else the one bit to flip."""
    found = np.zeros(len(values), np.int64)
    for place in range(PART_BITS):
        found ^= np.where((values >> np.uint64(place)) & np.uint64(1), place + 1, 0)
    return found


@lru_cache
def masks_within(reach: int) -> np.ndarray:
    """By syndrome, the bits to flip to come to each anchor within ``reach``, the nearest first.

    All rows are of one length but for padding with the nearest, as the code is perfect.
    """
    found: list[list[int]] = [[] for _ in range(PART_BITS + 1)]
    for weight in range(reach + 1):
        for places in combinations(range(PART_BITS), weight):
            found[reduce(xor, (p + 1 for p in places), 0)].append(sum(1 << p for p in places))
    longest = max(map(len, found))
    return np.array([row + [row[0]] * (longest - len(row)) for row in found], np.uint64)


def part_thresholds(distance: int) -> tuple[int, int]:
    """Bits that may differ in the left or else in the right part; -1 if the left part suffices."""
    return distance // 2, distance - distance // 2 - 1


_DATA_PLACES = [p for p in range(PART_BITS) if (p + 1) & p]  # places that are no power of two


def code_number(words: np.ndarray) -> np.ndarray:
    """0 to 2^26 - 1 for each word of the code: the bits that are free to choose."""
    numbers = np.zeros(len(words), np.int64)
    for i, place in enumerate(_DATA_PLACES):
        numbers |= (((words >> np.uint64(place)) & np.uint64(1)) << np.uint64(i)).astype(np.int64)
    return numbers


def home_anchors(fps: np.ndarray) -> list[np.ndarray]:
    """Per part, the anchor of each fingerprint; numbers of the second part follow those of the first."""
    homes = []
    for part, shift in enumerate(PART_SHIFTS):
        values = (fps.view(np.uint64) >> np.uint64(shift)) & _PART_MASK
        homes.append(code_number(values ^ masks_within(COVERING_RADIUS)[syndromes(values), 0]) + (part << CODE_BITS))
    return homes


def occupied_anchors(fps: DataFrame) -> Broadcast:
    """One bit per anchor at which a fingerprint of the table is at home, as a broadcast byte array."""

    @F.arrow_udf("array<long>")
    def homes(column: pa.Array) -> pa.Array:
        both = np.stack(home_anchors(column.to_numpy(zero_copy_only=False)), axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, both.size + 1, 2), pa.int32()), pa.array(both.ravel()))

    anchor = fps.select(F.explode(homes("fp")).alias("anchor"))
    # Spark counts bitmap positions from 0, and numbers bitmaps from 1 for positions from 1.
    maps = anchor.groupBy(F.bitmap_bucket_number(F.col("anchor") + 1).alias("map")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("anchor") + 1)).alias("bits")
    )
    bits = np.zeros(len(PART_SHIFTS) << (CODE_BITS - 3), np.uint8)
    size = MAP_BITS // 8
    for row in maps.toLocalIterator():  # at most 4,096 bitmaps of 4 KB
        bits[(row["map"] - 1) * size : row["map"] * size] = np.frombuffer(row["bits"], np.uint8)
    return fps.sparkSession.sparkContext.broadcast(bits)


def replicas(fps: DataFrame, occupied: Broadcast, distance: int = MAX_DISTANCE) -> DataFrame:
    """``anchor``, ``fp`` and ``at_home``: each fingerprint at every occupied anchor within its reach."""
    thresholds = part_thresholds(distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = occupied.value
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False)
            for first in range(0, len(whole), 2048):
                fps_here = whole[first : first + 2048]
                for part, (shift, threshold) in enumerate(zip(PART_SHIFTS, thresholds, strict=True)):
                    if threshold < 0:
                        continue
                    values = (fps_here.view(np.uint64) >> np.uint64(shift)) & _PART_MASK
                    masks = masks_within(COVERING_RADIUS + threshold)[syndromes(values)]
                    anchors = code_number((values[:, None] ^ masks).ravel()) + (part << CODE_BITS)
                    at_home = np.zeros(masks.shape, bool)
                    at_home[:, 0] = True
                    met = (bits[anchors >> 3] >> (anchors & 7).astype(np.uint8)) & 1 > 0
                    met &= (at_home | (masks != masks[:, :1])).ravel()
                    columns = [anchors, np.repeat(fps_here, masks.shape[1]), at_home.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(c[met]) for c in columns], ["anchor", "fp", "at_home"])

    return fps.mapInArrow(lambda batches: released(run(batches)), "anchor long, fp long, at_home boolean")


def in_blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows with the pair of blocks they are compared in: one for anchors of up to ``block`` members.

    Of larger anchors, those at home meet all others block by block.
    """
    large = rows.groupBy("anchor").agg(F.count("*").alias("members")).where(F.col("members") > block)
    blocks = F.coalesce(F.ceil(F.col("members") / block), F.lit(1)).cast("int")
    dealt = rows.join(large, "anchor", "left").withColumn("blocks", blocks)
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    # Who is at home visits too, and so is in a row and in a column of the blocks.
    visits = F.transform(others, lambda b: F.struct(b.alias("row"), own.alias("column"), F.lit(False).alias("hosts")))
    hosts = F.transform(others, lambda b: F.struct(own.alias("row"), b.alias("column"), F.lit(True).alias("hosts")))
    is_split = F.col("blocks") > 1
    places = F.when(~F.col("at_home"), visits).when(is_split, F.concat(visits, hosts)).otherwise(hosts)
    return dealt.select("anchor", "fp", F.inline(places))


def group_links(fps: np.ndarray, hosts: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join the members of one anchor as far as those at home link them, without spare ones."""
    if len(fps) < 2 or not hosts.any():
        return []
    values, group, links = fps.view(np.uint64), np.arange(len(fps)), []
    for host in np.flatnonzero(hosts):
        near = np.flatnonzero(np.bitwise_count(values ^ values[host]) <= distance)
        for other in near[np.unique(group[near], return_index=True)[1]]:
            if group[other] != group[host]:
                if fps[other] != fps[host]:
                    links.append((int(fps[host]), int(fps[other])))
                group[group == group[other]] = group[host]
    return links


def anchor_links(rows: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """Links ``(a, b)`` between fingerprints of one anchor and block that differ in few bits."""
    key = ["anchor", "row", "column"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows: a group that the end of a batch cuts waits for the next one."""
        waiting: list[np.ndarray] = [np.zeros(0, np.int64)] * 5
        for batch in [*_marked(batches)]:
            columns = waiting if batch is None else [np.concatenate(c) for c in zip(waiting, batch, strict=True)]
            n = len(columns[0])
            if not n:
                continue
            changes = np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)
            bounds = [0, *(np.flatnonzero(changes) + 1).tolist()] + [n] * (batch is None)
            links = []
            for first, end in zip(bounds, bounds[1:], strict=False):
                links += group_links(columns[3][first:end], columns[4][first:end].astype(bool), distance)
            waiting = [c[bounds[-1] :] for c in columns]
            a, b = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    sorted_rows = rows.repartition(*key).sortWithinPartitions(*key)
    return sorted_rows.select(*key, "fp", "hosts").mapInArrow(lambda batches: released(run(batches)), "a long, b long")


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray] | None]:
    for batch in batches:
        yield [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
    yield None


def link_fingerprints(fps: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """Links ``(a, b)`` that connect whatever distinct values of ``fp`` differ in up to ``distance`` bits.

    Not every pair is given: what is linked through others needs no link of its own.
    """
    if not 0 <= distance <= 2 * (PART_BITS - COVERING_RADIUS):
        raise ValueError(f"distance {distance} is outside 0 to {2 * (PART_BITS - COVERING_RADIUS)}")
    shipped(fps.sparkSession)
    return anchor_links(in_blocks(replicas(fps, occupied_anchors(fps), distance)), distance)


def near_duplicates(
    docs: DataFrame,
    size: int = SHINGLE_WORDS,
    distance: int = MAX_DISTANCE,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """One row per row of ``docs``: ``keep``, ``fp``, ``component_id``, the least id of its group, and
    ``root``, the group's least fingerprint.

    A group is what links of up to ``distance`` differing bits connect; a document without links is a
    group of its own. Null and empty texts have the fingerprint 0 and link like others. Null
    ids are never the least; a group of null ids only has a null ``component_id``.
    """
    rows = checkpointed(fingerprints(docs, size, text, tuple(dict.fromkeys(("doc_id", *keep)))))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    stars = connected_components(link_fingerprints(distinct.select("fp"), distance))
    rooted = distinct.join(stars.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = rooted.select("fp", "root").join(least, "root")
    return rows.join(members, "fp").select(*keep, "fp", "root", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_per_group(
    docs: DataFrame, size: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE, text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the document of the least id.

    Rows that agree in id and text are one document.
    """
    whole = docs.select(
        F.struct(*docs.columns).alias("whole"),
        "doc_id",
        F.col(text).alias("text"),
        digest(text_or_empty(text)).alias("own_digest"),
    )
    groups = near_duplicates(whole, size, distance, "text", keep=("doc_id", "own_digest"))
    id_is_null = F.col("doc_id").isNull().alias("is_null")
    first = groups.groupBy("root").agg(F.min(F.struct(id_is_null, "doc_id", "own_digest")).alias("kept"))
    chosen = first.select(F.col("kept.doc_id").alias("kept_id"), F.col("kept.own_digest").alias("kept_digest"))
    same = F.col("kept_id").eqNullSafe(F.col("doc_id")) & (F.col("kept_digest") == F.col("own_digest"))
    rows = whole.drop("text").join(chosen, same, "left_semi").dropDuplicates(["doc_id", "own_digest"])
    return rows.select(*[F.col(f"whole.`{c}`").alias(c) for c in docs.columns])
