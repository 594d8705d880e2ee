import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from cases import SCHEMA, empty_table, odd_rows, odd_table, words
from pyspark.sql import functions as F

from corpusweave.llm import simhash
from corpusweave.llm.components import connected_components
from corpusweave.llm.simhash import (
    code_number,
    fingerprint,
    hex_digits,
    home_anchors,
    in_blocks,
    link_fingerprints,
    masks_within,
    near_duplicates,
    one_per_group,
    occupied_anchors,
    replicas,
    syndromes,
)


def plain_fingerprint(text):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    shingles = [b" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_groups(values, distance=4):
    """Least member of the component of each distinct value, by comparing all pairs."""
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    distinct = sorted(root)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {v: find(v) for v in distinct}


def near_copies(rng, n):
    """Copies of one text, each with a few words changed."""
    base = words(rng, 160).split()
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = words(rng, 1)
        yield " ".join(own)


@pytest.mark.parametrize("text", [t for _, t, *_ in odd_rows()][::3] + [None, "", "a b", "A B", "a b c d", "a b c d a b c d"])
def test_fingerprint_equals_plain_one(text):
    assert fingerprint(text or "") == plain_fingerprint(text)


def test_groups_equal_all_pairs(spark):
    rng = random.Random(2)
    rows = odd_rows() + [(200 + i, t, "en", "s", 0) for i, t in enumerate(near_copies(rng, 60))]
    found = near_duplicates(spark.createDataFrame(rows, SCHEMA).withColumn("fp", F.lit("clash")))
    got = Counter(tuple(r) for r in found.select("doc_id", hex_digits(F.col("fp")), "component_id").collect())
    fps = [plain_fingerprint(r[1]) for r in rows]
    groups = plain_groups(fps)
    least = {}
    for r, fp in zip(rows, fps, strict=True):
        if r[0] is not None:
            least[groups[fp]] = min(least.get(groups[fp], r[0]), r[0])
    assert got == Counter((r[0], f"{fp:016x}", least.get(groups[fp])) for r, fp in zip(rows, fps, strict=True))
    assert max(Counter(c for _, _, c in got).values()) > 5


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4, 5])
def test_links_connect_all_close_values(spark, distance):
    rng = random.Random(distance)
    values = {rng.getrandbits(64) for _ in range(150)}
    for v in list(values)[:80]:
        for n in (1, distance, distance + 1):
            flipped = v
            for bit in rng.sample(range(64), n):
                flipped ^= 1 << bit
            values.add(flipped)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = link_fingerprints(spark.createDataFrame(signed, "fp long"), distance).collect()
    mask = (1 << 64) - 1
    assert all((int(r["a"] & mask) ^ int(r["b"] & mask)).bit_count() <= distance for r in links)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for r in links:
        low, high = sorted((find(r["a"] & mask), find(r["b"] & mask)))
        root[high] = low
    assert {v: find(v) for v in values} == plain_groups(values, distance)


def test_blocks_of_a_full_anchor_lose_no_link(spark, monkeypatch):
    rng = random.Random(9)
    centre = rng.getrandbits(62)
    values = {centre ^ sum(1 << b for b in rng.sample(range(62), rng.randint(0, 3))) for _ in range(400)}
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    placed = replicas(fps, occupied_anchors(fps))
    links = simhash.anchor_links(in_blocks(placed, block=16), 4)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for r in links.collect():
        low, high = sorted((find(r["a"]), find(r["b"])))
        root[high] = low
    assert {v: find(v) for v in values} == plain_groups(values)


def test_dense_anchors_give_few_links():
    fps = np.arange(64, dtype=np.int64)
    hosts = np.ones(64, bool)
    assert len(simhash.group_links(fps, hosts, 6)) == 63


def test_the_code_is_perfect():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 31, 2000).astype(np.uint64)
    homes = values ^ masks_within(1)[syndromes(values), 0]
    assert (syndromes(homes) == 0).all()
    assert (np.bitwise_count(values ^ homes) <= 1).all()
    assert len(set(code_number(homes).tolist())) == len(set(homes.tolist()))
    assert masks_within(3).shape == (32, 156)
    assert masks_within(2).shape == (32, 16)
    assert all(h.max() < 2 << 26 for h in home_anchors(values.view(np.int64)))


def test_empty_tables_and_wrong_distances(spark):
    assert near_duplicates(empty_table(spark)).collect() == []
    assert one_per_group(empty_table(spark)).collect() == []
    with pytest.raises(ValueError, match="distance"):
        link_fingerprints(spark.createDataFrame([(1,)], "fp long"), -1)


def test_one_row_of_each_group_stays(spark):
    docs = odd_table(spark, clashes=True)
    kept = one_per_group(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    groups = plain_groups([plain_fingerprint(r[1]) for r in odd_rows()])
    assert Counter(groups[plain_fingerprint(r["text"])] for r in rows) == Counter(set(groups.values()))
    for r in rows:
        own = [o[0] for o in odd_rows() if groups[plain_fingerprint(o[1])] == groups[plain_fingerprint(r["text"])] and o[0] is not None]
        assert r["doc_id"] == min(own, default=None)


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (500, 501), (501, 500), (None, 3)]
    links += [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(90)]
    rng.shuffle(links)
    found = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    root = {}

    def find(v):
        root.setdefault(v, v)
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        if a is not None:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    assert found == {v: find(v) for v in root if find(v) != v}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
