import hashlib
import random

from cases import SCHEMA, empty_table, odd_rows, odd_table, words
from pyspark.sql import functions as F

from corpusweave.llm import ordermin
from corpusweave.llm.ordermin import CHOSEN, KMER_WORDS, LOW, SLOTS, edited_text, fingerprint, likeness, range_number, with_next, written
from corpusweave.llm.queries import op9_order_minhash


def spark_hash(spark, rows):
    """XXH64 as Spark takes it, of lists of values; used to replay the choice of k-mers."""
    return [r[0] for r in spark.createDataFrame(rows, "k array<string>").select(F.xxhash64("k")).collect()]


def plain_signature(hash_of, text):
    """Slots of a text by sorting all its numbered k-mers; ``hash_of`` gives Spark's hashes."""
    ws = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    if not ws:
        return []
    kmers = [tuple(ws[i : i + KMER_WORDS]) for i in range(len(ws) - KMER_WORDS + 1)] if len(ws) > KMER_WORDS else [tuple(ws)]
    seen, elements = {}, []
    for pos, kmer in enumerate(kmers):
        n = seen[kmer] = seen.get(kmer, -1) + 1
        elements.append((hash_of("kmer", kmer, len(ws) > KMER_WORDS) if n == 0 else hash_of("again", hash_of("kmer", kmer, len(ws) > KMER_WORDS), n), pos))
    slots = {}
    for g, pos in sorted(elements):
        own = slots.setdefault(g >> 59, [])
        if len(own) < CHOSEN:
            own.append((pos, g))
    return sorted(((s & 31) << 59 | (hash_of("tuple", tuple(g for _, g in sorted(own))) & LOW)) for s, own in slots.items())


def hasher(spark):
    known = {}

    def hash_of(kind, *args):
        key = (kind, *args)
        if key not in known:
            if kind == "kmer":
                kmer, whole = args
                column = F.xxhash64(*[F.lit(w) for w in kmer]) if whole else F.xxhash64(F.array(*[F.lit(w) for w in kmer]))
            elif kind == "again":
                column = F.xxhash64(F.lit(args[0]).cast("long"), F.lit(args[1]).cast("int"))
            else:
                column = F.xxhash64(F.array(*[F.lit(g).cast("long") for g in args[0]]))
            known[key] = spark.range(1).select(column).first()[0]
        return known[key]

    return hash_of


def unsigned(values):
    return sorted(v & ((1 << 64) - 1) for v in values)


def test_signatures_equal_plain_ones(spark):
    rng = random.Random(6)
    texts = [words(rng, n, "ab") for n in (1, 2, 3, 4, 12)] + ["a a a a a a a", "x y x y x y x y", "", None, "é ñ é ñ é"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    hash_of = hasher(spark)
    for row in fingerprint(docs).collect():
        assert unsigned(row["signature"]) == plain_signature(hash_of, row["text"])


def test_sifting_equals_sorting_all(spark, monkeypatch):
    rng = random.Random(7)
    texts = [words(rng, 4000, "abc"), words(rng, 4000), "same old words " * 1500, words(rng, 2500, "ab") + " z" * 3000]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    sifted = [r["signature"] for r in fingerprint(docs).collect()]
    monkeypatch.setattr(ordermin, "EXPECTED", 10**6)
    assert [r["signature"] for r in fingerprint(docs).collect()] == sifted
    assert len(sifted[0]) == SLOTS


def test_order_and_repeats_count(spark):
    rng = random.Random(8)
    ws = words(rng, 400).split()
    moved = ws[200:] + ws[:200]
    rows = [(" ".join(ws), " ".join(ws)), (" ".join(ws), " ".join(moved)), (" ".join(ws), words(rng, 400)), ("", ""), ("", "a b c")]
    near = likeness(F.col("sa"), F.col("sb"))
    pairs = fingerprint(fingerprint(spark.createDataFrame(rows, "a string, b string"), "a", "sa"), "b", "sb")
    same, shifted, other, empty, half = (r[0] for r in pairs.select(near).collect())
    assert same == 1 and empty == 1 and half == 0 and other == 0
    assert 0.2 < shifted < 0.9  # the same k-mers in another order


def test_likeness_falls_with_edits(spark):
    rng = random.Random(9)
    ws = words(rng, 600).split()
    rows = []
    for share in (0, 20, 60, 200, 600):
        own = list(ws)
        for i in rng.sample(range(600), share):
            own[i] = words(rng, 1)
        rows.append((" ".join(ws), " ".join(own)))
    pairs = fingerprint(fingerprint(spark.createDataFrame(rows, "a string, b string"), "a", "sa"), "b", "sb")
    near = [r[0] for r in pairs.select(likeness(F.col("sa"), F.col("sb"))).collect()]
    assert near == sorted(near, reverse=True) and near[0] == 1 and near[1] > 0.5 and near[-1] < 0.1


def plain_next(rows):
    """(id, text, edited) with each row's next by descending id, ties by the digest of their text."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5((r[1] or "").encode()).digest()))
    found = []
    for r, after in zip(order, order[1:] + order[:1], strict=True):
        text, other = r[1] or "", after[1] or ""
        cut = len(text) // 3
        found.append((r[0], text, text[: len(text) - cut] + other[:cut]))
    return sorted(found, key=str)


def test_next_rows_and_edits_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(ordermin, "ROWS_PER_RANGE", 4)
    for rows in (odd_rows(), odd_rows()[:1], [r for r in odd_rows() if r[0] is None], [r for r in odd_rows() if r[0] is not None]):
        docs = spark.createDataFrame(rows, SCHEMA).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartition(5)
        edited = with_next(docs, ["text"]).select("doc_id", "text", edited_text(F.col("text"), F.col("next_text")))
        assert sorted(map(tuple, edited.collect()), key=str) == plain_next(rows)


def test_ranges_by_halving(spark):
    for bounds in ([5], [1, 5], [1, 5, 9], list(range(0, 100, 3))):
        rows = spark.range(-3, 110).select("id", range_number(F.col("id"), bounds).alias("n"))
        assert all(n == sum(b < i for b in bounds) for i, n in rows.collect())


def test_equal_texts_have_equal_fingerprints(spark):
    rows = fingerprint(odd_table(spark, clashes=True)).select("text", written(F.col("signature"))).collect()
    by_text = {}
    for text, shown in rows:
        assert by_text.setdefault(text or "", shown) == shown
    assert fingerprint(empty_table(spark)).collect() == []


def test_query_on_an_empty_table(spark, tmp_path):
    empty_table(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert op9_order_minhash(spark, str(tmp_path)).collect() == []


def test_plan_is_native(spark, sf_dir):
    plan = op9_order_minhash(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
