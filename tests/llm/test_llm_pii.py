import math
import random
import re

import pytest
from cases import SCHEMA, empty_table, odd_rows, odd_table, words
from pyspark.sql import functions as F

import corpus_pipeline
from corpusweave.llm import pii
from corpusweave.llm.pii import BASE_KINDS, KINDS, MASKS, base_spans, find_private, masked, of_kind, sanitised, term_class, written
from corpusweave.llm.queries import op7_pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in value.split(".")),
        "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 10 <= len(digits) <= 15,
    }[kind]()


def plain_spans(text):
    found = []
    for number, kind in enumerate(BASE_KINDS):
        found += [(m.start(), number, m.end()) for m in re.finditer(PLAIN[kind], text or "") if holds(kind, m.group())]
    return ",".join(f"{BASE_KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


TEXTS = [
    "mail a.b+c@x-y.co.uk, or @x.y a@b a@b.c@d.e.f a@b.c_x@d.e é😀 z@q.de.",
    "ips 1.2.3.4 256.1.1.1 001.002.003.0255 1.2.3.4.5.6.7.8 9.9.9 1..2.3.4 0.0.0.0",
    "cards 4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 378282246310005 6011  000990139424 1 2 3",
    "phones +1 (555) 010-9999 +49 30 1234567 +12 +123456789012345678 ++44 20 7946 0958. +1--------5",
    "4111111111111111@mail.example 10.0.0.1@host.example +4111111111111111",
    "a" * 3000 + "@" + "b." * 2000 + "c " + "1" * 5000 + " " + "1." * 3000 + "+" * 2000 + "1 " * 3000,
    "@" * 500 + "." * 500 + "+1" * 500,
    "",
    None,
]


def test_base_spans_equal_plain_ones(spark):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("0123456789  --..+@()ab%é") for _ in range(rng.randint(5, 120))) for _ in range(600)]
    texts += ["".join(rng.choice(["4111 1111 1111 1111", "10.2.3.4", "a@b.c", "+1 555 010 9999", ".", "-", " ", "@", "5"]) for _ in range(8)) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4)
    found = dict(rows.select("i", written(base_spans(F.coalesce("t", F.lit(""))))).collect())
    for i, text in enumerate(texts):
        assert found[i] == plain_spans(text), text


def corpus():
    """Texts that name a person beside an address, and others that use the same common words."""
    rng = random.Random(5)
    rows = [(i, f"{words(rng, 30)} please write to Zyxelbrandt at zyx.b{i % 1}@corp.example about it {words(rng, 30)} zyxelbrandt again") for i in range(6)]
    rows += [(10 + i, f"{words(rng, 40)} please write about it {words(rng, 20)}") for i in range(40)]
    rows += [(60 + i, f"{words(rng, 20)} host 10.0.0.7 near Mostlyhere {words(rng, 20)}") for i in range(9)]
    rows += [(80, f"{words(rng, 20)} Mostlyhere alone")]
    return [(i, t, "en", "s", len(t)) for i, t in rows]


def test_terms_that_disclose_an_entity(spark):
    rows = {r["doc_id"]: r for r in find_private(spark.createDataFrame(corpus(), SCHEMA), keep=("doc_id", "text")).collect()}
    for i in range(6):
        text = rows[i]["text"]
        terms = {(text[s["start"] : s["end"]].lower(), s["kind"]) for s in rows[i]["spans"] if s["kind"] >= len(BASE_KINDS)}
        assert ("zyxelbrandt", BASE_KINDS.index("phone") + 2) in terms
        assert not {"please", "write", "about"} & {t for t, _ in terms}
        assert sum(s["value"] == "zyxelbrandt" for s in rows[i]["spans"]) == 2  # also outside of the context
        assert [tuple(s) for s in rows[i]["base"]] == [tuple(s) for s in rows[i]["spans"] if s["kind"] < len(BASE_KINDS)]
    told = {s["value"]: s["kind"] for i in range(60, 69) for s in rows[i]["spans"] if s["kind"] >= len(BASE_KINDS)}
    assert told["mostlyhere"] == len(BASE_KINDS)  # generalised: it has one more text elsewhere
    for i in [*range(10, 50), 80]:
        assert rows[i]["spans"] == []


def test_copies_of_one_text_bear_no_estimate(spark):
    rows = [(i, "write to Zyxelbrandt at z@corp.example", "en", "s", 0) for i in range(9)]
    assert all(len(r["spans"]) == 1 for r in find_private(spark.createDataFrame(rows, SCHEMA)).collect())


def test_copies_hide_no_term(spark):
    rng = random.Random(6)
    naming = [f"{words(rng, 9)} write to Zyxelbrandt at z@corp.example" for _ in range(3)]
    others = [f"{words(rng, 20)} write at {i}" for i in range(200)]
    for copies in (1, 2, 30):
        rows = [(i, t, "en", "s", 0) for i, t in enumerate(naming * copies + others)]
        found = [r for r in find_private(spark.createDataFrame(rows, SCHEMA)).collect() if r["base"]]
        assert len(found) == 3 * copies
        assert all(("zyxelbrandt", BASE_KINDS.index("phone") + 2) in {(s["value"], s["kind"]) for s in r["spans"]} for r in found)


def told_in(found):
    return {r["doc_id"]: {(s["value"], KINDS[s["kind"]]) for s in r["spans"] if s["kind"] >= len(BASE_KINDS)} for r in found}


def test_one_text_is_never_enough_and_origins_count(spark):
    rng = random.Random(7)
    far = " ".join(rng.choice(["common", "filler"]) for _ in range(60))
    once = f"Kim has account 77031. {far} write to k@once.example common"
    pooled = [f"{words(rng, 9)} write to p{i}@corp.example in Ostrovar" for i in range(4)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([once, once, *pooled])]
    rows += [(i, f"common filler write to and has account in {words(rng, 9)}", "en", "s", 0) for i in range(6, 200)]
    found = told_in(find_private(spark.createDataFrame(rows, SCHEMA)).collect())
    assert all(found[i] == ({("ostrovar", "remove")} if 2 <= i < 6 else set()) for i in range(200))


def test_a_passage_that_texts_share_tells_of_none_of_its_words(spark):
    rng = random.Random(8)
    passage = " ".join(f"shared{i}" for i in range(30))
    naming = [f"{passage} z@corp.example {words(rng, 5)}" for _ in range(4)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(naming + [words(rng, 30) for _ in range(200)])]
    found = told_in(find_private(spark.createDataFrame(rows, SCHEMA)).collect())
    assert not any(found.values())


def plain_terms(texts):
    """Disclosing terms by text, by plain loops over all pairs of entities and terms."""
    terms, entities = {}, {}
    for t in set(texts):
        base = [(m.start(), k, m.end(), m.group()) for k, kind in enumerate(BASE_KINDS) for m in re.finditer(PLAIN[kind], t) if holds(kind, m.group())]
        clear = "".join(" " if any(a <= i < b for a, _, b, _ in base) else c for i, c in enumerate(t))
        terms[t] = set(re.findall(r"[^\W_]+", t.lower())), set(re.findall(r"[^\W_]+", clear.lower()))
        for _, k, _, value in base:
            value = re.sub("[^0-9]", "", value) if k > 1 else value.lower()
            pool = {0: lambda v: v[v.index("@") :], 1: lambda v: v[: v.rindex(".") + 1]}.get(k, lambda v: v[:6])(value)
            for e in ((k, value), (k, pool)):
                entities.setdefault(e, set()).add(t)
    n, found = len(terms), {t: {} for t in terms}
    for own in {frozenset(v) for v in entities.values()}:
        information, telling = math.log2(n / len(own)), {}
        for term in set().union(*(terms[t][1] for t in own)):
            both, total = frozenset(t for t in own if term in terms[t][1]), sum(term in all_terms for all_terms, _ in terms.values())
            if len(both) < 2 or not information:
                continue
            rate = len(both) / total if len(both) >= 3 else (len(both) + 1) / (total + 2)
            told = information + math.log2(rate)
            if told >= 0.9 * information and len(both) * told >= math.log2(n):
                telling[term] = both, "remove" if told >= information - 1e-9 else "generalise"
        for term, (both, kind) in telling.items():
            if sum(b == both for b, _ in telling.values()) <= 8:
                for t in both:
                    found[t][term] = max(kind, found[t].get(term, ""))
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_added_spans_equal_plain_ones(spark, seed):
    rng = random.Random(seed)
    names = ["Zyx", "Ostrovar", "Q7b", "4455", "Lee"]
    texts = []
    for i in range(300):
        t = words(rng, rng.randint(3, 25), "abcdef")
        if i % 3 == 0:
            k = rng.randrange(5)
            spelled = [f"u{k}@d{k}.example", f"v{rng.randrange(9)}@d{k}.example", f"10.0.{k}.{rng.randrange(3)}", f"+49 30 55{k}00{k}{k}", "4111 1111 1111 1111"]
            value = spelled[rng.randrange(2) if k < 2 else k]
            t += f" {value} {names[k] if rng.random() < 0.9 else ''} end"
        elif rng.random() < 0.01:
            t += f" {rng.choice(names)}"
        texts.append(t)
    texts += [texts[0], texts[3], texts[3]]
    rows = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    found, want = told_in(find_private(rows).collect()), plain_terms(texts)
    assert sum(map(len, want.values())) > 20
    for i, t in enumerate(texts):
        assert found[i] == set(want[t].items()), t


def test_sanitised_texts(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA).withColumn("base", F.lit("clash"))
    clean = sanitised(docs)
    assert clean.columns == docs.columns
    rows = {r["doc_id"]: r for r in clean.collect()}
    assert "[EMAIL]" in rows[0]["text"] and "yxelbrandt" not in rows[0]["text"]
    assert "[IP]" in rows[60]["text"] and "[NAME]" in rows[60]["text"]
    originals = {r[0]: r[1] for r in corpus()}
    assert all(rows[i]["text"] == originals[i] for i in range(10, 50))
    assert all(r["n_chars"] == len(r["text"]) for r in rows.values())


def test_masks_and_overlaps(spark):
    spans = [(0, 0, 3, "x"), (2, 1, 5, "y"), (7, 5, 8, "z")]
    rows = spark.createDataFrame([("abcdefghi", spans), ("abc", [])], "t string, s array<struct<start:int,kind:int,end:int,value:string>>")
    assert [r[0] for r in rows.select(masked(F.col("t"), F.col("s"))).collect()] == [MASKS[0] + "fg" + "i", "abc"]
    assert rows.select(of_kind(F.col("s"), "ip")).first()[0] == 1


def test_classes_of_terms(spark):
    wanted = {"77031": "[NUMBER]", "A7x": "[CODE]", "Élan": "[NAME]", "élan": "[WORD]", "語": "[WORD]"}
    rows = spark.createDataFrame([(t,) for t in wanted], "t string")
    assert dict(rows.select("t", term_class(F.col("t"))).collect()) == wanted


@pytest.mark.parametrize("clashes", [False, True])
def test_odd_rows_stay(spark, clashes):
    docs = odd_table(spark, clashes)
    assert find_private(docs).count() == len(odd_rows())
    assert sorted(map(str, sanitised(docs).select("doc_id", "text").collect())) == sorted(
        map(str, docs.select("doc_id", "text").collect())
    )
    assert find_private(empty_table(spark)).collect() == [] == sanitised(empty_table(spark)).collect()


def test_plan_is_native(spark, sf_dir):
    plan = op7_pii(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_all_terms_of_a_shared_passage_without_a_limit(spark, tmp_path):
    rng = random.Random(8)
    signature = [f"signed{i}" for i in range(12)]
    naming = [f"{words(rng, 5)} {' '.join(signature)} z@corp.example" for _ in range(4)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(naming + [words(rng, 30) for _ in range(200)])]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = told_in(find_private(docs, max_alike=None).collect())
    assert all(found[i] >= {(t, "remove") for t in signature} for i in range(4))
    assert not any(found[i] for i in range(4, 204))
    clean = {r["doc_id"]: r["text"] for r in corpus_pipeline.sanitise(spark, docs, "").collect()}
    assert not any("signed" in clean[i] for i in range(4))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spans = {r["doc_id"]: r["spans"] for r in op7_pii(spark, str(tmp_path)).collect()}
    assert all(spans[i].count("remove") >= 12 for i in range(4))


@pytest.mark.parametrize("most_bits", [1, pii.MAX_COPY_BITS])
def test_distinct_texts_of_odd_rows(spark, monkeypatch, most_bits):
    """Also with a bitmap so small that it takes texts without copies for copied ones."""
    monkeypatch.setattr(pii, "MAX_COPY_BITS", most_bits)
    rng = random.Random(11)
    rows = odd_rows() + [(200 + i, words(rng, 9), "en", "s", 0) for i in range(60)] + [(300, "hot text", "en", "s", 0)] * 25
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    counts = pii.checkpointed(pii.text_counts(docs))
    wanted = {t or "" for _, t, *_ in rows}
    assert counts.count() == len(wanted) and counts.agg(F.sum("rows")).first()[0] == len(rows)
    assert sorted(r["text"] for r in pii.distinct_texts(docs, counts).collect()) == sorted(wanted)
    none = empty_table(spark)
    assert pii.distinct_texts(none, pii.checkpointed(pii.text_counts(none))).collect() == []


def moved_rows(plan):
    """Rows that the shuffles of a plan that ran have written."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return moved_rows(plan.executedPlan())
    if "QueryStage" in name:
        return moved_rows(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
    children = plan.children()
    return own + sum(moved_rows(children.apply(i)) for i in range(children.size()))


def test_texts_without_copies_do_not_move(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, words(rng, 12), "en", "s", 0) for i in range(500)]
    spark.createDataFrame([*rows, rows[0], rows[1]], SCHEMA).repartition(4).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    found = pii.distinct_texts(docs, pii.checkpointed(pii.text_counts(docs)))
    plan = found._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    assert found.count() == 500 and 2 <= moved_rows(plan) <= 50


def test_places_of_terms_are_sought_in_texts_that_hold_one(spark):
    base = [(0, 0, 3, "x")]
    rows = [(bytes([i]), f"x@y {' '.join(f'w{i}n{k}' for k in range(40))} told", base) for i in range(100)]
    protected = spark.createDataFrame(rows, f"text_key binary, text string, base {pii.SPANS}")
    disclosed = spark.createDataFrame([(bytes([7]), "told", 5), (bytes([8]), "w8n0", 4)], "text_key binary, term string, kind int")
    found = pii.term_spans(protected, pii.checkpointed(disclosed))
    plan = found._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    spans = {r["text_key"][0]: [tuple(s) for s in r["added"]] for r in found.collect()}
    text = rows[7][1]
    assert spans == {7: [(len(text) - 4, 5, len(text), "told")], 8: [(4, 4, 8, "w8n0")]}
    assert moved_rows(plan) < 500  # all places of all texts are over 4,000
