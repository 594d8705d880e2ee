"""Personal data in texts, and terms that give it away, in functions of Spark only.

Base spans are e-mail addresses, IP addresses, card and phone numbers, found by pattern and checked.
What they hold are the protected entities. Terms that stand in a text with an entity can disclose it even
where the entity itself is masked; how much is estimated from the corpus: with ``n`` texts, the
information of entity ``c`` is ``IC(c) = log2(n / n(c))``, and what term ``t`` tells of it is
``PMI(c, t) = log2(n * n(c, t) / (n(c) * n(t)))``. ``n(c, t)`` counts the texts that hold both, ``n(t)`` those
that hold ``t``; a term is a run of letters, marks and digits of any length. All four count distinct texts, so
copies of a text change nothing. In the texts of an entity, a term with ``PMI >= GENERALISE * IC`` is
generalised, one with ``PMI >= REMOVE * IC`` removed. Besides the entity itself its origin counts as one: the domain
of an address, the network of an IP address, the issuer of a card, the area of a phone number.

One text is no evidence: a term tells only if at least ``MIN_TEXTS`` texts hold it beside the entity, and if so many would not
meet by chance, ``n(c, t) * PMI >= log2(n)``. Below ``MIN_SUPPORT`` texts ``n(c, t) / n(t)`` is smoothed to
``(n(c, t) + 1) / (n(t) + 2)``: such a term may be generalised, never removed. Callers may ask that a term stand
out: where over ``max_alike`` terms tell of an entity through the very same texts, these share a passage, and none of the
terms is named by it. Without a limit, as in the query and the pipeline, all terms that disclose count, such as those of a signature.
A generalised term gives way to its class: a number, a code, a name or a word.

Plan: patterns run beside the scan. Texts with base spans move once, one per distinct text, and those that hold a
disclosing term once more. For the counts of terms only texts that may have copies move, to meet these: digests are counted first, and
a bitmap of those that occur again, of 16 MB at most, tells beside the scan. Entities that are in the same texts
are counted as one group, so a text of many entities does not pair each of them with each of its terms; groups of fewer than
``MIN_TEXTS`` texts are paired with none. Terms too common to reach ``GENERALISE`` beside any entity (a bound from the counts, so none
is lost) leave before they are paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusweave.llm.arrays import let, running_starts
from corpusweave.llm.common import checkpointed, digest, text_or_empty
from corpusweave.operators.bitmaps import id_bitmaps, with_membership

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "generalise", "remove")
MASKS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[WORD]", "")
BLANKS = (" ",) * len(MASKS)
SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"

MIN_TEXTS = 2
MIN_SUPPORT = 3
MAX_ALIKE = 8
GENERALISE = 0.9
REMOVE = 1.0
TERM = "[\\p{L}\\p{M}\\p{N}]+"
# Bits for each text that has copies in the bitmap of these, as powers of two, and of the largest bitmap: 16 MB. With more such
# texts than it has room for, more texts that have no copies move beside them.
COPY_BITS = 6
MAX_COPY_BITS = 27

# The given patterns, written so that a run of characters is tried once from its start: possessive
# where what follows cannot be part of the run, and not from the middle of one, except where the match before ended.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\\.{_LABEL}++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "(?:\\G|(?<![0-9]))[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
# What a text must hold for the pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def passes_luhn(digits: Column) -> Column:
    def weighted(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(F.transform(places, weighted), F.lit(0), lambda a, x: a + x) % 10 == 0


def holds(kind: str, found: Column) -> Column:
    """Whether a match of the kind's pattern is one."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return found.rlike(f"^{_BYTE}(?:\\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when(n.between(14, 19), let(digits, passes_luhn)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def entity(kind: str, found: Column) -> Column:
    """The value that spellings of one entity share."""
    return F.regexp_replace(found, "[^0-9]", "") if kind in ("card", "phone") else F.lower(found)


def origin(kind: Column, value: Column) -> Column:
    """What entities of one origin share, which is no entity's own value."""
    return (
        F.when(kind == 0, F.regexp_extract(value, "@.*$", 0))
        .when(kind == 1, F.regexp_extract(value, "^[0-9]+\\.[0-9]+\\.[0-9]+\\.", 0))
        .otherwise(F.substring(value, 1, 6))
    )


def matches(text: Column, pattern: str) -> Column:
    """``(start, end, value)`` of all matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(values: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(values))
        steps = F.zip_with(
            gaps, values, lambda g, v: F.struct((F.length(g) + F.length(v)).alias("step"), v.alias("value"))
        )

        def with_starts(s: Column) -> Column:
            before = running_starts(F.transform(s, lambda x: x["step"]))

            def span(x: Column, b: Column) -> Column:
                end = (b + x["step"]).cast("int")
                start = end - F.length(x["value"])
                return F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))

            return F.zip_with(s, before, span)

        return F.when(F.size(values) > 0, let(steps, with_starts)).otherwise(
            F.array().cast("array<struct<start:int,end:int,value:string>>")
        )

    return let(found, placed)


def base_spans(text: Column) -> Column:
    """All base spans, by start, then kind; ``kind`` is a place in ``KINDS``."""

    def of_kind(number: int, kind: str) -> Column:
        def own(m: Column) -> Column:
            return F.struct(
                m["start"].alias("start"),
                F.lit(number).alias("kind"),
                m["end"].alias("end"),
                entity(kind, m["value"]).alias("value"),
            )

        spans = F.transform(F.filter(matches(text, PATTERNS[kind]), lambda m: holds(kind, m["value"])), own).cast(SPANS)
        none = F.array().cast(SPANS)
        needed = text.contains(NEEDS[kind]) if NEEDS[kind] else text.rlike("[0-9]")
        return F.when(needed, spans).otherwise(none)

    return F.array_sort(F.concat(*[of_kind(i, k) for i, k in enumerate(BASE_KINDS)]))


def terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def found_in(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``text_key``, a digest of the text, and ``base``, its base spans; null counts as empty."""
    own = text_or_empty(text)
    return docs.select(*keep, digest(own).alias("text_key"), base_spans(own).alias("base"))


def protected_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``text_key``, ``text`` and ``base`` of each distinct text that has base spans."""
    rows = docs.select(text_or_empty(text).alias("text")).withColumn("base", base_spans(F.col("text")))
    with_spans = rows.where(F.size("base") > 0).withColumn("text_key", digest(F.col("text")))
    return with_spans.groupBy("text_key").agg(F.first("text").alias("text"), F.first("base").alias("base"))


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``text_key`` and ``rows``, their number, of each distinct text; null counts as empty."""
    return docs.select(digest(text_or_empty(text)).alias("text_key")).groupBy("text_key").agg(F.count("*").alias("rows"))


def distinct_texts(docs: DataFrame, counts: DataFrame, text: str = "text") -> DataFrame:
    """``text`` of each distinct text; null counts as empty.

    ``counts`` are the ``text_counts``, stored. A text whose digest is not in the bitmap of copied ones is alone and stays where it is read.
    """
    copied = counts.where("rows > 1").select("text_key")
    bits = min(MAX_COPY_BITS, copied.count().bit_length() + COPY_BITS)

    def mark(key: Column) -> Column:
        return F.xxhash64(key).bitwiseAND((1 << bits) - 1)

    marks = checkpointed(id_bitmaps(copied.select(mark(F.col("text_key")).alias("id"))))
    rows = docs.select(text_or_empty(text).alias("text")).withColumn("text_key", digest(F.col("text")))
    marked = with_membership(rows.withColumn("mark", mark(F.col("text_key"))), marks, "mark", "copied")
    met = marked.where("copied").groupBy("text_key").agg(F.first("text").alias("text"))
    return marked.where("not copied").select("text").unionByName(met.select("text"))


def disclosures(
    protected: DataFrame, docs: DataFrame, text: str = "text", max_alike: int | None = MAX_ALIKE
) -> DataFrame:
    """``text_key``, ``term`` and ``kind``: the terms of each protected text that disclose an entity of it.

    Without ``max_alike`` these are all of them, else those that no more than so many tell through the same texts.
    """
    named = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value")))
    origins = F.transform(
        "base", lambda s: F.struct(s["kind"].alias("kind"), origin(s["kind"], s["value"]).alias("value"))
    )
    of_texts = protected.select("text_key", F.explode(F.array_distinct(F.concat(named, origins))).alias("entity"))
    # Entities in the same texts have the same counts: one group stands for them, known by two hashes over the texts.
    hashes = [F.bit_xor(F.xxhash64("text_key")).alias("one"), F.bit_xor(F.xxhash64("text_key", F.lit(1))).alias("two")]
    per_entity = of_texts.groupBy("entity").agg(F.count("*").alias("n_entity"), *hashes)
    group = F.struct("n_entity", "one", "two").alias("entities")
    groups = of_texts.join(per_entity.where(F.col("n_entity") >= MIN_TEXTS), "entity").select("text_key", group).distinct()
    groups = checkpointed(groups)
    counts = checkpointed(text_counts(docs, text))
    n = counts.count()
    most = groups.agg(F.max("entities.n_entity")).first()[0] or 0

    def bound(n_entity: Column) -> Column:
        """No term in more texts than this reaches GENERALISE, as n_both is n_entity at most; grows with n_entity."""
        return (n_entity + 1) * F.pow(F.lit(float(max(n, 1))) / n_entity, 1 - GENERALISE) + 1

    per_term = (
        distinct_texts(docs, counts, text)
        .select(F.explode(terms(F.col("text"))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("n_term"))
        .where((F.col("n_term") >= MIN_TEXTS) & (F.col("n_term") <= bound(F.lit(max(most, 1)))))
    )
    outside = masked(F.col("text"), F.col("base"), BLANKS)
    held = protected.select("text_key", F.explode(terms(outside)).alias("term"))
    rare = held.join(per_term.hint("merge"), "term").join(groups, "text_key")
    together = checkpointed(rare.where(F.col("n_term") <= bound(F.col("entities.n_entity"))))
    places = [F.count("*").alias("n_both"), F.bit_xor(F.xxhash64("text_key")).alias("texts")]
    per_pair = together.groupBy("entities", "term", "n_term").agg(*places).where(F.col("n_both") >= MIN_TEXTS)
    information = F.log2(F.lit(float(max(n, 1))) / F.col("entities.n_entity"))
    counted = F.col("n_both") / F.col("n_term")
    smoothed = (F.col("n_both") + 1) / (F.col("n_term") + 2)
    told = information + F.log2(F.when(F.col("n_both") >= MIN_SUPPORT, counted).otherwise(smoothed))
    share = F.when(information > 0, told / information)
    beyond_chance = F.col("n_both") * told >= F.log2(F.lit(float(max(n, 1))))
    # A hair's breadth below, as both logarithms are rounded.
    kind = F.when(share >= REMOVE - 1e-9, KINDS.index("remove")).when(share >= GENERALISE, KINDS.index("generalise"))
    telling = per_pair.where(beyond_chance).select("entities", "term", "texts", kind.alias("kind")).where("kind is not null")
    if max_alike is not None:
        # At most the terms of one text are alike, as all of them are in the same ones.
        alike = F.count("*").over(W.partitionBy("entities", "texts"))
        telling = telling.withColumn("n_alike", alike).where(F.col("n_alike") <= max_alike).drop("n_alike")
    together = together.drop("n_term")
    return together.join(telling.drop("texts"), ["entities", "term"]).groupBy("text_key", "term").agg(F.max("kind").alias("kind"))


def term_spans(protected: DataFrame, disclosed: DataFrame) -> DataFrame:
    """``text_key`` and ``added``, the spans of disclosing terms outside of base spans."""
    holding = protected.join(disclosed.select("text_key").distinct(), "text_key", "left_semi")
    places = holding.select("text_key", F.inline(matches(F.col("text"), TERM)))
    told = places.select("text_key", "start", "end", F.lower("value").alias("term")).join(disclosed, ["text_key", "term"])
    span = F.struct("start", "kind", "end", F.col("term").alias("value"))
    per_text = told.groupBy("text_key").agg(F.array_sort(F.collect_list(span)).cast(SPANS).alias("told"))

    def free(s: Column) -> Column:
        return ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))

    bases = protected.select("text_key", "base")
    return bases.join(per_text, "text_key").select("text_key", F.filter("told", free).alias("added"))


def find_private(
    docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), max_alike: int | None = MAX_ALIKE
) -> DataFrame:
    """``keep``, ``base`` and ``spans``: base spans, and all spans with those of disclosing terms.

    One row per row; a null text counts as empty and has none; repeated rows get equal spans. Where no
    term tells enough, as in a corpus whose entities are all in one text, or an entity is in every distinct text, no term is added. ``keep`` may name any
    columns but ``text_key``, ``base``, ``added`` and ``spans``, which are replaced.
    """
    kept = tuple(c for c in keep if c not in ("text_key", "base", "added", "spans"))
    protected = checkpointed(protected_texts(docs, text))
    # Few rows, and stored, so that a hot text's share of the join can be split at run time.
    disclosed = checkpointed(disclosures(protected, docs, text, max_alike))
    more = checkpointed(term_spans(protected, disclosed))
    rows = found_in(docs, text, kept)
    # Texts without base spans meet nothing: copies of one are dealt out by their rows, under keys no digest has.
    spread = F.xxhash64(*kept, "text_key").cast("string").cast("binary") if kept else F.col("text_key")
    key = F.when(F.size("base") > 0, F.col("text_key")).otherwise(spread)
    keyed = more.withColumnRenamed("text_key", "added_key")
    rows = rows.withColumn("text_key", key).join(keyed, F.col("text_key") == F.col("added_key"), "left")
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))
    return rows.select(*kept, "base", spans.alias("spans"))


def of_kind(spans: Column, kind: str) -> Column:
    """How many spans are of the kind."""
    number = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def one(s: Column) -> Column:
        return F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))

    return F.array_join(F.transform(spans, one), ",")


def term_class(term: Column) -> Column:
    """What a generalised term gives way to."""
    return (
        F.when(term.rlike("^\\p{N}+$"), "[NUMBER]")
        .when(term.rlike("\\p{N}"), "[CODE]")
        .when(term.rlike("^[\\p{Lu}\\p{Lt}]"), "[NAME]")
        .otherwise(MASKS[KINDS.index("generalise")])
    )


def masked(text: Column, spans: Column, with_masks: tuple[str, ...] = MASKS) -> Column:
    """The text with each span replaced by the mask of its kind, terms to generalise by that of their class.

    The mask of the first of overlapping spans stands for all.
    """
    masks = F.array(*[F.lit(m) for m in with_masks])

    def mask(s: Column) -> Column:
        term = F.substr(text, s["start"] + 1, s["end"] - s["start"])
        return F.when(s["kind"] == KINDS.index("generalise"), term_class(term)).otherwise(F.get(masks, s["kind"]))

    zero = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("upto"))

    def add(a: Column, s: Column) -> Column:
        between = F.substr(text, a["upto"] + 1, s["start"] - a["upto"])
        parts = F.concat(a["parts"], F.array(between, mask(s)))
        longer = F.when(s["start"] >= a["upto"], parts).otherwise(a["parts"])
        return F.struct(longer.alias("parts"), F.greatest(a["upto"], s["end"]).alias("upto"))

    def whole(a: Column) -> Column:
        return F.concat(F.array_join(a["parts"], ""), F.substr(text, a["upto"] + 1))

    return F.when(F.size(spans) > 0, F.aggregate(spans, zero, add, whole)).otherwise(text)


def sanitised(docs: DataFrame, text: str = "text", max_alike: int | None = MAX_ALIKE) -> DataFrame:
    """``docs`` with base spans masked and disclosing terms generalised or removed; ``n_chars``, if there, anew."""
    whole = docs.select(F.struct(*docs.columns).alias("whole"), F.col(text).alias("own_text"))
    rows = find_private(whole, "own_text", ("whole",), max_alike)
    own = F.col(f"whole.`{text}`")
    clean = F.when(own.isNotNull(), masked(own.cast("string"), F.col("spans")))
    columns = {c: F.col(f"whole.`{c}`") for c in docs.columns} | {text: clean}
    if "n_chars" in columns:
        columns["n_chars"] = F.length(columns[text]).cast("long")
    return rows.select(*[value.alias(name) for name, value in columns.items()])
