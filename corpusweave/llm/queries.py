"""The registered queries of this package and, where SQL can express them, their SQL.

Each query applies its operator to its whole table and derives the digest columns from the
operator's real output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.llm import (
    bpe,
    centroids,
    chat,
    maxent,
    mixing,
    ordermin,
    pii,
    quality,
    simhash,
    suffixes,
    toxicity,
    unigram,
    whitening,
)
from corpusweave.llm.common import crc_fold, documents, text_or_empty

Query = Callable[[SparkSession, str], DataFrame]

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_by_document(mixing.mix_sources(documents(spark, sf_dir))).drop("source", "place")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate_quality(documents(spark, sf_dir)).drop("cleaned")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(toxicity.sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    scored = toxicity.score_toxicity(docs, model)
    held_out = (crc_fold(F.col("doc_id"), toxicity.FOLDS) == 0).alias("held_out")
    return scored.select("doc_id", held_out, "score", "predicted", "n_windows")


def op5_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_texts(documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = bpe.load(spark, public_tokenizers.path(WORD_BPE))
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.encode_bpe(docs, model, decoded="decoded").select(
        "doc_id",
        F.size("input_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("input_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_private(documents(spark, sf_dir), max_alike=None)
    counts = [pii.of_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    base = F.sha2(pii.written(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, pii.written(F.col("spans")).alias("spans"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = unigram.load(spark, public_tokenizers.path(BYTE_BPE))
    return unigram.count_tokens(documents(spark, sf_dir), model)


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", text_or_empty().alias("text"))
    rows = ordermin.with_next(ordermin.fingerprint(docs), ["text", "signature"])
    edited = rows.withColumn("edited", ordermin.edited_text(F.col("text"), F.col("next_text")))
    both = ordermin.fingerprint(edited, "edited", "edited_signature")
    return both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        ordermin.written(F.col("signature")).alias("fingerprint"),
        ordermin.written(F.col("edited_signature")).alias("edited_fingerprint"),
        ordermin.likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        ordermin.likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )


def with_example(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -7, whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    one = conversations.sparkSession.range(1)
    rows = [
        one.select(
            F.lit(-7).cast("long").alias("conv_id"),
            F.lit(turn).cast("long").alias("turn"),
            F.lit(role).alias("role"),
            F.lit(said).alias("text"),
        )
        for turn, role in enumerate(("user", "assistant"))
    ]
    extra = rows[0].unionByName(rows[1])
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_example(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    back = chat.read_back(chat.format_chat(chat.table_turns(rows)))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def as_records(turns: DataFrame) -> DataFrame:
    """Conversations as JSON records of all layouts, dealt by id, with fields that no layout knows."""
    roles = F.array_join(F.transform("turns", lambda t: t["role"]), ",")
    k = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(12))
    has_system = F.element_at("turns", 1)["role"] == "system"
    pair = roles.isin("user,assistant", "system,user,assistant")
    lifted = has_system & (F.size("turns") > 1) & (pair & (k < 5) | (k % 2 == 0))
    rows = turns.select("conv_id", "turns", k.alias("k"), lifted.alias("lifted"), (pair & (k < 5)).alias("flat"))
    rows = rows.withColumn("system", F.when(F.col("lifted"), F.element_at("turns", 1)["text"]))
    rows = rows.withColumn("said", F.when(F.col("lifted"), F.slice("turns", 2, F.size("turns"))).otherwise(F.col("turns")))
    asked, answered = F.get("said", F.lit(0))["text"], F.get("said", F.lit(1))["text"]
    given = F.when(F.col("k") == 4, F.lit(""))
    flat = [("prompt", "completion"), ("prompt", "response"), ("question", "answer"), ("instruction", "output")]
    flat.append(flat[-1])  # with an empty input beside it
    name = F.create_map([x for pair in (("user", "human"), ("assistant", "gpt"), ("system", "system"), ("", "")) for x in map(F.lit, pair)])

    def list_of(field: str, message: Callable[[Column], Column]) -> Column:
        common = [F.col("system"), F.col("conv_id").alias("id"), F.lit("unread").alias("prompt")]
        return F.to_json(F.struct(*common, F.transform("said", message).alias(field)))

    def parts(text: Column) -> Column:
        return F.transform(F.split(text, "\n"), lambda t: F.struct(F.lit("text").alias("type"), t.alias("text")))

    record = F.when(
        F.col("k") % 3 == 0,
        list_of("conversations", lambda t: F.struct(name[t["role"]].alias("from"), t["text"].alias("value"))),
    ).when(F.col("k") % 3 == 1, list_of("messages", lambda t: F.struct(t["role"], t["text"].alias("content"))))
    record = record.otherwise(list_of("messages", lambda t: F.struct(t["role"], parts(t["text"]).alias("content"))))
    for i, (question, answer) in enumerate(flat):
        fields = [F.col("system"), given.alias("input"), asked.alias(question), answered.alias(answer), F.lit(i).alias("id")]
        record = F.when(F.col("flat") & (F.col("k") == i), F.to_json(F.struct(*fields))).otherwise(record)
    return rows.select("conv_id", record.alias("record"))


def chat_json_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, written as a JSON record of one of the layouts, and read back by the hash of its paths."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = chat.json_turns(as_records(chat.table_turns(rows)))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    sha = F.sha2(F.array_join(said, ""), 256).alias("turns_sha256")
    return found.select("conv_id", "layout", F.size("turns").cast("long").alias("n_turns"), sha)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(embeddings(spark, sf_dir))
    return rows.select(
        "vec_id",
        "n",
        F.col("deviation").cast("long").alias("deviation"),
        "identity_error",
        F.inline(
            F.transform(
                F.arrays_zip("whitened", "explained"),
                lambda both, i: F.struct((i + 1).alias("component"), both["whitened"].alias("whitened"), both["explained"].alias("explained")),
            )
        ),
    ).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster_vectors(embeddings(spark, sf_dir))
    written = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return found.withColumn("centroid_sha256", F.sha2(written, 256)).drop("centroid")


QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_mixing": op2_mixing,
    "op3_quality_rules": op3_quality_rules,
    "op4_toxicity": op4_toxicity,
    "op5_maxent": op5_maxent,
    "op6_bpe": op6_bpe,
    "op7_pii": op7_pii,
    "op8_token_counts": op8_token_counts,
    "op9_order_minhash": op9_order_minhash,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_whitening": op11_whitening,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_centroids": op13_centroids,
    "chat_json_layouts": chat_json_layouts,
}
