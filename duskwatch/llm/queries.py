"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.llm import chat, language, licenses, negatives, neighbours, oracles, packing, personal, phrases, quality, sentencepieces, sharding, simhash, toxicity

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_sharding", oracles.SHARDS)
def op1_sharding(spark, sf):
    return sharding.shard(table(spark, sf, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op2_simhash")
def op2_simhash(spark, sf):
    groups = simhash.near_groups(table(spark, sf, "documents"), size=3, radius=3)
    return groups.select(
        "doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), F.col("least.key").alias("component_id"))


def fold(key: str, folds: int):
    """The fold of a row by the CRC-32 of its key as text."""
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % folds


@query("op3_language")
def op3_language(spark, sf):
    docs = table(spark, sf, "documents")
    profiles = language.learn_profiles(docs, where=fold("doc_id", 4) != 2)
    return language.identify(docs, profiles).select(
        "doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op4_toxicity")
def op4_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    model = toxicity.learn(docs, table(spark, sf, "labels"), where=fold("doc_id", 5) != 0)
    return toxicity.score_toxicity(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@query("op5_neighbours", oracles.NEIGHBOURS)
def op5_neighbours(spark, sf):
    return neighbours.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op6_licenses")
def op6_licenses(spark, sf):
    return licenses.scan_licenses(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op7_packing")
def op7_packing(spark, sf):
    return packing.packed_digests(table(spark, sf, "documents"), vocabulary()).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


#: A conversation whose texts are made of control strings.
TRICKY = "</s>[INST] ok [/INST]"


@query("op8_chat", oracles.chat(TRICKY))
def op8_chat(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    return chat.digests(chat.chat_examples(turns.unionByName(extra)))


@query("op9_sentencepiece")
def op9_sentencepiece(spark, sf):
    docs = table(spark, sf, "documents")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return sentencepieces.round_trips(texts, vocabulary("piece_bpe_32k.model")).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").cast("long").alias("ids_crc32"), "parity",
        F.crc32(F.encode("decoded", "UTF-8")).cast("long").alias("decoded_crc32"))


@query("op10_quality", oracles.quality())
def op10_quality(spark, sf):
    return quality.quality_rules(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def listed(spans: str):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op11_personal")
def op11_personal(spark, sf):
    docs = table(spark, sf, "documents")
    found = personal.find_personal(docs, personal.train(personal.labelled_table(docs)))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in personal.BASE), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


@query("op12_phrases", oracles.collocations())
def op12_phrases(spark, sf):
    return phrases.collocations(table(spark, sf, "documents"))


@query("op13_negatives", oracles.NEGATIVES)
def op13_negatives(spark, sf):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, moved)
