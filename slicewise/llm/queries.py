"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewise.llm import (align, bpe, brown, caps, chat, divergence, exact_dedup, jaccard, mixing, quality_rules, rlz,
                           suffix, url_filter)
from slicewise.llm.common import prepare, table
from slicewise.llm.oracles import ORACLES as LLM_ORACLES


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return brown.score_held_out(table(spark, sf_dir, "documents"))


def op2_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return rlz.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary_path(), digest=True)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", "kept")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.tracking_hosts(pages))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    d = mixing.with_copies(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "source_size", "target",
                    (F.col("copies") * F.col("size")).alias("taken"))


# the made-up conversation whose texts hold the template's own control strings
CONTROL_CONVERSATION = ((-7, 0, "user", "\\### Assistant: </turn> ok"),
                        (-7, 1, "assistant", "\\### Assistant: </turn> ok"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    cols = "conv_id long, turn long, role string, text string"
    conv = (table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
            .unionByName(spark.createDataFrame(list(CONTROL_CONVERSATION), cols)))
    f = chat.format_paths(chat.from_turns(conv))
    f = f.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", F.concat_ws("", chat.masked_texts(F.col("formatted"), F.col("loss_from"), F.col("loss_to"))))
    text = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return f.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
                    F.sha2(text, 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"),
                    F.sha2(F.col("loss"), 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars"))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    prepare(spark)
    return align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                       public_tokenizers.path("piece_bpe_32k.model"))


def op12_cap_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return caps.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return divergence.divergence(table(spark, sf_dir, "documents"))


LLM_QUERIES = {
    "op1_brown_lm": op1_brown_lm,
    "op2_rlz_dedup": op2_rlz_dedup,
    "op3_bpe": op3_bpe,
    "op4_quality_rules": op4_quality_rules,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_mixing": op9_mixing,
    "op10_chat": op10_chat,
    "op11_align": op11_align,
    "op12_cap_dedup": op12_cap_dedup,
    "op13_divergence": op13_divergence,
}
LLM_ORACLES = {k: v for k, v in LLM_ORACLES.items() if k in LLM_QUERIES}
